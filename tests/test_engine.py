"""The script language, codecs, strokes and operators without SQL, against plain Python and worked numbers."""

import base64
import math

import numpy as np
import pandas as pd
import pytest

from mosaiq.functions import adjust
from mosaiq.operators import geometry, regions, selections, stroke
from mosaiq.plans import script
from mosaiq.plans.document import ScriptError
from mosaiq.sources import png

GRADIENT = {"op": "add_layer", "id": "k", "fill": "gradient", "from": "#2040C0FF", "to": "#F0C02080"}


def image(spark, ops, w=24, h=16, bg="#00000000"):
    df = script.pixels(spark, {"canvas": {"w": w, "h": h, "bg": bg}, "ops": ops, "out": "png8"}).toPandas()
    out = np.zeros((df.y.max() + 1, df.x.max() + 1, 4), dtype=np.int64)
    out[df.y, df.x] = df[["r", "g", "b", "a"]].to_numpy()
    return out


@pytest.mark.parametrize(
    "text",
    [
        '{"canvas":{"w":4,"h":4},"ops":[],"out":"jpg"}',
        '{"canvas":{"w":4,"h":4,"h":5},"ops":[],"out":"png8"}',
        '{"canvas":{"w":0,"h":4},"ops":[],"out":"png8"}',
        '{"canvas":{"w":4.0,"h":4},"ops":[],"out":"png8"}',
        '{"canvas":{"w":4,"h":4},"ops":[{"op":"nothing"}],"out":"png8"}',
        '{"canvas":{"w":4,"h":4},"ops":[{"op":"add_layer","id":"a","colour":1}],"out":"png8"}',
        '{"canvas":{"w":4,"h":4},"ops":[{"op":"add_layer","id":"root"}],"out":"png8"}',
        '{"canvas":{"w":4,"h":4},"ops":[{"op":"add_layer","id":"a"},{"op":"set_opacity","layer":"a","value":1.5}],"out":"png8"}',
        '{"canvas":{"w":4,"h":4},"ops":[{"op":"add_layer","id":"a"},{"op":"set_opacity","layer":"a","value":NaN}],"out":"png8"}',
        '{"canvas":{"w":4,"h":4},"ops":[{"op":"add_layer","id":"a"},{"op":"set_visible","layer":"a","value":1}],"out":"png8"}',
        '{"canvas":{"w":4,"h":4},"ops":[{"op":"add_layer","id":"a"},{"op":"transform","layer":"a","matrix":[1,0,0,2,0,0,0,0,1]}],"out":"png8"}',
        '{"canvas":{"w":4,"h":4},"ops":[{"op":"add_layer","id":"a"},{"op":"layer_via_copy","id":"b","layer":"a"}],"out":"png8"}',
        '{"canvas":{"w":4,"h":4},"ops":[{"op":"add_adjustment","id":"a","type":"levels","params":{"rgb":{"in_black":9,"in_white":9}}}],"out":"png8"}',
        '{"canvas":{"w":4,"h":4},"ops":[{"op":"undo","steps":2}],"out":"png8"}',
        '{"canvas":{"w":4,"h":4},"ops":[{"op":"add_layer","id":"a"},{"op":"merge_down","layer":"a"}],"out":"png8"}',
    ],
)
def test_bad_scripts(spark, text):
    with pytest.raises(ScriptError):
        script.run(spark, text)


def test_structure(spark):
    ops = [GRADIENT, {"op": "add_group", "id": "g"}, {"op": "add_layer", "id": "a", "parent": "g"}, {"op": "duplicate_layer", "layer": "g", "id": "h"}, {"op": "set_name", "layer": "h", "name": "é"}, {"op": "move_layer", "id": "h", "index": 0}, {"op": "delete_layer", "layer": "g"}]
    s = script.run(spark, {"canvas": {"w": 4, "h": 4}, "ops": ops, "out": "png8"}).state
    assert [n.id for n in s.root.walk()] == ["h", "h/a", "k"] and s.find("h").name == "é"


def test_failed_op_changes_nothing(spark):
    doc = script.run(spark, {"canvas": {"w": 4, "h": 4}, "ops": [GRADIENT], "out": "png8"})
    before = doc.state
    with pytest.raises(ScriptError):
        script.apply(spark, doc, {"op": "set_fill", "layer": "k", "value": 2})
    assert doc.state is before and len(doc.past) == 1
    doc.undo()
    doc.redo()
    assert doc.state is before


def test_identities(spark):
    plain = image(spark, [GRADIENT])
    for ops in (
        [{"op": "transform", "layer": "k", "translate": [0, 0]}],
        [{"op": "flip", "axis": "h"}, {"op": "flip", "axis": "h", "layer": "k"}],
        [{"op": "rotate_canvas", "angle": 90}, {"op": "rotate_canvas", "angle": 270}],
        [{"op": "canvas_size", "w": 31, "h": 21}, {"op": "crop", "x": 3, "y": 2, "w": 24, "h": 16}],
        [{"op": "filter_gaussian_blur", "layer": "k", "radius": 0.5}],
        [{"op": "add_adjustment", "id": "j", "type": "hue_saturation"}],
        [{"op": "add_adjustment", "id": "j", "type": "curves"}],
        [{"op": "select_all"}, {"op": "feather", "radius": 8}, {"op": "contract", "by": 3}, {"op": "deselect"}, {"op": "reselect"}],
        [{"op": "select_rect", "x": 1, "y": 1, "w": 9, "h": 9}, {"op": "filter_offset", "layer": "k", "dx": 3, "coverage": {"src": "rect", "x": 0, "y": 0, "w": 0, "h": 0}}],
        [{"op": "lock_transparency", "layer": "k"}, {"op": "clear", "layer": "k"}],
    ):
        assert (image(spark, [GRADIENT, *ops]) == plain).all(), ops


def keys(d):
    x = abs(d)
    return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0


def test_warp_is_the_direct_sum(spark):
    m = [0.9, 0.2, 1.5, -0.1, 1.1, 0.7, 0.001, 0.0, 1.0]
    source, got = image(spark, [GRADIENT]), image(spark, [GRADIENT, {"op": "transform", "layer": "k", "matrix": m}])
    inv = np.array(geometry.inverse([float(v) for v in m])).reshape(3, 3)
    h, w, _ = source.shape
    for y, x in ((0, 0), (5, 7), (8, 20), (15, 3), (10, 12)):
        u, v, k = inv @ [x + 0.5, y + 0.5, 1]
        fx, fy = u / k - 0.5, v / k - 0.5
        total = np.zeros(4)
        for j in range(math.floor(fy) - 1, math.floor(fy) + 3):
            for i in range(math.floor(fx) - 1, math.floor(fx) + 3):
                if 0 <= i < w and 0 <= j < h:
                    a = source[j, i, 3] / 255
                    total += keys(fx - i) * keys(fy - j) * np.array([*(source[j, i, :3] / 255 * a), a])
        a = min(max(total[3], 0), 1)
        want = np.array([*(np.clip(total[:3], 0, a) / a if a else np.zeros(3)), a]) * 255
        assert np.abs(got[y, x] - want).max() <= 0.5 + 1e-6 or round(want[3]) == 0


def test_resize_is_the_direct_sum(spark):
    source, got = image(spark, [GRADIENT]), image(spark, [GRADIENT, {"op": "image_size", "w": 9, "h": 7}])

    def matrix(n_in, n_out):
        m = np.zeros((n_out, n_in))
        for o, i, k in geometry.axis_taps(n_in, n_out):
            m[o, i] = k
        return m

    a = source[..., 3:] / 255
    both = np.concatenate([source[..., :3] / 255 * a, a], axis=2)
    out = np.einsum("yj,xi,jic->yxc", matrix(16, 7), matrix(24, 9), both)
    want = np.concatenate([out[..., :3] / out[..., 3:], out[..., 3:]], axis=2) * 255
    assert np.abs(got - want).max() <= 0.5 + 1e-6


def test_motion_blur_is_the_direct_mean(spark):
    got = image(spark, [GRADIENT, {"op": "filter_motion_blur", "layer": "k", "angle": 90, "distance": 4}])
    source = image(spark, [GRADIENT])
    assert (got == source).all()  # columns are constant
    flat = image(spark, [GRADIENT, {"op": "filter_motion_blur", "layer": "k", "angle": 0, "distance": 4}])
    a = source[..., 3] / 255
    rows = np.pad(a, ((0, 0), (2, 2)), mode="edge")
    mean = sum(rows[:, i : i + 24] for i in range(5)) / 5
    assert np.abs(flat[..., 3] - mean * 255).max() <= 0.5 + 1e-6


def test_gaussian_noise(spark):
    from test_reference import pixel_hash, unit

    got = image(spark, [GRADIENT, {"op": "filter_add_noise", "layer": "k", "amount": 40, "distribution": "gaussian", "seed": 7}])
    source, sigma = image(spark, [GRADIENT]), (40 * 255.0) / 100.0 / 1.7320508075688772
    for y, x in ((0, 0), (3, 9), (15, 23)):
        for c in range(3):
            u1, u2 = (unit(pixel_hash(7, x, y, k)) for k in (2 * c, 2 * c + 1))
            v = (source[y, x, c] + sigma * (math.sqrt(-2.0 * math.log(1.0 - u1)) * math.cos(6.283185307179586 * u2))) / 255.0
            assert got[y, x, c] == math.floor(min(max(v, 0.0), 1.0) * 255.0 + 0.5)


def test_wand_takes_corners_and_softens_the_rim(spark):
    checker = {"op": "add_layer", "id": "c", "fill": "checker", "a": "#000000", "b": "#FFFFFF", "cell": 4}
    doc = script.run(spark, {"canvas": {"w": 16, "h": 16}, "ops": [checker, {"op": "select_wand", "layer": "c", "x": 0, "y": 0, "antialias": False}], "out": "png8"})
    got = {(r["x"], r["y"]) for r in doc.state.selection.df.collect()}
    assert got == {(x, y) for x in range(16) for y in range(16) if (x // 4 + y // 4) % 2 == 0}
    ramp = {"op": "add_layer", "id": "c", "fill": "gradient", "from": "#000000", "to": "#FFFFFF"}
    doc = script.run(spark, {"canvas": {"w": 52, "h": 2}, "ops": [ramp, {"op": "select_wand", "layer": "c", "x": 0, "y": 0, "tolerance": 20}], "out": "png8"})
    row = {r["x"]: r["v"] for r in doc.state.selection.df.where("y = 0").collect()}
    assert row == {0: 255, 1: 255, 2: 255, 3: 255, 4: 255, 5: 128}


def flooded(inside, x, y):
    """The 8-connected cells, by a stack."""
    got, stack = {(x, y)}, [(x, y)]
    while stack:
        x, y = stack.pop()
        near = {(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & inside
        stack += near - got
        got |= near
    return got


@pytest.mark.parametrize("side", [regions.SIDE, 4])
def test_component_of_long_arms(spark, side):
    """Arms that meet at their far ends: labels that spread from cell to cell would need a round for each row."""
    inside = {(0, y) for y in range(60)} | {(2, y) for y in range(1, 60)} | {(1, 60)} | {(4, y) for y in range(60)}
    cells = spark.createDataFrame(sorted(inside), "x int, y int")
    runs = regions.component(spark, cells, 5, 2, 1, side, 2)
    assert {(x, r.y) for r in runs.collect() for x in range(r.a, r.b + 1)} == {c for c in inside if c[0] < 4}
    size = runs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(size) < 10**12  # no estimate that doubles its digits with each round


@pytest.mark.parametrize("density, side, block", [(0.41, 4, 2), (0.6, 5, 3), (1.0, 7, 16)])
def test_component_across_tiles(spark, density, side, block):
    on = np.random.default_rng(8).random((37, 41)) < density
    inside = {(int(x), int(y)) for y, x in zip(*np.nonzero(on), strict=True)}
    cells = spark.createDataFrame(sorted(inside), "x int, y int")
    x, y = max(inside, key=lambda c: (len(flooded(inside, *c)), c)) if density < 0.5 else max(inside)
    runs = regions.component(spark, cells, 41, x, y, side, block).collect()
    got = [(x, r.y) for r in runs for x in range(r.a, r.b + 1)]
    assert set(got) == flooded(inside, x, y) and len(got) == len(set(got))


@pytest.mark.parametrize("contiguous", [True, False])
def test_region_and_fringe(spark, contiguous):
    rgba = np.random.default_rng(3).choice(np.array([0, 60, 100, 130, 149, 255], dtype=np.uint8), (30, 26, 1)) * np.array([1, 0, 1, 0], dtype=np.uint8)
    rgba[..., 3], tolerance = 255, 100
    data = base64.b64encode(png.encode(rgba)).decode()
    doc = script.run(spark, {"canvas": {"w": 26, "h": 30}, "ops": [{"op": "place_image", "id": "p", "png": data, "x": 0, "y": 0}, {"op": "select_wand", "layer": "p", "x": 5, "y": 7, "tolerance": tolerance, "contiguous": contiguous}], "out": "png8"})
    d = np.abs(rgba.astype(int) - rgba[7, 5].astype(int)).max(axis=2)
    inside = {(x, y) for y in range(30) for x in range(26) if d[y, x] <= tolerance}
    core = flooded(inside, 5, 7) if contiguous else inside
    ring = {(x + i, y + j) for x, y in core for i in (-1, 0, 1) for j in (-1, 0, 1)} - core
    want = {c: 255 for c in core} | {(x, y): v for x, y in ring if 0 <= x < 26 and 0 <= y < 30 and (v := math.floor(max(1.5 - d[y, x] / tolerance, 0.0) * 2.0 * 255.0 + 0.5))}
    assert {(r.x, r.y): r.v for r in doc.state.selection.df.collect()} == want


def test_walk_and_mask_have_the_worked_numbers():
    brush = stroke.Brush(size=8.0, rate=20.0, smoothing=0.5, size_lut=tuple(stroke.pressure_lut([[0, 0], [1, 1]])))
    samples = [{"x": 10.0, "y": 10.0, "pressure": 1.0, "t_ms": 0.0}, {"x": 13.0, "y": 14.0, "pressure": 0.5, "t_ms": 20.0}, {"x": 13.0, "y": 14.0, "pressure": 0.5, "t_ms": 120.0}]
    dabs = list(stroke.walk(brush, samples))
    assert dabs[1] == (10.90909090909091, 11.212121212121213, 0.696969696969697) and len(dabs) == 6
    assert dabs[5][:2] == (12.228833254055314, 12.97177767207375) and brush.diameter(dabs[1][2]) == 5.584313725490196
    dab = pd.Series({"x": 10.0, "y": 10.0, "d": 8.0})
    at = lambda x, y, **k: float(stroke.mask_of(dab, stroke.Brush(size=8.0, **k), np.array([x]), np.array([y]))[0])
    assert at(12, 11, hardness=0.5) == 0.563242072809033 and at(13, 10, hardness=0.0) == 0.037317932004975574
    assert at(12, 8, hardness=1.0, roundness=0.5, angle=30.0) == 0.5623208812614978
    line = stroke.Brush(size=16.0)
    assert len(list(stroke.walk(line, [{"x": 32.0, "y": 64.0}, {"x": 224.0, "y": 64.0}]))) == 48
    assert len(list(stroke.walk(line, [{"x": 32.0 + 2.4 * i, "y": 64.0} for i in range(81)]))) == 49


def test_strokes(spark):
    one = {"layer": "k", "size": 6, "samples": [{"x": 12, "y": 8}]}
    source = image(spark, [GRADIENT])
    painted = image(spark, [GRADIENT, {"op": "brush_stroke", "color": "#FF0000", **one}])
    assert tuple(painted[8, 12]) == (255, 0, 0, 255) and (painted[0] == source[0]).all()
    erased = image(spark, [GRADIENT, {"op": "eraser_stroke", **one}])
    assert tuple(erased[8, 12]) == (0, 0, 0, 0)
    cloned = image(spark, [GRADIENT, {"op": "clone_stroke", "source": [2, 8], **one}])
    a, b = source[8, 2, 3] / 255, source[8, 12, 3] / 255
    assert abs(cloned[8, 12, 3] / 255 - (a + b * (1 - a))) < 0.01
    masked = image(spark, [GRADIENT, {"op": "add_mask", "layer": "k"}, {"op": "brush_stroke", "target": "mask", **one}])
    assert tuple(masked[8, 12]) == (0, 0, 0, 0) and masked[0, 0, 3] == source[0, 0, 3]


@pytest.mark.parametrize("cuts", [1, 3])
def test_stream_places_the_dabs_of_a_batch(spark, tmp_path, cuts):
    from mosaiq.streaming.strokes import SAMPLES, batch_dabs, stream_dabs

    rows = [(s, k, 3.0 * k + s, 2.0 * (k % 4), 0.5, 10.0 * k, False) for s in (1, 2) for k in range(9)]
    brush = stroke.Brush(size=5.0, smoothing=0.2)
    want = sorted(map(tuple, batch_dabs(spark.createDataFrame(rows, SAMPLES), brush).collect()))
    for i in range(cuts):
        part = [r for r in rows if r[1] * cuts // 9 == i]
        spark.createDataFrame(part, SAMPLES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream_dabs(stream, brush).writeStream.format("memory").queryName(f"dabs{cuts}").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table(f"dabs{cuts}").collect())) == want


def test_png(spark):
    rng = np.random.default_rng(1)
    rgba = rng.integers(0, 256, (9, 7, 4), dtype=np.uint8)
    assert (png.decode(png.encode(rgba)) == rgba).all()
    data = base64.b64encode(png.encode(rgba)).decode()
    got = image(spark, [{"op": "place_image", "id": "p", "png": data, "x": 3, "y": -2}])
    want = np.where(rgba[2:, :, 3:] == 0, 0, rgba[2:])
    assert (got[:7, 3:10] == want).all()
    df = script.pixels(spark, {"canvas": {"w": 24, "h": 130}, "ops": [GRADIENT], "out": "png8"})
    decoded = png.decode(png.to_png(df, 24, 130))
    assert (decoded[:16] == image(spark, [GRADIENT])).all() and decoded.shape == (130, 24, 4)
    for bad in (b"x", png.encode(rgba)[:-5], png.encode(rgba).replace(b"IDAT", b"IDAX")):
        with pytest.raises(ScriptError):
            png.decode(bad)


def test_box_widths():
    assert [selections.box_widths(r) for r in (0.5, 1.0, 1.5, 2.0, 3.0, 8.0, 25.0)] == [[1, 1, 1], [1, 1, 3], [3, 3, 3], [3, 3, 5], [5, 5, 7], [15, 15, 17], [49, 49, 51]]
    assert [selections.box_widths(r / 2.0, True) for r in (2, 4, 8, 10)] == [[1, 1, 3], [3, 3, 5], [7, 7, 9], [9, 9, 11]]


def test_adjustment_tables():
    assert adjust.luts("brightness_contrast", {"brightness": 0.0, "contrast": -1.0})[0] == [128] * 256
    assert adjust.luts("curves", adjust.read("curves", {}))[0] == list(range(256))
    assert adjust.luts("posterize", {"levels": 2})[0] == [0] * 128 + [255] * 128
