"""Files in and out, and looking at documents."""

import io
import json
import zipfile

import numpy as np
from test_engine import GRADIENT, image

from mosaiq.operators import inspect, render
from mosaiq.plans import script
from mosaiq.sources import images, openraster, png

OPS = [
    GRADIENT,
    {"op": "add_group", "id": "g", "mode": "isolated"},
    {"op": "add_layer", "id": "n", "fill": "noise", "seed": 3, "rect": [2, 3, 9, 7], "parent": "g"},
    {"op": "add_mask", "layer": "n", "fill": "gradient"},
    {"op": "set_blend", "layer": "n", "mode": "mul"},
    {"op": "add_adjustment", "id": "a", "type": "invert"},
    {"op": "set_opacity", "layer": "a", "value": 0.5},
]


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_openraster_round_trip(spark):
    doc = script.run(spark, {"canvas": {"w": 20, "h": 12, "bg": "#102030"}, "ops": OPS, "out": "png8"})
    data = openraster.write(spark, doc)
    back = openraster.read(spark, data)
    assert rows(render.render(spark, back.state)) == rows(render.render(spark, doc.state))
    assert inspect.tree(back.state) == inspect.tree(doc.state) and images.sniff(data) == "zip"
    bare = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(bare, "w") as new:
        for name in old.namelist():
            if name != "document.json":
                new.writestr(name, old.read(name))
    plain = openraster.read(spark, bare.getvalue())
    assert [n.kind for n in plain.state.root.walk()] == ["raster", "group", "raster"]


def test_images(spark, tmp_path):
    df = script.pixels(spark, {"canvas": {"w": 24, "h": 16}, "ops": [GRADIENT], "out": "png8"})
    for kind, close in (("png", 0), ("tiff", 0), ("jpeg", 24)):
        path = tmp_path / f"a.{kind}"
        path.write_bytes(images.export(spark, df, 24, 16, kind))
        assert images.sniff(path.read_bytes()) == kind
        doc = images.open_image(spark, str(path))
        got = {(r["x"], r["y"]): r for r in render.render(spark, doc.state).collect()}
        want = image(spark, [GRADIENT])
        if kind == "jpeg":
            a = want[..., 3:] / 255
            want = np.concatenate([want[..., :3] * a + 255 * (1 - a), np.full_like(a, 255)], axis=2)
        assert max(abs(got[x, y][c] - want[y, x, i]) for x in range(24) for y in range(16) for i, c in enumerate("rgba")) <= close
    assert {r["kind"] for r in images.kinds(spark, str(tmp_path / "a.*")).collect()} == {"png", "tiff", "jpeg"}


def test_looking(spark):
    doc = script.run(spark, {"canvas": {"w": 130, "h": 70}, "ops": [*OPS, {"op": "select_rect", "x": 3, "y": 2, "w": 4, "h": 3}, {"op": "select_rect", "x": 7, "y": 5, "w": 2, "h": 2, "mode": "add"}], "out": "png8"})
    s = doc.state
    assert inspect.nodes_df(spark, s).count() == 4 and json.loads(inspect.tree(s))["children"][1]["mode"] == "norm"
    assert {(r["node_id"], r["allocated"], r["total"]) for r in inspect.tile_statistics(spark, s).collect()} == {("k", 6, 6), ("n", 1, 6)}
    assert inspect.crop_to_selection(spark, doc) == {"op": "crop", "x": 3, "y": 2, "w": 6, "h": 5}
    loops = inspect.outline(spark, s)
    assert sorted(map(len, loops)) == [4, 4] and all((7, 5) in loop for loop in loops)
    assert inspect.eyedropper(spark, s, 0, 0) == tuple(render.render(spark, s).where("x = 0 and y = 0").first()[2:])
    one = inspect.thumbnail(spark, s, 13).toPandas()
    assert (one.x.max(), one.y.max()) == (12, 6)
    script.apply(spark, doc, {"op": "fill_selection", "layer": "k", "color": "#FF00FF"})
    assert rows(inspect.changed_tiles(render.render(spark, s), render.render(spark, doc.state))) == [(0, 0)]
    assert inspect.pyramid(spark, s, 2)[2].count() == 33 * 18


def test_png_kinds():
    import struct
    import zlib

    def build(kind, depth, raw, extra=b""):
        return png.MAGIC + png._chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, depth, kind, 0, 0, 0)) + extra + png._chunk(b"IDAT", zlib.compress(raw)) + png._chunk(b"IEND", b"")

    assert png.decode(build(0, 8, b"\x00\x05\x09")).tolist() == [[[5, 5, 5, 255], [9, 9, 9, 255]]]
    assert png.decode(build(0, 1, b"\x00\x40")).tolist() == [[[0, 0, 0, 255], [255, 255, 255, 255]]]
    assert png.decode(build(2, 8, b"\x01\x01\x02\x03\x01\x01\x01")).tolist() == [[[1, 2, 3, 255], [2, 3, 4, 255]]]
    assert png.decode(build(4, 8, b"\x00\x05\x06\x07\x08")).tolist() == [[[5, 5, 5, 6], [7, 7, 7, 8]]]
    assert png.decode(build(3, 8, b"\x00\x00\x01", png._chunk(b"PLTE", bytes(range(6))) + png._chunk(b"tRNS", b"\x09"))).tolist() == [[[0, 1, 2, 9], [3, 4, 5, 255]]]
    assert png.decode(build(0, 16, b"\x00\xff\xff\x00\x80")).tolist()[0][0] == [255, 255, 255, 255]
