"""Selections: analytic shapes, set operations on coverage bytes, regions of like colour, feather, expand and contract.

An all-zero selection means "no selection", so everything is selected; State.active says which, from a one-row job where
it cannot be known from the op.
"""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import dec, q, q_float, unpack
from ..plans.document import Node, State
from ..plans.relation import EMPTY, Rel, frame, moved, table, tabled
from ..plans.shared import materialize
from .regions import component

C = F.col
ALL = Rel(fn=lambda x, y: F.lit(255))


def effective(s: State) -> Rel:
    """Coverage that ops use: the selection, or everything."""
    return s.selection if s.active else ALL


def is_active(spark: SparkSession, s: State, rel: Rel) -> bool:
    if rel.df is not None:
        return not rel.df.where("v <> 0").isEmpty()
    return not rel.is_empty and not frame(spark, s.w, s.h, {"v_": rel}).where("v_ <> 0").isEmpty()


def selected(spark: SparkSession, s: State, rel: Rel) -> State:
    active = is_active(spark, s, rel)
    return replace(s, selection=rel if active else EMPTY, active=active)


def combine(spark: SparkSession, s: State, b: Rel, mode: str) -> State:
    """new, add (greatest), subtract (floor 0) or intersect (least) of two fuzzy sets."""
    if mode == "new":
        return selected(spark, s, b)
    old = s.selection if s.active else EMPTY
    how = {"add": F.greatest, "subtract": lambda x, y: F.greatest(x - y, F.lit(0).cast("long")), "intersect": F.least}[mode]
    if old.df is None and b.df is None:
        fn_old, fn_b = old.fn or (lambda x, y: F.lit(0)), b.fn or (lambda x, y: F.lit(0))
        return selected(spark, s, Rel(fn=lambda x, y: how(fn_old(x, y).cast("long"), fn_b(x, y).cast("long"))))
    dense = any(r.fn is not None for r in (old, b))
    return selected(spark, s, table(frame(spark, s.w, s.h, {"a_": old, "b_": b}, dense), how(C("a_"), C("b_"))))


def _sampled(inside, antialias: bool, box: tuple[float, float, float, float]) -> Rel:
    """Coverage of a shape by 16 x 16 samples a pixel, or by its centre; nothing outside the box."""

    def value(x: Column, y: Column) -> Column:
        near = (x + 1.0 > box[0]) & (x < box[2]) & (y + 1.0 > box[1]) & (y < box[3])
        if not antialias:
            return F.when(near & inside(x + 0.5, y + 0.5), 255).otherwise(0)
        places = F.array(*[F.lit((2 * i + 1) / 32.0) for i in range(16)])
        row = lambda oy: F.size(F.filter(places, lambda ox: inside(x + ox, y + oy)))
        n = F.aggregate(places, F.lit(0), lambda a, oy: a + row(oy))
        return F.when(near, q(n / 256.0)).otherwise(0)

    return Rel(fn=value)


def rect(x: float, y: float, w: float, h: float, antialias: bool) -> Rel:
    x1, y1 = x + w, y + h
    return _sampled(lambda px, py: (px >= x) & (px < x1) & (py >= y) & (py < y1), antialias, (x, y, x1, y1))


def ellipse(x: float, y: float, w: float, h: float, antialias: bool) -> Rel:
    rx, ry = w / 2.0, h / 2.0
    cx, cy = x + rx, y + ry

    def inside(px: Column, py: Column) -> Column:
        dx, dy = (px - cx) / rx, (py - cy) / ry
        return dx * dx + dy * dy <= 1.0

    return _sampled(inside, antialias, (x, y, x + w, y + h))


def polygon(points: list[list[float]], antialias: bool) -> Rel:
    """Even-odd crossing count over the edges, as one array literal."""
    edges = F.array(*[F.struct(F.lit(float(xi)).alias("xi"), F.lit(float(yi)).alias("yi"), F.lit(float(xj)).alias("xj"), F.lit(float(yj)).alias("yj")) for (xi, yi), (xj, yj) in zip(points, [points[-1], *points[:-1]], strict=True) if yi != yj])

    def inside(px: Column, py: Column) -> Column:
        def crossed(e: Column) -> Column:
            at = ((e["xj"] - e["xi"]) * (py - e["yi"])) / (e["yj"] - e["yi"]) + e["xi"]
            return ((e["yi"] > py) != (e["yj"] > py)) & (px < at)

        return F.size(F.filter(edges, crossed)) % 2 == 1

    if all(p[1] == points[0][1] for p in points):
        return EMPTY
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return _sampled(inside, antialias, (min(xs), min(ys), max(xs), max(ys)))


def inverse(s: State) -> Rel:
    if not s.active:
        return ALL
    if s.selection.df is None:
        fn = s.selection.fn
        return Rel(fn=lambda x, y: 255 - fn(x, y))
    return Rel(s.selection.df.select("x", "y", (255 - C("v")).alias("v")), None, 255)


def of_alpha(spark: SparkSession, s: State, n: Node) -> Rel:
    if n.pixels.df is not None:
        return table(n.pixels.df, unpack(C("v"), "a"))
    if n.pixels.streams:
        return of_alpha(spark, s, replace(n, pixels=tabled(spark, s.w, s.h, n.pixels)))
    return EMPTY if n.pixels.is_empty else Rel(fn=lambda x, y: unpack(n.pixels.fn(x, y), "a"))


def region(spark: SparkSession, s: State, n: Node, sx: int, sy: int, tolerance: int, contiguous: bool, antialias: bool) -> Rel:
    """Pixels like the seed's, all of them or the 8-connected component with the seed, and its soft fringe.

    Distances are written once, as far as the fringe can reach. A pixel of the fringe is never like the seed: next to the
    component it would belong to it."""
    if not (0 <= sx < s.w and 0 <= sy < s.h):
        return EMPTY
    df = frame(spark, s.w, s.h, {"v": n.pixels})
    seed = df.where((C("x") == sx) & (C("y") == sy)).select("v").first()["v"]
    parts = [(seed >> k) & 255 for k in (0, 8, 16, 24)]
    d = F.greatest(*[F.abs(F.shiftright("v", k).bitwiseAND(F.lit(255).cast("long")) - p) for k, p in zip((0, 8, 16, 24), parts, strict=True)])
    rim = antialias and tolerance > 0
    near = materialize(spark, df.select("x", "y", d.cast("int").alias("d")).where(C("d") < 1.5 * tolerance if rim else C("d") <= tolerance), "near")
    inside = near.where(C("d") <= tolerance).select("x", "y")
    runs = component(spark, inside, s.w, sx, sy) if contiguous else inside.select("y", C("x").alias("a"), C("x").alias("b"))
    core = runs.select(F.explode(F.sequence("a", "b")).alias("x"), "y", F.lit(255).cast("long").alias("v"))
    if not rim:
        return Rel(core)
    row = F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias("o")
    around = F.when(C("o") == 0, F.array(C("a") - 1, C("b") + 1)).otherwise(F.sequence(C("a") - 1, C("b") + 1))
    ring = runs.select("y", "a", "b", row).select(F.explode(around).alias("x"), (C("y") + C("o")).alias("y")).distinct()
    a = 1.5 - C("d") / F.lit(float(tolerance))
    soft = near.where(C("d") > tolerance).join(ring, ["x", "y"], "left_semi").select("x", "y", q(a * 2.0).cast("long").alias("v"))
    return Rel(core.unionByName(soft.where("v > 0")))


def box_widths(sigma: float, half_up: bool = False) -> list[int]:
    """Widths of the three boxes whose passes are nearly a Gaussian, narrow ones first."""
    s12 = (12.0 * sigma) * sigma
    low = int(math.floor(math.sqrt(s12 / 3.0 + 1.0)))
    low -= low % 2 == 0
    m = (((s12 - 3 * low * low) - 12 * low) - 9) / (-4.0 * low - 4.0)
    if half_up:
        n = math.floor(m + 0.5)
    else:
        n = math.floor(abs(m)) + (abs(m) - math.floor(abs(m)) >= 0.5)
        n = -n if m < 0 else n
    n = min(max(n, 0), 3)
    return [low if i < n else low + 2 for i in range(3)]


def box_pass(df: DataFrame, names: list[str], along: str, size: int, width: int, clamp: bool, finish) -> DataFrame:
    """Sums of `width` neighbours along an axis, by differences of running sums (exact in BIGINT, O(1) for any width).
    Beyond the ends come the end values (clamp) or zeros. df is dense."""
    if width == 1:
        return df
    r = (width - 1) // 2
    across = "y" if along == "x" else "x"
    w = Window.partitionBy(across).orderBy(along)
    ends = Window.partitionBy(across).orderBy(along).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    cols = {f"_s{i}": F.sum(c).over(run) for i, c in enumerate(names)}
    df = df.withColumns(cols)
    out = {}
    for i, c in enumerate(names):
        first, last, total = F.first(c).over(ends), F.last(c).over(ends), F.last(f"_s{i}").over(ends)
        high = F.coalesce(F.lead(f"_s{i}", r).over(w), total)
        low = F.coalesce(F.lag(f"_s{i}", r + 1).over(w), F.lit(0).cast("long"))
        s = high - low
        if clamp:
            s = s + F.greatest(C(along) + r - (size - 1), F.lit(0)) * last + F.greatest(r - C(along), F.lit(0)) * first
        out[c] = s
    df = df.select("x", "y", *(finish(v).cast("long").alias(c) for c, v in out.items()))
    return df


def feather(spark: SparkSession, s: State, radius: float) -> Rel:
    if radius == 0 or not s.active:
        return s.selection
    df = frame(spark, s.w, s.h, {"t": s.selection})
    widths = box_widths(radius / 2.0, True)
    for width in widths:
        df = box_pass(df, ["t"], "x", s.w, width, True, lambda v: v)
        df = box_pass(df, ["t"], "y", s.h, width, True, lambda v: v)
    d = (widths[0] * widths[1] * widths[2]) ** 2
    return table(df, F.expr(f"(2 * t + {d}L) div {2 * d}L"))


def spread(spark: SparkSession, s: State, by: int, grow: bool) -> Rel:
    """Greatest (or least) coverage within a disc: a frame of each half-width along x, then the rows' shifts."""
    if not s.active:
        return s.selection
    best, outside = (F.max, 0) if grow else (F.min, 255)
    df = frame(spark, s.w, s.h, {"v": s.selection})
    half = {dy: math.isqrt(by * by - dy * dy) for dy in range(-by, by + 1)}
    for k in sorted(set(half.values())):
        df = df.withColumn(f"h{k}", best("v").over(Window.partitionBy("y").orderBy("x").rowsBetween(-k, k)))
    if not grow:
        df = df.withColumns({f"h{k}": C(f"h{k}") for k in set(half.values())})
    spans = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), C(f"h{k}").alias("v")) for dy, k in half.items()]))
    parts = df.select("x", "y", spans.alias("o")).select("x", (C("y") - C("o.dy")).alias("y"), C("o.v").alias("v"))
    parts = parts.where(f"y >= 0 and y < {s.h}").groupBy("x", "y").agg(best("v").alias("v"))
    assert outside in (0, 255)
    return table(parts, C("v"))


def edge(spark: SparkSession, s: State) -> DataFrame:
    """Selected pixels with an unselected 4-neighbour (outside the canvas counts as unselected)."""
    on = tabled(spark, s.w, s.h, effective(s)).df.where("v >= 128").select("x", "y")
    near = None
    for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)):
        part = on.select((C("x") + dx).alias("x"), (C("y") + dy).alias("y"))
        near = part if near is None else near.unionByName(part)
    inner = near.groupBy("x", "y").agg(F.count("*").alias("n")).where("n = 4").select("x", "y")
    return on.join(inner, ["x", "y"], "left_anti")


def bounds(rel: DataFrame) -> tuple[int, int, int, int] | None:
    """x, y, width and height of the rows, or None."""
    r = rel.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    return None if r[0] is None else (r[0], r[1], r[2] - r[0] + 1, r[3] - r[1] + 1)


__all__ = ["ALL", "bounds", "box_pass", "box_widths", "combine", "component", "dec", "edge", "effective", "ellipse", "feather", "inverse", "is_active", "moved", "of_alpha", "polygon", "q_float", "rect", "region", "selected", "spread"]
