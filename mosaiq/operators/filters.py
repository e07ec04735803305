"""The six filters of a layer, and the coverage they are applied with."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.rules import dec, pack, q, unpack
from ..plans.document import Node, State
from ..plans.relation import Rel, frame, table, tabled
from . import paint, selections
from .tiles import map_tiles, packed, q_array, unpacked

C = F.col


def apply(spark: SparkSession, s: State, n: Node, new: Rel, coverage: dict | None) -> Rel:
    """The filtered pixels over the old ones: a locked layer keeps its alpha, then the coverage mixes."""
    if not coverage and not n.lock:
        return new
    df = frame(spark, s.w, s.h, {"old_": n.pixels, "new_": new, "sel_": selections.effective(s)})
    if n.lock:
        keep = pack(*(unpack(C("new_"), c) for c in "rgb"), unpack(C("old_"), "a"))
        df = df.withColumn("new_", keep)
    if not coverage:
        return table(df, C("new_"))
    kind = coverage["src"]
    if kind == "selection":
        m = C("sel_").cast("int")
    elif kind == "rect":
        inside = (C("x") >= coverage["x"]) & (C("x") < coverage["x"] + coverage["w"]) & (C("y") >= coverage["y"]) & (C("y") < coverage["y"] + coverage["h"])
        m = F.when(inside, coverage["value"]).otherwise(0)
    else:
        along, size = ("x", s.w) if coverage["dir"] == "h" else ("y", s.h)
        m = F.lit(255) if size == 1 else F.expr(f"cast({along} * 255 div {size - 1} as int)")
    return paint.coverage_lerp(df, "old_", "new_", m)


def _planes(df: DataFrame) -> DataFrame:
    a = unpack(C("v"), "a").cast("long")
    return df.select("x", "y", *((unpack(C("v"), c) * a).alias(c) for c in "rgb"), (a * 255).alias("a"))


def gaussian(spark: SparkSession, s: State, pixels: Rel, radius: float, clamp: bool) -> Rel:
    """Three box passes along x, then three along y, each rounded, on premultiplied integers. Windows of running sums;
    one shuffle for each axis."""
    df = _planes(frame(spark, s.w, s.h, {"v": pixels}))
    for along, size in (("x", s.w), ("y", s.h)):
        for width in selections.box_widths(radius):
            r = (width - 1) // 2
            df = selections.box_pass(df, list("rgba"), along, size, width, clamp, lambda v, r=r, width=width: F.floor((v + r) / F.lit(float(width))))
    plane = lambda c: q(F.coalesce(C(c) / F.nullif(C("a"), F.lit(0).cast("long")), F.lit(0.0)))
    return table(df, pack(*(plane(c) for c in "rgb"), q(C("a") / F.lit(65025.0))))


def unsharp(spark: SparkSession, s: State, pixels: Rel, amount: float, radius: float, threshold: int, clamp: bool) -> Rel:
    k = amount / 100.0

    def one(o: Column, b: Column) -> Column:
        return F.when(F.abs(o - b) < threshold, o).otherwise(q((o + k * (o - b)) / F.lit(255.0)))

    return _against_blur(spark, s, pixels, radius, clamp, one)


def high_pass(spark: SparkSession, s: State, pixels: Rel, radius: float, clamp: bool) -> Rel:
    return _against_blur(spark, s, pixels, radius, clamp, lambda o, b: q((o - b) / F.lit(255.0) + 0.5))


def _against_blur(spark: SparkSession, s: State, pixels: Rel, radius: float, clamp: bool, one) -> Rel:
    df = frame(spark, s.w, s.h, {"v": pixels, "b_": gaussian(spark, s, pixels, radius, clamp)})
    return table(df, pack(*(one(unpack(C("v"), c), unpack(C("b_"), c)) for c in "rgb"), unpack(C("v"), "a")))


def motion(spark: SparkSession, s: State, pixels: Rel, angle: float, distance: float, clamp: bool) -> Rel:
    """Mean of bilinear samples along a segment, in order, on premultiplied doubles: tiles with a halo."""
    th = angle * (math.pi / 180.0)
    ox, oy = distance * math.cos(th), -(distance * math.sin(th))
    ox, oy = (0.0 if abs(v) < 1e-9 else v for v in (ox, oy))
    n = math.ceil(distance) + 1
    t = [i / (n - 1) - 0.5 for i in range(n)]
    whole = [(math.floor(u * ox), math.floor(u * oy)) for u in t]
    part = [(u * ox - math.floor(u * ox), u * oy - math.floor(u * oy)) for u in t]
    halo = max(max(abs(a), abs(b)) for a, b in whole) + 1
    w, h = s.w, s.h

    def kernel(block: np.ndarray, x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
        left, top = max(x0 - halo, 0), max(y0 - halo, 0)
        r, g, b, a = unpacked(block)
        out = []
        for plane in (*((c * a) / 65025.0 for c in (r, g, b)), a / 255.0):
            acc = np.zeros((y1 - y0, x1 - x0))

            def read(i: int, j: int, plane: np.ndarray = plane) -> np.ndarray:
                xs, ys = np.arange(x0, x1) + i, np.arange(y0, y1) + j
                got = plane[np.clip(ys, 0, h - 1)[:, None] - top, np.clip(xs, 0, w - 1)[None, :] - left]
                if not clamp:
                    got = np.where(((ys >= 0) & (ys < h))[:, None] & ((xs >= 0) & (xs < w))[None, :], got, 0.0)
                return got

            for (i, j), (fx, fy) in zip(whole, part, strict=True):
                p0, p1, p2, p3 = read(i, j), read(i + 1, j), read(i, j + 1), read(i + 1, j + 1)
                m0 = fy * (p2 - p0) + p0
                m1 = fy * (p3 - p1) + p1
                acc = acc + (fx * (m1 - m0) + m0)
            out.append(acc)
        alpha = out[3] / n
        safe = np.where(alpha > 0, alpha, 1.0)
        return packed(*(q_array(np.where(alpha > 0, (c / n) / safe, 0.0)) for c in out[:3]), q_array(alpha))

    return Rel(map_tiles(tabled(spark, w, h, pixels).df, w, h, halo, kernel))


def noise(spark: SparkSession, s: State, pixels: Rel, amount: float, gaussian_: bool, mono: bool, seed: int) -> Rel:
    """Uniform or Box-Muller noise from the pixel hash; alpha stays."""
    a = (amount * 255.0) / 100.0
    sigma = a / 1.7320508075688772
    df = frame(spark, s.w, s.h, {"v": pixels}, dense=False) if pixels.df is not None else frame(spark, s.w, s.h, {"v": pixels})
    streams = (1 if mono else 3) * (2 if gaussian_ else 1)
    with rules.wrapping(spark):
        df = rules.pixel_hash(df, seed, {f"_u{k}": k for k in range(streams)})
        df = df.withColumns({f"_u{k}": rules.unit(C(f"_u{k}")) for k in range(streams)})

    def shift(c: int) -> Column:
        c = 0 if mono else c
        if not gaussian_:
            return a * (2.0 * C(f"_u{c}") - 1.0)
        return sigma * (F.sqrt(-2.0 * F.log(1.0 - C(f"_u{2 * c}"))) * F.cos(6.283185307179586 * C(f"_u{2 * c + 1}")))

    return table(df, pack(*(q((unpack(C("v"), k) + shift(i)) / F.lit(255.0)) for i, k in enumerate("rgb")), unpack(C("v"), "a")))


def offset(spark: SparkSession, s: State, pixels: Rel, dx: int, dy: int, mode: str) -> Rel:
    """Rows moved by key arithmetic; repeated edges come from the edge pixels alone."""
    rel = tabled(spark, s.w, s.h, pixels)
    if mode == "wrap":
        return Rel(rel.df.select(F.pmod(C("x") + dx, F.lit(s.w)).cast("int").alias("x"), F.pmod(C("y") + dy, F.lit(s.h)).cast("int").alias("y"), "v"))
    if mode == "transparent":
        return Rel(rel.df.select((C("x") + dx).alias("x"), (C("y") + dy).alias("y"), "v").where(f"x >= 0 and y >= 0 and x < {s.w} and y < {s.h}"))

    def places(c: str, d: int, size: int) -> Column:
        """Where the source at c shows: its own new place, and all beyond the edge for an edge pixel."""
        low = F.when(C(c) == 0, F.lit(0)).otherwise(C(c) + d)
        high = F.when(C(c) == size - 1, F.lit(size - 1)).otherwise(C(c) + d)
        low, high = F.greatest(low, F.lit(0)), F.least(high, F.lit(size - 1))
        low = F.when(C(c) == 0, F.lit(0)).otherwise(low) if d >= 0 else F.when((C(c) == 0) & (C(c) + d < 0), F.lit(0)).otherwise(low)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    df = rel.df.select(F.explode(places("x", dx, s.w)).alias("x"), "y", "v")
    return Rel(df.select("x", F.explode(places("y", dy, s.h)).alias("y"), "v").where(f"x < {s.w} and y < {s.h}"))


__all__ = ["apply", "dec", "gaussian", "high_pass", "motion", "noise", "offset", "unsharp"]
