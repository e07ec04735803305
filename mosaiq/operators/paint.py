"""Painting into one layer: fills, gradients, the bucket, clearing and copies through the selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import clamp, color, dec, pack, q, unpack
from ..plans.document import Node, State
from ..plans.relation import Rel, frame, table
from . import selections

C = F.col


def over(df: DataFrame, n: Node, source: Sequence[Column], alpha: Column) -> Rel:
    """df has v (the layer's pixel); source colour (doubles) of coverage alpha goes over it. Where the coverage is 0 the
    pixel stays; on a locked layer colours move and alpha stays."""
    df = df.withColumns({"_as": alpha.cast("double"), "_av": unpack(C("v"), "a")} | {f"_k{i}": dec(unpack(C("v"), c)) for i, c in enumerate("rgb")} | {f"_s{i}": s for i, s in enumerate(source)})
    a = C("_as")
    if n.lock:
        done = [q(C(f"_k{i}") * (1.0 - a) + C(f"_s{i}") * a) for i in range(3)]
        return table(df, F.when((a == 0.0) | (C("_av") == 0), C("v")).otherwise(pack(*done, C("_av"))))
    df = df.withColumn("_ab", dec(C("_av"))).withColumn("_ao", a + C("_ab") * (1.0 - a))
    ao = F.nullif(C("_ao"), F.lit(0.0))
    done = [q((C(f"_s{i}") * a + (C(f"_k{i}") * C("_ab")) * (1.0 - a)) / ao) for i in range(3)]
    return table(df, F.when(a == 0.0, C("v")).otherwise(pack(*done, q(C("_ao")))))


def _grid(spark: SparkSession, s: State, n: Node, **more: Rel) -> DataFrame:
    df = frame(spark, s.w, s.h, {"v": n.pixels, "e_": selections.effective(s), **more})
    return df.withColumn("_e", dec(C("e_")))


def fill_selection(spark: SparkSession, s: State, n: Node, text: str, opacity: float) -> Rel:
    r, g, b, a = (v / 255.0 for v in color(text))
    return over(_grid(spark, s, n), n, [F.lit(r), F.lit(g), F.lit(b)], F.lit(a * opacity) * C("_e"))


def gradient(spark: SparkSession, s: State, n: Node, kind: str, p0: Sequence[float], p1: Sequence[float], c0: str, c1: str, opacity: float, reverse: bool) -> Rel:
    dx, dy = p1[0] - p0[0], p1[1] - p0[1]
    length = dx * dx + dy * dy
    if length == 0.0:
        return n.pixels
    ex, ey = (C("x") + 0.5) - p0[0], (C("y") + 0.5) - p0[1]
    t = (ex * dx + ey * dy) / F.lit(length) if kind == "linear" else F.sqrt(ex * ex + ey * ey) / F.lit(length**0.5)
    t = clamp(t)
    df = _grid(spark, s, n).withColumn("_t", 1.0 - t if reverse else t)
    a, b = ([v / 255.0 for v in color(c)] for c in (c0, c1))
    mixed = [u + F.lit(v - u) * C("_t") for u, v in zip(a, b, strict=True)]
    return over(df, n, mixed[:3], (mixed[3] * F.lit(float(opacity))) * C("_e"))


def bucket(spark: SparkSession, s: State, n: Node, x: int, y: int, text: str, opacity: float, tolerance: int, contiguous: bool, antialias: bool) -> Rel:
    if not (0 <= x < s.w and 0 <= y < s.h):
        return n.pixels
    rg = selections.region(spark, s, n, x, y, tolerance, contiguous, antialias)
    r, g, b, a = (v / 255.0 for v in color(text))
    return over(_grid(spark, s, n, rg_=rg), n, [F.lit(r), F.lit(g), F.lit(b)], (F.lit(a * opacity) * dec(C("rg_"))) * C("_e"))


def coverage_lerp(df: DataFrame, old: str, new: str, cover: Column) -> Rel:
    """Old to new pixels by a coverage byte, premultiplied; 0 and 255 are exact."""
    df = df.withColumn("_m8", cover)
    df = df.withColumns({"_m": dec(C("_m8")), "_ao": dec(unpack(C(old), "a")), "_af": dec(unpack(C(new), "a"))})
    df = df.withColumn("_a", C("_ao") * (1.0 - C("_m")) + C("_af") * C("_m"))
    mixed = [((dec(unpack(C(old), c)) * C("_ao")) * (1.0 - C("_m")) + (dec(unpack(C(new), c)) * C("_af")) * C("_m")) / F.nullif(C("_a"), F.lit(0.0)) for c in "rgb"]
    lerp = pack(*(q(F.coalesce(v, F.lit(0.0))) for v in mixed), q(C("_a")))
    return table(df, F.when(C("_m8") == 0, C(old)).when(C("_m8") == 255, C(new)).otherwise(lerp))


def clear(spark: SparkSession, s: State, n: Node) -> Rel:
    if n.lock:
        return n.pixels
    df = _grid(spark, s, n).withColumn("_none", F.lit(0).cast("long"))
    return coverage_lerp(df, "v", "_none", C("e_"))


def copied(spark: SparkSession, s: State, source: Rel) -> Rel:
    """The pixels with alpha scaled by the selection."""
    df = frame(spark, s.w, s.h, {"v": source, "e_": selections.effective(s)})
    a = q(dec(unpack(C("v"), "a")) * dec(C("e_")))
    return table(df, F.when(C("e_") == 255, C("v")).otherwise(pack(*(unpack(C("v"), c) for c in "rgb"), a)))


def apply_mask(spark: SparkSession, s: State, n: Node) -> Rel:
    df = frame(spark, s.w, s.h, {"v": n.pixels, "m_": n.mask.rel})
    a = q(dec(unpack(C("v"), "a")) * dec(C("m_")))
    return table(df, pack(*(unpack(C("v"), c) for c in "rgb"), a))
