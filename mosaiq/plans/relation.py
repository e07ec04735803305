"""Sparse canvas relations.

A Rel gives each pixel of a canvas one BIGINT: a packed pixel, or a byte of a mask or selection. It is an expression of x
and y (fills, analytic shapes: no join needed), or a table (x, y, v) with a default for absent rows. frame() brings any
number of tables onto one grid with a single shuffle: their rows are united and grouped by (x, y), with partial
aggregation before it, however many layers there are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import pixel_hash, wrapping


@dataclass(frozen=True)
class Rel:
    df: DataFrame | None = None
    fn: Callable[..., Column] | None = None
    default: int = 0
    streams: tuple[int, tuple[int, ...]] | None = None  # seed and streams of the pixel hash that fn takes as third argument

    @property
    def is_empty(self) -> bool:
        return self.df is None and self.fn is None


EMPTY = Rel()


def spine(spark: SparkSession, w: int, h: int) -> DataFrame:
    """Every pixel of a canvas."""
    return spark.range(w * h).select(F.pmod("id", F.lit(w)).cast("int").alias("x"), F.expr(f"cast(id div {w} as int)").alias("y"))


def frame(spark: SparkSession, w: int, h: int, rels: dict[str, Rel], dense: bool = True) -> DataFrame:
    """x, y and a BIGINT column for each relation; all pixels, or (dense=False) those that a table has rows of."""
    tables = {k: r for k, r in rels.items() if r.df is not None}
    if not tables:
        df = spine(spark, w, h)
    else:
        parts = [r.df.select("x", "y", *(F.col("v").alias(k) if k == name else F.lit(None).cast("long").alias(k) for k in tables)) for name, r in tables.items()]
        if dense:
            parts.append(spine(spark, w, h).select("x", "y", *(F.lit(None).cast("long").alias(k) for k in tables)))
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        df = df.groupBy("x", "y").agg(*(F.max(k).alias(k) for k in tables)) if len(parts) > 1 else df
        df = df.select("x", "y", *(F.coalesce(k, F.lit(r.default).cast("long")).alias(k) for k, r in tables.items()))
    with wrapping(spark):
        for k, r in rels.items():
            if r.df is None and r.streams:
                names = {f"_h{i}": i for i in r.streams[1]}
                df = pixel_hash(df, r.streams[0], names).withColumn(k, r.fn(F.col("x"), F.col("y"), [F.col(n) for n in names]).cast("long")).drop(*names)
            elif r.df is None:
                df = df.withColumn(k, (r.fn(F.col("x"), F.col("y")) if r.fn else F.lit(r.default)).cast("long"))
    return df


def table(df: DataFrame, value: Column, default: int = 0) -> Rel:
    """A table relation of value over df's x and y, without rows that hold the default. They go by a generator: a filter
    would be pushed down through every Project below, with the whole formula copied into it."""
    v = F.col("v")
    return Rel(df.select("x", "y", value.cast("long").alias("v")).select("x", "y", F.explode(F.when(v != default, F.array(v))).alias("v")), None, default)


def moved(rel: Rel, w: int, h: int, x: Callable[[Column, Column], Column], y: Callable[[Column, Column], Column]) -> Rel:
    """The table with rows at new coordinates, cut to a canvas. Only for one-to-one maps."""
    a, b = F.col("x"), F.col("y")
    df = rel.df.select(x(a, b).cast("int").alias("x"), y(a, b).cast("int").alias("y"), "v")
    return Rel(df.where(f"x >= 0 and y >= 0 and x < {w} and y < {h}"), None, rel.default)


def tabled(spark: SparkSession, w: int, h: int, rel: Rel) -> Rel:
    """The relation as a table."""
    return rel if rel.df is not None else table(frame(spark, w, h, {"v_": rel}), F.col("v_"), rel.default)
