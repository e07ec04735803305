"""Tiles with a halo: NumPy kernels over blocks of a canvas, for operators that built-in expressions cannot express."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Kernel = Callable[[np.ndarray, int, int, int, int], np.ndarray]


def map_tiles(df: DataFrame, w: int, h: int, halo: int, kernel: Kernel, size: int = 256) -> DataFrame:
    """x, y, v of kernel(block, x0, y0, x1, y1) for each tile, from a dense or sparse (x, y, v).

    block is the tile with its halo, cut to the canvas: packed pixels at [y - max(y0 - halo, 0), x - max(x0 - halo, 0)].
    Tiles are at least twice the halo wide, so a pixel goes to four tiles at most and a block's size is bounded."""
    size = max(size, 2 * halo)
    span = lambda c, n: F.explode(F.sequence(F.floor(F.greatest(F.col(c) - halo, F.lit(0)) / F.lit(float(size))).cast("int"), F.floor(F.least(F.col(c) + halo, F.lit(n - 1)) / F.lit(float(size))).cast("int")))
    dealt = df.select("x", "y", "v", span("x", w).alias("tx")).select("x", "y", "v", "tx", span("y", h).alias("ty"))
    across, down = -(-w // size), -(-h // size)
    every = df.sparkSession.range(across * down).select(F.lit(-1).alias("x"), F.lit(-1).alias("y"), F.lit(0).cast("long").alias("v"), F.expr(f"cast(id % {across} as int)").alias("tx"), F.expr(f"cast(id div {across} as int)").alias("ty"))

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        tx, ty = key[0].as_py(), key[1].as_py()
        x0, y0 = tx * size, ty * size
        x1, y1 = min(x0 + size, w), min(y0 + size, h)
        left, top = max(x0 - halo, 0), max(y0 - halo, 0)
        block = np.zeros((min(y1 + halo, h) - top, min(x1 + halo, w) - left), dtype=np.int64)
        x, y, v = (t.column(c).to_numpy() for c in ("x", "y", "v"))
        real = x >= 0
        block[y[real] - top, x[real] - left] = v[real]
        out = kernel(block, x0, y0, x1, y1)
        at = np.flatnonzero(out)
        return pa.table({"x": pa.array((at % (x1 - x0) + x0).astype(np.int32)), "y": pa.array((at // (x1 - x0) + y0).astype(np.int32)), "v": pa.array(out.ravel()[at])})

    return dealt.unionByName(every).groupBy("tx", "ty").applyInArrow(run, "x int, y int, v long")


def unpacked(block: np.ndarray) -> tuple[np.ndarray, ...]:
    return tuple((block >> k) & 255 for k in (16, 8, 0, 24))


def q_array(v: np.ndarray) -> np.ndarray:
    y = np.clip(v, 0.0, 1.0) * 255.0
    low = np.floor(y)
    return (low + (y - low >= 0.5)).astype(np.int64)


def packed(r: np.ndarray, g: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    return np.where(a == 0, 0, a << 24 | r << 16 | g << 8 | b)
