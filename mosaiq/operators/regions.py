"""Connected regions of a canvas: runs of cells are joined within tiles, then tiles within ever larger blocks.

A tile's runs carry the id (y * w + x) of the least run that they are connected to within the tile. Pairs of ids that touch
across a border are joined in blocks of 16 x 16 tiles, the pairs that are left in blocks of 16 x 16 of those, and so on: the
number of levels is the logarithm of the canvas's longer side, whatever winding shape a region has. What a level hands on
grows with the borders of its blocks, not with their area. Each level is written, so its size is known from its files: in a
loop of checkpoints the estimate of a join is the product of both sides, and its digits double in every round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import materialize

C = F.col
SIDE, BLOCK = 256, 16
#: Neighbours of a cell that come after it.
_AFTER = ((1, 0), (-1, 1), (0, 1), (1, 1))


def least(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least of 0 .. n - 1 that each of them is connected to by the pairs (u, v)."""
    p = np.arange(n)
    while len(u):
        a, b = p[u], p[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(p, np.maximum(a, b), np.minimum(a, b))
        while (p[p] != p).any():
            p = p[p]
    return p


def _tile(c: Column, span: int) -> Column:
    return F.floor(c / F.lit(float(span))).cast("int")


def tile_runs(cells: DataFrame, w: int, side: int) -> DataFrame:
    """y, a, b (runs from a to b, cut at tiles) and c, the id of the least run of the tile that each is connected to."""
    step = side + 2  # a gap between rows, so that runs and neighbours end with them

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        x0, y0 = key[0].as_py() * side, key[1].as_py() * side
        at = np.unique((t.column("y").to_numpy().astype(np.int64) - y0) * step + (t.column("x").to_numpy() - x0))
        first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        a, b = at[first], at[np.append(first[1:], len(at)) - 1]
        low, high = np.searchsorted(b, a + step - 1), np.searchsorted(a, b + step + 1, "right")
        n = np.maximum(high - low, 0)
        u = np.repeat(np.arange(len(a)), n)
        v = np.arange(len(u)) + np.repeat(low - (np.cumsum(n) - n), n)
        y, xa, xb = a // step + y0, a % step + x0, b % step + x0
        c = (y * w + xa)[least(len(a), u, v)]
        return pa.table({"y": pa.array(y, pa.int32()), "a": pa.array(xa, pa.int32()), "b": pa.array(xb, pa.int32()), "c": pa.array(c, pa.int64())})

    dealt = cells.select("x", "y", _tile(C("x"), side).alias("tx"), _tile(C("y"), side).alias("ty"))
    return dealt.groupBy("tx", "ty").applyInArrow(run, "y int, a int, b int, c long")


def _crossing(runs: DataFrame, side: int) -> DataFrame:
    """Pairs of ids whose cells touch across a border of tiles."""
    rim = lambda c: (C(c) % side).isin(0, side - 1)
    cells = runs.select(F.explode(F.when(rim("y"), F.sequence("a", "b")).otherwise(F.array_distinct(F.array("a", "b")))).alias("x"), "y", "c").where(rim("x") | rim("y"))
    shifts = F.explode(F.array(*[F.struct((C("x") + i).alias("x"), (C("y") + j).alias("y")) for i, j in _AFTER]))
    near = cells.select("c", _tile(C("x"), side).alias("tx"), _tile(C("y"), side).alias("ty"), shifts.alias("o"))
    near = near.where((_tile(C("o.x"), side) != C("tx")) | (_tile(C("o.y"), side) != C("ty"))).select(C("c").alias("u"), C("o.x").alias("x"), C("o.y").alias("y"))
    return near.join(cells.select("x", "y", C("c").alias("v")), ["x", "y"]).select("u", "v").distinct()


def _joined(pairs: DataFrame) -> DataFrame:
    """c and up, the least id that it is connected to by the pairs of its block (bx, by)."""

    def run(t: pa.Table) -> pa.Table:
        ids, at = np.unique(np.concatenate([t.column("u").to_numpy(), t.column("v").to_numpy()]), return_inverse=True)
        up = ids[least(len(ids), *np.split(at.reshape(-1), 2))]
        return pa.table({"c": pa.array(ids), "up": pa.array(up)})

    return pairs.groupBy("bx", "by").applyInArrow(run, "c long, up long")


def component(spark: SparkSession, cells: DataFrame, w: int, sx: int, sy: int, side: int = SIDE, block: int = BLOCK) -> DataFrame:
    """The runs (y, a, b) of the cells that are 8-connected to (sx, sy)."""
    runs = materialize(spark, tile_runs(cells, w, side), "runs")
    home = runs.where((C("y") == sy) & (C("a") <= sx) & (C("b") >= sx)).select("c").first()
    if home is None:
        return runs.select("y", "a", "b").where(F.lit(False))
    home = home["c"]
    pairs, span, levels = materialize(spark, _crossing(runs, side), "pairs"), side, []
    while not pairs.isEmpty():
        span *= block
        at = lambda c, span=span: (_tile(C(c) % w, span), _tile(F.expr(f"{c} div {w}"), span))
        (ux, uy), (vx, vy) = at("u"), at("v")
        placed = pairs.select("u", "v", ux.alias("bx"), uy.alias("by"), ((ux == vx) & (uy == vy)).alias("within"))
        up = materialize(spark, _joined(placed.where("within").select("u", "v", "bx", "by")), "joined")
        levels.append(up)
        rest = placed.where("not within").select("u", "v")
        for k in "uv":
            rest = rest.join(up.select(C("c").alias(k), "up"), k, "left").withColumn(k, F.coalesce("up", k)).drop("up")
        pairs = materialize(spark, rest.select("u", "v").distinct(), "pairs")
        above = up.where(C("c") == home).select("up").first()
        home = above["up"] if above else home
    chosen = spark.range(home, home + 1).select(C("id").alias("c"))
    for up in reversed(levels):
        below = up.join(chosen.select(C("c").alias("up")), "up", "left_semi").select("c")
        chosen = materialize(spark, chosen.unionByName(below).distinct(), "chosen")
    return runs.join(chosen, "c", "left_semi").select("y", "a", "b")
