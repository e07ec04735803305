"""Strokes: samples become dabs by a stateful walk, dabs accumulate into a buffer tile by tile, the buffer goes over the
layer as it was before the stroke.

The walk is one pure step function over a small state (position, pressure, time, partial dab, step); a batch feeds it a
stroke's samples in order, a stream keeps the state by stroke. Dabs are rows; each goes to the tiles it touches, where
they are applied in order by NumPy.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import color, dec, pack, q, q_float, unpack
from ..plans.document import Node, ScriptError, State
from ..plans.relation import Rel, frame, moved, table, tabled
from . import paint, selections

C = F.col
MOST_DABS = 1_000_000
TILE = 64


def pressure_lut(curve: list[list[float]] | None) -> list[int] | None:
    if curve is None:
        return None
    out = []
    for i in range(256):
        x = i / 255.0
        k = max(j for j in range(len(curve) - 1) if curve[j][0] <= x)
        (x0, y0), (x1, y1) = curve[k], curve[k + 1]
        y = y0 + ((x - x0) / (x1 - x0)) * (y1 - y0)
        out.append(math.floor(min(max(y, 0.0), 1.0) * 65535.0 + 0.5))
    return out


@dataclass(frozen=True)
class Brush:
    size: float = 20.0
    hardness: float = 1.0
    spacing: float = 0.25
    opacity: float = 1.0
    flow: float = 1.0
    angle: float = 0.0
    roundness: float = 1.0
    mode: str = "wash"
    rate: float = 0.0
    smoothing: float = 0.0
    size_lut: tuple[int, ...] | None = None
    opacity_lut: tuple[int, ...] | None = None

    def factor(self, lut: tuple[int, ...] | None, p: float) -> float:
        return 1.0 if lut is None else lut[q_float(p)] / 65535.0

    def diameter(self, p: float) -> float:
        return self.size * self.factor(self.size_lut, p)

    def next_step(self, p: float) -> float:
        return self.spacing * max(self.diameter(p), 1.0)


@dataclass(frozen=True)
class Walk:
    """What is carried from sample to sample."""

    x: float = 0.0
    y: float = 0.0
    p: float = 0.0
    t: float = 0.0
    frac: float = 0.0
    step: float = 0.0
    dabs: int = 0
    started: bool = False


Dab = tuple[float, float, float]  # x, y, pressure


def advance(brush: Brush, s: Walk, x: float, y: float, pressure: float, t: float | None) -> tuple[Walk, list[Dab]]:
    """The state after a sample, and the dabs it placed. t: null is the time of the sample before."""
    p = min(max(pressure, 0.0), 1.0)
    if not s.started:
        return Walk(x, y, p, t or 0.0, 0.0, brush.next_step(p), 1, True), [(x, y, p)]
    m = brush.smoothing
    xs, ys = (1.0 - m) * x + m * s.x, (1.0 - m) * y + m * s.y
    te = s.t if t is None else max(s.t, t)
    dx, dy = xs - s.x, ys - s.y
    length, seconds = math.sqrt(dx * dx + dy * dy), (te - s.t) / 1000.0
    u, frac, step, out = 0.0, s.frac, s.step, []
    while True:
        w = 1.0 - u
        todo = (length * w) / step + (seconds * w) * brush.rate
        if frac + todo < 1.0:
            break
        u = min(u + w * ((1.0 - frac) / todo), 1.0)
        at = s.p + u * (p - s.p)
        out.append((s.x + u * dx, s.y + u * dy, at))
        if s.dabs + len(out) > MOST_DABS:
            raise ScriptError("too many dabs in a stroke")
        frac, step = 0.0, brush.next_step(at)
    return Walk(xs, ys, p, te, frac + todo, step, s.dabs + len(out), True), out


def walk(brush: Brush, samples: Iterable[dict[str, float]]) -> Iterator[Dab]:
    state = Walk()
    for k in samples:
        state, dabs = advance(brush, state, k["x"], k["y"], k.get("pressure", 1.0), k.get("t_ms"))
        yield from dabs


DAB_SCHEMA = "dab_no int, x double, y double, p double, d double"


def dabs_df(spark: SparkSession, brush: Brush, samples: list[dict[str, float]]) -> DataFrame:
    """dab_no, x, y, p (pressure), d (diameter)."""
    rows = [(i, x, y, p, brush.diameter(p)) for i, (x, y, p) in enumerate(walk(brush, samples))]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["dab_no", "x", "y", "p", "d"]).astype({"dab_no": "int32"}), DAB_SCHEMA)


def mask_of(dab: Any, brush: Brush, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Coverage of a dab (x, y, d) at pixels: a rotated ellipse with a smooth edge of a pixel at least."""
    theta = brush.angle * (math.pi / 180.0)
    ca, sa = math.cos(theta), math.sin(theta)
    r = max(dab.d, 1.0) / 2.0
    rm = r * brush.roundness
    he = min(brush.hardness, 1.0 - (1.0 / rm if rm > 1.0 else 1.0))
    dx, dy = (px + 0.5) - dab.x, (py + 0.5) - dab.y
    nu, nv = (dx * ca - dy * sa) / r, (dx * sa + dy * ca) / rm
    rr = np.sqrt(nu * nu + nv * nv)
    t = (rr - he) / (1.0 - he)
    return np.where(rr >= 1.0, 0.0, np.where(rr <= he, 1.0, 1.0 - (t * t) * (3.0 - 2.0 * t)))


def buffer(dabs: DataFrame, brush: Brush, w: int, h: int) -> DataFrame:
    """x, y, b: the stroke buffer where it is above 0. A group is the dabs of one 64 x 64 tile, in order."""
    r = F.greatest("d", F.lit(1.0)) / 2.0
    low = lambda c: F.greatest(F.ceil((C(c) - r) - 0.5), F.lit(0))
    high = lambda c, n: F.least(F.floor((C(c) + r) - 0.5), F.lit(n - 1))
    df = dabs.where("d > 0").withColumns({"x0": low("x"), "x1": high("x", w), "y0": low("y"), "y1": high("y", h)}).where("x0 <= x1 and y0 <= y1")
    tiles = lambda a, b: F.explode(F.sequence(F.floor(C(a) / F.lit(float(TILE))), F.floor(C(b) / F.lit(float(TILE)))))
    df = df.withColumn("tx", tiles("x0", "x1")).withColumn("ty", tiles("y0", "y1"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tx, ty = int(pdf.tx.iloc[0]) * TILE, int(pdf.ty.iloc[0]) * TILE
        b = np.zeros((TILE, TILE))
        for dab in pdf.sort_values("dab_no").itertuples():
            i0, i1 = max(int(dab.x0), tx) - tx, min(int(dab.x1), tx + TILE - 1) - tx + 1
            j0, j1 = max(int(dab.y0), ty) - ty, min(int(dab.y1), ty + TILE - 1) - ty + 1
            part = b[j0:j1, i0:i1]
            m = mask_of(dab, brush, np.arange(tx + i0, tx + i1)[None, :], np.arange(ty + j0, ty + j1)[:, None])
            ceiling = (brush.opacity * brush.factor(brush.opacity_lut, dab.p)) * min(dab.d, 1.0)
            if brush.mode == "wash":
                part[...] = np.where(ceiling > part, part + (brush.flow * m) * (ceiling - part), part)
            else:
                part[...] = part + ((brush.flow * ceiling) * m) * (1.0 - part)
        y, x = np.nonzero(b)
        return pd.DataFrame({"x": (x + tx).astype("int32"), "y": (y + ty).astype("int32"), "b": b[y, x]})

    return df.select("dab_no", "x", "y", "p", "d", "x0", "x1", "y0", "y1", "tx", "ty").groupBy("tx", "ty").applyInPandas(run, "x int, y int, b double")


@dataclass(frozen=True)
class Target:
    kind: str  # brush, eraser or clone
    color: str = "#000000"
    mask: bool = False
    source: Rel = field(default_factory=Rel)
    offset: tuple[int, int] = (0, 0)


def _with_buffer(spark: SparkSession, s: State, rels: dict[str, Rel], b: DataFrame) -> DataFrame:
    df = frame(spark, s.w, s.h, {**rels, "e_": selections.effective(s)})
    return df.join(b, ["x", "y"], "left").withColumn("_as", F.coalesce(C("b"), F.lit(0.0)) * dec(C("e_")))


def commit(spark: SparkSession, s: State, n: Node, b: DataFrame, target: Target) -> Node:
    """The node with the stroke buffer over its pixels (or mask) as they were."""
    if target.mask:
        if n.mask is None:
            raise ScriptError("the layer has no mask")
        r, g, k = (v / 255.0 for v in color(target.color)[:3])
        luma = (0.30 * r + 0.59 * g) + 0.11 * k
        df = _with_buffer(spark, s, {"v": n.mask.rel}, b)
        v = F.when(C("_as") == 0.0, C("v")).otherwise(q(dec(C("v")) + C("_as") * (luma - dec(C("v")))))
        return replace(n, mask=replace(n.mask, rel=Rel(df.select("x", "y", v.cast("long").alias("v")), None, n.mask.rel.default)))
    if target.kind == "eraser":
        if n.lock:
            return n
        df = _with_buffer(spark, s, {"v": n.pixels}, b)
        a = q(dec(unpack(C("v"), "a")) * (1.0 - C("_as")))
        return replace(n, pixels=table(df, F.when(C("_as") == 0.0, C("v")).otherwise(pack(*(unpack(C("v"), c) for c in "rgb"), a))))
    if target.kind == "brush":
        df = _with_buffer(spark, s, {"v": n.pixels}, b)
        return replace(n, pixels=paint.over(df, n, [F.lit(v / 255.0) for v in color(target.color)[:3]], C("_as")))
    ox, oy = target.offset
    source = moved(tabled(spark, s.w, s.h, target.source), s.w, s.h, lambda x, y: x - ox, lambda x, y: y - oy)
    df = _with_buffer(spark, s, {"v": n.pixels, "c_": source}, b)
    return replace(n, pixels=paint.over(df, n, [dec(unpack(C("c_"), c)) for c in "rgb"], C("_as") * dec(unpack(C("c_"), "a"))))
