"""Looking at documents: node rows, tree dumps, statistics, thumbnails, outlines and single pixels."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import dec, q
from ..plans.document import Document, Node, State
from ..plans.relation import Rel, tabled
from . import render, selections

C = F.col
NODE = "node_id string, parent_id string, idx int, kind string, name string, visible boolean, opacity double, fill double, mode string, seed long, clip boolean, clbl boolean, lock_alpha boolean, mask_enabled boolean, mask_outside int, adj_type string, adj_params string"


def _mode(n: Node) -> str:
    return "pass" if n.kind == "group" and n.passes else n.mode


def nodes_df(spark: SparkSession, s: State) -> DataFrame:
    """The tree as an adjacency relation; idx 0 is the bottom."""
    rows: list[tuple] = []

    def add(parent: Node) -> None:
        for i, n in enumerate(parent.children):
            rows.append((n.id, parent.id, i, n.kind, n.name, n.visible, float(n.opacity), float(n.fill), _mode(n), n.seed, n.clip, n.clbl, n.lock, n.mask.enabled if n.mask else None, n.mask.outside if n.mask else None, n.adjustment or None, json.dumps(n.params) if n.adjustment else None))
            add(n)

    add(s.root)
    return spark.createDataFrame(rows, NODE)


def tree(s: State) -> str:
    """The document's structure as JSON."""

    def one(n: Node) -> dict[str, Any]:
        out: dict[str, Any] = {"id": n.id, "kind": n.kind, "name": n.name, "visible": n.visible, "opacity": n.opacity, "mode": _mode(n)}
        if n.kind == "group":
            return out | {"children": [one(c) for c in n.children]}
        out |= {"fill": n.fill, "clip": n.clip, "clbl": n.clbl}
        if n.kind == "adjustment":
            out |= {"type": n.adjustment, "params": n.params}
        return out | ({"mask": {"enabled": n.mask.enabled, "outside": n.mask.outside}} if n.mask else {})

    return json.dumps({"w": s.w, "h": s.h, "bg": s.bg, "children": [one(c) for c in s.root.children]})


def tile_statistics(spark: SparkSession, s: State, size: int = 64) -> DataFrame:
    """node_id, allocated and total tiles of each raster layer: tiles without a visible pixel need no room."""
    total = -(-s.w // size) * -(-s.h // size)
    out = None
    for n in s.root.walk():
        if n.kind == "raster":
            tiles = F.lit(0) if n.pixels.is_empty else F.countDistinct(F.floor(C("x") / F.lit(float(size))), F.floor(C("y") / F.lit(float(size))))
            df = spark.range(1) if n.pixels.is_empty else tabled(spark, s.w, s.h, n.pixels).df
            df = df.agg(F.lit(n.id).alias("node_id"), (F.max(tiles) if n.pixels.is_empty else tiles).cast("long").alias("allocated"), F.lit(total).cast("long").alias("total"))
            out = df if out is None else out.unionByName(df)
    return out if out is not None else spark.createDataFrame([], "node_id string, allocated long, total long")


def content_box(spark: SparkSession, s: State, rel: Rel) -> tuple[int, int, int, int] | None:
    return None if rel.is_empty else selections.bounds(tabled(spark, s.w, s.h, rel).df.where("v <> 0"))


def thumbnail(spark: SparkSession, s: State, most: int = 256) -> DataFrame:
    """x, y, r, g, b, a of the render, area-averaged in premultiplied doubles to at most `most` a side. Sums are in row
    order, so they don't depend on the partitions."""
    scale = min(1.0, most / max(s.w, s.h))
    w, h = max(1, int(s.w * scale)), max(1, int(s.h * scale))
    df = render.render(spark, s)
    a = dec(C("a"))
    cell = df.select(F.expr(f"cast(x * {w} div {s.w} as int)").alias("ox"), F.expr(f"cast(y * {h} div {s.h} as int)").alias("oy"), "x", "y", *((dec(C(c)) * a).alias(c) for c in "rgb"), a.alias("a"))
    lists = cell.groupBy("ox", "oy").agg(F.sort_array(F.collect_list(F.struct("y", "x", "r", "g", "b", "a"))).alias("_l"))  # one cell's pixels
    fold = lambda c: F.aggregate("_l", F.lit(0.0), lambda t, e: t + e[c])
    sums = lists.select(C("ox").alias("x"), C("oy").alias("y"), F.size("_l").alias("n"), *(fold(c).alias(c) for c in "rgba"))
    straight = lambda c: q(F.coalesce(C(c) / F.nullif(C("a"), F.lit(0.0)), F.lit(0.0)))
    out = sums.select("x", "y", *(straight(c).alias(c) for c in "rgb"), q(C("a") / C("n")).alias("a"))
    return out.select("x", "y", *(F.when(C("a") == 0, 0).otherwise(C(c)).alias(c) for c in "rgb"), "a")


def eyedropper(spark: SparkSession, s: State, x: int, y: int) -> tuple[int, int, int, int] | None:
    """The rendered pixel at a place."""
    row = render.render(spark, s).where((C("x") == x) & (C("y") == y)).select("r", "g", "b", "a").first()
    return tuple(row) if row else None


def pyramid(spark: SparkSession, s: State, levels: int) -> list[DataFrame]:
    """The render and its halvings."""
    out = [render.render(spark, s)]
    for _ in range(levels):
        out.append(render.mean_by(out[-1], lambda c: F.floor(c / F.lit(2.0)).cast("int")))
    return out


def outline(spark: SparkSession, s: State) -> list[list[tuple[int, int]]]:
    """Closed polylines around the selected pixels (coverage 128 and above), inside on the right, without points in the
    middle of a straight part. Boundary edges come from an anti join; joining them up is a walk over the boundary alone."""
    on = tabled(spark, s.w, s.h, selections.effective(s)).df.where("v >= 128").select("x", "y")
    sides = {(0, -1): (0, 0, 1, 0), (1, 0): (1, 0, 1, 1), (0, 1): (1, 1, 0, 1), (-1, 0): (0, 1, 0, 0)}
    edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for (dx, dy), (ax, ay, bx, by) in sides.items():
        inner = on.select((C("x") - dx).alias("x"), (C("y") - dy).alias("y"))
        for r in on.join(inner, ["x", "y"], "left_anti").toLocalIterator():
            edges.setdefault((r["x"] + ax, r["y"] + ay), []).append((r["x"] + bx, r["y"] + by))
    loops = []
    while edges:
        start = min(edges, key=lambda p: (p[1], p[0]))
        loop, at, way = [], start, (1, 0)
        while at in edges:
            right = (-way[1], way[0])
            options = edges[at]
            to = next((p for p in options if (p[0] - at[0], p[1] - at[1]) == right), options[0])
            options.remove(to)
            if not options:
                del edges[at]
            step = (to[0] - at[0], to[1] - at[1])
            if not loop or step != way:
                loop.append(at)
            at, way = to, step
        loops.append(loop)
    return loops


def changed_tiles(before: DataFrame, after: DataFrame, size: int = 64) -> DataFrame:
    """tx, ty of tiles that differ between two renders: what has to be drawn again."""

    def hashed(df: DataFrame, name: str) -> DataFrame:
        tiles = df.select(F.floor(C("x") / F.lit(float(size))).alias("tx"), F.floor(C("y") / F.lit(float(size))).alias("ty"), F.xxhash64("x", "y", "r", "g", "b", "a").alias("h"))
        return tiles.groupBy("tx", "ty").agg(F.bit_xor("h").alias(name))

    both = hashed(before, "h1").join(hashed(after, "h2"), ["tx", "ty"], "full")
    return both.where(~C("h1").eqNullSafe(C("h2"))).select("tx", "ty")


def crop_to_selection(spark: SparkSession, doc: Document) -> dict[str, Any] | None:
    """The crop op for the selection's bounds."""
    if not doc.state.active:
        return None
    box = selections.bounds(tabled(spark, doc.state.w, doc.state.h, doc.state.selection).df.where("v > 0"))
    return {"op": "crop"} | dict(zip(("x", "y", "w", "h"), box, strict=True)) if box else None
