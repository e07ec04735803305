"""Rendering: the ordered fold of a layer tree over a backdrop, as a chain of projections over one frame.

All tables that a render reads are brought onto the canvas by one frame() (one shuffle); the fold itself is arithmetic
on columns, each formula step a Project of its own, so whole-stage codegen covers it and no expression is copied.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import adjust, blend
from ..functions.rules import dec, pack, pixel_hash, q, unit, unpack, wrapping
from ..plans.document import Node, ScriptError, State
from ..plans.relation import Rel, frame, table

C = F.col


class Fold:
    """The columns x, y, the relations' values, and running buffers named by a prefix (prefix + r, g, b, a: bytes)."""

    def __init__(self, spark: SparkSession, w: int, h: int, rels: dict[str, Rel], dense: bool = True) -> None:
        self.spark, self.df, self.n = spark, frame(spark, w, h, rels, dense), 0
        self.kept = list(self.df.columns)

    def fresh(self) -> str:
        self.n += 1
        return f"b{self.n}_"

    def add(self, columns: dict[str, Column]) -> None:
        self.df = self.df.withColumns(columns)

    def keep(self, prefix: str, values: dict[str, Column]) -> None:
        """New buffer columns; columns that only a step needed are dropped."""
        named = {prefix + k: v for k, v in values.items()}
        self.df = self.df.select(*[c for c in self.kept if c not in named], *(v.cast("int").alias(k) for k, v in named.items()))
        self.kept = list(self.df.columns)

    def buffer(self, value: Column) -> str:
        p = self.fresh()
        self.keep(p, {c: unpack(value, c) for c in "rgba"})
        return p

    def copy(self, prefix: str) -> str:
        p = self.fresh()
        self.keep(p, {c: C(prefix + c) for c in "rgba"})
        return p

    def _coverage(self, c: Column, mode: str, seed: int) -> None:
        if mode == "diss":
            with wrapping(self.spark):
                self.df = pixel_hash(self.df.withColumn("_c0", c), seed, {"_u": 5})
                self.add({"_c": F.when(unit(C("_u")) < C("_c0"), 1.0).otherwise(0.0)})
        else:
            self.add({"_c": c.cast("double")})

    def _blended(self, mode: str, back: str, source: Sequence[Column]) -> None:
        """_cb0.., _cs0.. and _bl0..; source: bytes."""
        self.add({f"_cb{i}": dec(C(back + c)) for i, c in enumerate("rgb")} | {f"_cs{i}": dec(s) for i, s in enumerate(source)} | {f"_s8{i}": s for i, s in enumerate(source)})
        if mode in ("norm", "diss"):
            self.add({f"_bl{i}": C(f"_cs{i}") for i in range(3)})
            return
        three = lambda p: tuple(C(f"{p}{i}") for i in range(3))
        for step in blend.steps(mode, three("_cb"), three("_cs"), tuple(C(back + c) for c in "rgb"), three("_s8")):
            self.add(step(C))

    def composite(self, back: str, source: Sequence[Column], c: Column, mode: str = "norm", seed: int = 0) -> None:
        """A source of coverage c onto the buffer `back`, in place."""
        self._coverage(c, mode, seed)
        self._blended(mode, back, source)
        ab, a = C("_ab"), C("_c")
        self.add({"_ab": dec(C(back + "a"))})
        plain = mode in ("norm", "diss")
        self.add({"_ao": a + ab * (1.0 - a)} | {f"_m{i}": C(f"_cs{i}") if plain else (1.0 - ab) * C(f"_cs{i}") + ab * C(f"_bl{i}") for i in range(3)})
        over = F.nullif(C("_ao"), F.lit(0.0))
        self.add({f"_o{i}": q((a * C(f"_m{i}") + (ab * C(f"_cb{i}")) * (1.0 - a)) / over) for i in range(3)} | {"_oa": q(C("_ao"))})
        self._store(back, C("_oa"))

    def _store(self, back: str, alpha: Column) -> None:
        clear = alpha == 0
        self.keep(back, {c: F.when(clear, 0).otherwise(F.coalesce(C(f"_o{i}"), F.lit(0))) for i, c in enumerate("rgb")} | {"a": alpha})

    def adjust(self, back: str, node: Node, c: Column) -> None:
        """An adjustment of coverage c onto the buffer, alpha kept."""
        self._coverage(c, node.mode, node.seed)
        for step in adjust.steps(node.adjustment, node.params, tuple(C(back + k) for k in "rgb")):
            self.add(step(C))
        self._blended(node.mode, back, [C(f"_ad{i}") for i in range(3)])
        self.add({f"_o{i}": q((1.0 - C("_c")) * C(f"_cb{i}") + C("_c") * C(f"_bl{i}")) for i in range(3)})
        self._store(back, C(back + "a"))

    def mix(self, back: str, before: str, after: str, w: Column) -> None:
        """Pass-through groups: back becomes the premultiplied mixture of before and after."""
        self.add({"_w": w.cast("double"), "_a0": dec(C(before + "a")), "_ar": dec(C(after + "a"))})
        self.add({"_k0": (1.0 - C("_w")) * C("_a0"), "_kr": C("_w") * C("_ar")})
        self.add({"_ao": C("_k0") + C("_kr")})
        over = F.nullif(C("_ao"), F.lit(0.0))
        self.add({f"_o{i}": q((C("_k0") * dec(C(before + c)) + C("_kr") * dec(C(after + c))) / over) for i, c in enumerate("rgb")} | {"_oa": q(C("_ao"))})
        self._store(back, C("_oa"))

    def packed(self, prefix: str) -> Column:
        return pack(*(C(prefix + c) for c in "rgba"))


def column(kind: str, node: Node) -> str:
    """The column of a node's pixels (p) or mask (m); any id makes a plain name."""
    return f"{kind}_{node.id.encode().hex()}"


def needed(nodes: Sequence[Node]) -> dict[str, Rel]:
    """The relations that a render of the nodes reads; hidden nodes are pruned."""
    out: dict[str, Rel] = {}
    for n in nodes:
        if n.visible:
            if n.kind == "raster" and not n.pixels.is_empty:
                out[column("p", n)] = n.pixels
            if n.mask and n.mask.enabled:
                out[column("m", n)] = n.mask.rel
            out |= needed(n.children)
    return out


class Renderer:
    def __init__(self, fold: Fold) -> None:
        self.fold = fold

    def _mask(self, n: Node) -> Column:
        return dec(C(column("m", n))) if n.mask and n.mask.enabled else F.lit(1.0)

    def _pixel(self, n: Node, c: str) -> Column:
        return F.lit(0) if n.pixels.is_empty else unpack(C(column("p", n)), c)

    def _shape(self, n: Node) -> Column:
        return dec(self._pixel(n, "a")) * self._mask(n)

    def _own(self, n: Node) -> Column:
        start = self._shape(n) if n.kind == "raster" else F.lit(1.0) * self._mask(n)
        return (start * F.lit(float(n.fill))) * F.lit(float(n.opacity))

    def lone(self, n: Node, back: str, c: Column | None = None) -> None:
        if n.kind == "group":
            self.group(n, back)
        elif n.kind == "adjustment":
            self.fold.adjust(back, n, self._own(n) if c is None else c)
        elif not n.pixels.is_empty:
            self.fold.composite(back, [self._pixel(n, k) for k in "rgb"], self._own(n) if c is None else c, n.mode, n.seed)

    def group(self, n: Node, back: str) -> None:
        if not any(c.visible for c in n.children):
            return
        w = self._mask(n) * F.lit(float(n.opacity))
        if n.passes:
            before = self.fold.copy(back)
            after = self.fold.copy(back)
            self.children(n.children, after)
            self.fold.mix(back, before, after, w)
        else:
            inner = self.fold.buffer(F.lit(0).cast("long"))
            self.children(n.children, inner)
            self.fold.composite(back, [C(inner + k) for k in "rgb"], (dec(C(inner + "a")) * self._mask(n)) * F.lit(float(n.opacity)), n.mode, n.seed)

    def clip_interior(self, base: Node, members: Sequence[Node]) -> str:
        seed = q(F.lit(float(base.fill)))
        g = self.fold.buffer(pack(*(self._pixel(base, k) for k in "rgb"), seed))
        for m in members:
            self.lone(m, g)
        return g

    def clipped(self, base: Node, members: Sequence[Node], back: str) -> None:
        shape = self._shape(base)
        if base.clbl:
            g = self.clip_interior(base, members)
            self.fold.composite(back, [C(g + k) for k in "rgb"], (shape * dec(C(g + "a"))) * F.lit(float(base.opacity)), base.mode, base.seed)
        else:
            self.lone(base, back)
            for m in members:
                self.lone(m, back, (self._own(m) * shape) * F.lit(float(base.opacity)))

    def children(self, nodes: Sequence[Node], back: str) -> None:
        i = 0
        while i < len(nodes):
            base, j = nodes[i], i + 1
            if base.kind == "raster" and not base.clip:
                while j < len(nodes) and nodes[j].clip and nodes[j].kind in ("raster", "adjustment"):
                    j += 1
            if base.visible:
                members = [n for n in nodes[i + 1 : j] if n.visible]
                if members:
                    self.clipped(base, members, back)
                else:
                    self.lone(base, back)
            i = j


def render(spark: SparkSession, s: State, onto_bg: bool = True, nodes: Sequence[Node] | None = None) -> DataFrame:
    """x, y, r, g, b, a (bytes) of every pixel of the document."""
    fold, back = _render(spark, s, onto_bg, s.root.children if nodes is None else nodes)
    return fold.df.select("x", "y", *(C(back + c).alias(c) for c in "rgba"))


def _render(spark: SparkSession, s: State, onto_bg: bool, nodes: Sequence[Node]) -> tuple[Fold, str]:
    fold = Fold(spark, s.w, s.h, needed(nodes))
    back = fold.buffer(F.lit(s.bg if onto_bg else 0).cast("long"))
    Renderer(fold).children(nodes, back)
    return fold, back


def rendered(spark: SparkSession, s: State, onto_bg: bool, nodes: Sequence[Node] | None = None) -> Rel:
    fold, back = _render(spark, s, onto_bg, s.root.children if nodes is None else nodes)
    return table(fold.df, fold.packed(back))


def merge_pair(spark: SparkSession, s: State, upper: Node, lower: Node) -> Rel:
    """The pixels of two neighbours merged: a clipped upper onto its base keeps the base's shape."""
    if upper.clip and not lower.clip:
        fold = Fold(spark, s.w, s.h, needed([lower, upper]))
        r = Renderer(fold)
        g = r.clip_interior(lower, [upper])
        back = fold.fresh()
        fold.add({"_oa": q(r._shape(lower) * dec(C(g + "a")))} | {f"_o{i}": C(g + c) for i, c in enumerate("rgb")})
        fold._store(back, C("_oa"))
        return table(fold.df, fold.packed(back))
    fold = Fold(spark, s.w, s.h, needed([lower, upper]))
    r = Renderer(fold)
    shape = r._shape(lower) * F.lit(float(lower.fill))
    fold.add({"_oa": q(shape)} | {f"_o{i}": r._pixel(lower, c) for i, c in enumerate("rgb")})
    back = fold.fresh()
    fold._store(back, C("_oa"))
    r.lone(upper, back)
    return table(fold.df, fold.packed(back))


def check_merge(s: State, upper_id: str) -> tuple[Node, Node]:
    upper = s.require(upper_id, "raster", "adjustment")
    parent, i = s.parent_of(upper_id)
    if i == 0 or parent.children[i - 1].kind != "raster":
        raise ScriptError(f"nothing to merge {upper_id!r} into")
    lower = parent.children[i - 1]
    if not (upper.visible and lower.visible):
        raise ScriptError("both layers must be visible")
    if i + 1 < len(parent.children) and parent.children[i + 1].clip:
        raise ScriptError("the layer above is clipped to this one")
    return upper, lower


def mean_by(df: DataFrame, of: Callable[[Column], Column]) -> DataFrame:
    """Means of 2 x 2 blocks of premultiplied bytes, the display pyramid's next level; of: block coordinate of x or y."""
    pre = lambda c: F.floor((C(c) * C("a") + 127) / F.lit(255.0))
    cells = df.select(of(C("x")).alias("x"), of(C("y")).alias("y"), *(pre(c).alias(c) for c in "rgb"), "a")
    return cells.groupBy("x", "y").agg(*(F.expr(f"cast((sum({c}) + 2) div 4 as int)").alias(c) for c in "rgba"))
