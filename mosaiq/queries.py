"""Queries over the test tables: each applies one operator to canvases made of their rows, with the same formula in SQL.

`src` is made of events (100 wide, all four channels vary), `back` of orders (opaque), both keyed without gaps by their
ids; the canvas has a row for every 100 events.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import adjust, blend
from .functions.rules import pack, q, unpack
from .operators import inspect, render, selections, stroke
from .plans import script
from .plans.document import Document, Node
from .plans.relation import Rel
from .streaming.strokes import batch_dabs

C = F.col
W = 100
#: Bytes that stand for names (fixed values, in the tables' alphabetical order).
_EVENT_TYPES, _PRIORITIES = (20, 80, 140, 200, 250), (10, 70, 130, 190, 240)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _rank_byte(col: Column, bytes_: tuple[int, ...]) -> Column:
    """A byte from the first letters, so that no look-up table is needed."""
    return F.element_at(F.array(*map(F.lit, bytes_)), (F.pmod(F.ascii(col) * 7 + F.length(col), F.lit(5)) + 1).cast("int"))


def source(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("double")
    v = pack(q(C("value") / 500.0), (C("user_id") * 37 % 256).cast("int"), _rank_byte(C("event_type"), _EVENT_TYPES), q(k / 99.0))
    return e.select((C("event_id") % W).cast("int").alias("x"), F.expr(f"cast(event_id div {W} as int)").alias("y"), v.alias("v"))


def backdrop(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    v = pack(q(C("o_totalprice") / 500000.0), (C("o_custkey") * 11 % 256).cast("int"), _rank_byte(C("o_orderpriority"), _PRIORITIES), F.lit(255))
    return o.select((C("o_orderkey") % W).cast("int").alias("x"), F.expr(f"cast(o_orderkey div {W} as int)").alias("y"), v.alias("v"))


def document(spark: SparkSession, sf: str, layers: str = "bs") -> Document:
    """A document with the layers back (b) and src (s), as high as the larger of their tables needs."""
    keys = {"b": ("orders", "o_orderkey"), "s": ("events", "event_id")}
    h = max((spark.read.parquet(f"{sf}/{keys[k][0]}.parquet").agg(F.max(keys[k][1])).first()[0] + W) // W for k in layers)
    doc = Document(W, h)
    nodes = {"b": lambda: Node("back", "raster", pixels=Rel(backdrop(spark, sf))), "s": lambda: Node("src", "raster", pixels=Rel(source(spark, sf)))}
    doc.state = doc.state.insert("root", None, *(nodes[k]() for k in layers))
    return doc


def _rendered(layers: str, *ops: dict[str, Any]) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        doc = document(spark, sf, layers)
        for values in ops:
            script.apply(spark, doc, values)
        return render.render(spark, doc.state)

    return query


def _selected(*ops: dict[str, Any]) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        doc = document(spark, sf, "s")
        for values in ops:
            script.apply(spark, doc, values)
        rel = selections.tabled(spark, doc.state.w, doc.state.h, doc.state.selection)
        return rel.df.where("v > 0").select("x", "y", C("v").cast("int").alias("s"))

    return query


# -- SQL ----------------------------------------------------------------------------------------------------------


def sq(v: str) -> str:
    """The encoder in SQL."""
    y = f"(least(greatest({v}, 0.0::DOUBLE), 1.0::DOUBLE) * 255.0::DOUBLE)"
    return f"CAST(floor({y}) + CASE WHEN {y} - floor({y}) >= 0.5 THEN 1 ELSE 0 END AS INTEGER)"


def _bytes(col: str, values: tuple[int, ...]) -> str:
    return f"[{', '.join(map(str, values))}][CAST((ascii({col}) * 7 + length({col})) % 5 + 1 AS INTEGER)]"


S_SRC = f"""SELECT CAST(event_id % 100 AS INTEGER) x, CAST(event_id // 100 AS INTEGER) y, CASE WHEN a = 0 THEN 0 ELSE r END r, CASE WHEN a = 0 THEN 0 ELSE g END g, CASE WHEN a = 0 THEN 0 ELSE b END b, a FROM (SELECT event_id, {sq('value / 500.0::DOUBLE')} r, CAST(user_id * 37 % 256 AS INTEGER) g, {_bytes('event_type', _EVENT_TYPES)} b, {sq("CAST(json_extract_string(props, '$.k') AS DOUBLE) / 99.0::DOUBLE")} a FROM events)"""
S_BACK = f"""SELECT CAST(o_orderkey % 100 AS INTEGER) x, CAST(o_orderkey // 100 AS INTEGER) y, {sq('o_totalprice / 500000.0::DOUBLE')} r, CAST(o_custkey * 11 % 256 AS INTEGER) g, {_bytes('o_orderpriority', _PRIORITIES)} b, 255 a FROM orders"""
#: The source on the whole canvas of a document with both layers: it has no pixel beyond its table.
S_TOP = f"SELECT q.x, q.y, coalesce(t.r, 0) r, coalesce(t.g, 0) g, coalesce(t.b, 0) b, coalesce(t.a, 0) a FROM ({S_BACK}) q LEFT JOIN ({S_SRC}) t ON q.x = t.x AND q.y = t.y"
S_SIZE = "(SELECT CAST((max(event_id) + 100) // 100 AS INTEGER) FROM events)"


def _div(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0.0::DOUBLE)"


def s_burn(b: str, s: str) -> str:
    return f"CASE WHEN {b} = 1 THEN 1.0::DOUBLE WHEN {s} = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - least(1.0::DOUBLE, {_div(f'1.0::DOUBLE - {b}', s)}) END"


def s_dodge(b: str, s: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0::DOUBLE WHEN {s} = 1 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, {_div(b, f'1.0::DOUBLE - {s}')}) END"


def s_hard(b: str, s: str) -> str:
    return f"CASE WHEN {s} <= 0.5 THEN {b} * (2.0::DOUBLE * {s}) ELSE 1.0::DOUBLE - (1.0::DOUBLE - {b}) * (1.0::DOUBLE - (2.0::DOUBLE * {s} - 1.0::DOUBLE)) END"


_SQL_MODES: dict[str, Callable[[str, str], str]] = {
    "norm": lambda b, s: s,
    "dark": lambda b, s: f"least({b}, {s})",
    "lite": lambda b, s: f"greatest({b}, {s})",
    "mul": lambda b, s: f"{b} * {s}",
    "scrn": lambda b, s: f"1.0::DOUBLE - (1.0::DOUBLE - {b}) * (1.0::DOUBLE - {s})",
    "over": lambda b, s: s_hard(s, b),
    "hLit": s_hard,
    "div": s_dodge,
    "idiv": s_burn,
    "sLit": lambda b, s: f"CASE WHEN {s} <= 0.5 THEN {b} - (1.0::DOUBLE - 2.0::DOUBLE * {s}) * {b} * (1.0::DOUBLE - {b}) ELSE {b} + (2.0::DOUBLE * {s} - 1.0::DOUBLE) * ((CASE WHEN {b} <= 0.25 THEN ((16.0::DOUBLE * {b} - 12.0::DOUBLE) * {b} + 4.0::DOUBLE) * {b} ELSE sqrt({b}) END) - {b}) END",
    "diff": lambda b, s: f"abs({b} - {s})",
    "smud": lambda b, s: f"({b} + {s}) - (2.0::DOUBLE * {b}) * {s}",
    "lbrn": lambda b, s: f"greatest(0.0::DOUBLE, ({b} + {s}) - 1.0::DOUBLE)",
    "lddg": lambda b, s: f"least(1.0::DOUBLE, {b} + {s})",
    "fsub": lambda b, s: f"greatest(0.0::DOUBLE, {b} - {s})",
    "fdiv": lambda b, s: f"CASE WHEN {b} = 0 THEN 0.0::DOUBLE WHEN {s} = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, {_div(b, s)}) END",
    "vLit": lambda b, s: f"CASE WHEN {s} <= 0.5 THEN {s_burn(b, f'(2.0::DOUBLE * {s})')} ELSE {s_dodge(b, f'(2.0::DOUBLE * {s} - 1.0::DOUBLE)')} END",
    "lLit": lambda b, s: f"({b} + 2.0::DOUBLE * {s}) - 1.0::DOUBLE",
    "pLit": lambda b, s: f"CASE WHEN {s} <= 0.5 THEN least({b}, 2.0::DOUBLE * {s}) ELSE greatest({b}, 2.0::DOUBLE * {s} - 1.0::DOUBLE) END",
}


def _lum(p: str) -> str:
    return f"((0.3::DOUBLE * {p}0 + 0.59::DOUBLE * {p}1) + 0.11::DOUBLE * {p}2)"


def _set_sat(p: str, s: str) -> list[str]:
    high, low = f"greatest({p}0, {p}1, {p}2)", f"least({p}0, {p}1, {p}2)"
    top = f"(CASE WHEN {p}0 = {high} THEN 0 WHEN {p}1 = {high} THEN 1 ELSE 2 END)"
    bottom = f"(CASE WHEN {p}0 = {low} THEN 0 WHEN {p}1 = {low} THEN 1 ELSE 2 END)"
    return [f"CASE WHEN NOT {high} > {low} THEN 0.0::DOUBLE WHEN {top} = {i} THEN {s} WHEN {bottom} = {i} THEN 0.0::DOUBLE ELSE {_div(f'({p}{i} - {low}) * ({s})', f'{high} - {low}')} END" for i in range(3)]


_RGB = ("r", "g", "b")


def sql_blend(inner: str, mode: str) -> str:
    """inner has cb0.., cs0.. (doubles) and the bytes rb.., rs..; adds bl0...bl2 in [0, 1]."""
    clamp = lambda v: f"least(greatest({v}, 0.0::DOUBLE), 1.0::DOUBLE)"
    if mode in _SQL_MODES:
        return f"SELECT *, {', '.join(f'{clamp(_SQL_MODES[mode](f"cb{i}", f"cs{i}"))} bl{i}' for i in range(3))} FROM ({inner})"
    if mode == "hMix":
        return f"SELECT *, {', '.join(f'CASE WHEN {c}b + {c}s >= 255 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END bl{i}' for i, c in enumerate(_RGB))} FROM ({inner})"
    if mode in ("dkCl", "lgCl"):
        sign = "<" if mode == "dkCl" else ">"
        take = f"30 * rs + 59 * gs + 11 * bs {sign} 30 * rb + 59 * gb + 11 * bb"
        return f"SELECT *, {', '.join(f'CASE WHEN {take} THEN cs{i} ELSE cb{i} END bl{i}' for i in range(3))} FROM ({inner})"
    sat = lambda p: f"(greatest({p}0, {p}1, {p}2) - least({p}0, {p}1, {p}2))"
    base = _set_sat("cs", sat("cb")) if mode == "hue" else _set_sat("cb", sat("cs")) if mode == "sat" else [f"{'cs' if mode == 'colr' else 'cb'}{i}" for i in range(3)]
    one = f"SELECT *, {', '.join(f'{v} c{i}' for i, v in enumerate(base))}, {_lum('cs' if mode == 'lum' else 'cb')} target FROM ({inner})"
    two = f"SELECT *, {', '.join(f'c{i} + (target - {_lum("c")}) d{i}' for i in range(3))} FROM ({one})"
    three = f"SELECT *, {_lum('d')} l_, least(d0, d1, d2) n_, greatest(d0, d1, d2) x_ FROM ({two})"
    four = f"SELECT *, {', '.join(f'CASE WHEN n_ < 0 AND l_ - n_ > 0 THEN l_ + {_div(f"(d{i} - l_) * l_", "l_ - n_")} ELSE d{i} END e{i}' for i in range(3))} FROM ({three})"
    return f"SELECT *, {', '.join(clamp(f'CASE WHEN x_ > 1 AND x_ - l_ > 0 THEN l_ + {_div(f"(e{i} - l_) * (1.0::DOUBLE - l_)", "x_ - l_")} ELSE e{i} END') + f' bl{i}' for i in range(3))} FROM ({four})"


_M = "18446744073709551616::UHUGEINT"


def _mix_sql(z: str, levels: int = 0) -> str:
    """splitmix64 of an unsigned 64-bit expression, as nested sub-selects."""
    add = f"SELECT CAST((CAST({z} AS UHUGEINT) + 11400714819323198485::UHUGEINT) % {_M} AS UBIGINT) z"
    one = f"SELECT CAST((CAST(xor(z, z >> 30) AS UHUGEINT) * 13787848793156543929::UHUGEINT) % {_M} AS UBIGINT) z FROM ({add})"
    two = f"SELECT CAST((CAST(xor(z, z >> 27) AS UHUGEINT) * 10723151780598845931::UHUGEINT) % {_M} AS UBIGINT) z FROM ({one})"
    return f"(SELECT xor(z, z >> 31) FROM ({two}))"


def sql_hash(seed: int, k: int) -> str:
    """The pixel hash of x and y as UBIGINT."""
    place = _mix_sql("CAST(y AS UBIGINT) * 4294967296 + CAST(x AS UBIGINT)")
    stream = k * 0xD1B54A32D192ED03 % (1 << 64)
    return _mix_sql(f"xor(xor({place}, {seed}::UBIGINT), {stream}::UBIGINT)")


def sql_over(inner: str, mode: str = "norm", seed: int = 0) -> str:
    """inner: x, y, backdrop bytes rb gb bb ab, source bytes rs gs bs, coverage c; out: x, y, r, g, b, a."""
    if mode == "diss":
        inner = f"SELECT * REPLACE (CASE WHEN CAST({sql_hash(seed, 5)} >> 11 AS DOUBLE) * 1.1102230246251565e-16::DOUBLE < c THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c) FROM ({inner})"
        mode = "norm"
    values = f"SELECT *, {', '.join(f'{c}b / 255.0::DOUBLE cb{i}, {c}s / 255.0::DOUBLE cs{i}' for i, c in enumerate(_RGB))}, ab / 255.0::DOUBLE ba FROM ({inner})"
    mixed = "{0}" if mode == "norm" else "((1.0::DOUBLE - ba) * cs{1} + ba * bl{1})"
    blended = sql_blend(values, mode)
    sums = f"SELECT *, c + ba * (1.0::DOUBLE - c) ao FROM ({blended})"
    out = ", ".join(sq(_div(f"c * {mixed.format(f'cs{i}', i)} + (ba * cb{i}) * (1.0::DOUBLE - c)", "ao")) + f" o{i}" for i in range(3))
    raw = f"SELECT x, y, {out}, {sq('ao')} oa FROM ({sums})"
    return f"SELECT x, y, {', '.join(f'CAST(CASE WHEN oa = 0 THEN 0 ELSE coalesce(o{i}, 0) END AS INTEGER) {c}' for i, c in enumerate(_RGB))}, oa a FROM ({raw})"


def sql_pair(coverage: str, back: str = S_BACK, src: str = S_TOP) -> str:
    """Both layers by pixel, for sql_over(); coverage: SQL over s.a (the source's alpha byte), x and y."""
    return f"SELECT p.x, p.y, p.r rb, p.g gb, p.b bb, p.a ab, s.r rs, s.g gs, s.b bs, {coverage} c FROM ({back}) p JOIN ({src}) s ON p.x = s.x AND p.y = s.y"


def _coverage(fill: float = 1.0, opacity: float = 1.0, mask: str = "1.0::DOUBLE") -> str:
    return f"(((s.a / 255.0::DOUBLE) * ({mask})) * {fill!r}::DOUBLE) * {opacity!r}::DOUBLE"


def sql_mode(mode: str, opacity: float) -> str:
    return sql_over(sql_pair(_coverage(opacity=opacity)), mode, 7)


# -- blends and stacks --------------------------------------------------------------------------------------------

for _mode in blend.MODES:
    QUERIES[f"blend_{_mode}"] = _rendered("bs", {"op": "set_blend", "layer": "src", "mode": _mode, "seed": 7}, {"op": "set_opacity", "layer": "src", "value": 0.75})
    ORACLES[f"blend_{_mode}"] = sql_mode(_mode, 0.75)

_STACK = (
    {"op": "set_blend", "layer": "src", "mode": "sLit"}, {"op": "set_opacity", "layer": "src", "value": 0.8}, {"op": "set_fill", "layer": "src", "value": 0.9},
    {"op": "add_mask", "layer": "src", "fill": "gradient", "from": 40, "to": 250},
    {"op": "add_layer", "id": "top", "fill": "solid", "color": "#C03050B0", "rect": [10, 2, 60, 400000]}, {"op": "set_blend", "layer": "top", "mode": "mul"},
)
_mask_sql = sq("40 / 255.0::DOUBLE + (s.x / 99.0::DOUBLE) * (250 / 255.0::DOUBLE - 40 / 255.0::DOUBLE)") + " / 255.0::DOUBLE"
_two = sql_over(sql_pair(_coverage(0.9, 0.8, _mask_sql)), "sLit")
_inside = "p.x >= 10 AND p.x < 70 AND p.y >= 2"
QUERIES["composite_stack"] = _rendered("bs", *_STACK)
ORACLES["composite_stack"] = sql_over(f"SELECT p.x, p.y, p.r rb, p.g gb, p.b bb, p.a ab, CASE WHEN {_inside} THEN 192 ELSE 0 END rs, CASE WHEN {_inside} THEN 48 ELSE 0 END gs, CASE WHEN {_inside} THEN 80 ELSE 0 END bs, CASE WHEN {_inside} THEN 176 / 255.0::DOUBLE ELSE 0.0::DOUBLE END c FROM ({_two}) p", "mul")

_EMPTY_BACK = f"SELECT x, y, 0 r, 0 g, 0 b, 0 a FROM ({S_TOP})"
_group = ({"op": "add_group", "id": "g", "mode": "isolated"}, {"op": "move_layer", "id": "src", "parent": "g"}, {"op": "set_opacity", "layer": "g", "value": 0.6})
_inner = sql_over(sql_pair(_coverage(), _EMPTY_BACK), "mul")
QUERIES["group_isolated"] = _rendered("bs", *_group, {"op": "set_blend", "layer": "src", "mode": "mul"})
ORACLES["group_isolated"] = sql_over(sql_pair("((s.a / 255.0::DOUBLE) * 1.0::DOUBLE) * 0.6::DOUBLE", S_BACK, _inner))
QUERIES["group_pass"] = _rendered("bs", *_group, {"op": "set_blend", "layer": "src", "mode": "mul"}, {"op": "set_group_mode", "layer": "g", "mode": "pass"})
_after = sql_over(sql_pair(_coverage()), "mul")
_lerp = f"SELECT p.x, p.y, p.r r0, p.g g0, p.b b0, (1.0::DOUBLE - 0.6::DOUBLE) * (p.a / 255.0::DOUBLE) k0, s.r r1, s.g g1, s.b b1, 0.6::DOUBLE * (s.a / 255.0::DOUBLE) k1 FROM ({S_BACK}) p JOIN ({_after}) s ON p.x = s.x AND p.y = s.y"
ORACLES["group_pass"] = f"SELECT x, y, {', '.join(sq(_div(f'k0 * ({c}0 / 255.0::DOUBLE) + k1 * ({c}1 / 255.0::DOUBLE)', 'k0 + k1')) + ' ' + c for c in _RGB)}, {sq('k0 + k1')} a FROM ({_lerp})"

_clip = ({"op": "add_layer", "id": "c", "fill": "solid", "color": "#20E06080"}, {"op": "set_clip", "layer": "c", "value": True}, {"op": "set_fill", "layer": "src", "value": 0.5}, {"op": "set_opacity", "layer": "src", "value": 0.9}, {"op": "set_blend", "layer": "c", "mode": "diff"})
QUERIES["clip_on"] = _rendered("bs", *_clip)
_seed = f"SELECT x, y, CASE WHEN f = 0 THEN 0 ELSE r END rb, CASE WHEN f = 0 THEN 0 ELSE g END gb, CASE WHEN f = 0 THEN 0 ELSE b END bb, f ab, 32 rs, 224 gs, 96 bs, ((128 / 255.0::DOUBLE) * 1.0::DOUBLE) * 1.0::DOUBLE c FROM (SELECT *, {sq('0.5::DOUBLE')} f FROM ({S_TOP}))"
_built = sql_over(_seed, "diff")
ORACLES["clip_on"] = sql_over(f"SELECT p.x, p.y, p.r rb, p.g gb, p.b bb, p.a ab, g.r rs, g.g gs, g.b bs, ((s.a / 255.0::DOUBLE) * 1.0::DOUBLE * (g.a / 255.0::DOUBLE)) * 0.9::DOUBLE c FROM ({S_BACK}) p JOIN ({S_TOP}) s ON p.x = s.x AND p.y = s.y JOIN ({_built}) g ON p.x = g.x AND p.y = g.y")
QUERIES["clip_off"] = _rendered("bs", *_clip, {"op": "set_clbl", "layer": "src", "value": False})
_based = sql_over(sql_pair(_coverage(0.5, 0.9)))
ORACLES["clip_off"] = sql_over(f"SELECT p.x, p.y, p.r rb, p.g gb, p.b bb, p.a ab, 32 rs, 224 gs, 96 bs, ((128 / 255.0::DOUBLE) * (s.a / 255.0::DOUBLE)) * 0.9::DOUBLE c FROM ({_based}) p JOIN ({S_TOP}) s ON p.x = s.x AND p.y = s.y", "diff")
QUERIES["merge_down"] = _rendered("bs", {"op": "set_blend", "layer": "src", "mode": "scrn"}, {"op": "merge_down", "layer": "src"})
ORACLES["merge_down"] = sql_over(sql_pair(_coverage()), "scrn")
QUERIES["merge_visible"] = _rendered("bs", {"op": "set_visible", "layer": "back", "value": False}, {"op": "merge_visible"})
ORACLES["merge_visible"] = f"SELECT x, y, r, g, b, a FROM ({S_TOP})"
QUERIES["flatten"] = _rendered("bs", {"op": "flatten"})
ORACLES["flatten"] = sql_over(sql_pair(_coverage()))
QUERIES["undo_asof"] = _rendered("bs", {"op": "delete_layer", "layer": "src"}, {"op": "set_opacity", "layer": "back", "value": 0.1}, {"op": "undo", "steps": 2})
ORACLES["undo_asof"] = ORACLES["flatten"]

# -- adjustments --------------------------------------------------------------------------------------------------

_PARAMS: dict[str, dict[str, Any]] = {
    "levels": {"rgb": {"in_black": 20, "in_white": 235, "gamma": 1.4}, "r": {"out_black": 200, "out_white": 10}},
    "curves": {"rgb": [[0, 10], [60, 90], [128, 120], [255, 240]], "b": [[20, 0], [200, 255]]},
    "brightness_contrast": {"brightness": 0.3, "contrast": 0.4},
    "hue_saturation": {"hue": 75.0, "saturation": 35.0, "lightness": -12.0},
    "black_white": {"reds": 120.0, "blues": -40.0},
    "invert": {},
    "posterize": {"levels": 5},
    "threshold": {"level": 120},
}


def _sql_curve(points: list, v: str) -> str:
    """A natural cubic spline of two or four points in SQL; the slopes' equations are solved by Cramer's rule."""
    x, y = [f"{p[0]}.0::DOUBLE" for p in points], [f"{p[1]}.0::DOUBLE" for p in points]
    n = len(points) - 1
    h = [f"({x[i + 1]} - {x[i]})" for i in range(n)]
    rise = [f"(({y[i + 1]} - {y[i]}) / {h[i]})" for i in range(n)]
    m = ["0.0::DOUBLE"] * (n + 1)
    if n == 3:
        r1, r2 = f"(6 * ({rise[1]} - {rise[0]}))", f"(6 * ({rise[2]} - {rise[1]}))"
        d1, d2 = f"(2 * ({h[0]} + {h[1]}))", f"(2 * ({h[1]} + {h[2]}))"
        det = f"({d1} * {d2} - {h[1]} * {h[1]})"
        m[1:3] = f"(({r1} * {d2} - {h[1]} * {r2}) / {det})", f"(({d1} * {r2} - {h[1]} * {r1}) / {det})"
    t = f"least(greatest({v}, {x[0]}), {x[-1]})"
    piece = lambda i: f"({m[i]} * pow({x[i + 1]} - {t}, 3) + {m[i + 1]} * pow({t} - {x[i]}, 3)) / (6 * {h[i]}) + ({y[i]} / {h[i]} - {m[i]} * {h[i]} / 6) * ({x[i + 1]} - {t}) + ({y[i + 1]} / {h[i]} - {m[i + 1]} * {h[i]} / 6) * ({t} - {x[i]})"
    pieces = "".join(f" WHEN {t} < {x[i + 1]} THEN {piece(i)}" for i in range(n - 1))
    return f"least(greatest(CASE{pieces} ELSE {piece(n - 1)} END, 0.0::DOUBLE), 255.0::DOUBLE)" if n > 1 else f"least(greatest({piece(0)}, 0.0::DOUBLE), 255.0::DOUBLE)"


def _sql_table(kind: str, c: str) -> str:
    """The new byte of a channel, written out for _PARAMS."""
    v = f"({c} / 255.0::DOUBLE)"
    clamp = lambda e: f"least(greatest({e}, 0.0::DOUBLE), 1.0::DOUBLE)"
    if kind == "posterize":
        return sq(f"round({v} * 4) / 4")
    if kind == "brightness_contrast":
        return sq(f"({v} + (1 - {v}) * 0.15::DOUBLE - 0.5::DOUBLE) * tan(0.35::DOUBLE * pi()) + 0.5::DOUBLE")
    if kind == "levels":
        first = f"((200 - 190 * {v}) / 255.0::DOUBLE)" if c == "r" else v
        return sq(f"pow({clamp(f'({first} * 255.0::DOUBLE - 20) / 215.0::DOUBLE')}, 1 / 1.4::DOUBLE)")
    p = _PARAMS["curves"]
    return sq(f"({_sql_curve(p['rgb'], _sql_curve(p[c], f'({c} * 1.0::DOUBLE)') if c in p else f'({c} * 1.0::DOUBLE)')}) / 255.0::DOUBLE")


def _sql_adjusted(kind: str) -> str:
    """x, y, r, g, b, a of the source with the adjustment."""
    p = adjust.read(kind, _PARAMS[kind])
    zero = lambda v: f"CAST(CASE WHEN a = 0 THEN 0 ELSE {v} END AS INTEGER)"
    if kind == "invert":
        values = [f"255 - {c}" for c in _RGB]
    elif kind in ("levels", "curves", "brightness_contrast", "posterize"):
        values = [_sql_table(kind, c) for c in _RGB]
    elif kind == "threshold":
        values = ["CASE WHEN (299 * r + 587 * g + 114 * b + 500) // 1000 >= 120 THEN 255 ELSE 0 END"] * 3
    elif kind == "black_white":
        w = p
        first = f"CASE WHEN r = mx THEN {w['reds'] / 100.0!r}::DOUBLE WHEN g = mx THEN {w['greens'] / 100.0!r}::DOUBLE ELSE {w['blues'] / 100.0!r}::DOUBLE END"
        second = f"CASE WHEN b = mn THEN {w['yellows'] / 100.0!r}::DOUBLE WHEN r = mn THEN {w['cyans'] / 100.0!r}::DOUBLE ELSE {w['magentas'] / 100.0!r}::DOUBLE END"
        grey = f"((mn + (md - mn) * ({second})) + (mx - md) * ({first})) / 255.0::DOUBLE"
        return f"SELECT x, y, {', '.join(zero('o') + ' ' + c for c in _RGB)}, a FROM (SELECT *, {sq('v')} o FROM (SELECT *, {grey} v FROM (SELECT *, r + g + b - mx - mn md FROM (SELECT *, greatest(r, g, b) mx, least(r, g, b) mn FROM ({S_SRC})))))"
    else:
        one = f"SELECT *, r / 255.0::DOUBLE rr, g / 255.0::DOUBLE gg, b / 255.0::DOUBLE bb FROM ({S_SRC})"
        two = f"SELECT *, greatest(rr, gg, bb) hi, least(rr, gg, bb) lo FROM ({one})"
        three = f"SELECT *, hi - lo d, (hi + lo) / 2.0::DOUBLE l1 FROM ({two})"
        sat = f"CASE WHEN d = 0 THEN 0.0::DOUBLE WHEN l1 <= 0.5 THEN {_div('d', 'hi + lo')} ELSE {_div('d', '(2.0::DOUBLE - hi) - lo')} END"
        hue = f"CASE WHEN d = 0 THEN 0.0::DOUBLE WHEN rr = hi THEN {_div('gg - bb', 'd')} WHEN gg = hi THEN 2.0::DOUBLE + {_div('bb - rr', 'd')} ELSE 4.0::DOUBLE + {_div('rr - gg', 'd')} END"
        four = f"SELECT *, {sat} s1, {hue} h1 FROM ({three})"
        five = f"SELECT *, CASE WHEN h1 < 0 THEN h1 + 6.0::DOUBLE ELSE h1 END + {75.0 / 60.0!r}::DOUBLE h2, l1 * ({-12.0 / 100.0!r}::DOUBLE + 1.0::DOUBLE) l, least(greatest(s1 * {1.0 + 35.0 / 100.0!r}::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) s FROM ({four})"
        six = f"SELECT *, CASE WHEN h2 >= 6 THEN h2 - 6.0::DOUBLE WHEN h2 < 0 THEN h2 + 6.0::DOUBLE ELSE h2 END h, CASE WHEN l <= 0.5 THEN l * (1.0::DOUBLE + s) ELSE (l + s) - l * s END m2 FROM ({five})"
        seven = f"SELECT *, 2.0::DOUBLE * l - m2 m1 FROM ({six})"

        def value(shift: str) -> str:
            k = f"(h + {shift}::DOUBLE)"
            k = f"(CASE WHEN {k} > 6 THEN {k} - 6.0::DOUBLE WHEN {k} < 0 THEN {k} + 6.0::DOUBLE ELSE {k} END)"
            return sq(f"(CASE WHEN s = 0 THEN l WHEN {k} < 1 THEN m1 + (m2 - m1) * {k} WHEN {k} < 3 THEN m2 WHEN {k} < 4 THEN m1 + (m2 - m1) * (4.0::DOUBLE - {k}) ELSE m1 END)")

        return f"SELECT x, y, {', '.join(f'{zero(value(k))} {c}' for k, c in zip(('2.0', '0.0', '-2.0'), _RGB, strict=True))}, a FROM ({seven})"
    return f"SELECT x, y, {', '.join(f'{zero(v)} {c}' for v, c in zip(values, _RGB, strict=True))}, a FROM ({S_SRC})"


for _kind in adjust.TYPES:
    QUERIES[f"adj_{_kind}"] = _rendered("s", {"op": "add_adjustment", "id": "adj", "type": _kind, "params": _PARAMS[_kind]})
    ORACLES[f"adj_{_kind}"] = _sql_adjusted(_kind)

# -- selections ---------------------------------------------------------------------------------------------------

_RECT = {"op": "select_rect", "x": 5, "y": 1, "w": 40, "h": 6}
_ALPHA = {"op": "select_alpha", "layer": "src"}
_grid = f"SELECT x, y, a s0, CASE WHEN x >= 5 AND x < 45 AND y >= 1 AND y < 7 THEN 255 ELSE 0 END b0 FROM ({S_SRC})"
for _name, _expr in (("new", "b0"), ("add", "greatest(s0, b0)"), ("subtract", "greatest(s0 - b0, 0)"), ("intersect", "least(s0, b0)")):
    QUERIES[f"sel_rect_{_name}"] = _selected(_ALPHA, {**_RECT, "mode": _name})
    ORACLES[f"sel_rect_{_name}"] = f"SELECT x, y, CAST({_expr} AS INTEGER) s FROM ({_grid}) WHERE {_expr} > 0"
QUERIES["sel_alpha"] = _selected(_ALPHA)
ORACLES["sel_alpha"] = f"SELECT x, y, a s FROM ({S_SRC}) WHERE a > 0"
QUERIES["sel_inverse"] = _selected(_ALPHA, {"op": "select_inverse"})
ORACLES["sel_inverse"] = f"SELECT x, y, CAST(255 - a AS INTEGER) s FROM ({S_SRC}) WHERE a < 255"
_unnested = f"SELECT x, y, x + u.ox px, y + v.oy py FROM ({S_SRC}), (SELECT (2 * i + 1) / 32.0::DOUBLE ox FROM range(16) t(i)) u, (SELECT (2 * i + 1) / 32.0::DOUBLE oy FROM range(16) t(i)) v WHERE y < 10"
QUERIES["sel_ellipse"] = _selected({"op": "select_ellipse", "x": 3.5, "y": 0.25, "w": 60.5, "h": 8.5})
ORACLES["sel_ellipse"] = f"SELECT x, y, s FROM (SELECT x, y, {sq('n / 256.0::DOUBLE')} s FROM (SELECT x, y, count(*) n FROM (SELECT *, (px - (3.5::DOUBLE + 60.5::DOUBLE / 2)) / (60.5::DOUBLE / 2) dx, (py - (0.25::DOUBLE + 8.5::DOUBLE / 2)) / (8.5::DOUBLE / 2) dy FROM ({_unnested})) WHERE dx * dx + dy * dy <= 1 GROUP BY x, y)) WHERE s > 0"
_POINTS = [[2.0, 0.5], [80.25, 1.0], [40.0, 9.5], [10.0, 3.0], [60.0, 4.0]]
_crossings = " + ".join(f"CASE WHEN ({yi!r} > py) != ({yj!r} > py) AND px < ((({xj!r}::DOUBLE - {xi!r}::DOUBLE) * (py - {yi!r}::DOUBLE)) / ({yj!r}::DOUBLE - {yi!r}::DOUBLE)) + {xi!r}::DOUBLE THEN 1 ELSE 0 END" for (xi, yi), (xj, yj) in zip(_POINTS, [_POINTS[-1], *_POINTS[:-1]], strict=True))
QUERIES["sel_polygon"] = _selected({"op": "select_polygon", "points": _POINTS})
ORACLES["sel_polygon"] = f"SELECT x, y, s FROM (SELECT x, y, {sq('n / 256.0::DOUBLE')} s FROM (SELECT x, y, count(*) n FROM ({_unnested}) WHERE ({_crossings}) % 2 = 1 GROUP BY x, y)) WHERE s > 0"


def _box_sql(inner: str, along: str, size: str, width: int, clamp: bool, cols: tuple[str, ...], finish: Callable[[str], str]) -> str:
    """Direct sums of neighbours (a frame), ends repeated or zero."""
    if width == 1:
        return inner
    r, across = (width - 1) // 2, "y" if along == "x" else "x"
    w = f"(PARTITION BY {across} ORDER BY {along}"
    frame = f"{w} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)"
    whole = f"{w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    edge = lambda c: f" + greatest({along} + {r} - ({size} - 1), 0) * last_value({c}) OVER {whole} + greatest({r} - {along}, 0) * first_value({c}) OVER {whole}" if clamp else ""
    return f"SELECT x, y, {', '.join(f'CAST({finish(f"CAST(sum({c}) OVER {frame} AS HUGEINT){edge(c)}")} AS BIGINT) {c}' for c in cols)} FROM ({inner})"


_feathered = f"SELECT x, y, CAST(a AS BIGINT) t FROM ({S_SRC})"
_widths = selections.box_widths(4.0 / 2.0, True)
for _w in _widths:
    _feathered = _box_sql(_feathered, "x", "100", _w, True, ("t",), lambda v: v)
    _feathered = _box_sql(_feathered, "y", S_SIZE, _w, True, ("t",), lambda v: v)
_d = (_widths[0] * _widths[1] * _widths[2]) ** 2
QUERIES["feather"] = _selected(_ALPHA, {"op": "feather", "radius": 4})
ORACLES["feather"] = f"SELECT x, y, CAST(s AS INTEGER) s FROM (SELECT x, y, (2 * t + {_d}) // {2 * _d} s FROM ({_feathered})) WHERE s > 0"
for _name, _agg in (("expand", "max"), ("contract", "min")):
    QUERIES[_name] = _selected(_ALPHA, {"op": _name, "by": 2})
    ORACLES[_name] = f"SELECT x, y, CAST({_agg}(a) AS INTEGER) s FROM (SELECT CAST(x - dx AS INTEGER) x, CAST(y - dy AS INTEGER) y, a FROM ({S_SRC}), (SELECT i - 2 dx FROM range(5) t(i)), (SELECT i - 2 dy FROM range(5) t(i)) WHERE dx * dx + dy * dy <= 4) WHERE x >= 0 AND x < 100 AND y >= 0 AND y < {S_SIZE} GROUP BY x, y HAVING {_agg}(a) > 0"
QUERIES["wand_global"] = _selected({"op": "select_wand", "layer": "src", "x": 3, "y": 2, "tolerance": 60, "contiguous": False, "antialias": False})
_seedpx = f"(SELECT r sr, g sg, b sb, a sa FROM ({S_SRC}) WHERE x = 3 AND y = 2)"
ORACLES["wand_global"] = f"SELECT x, y, 255 s FROM ({S_SRC}), {_seedpx} WHERE greatest(abs(r - sr), abs(g - sg), abs(b - sb), abs(a - sa)) <= 60"
QUERIES["wand_contiguous"] = _selected({"op": "select_wand", "layer": "src", "x": 3, "y": 2, "tolerance": 170, "antialias": False})
_like = f"SELECT x, y FROM ({S_SRC}), {_seedpx} WHERE greatest(abs(r - sr), abs(g - sg), abs(b - sb), abs(a - sa)) <= 170"
ORACLES["wand_contiguous"] = f"WITH RECURSIVE m AS MATERIALIZED ({_like}), reached(x, y) AS (SELECT 3, 2 UNION SELECT m.x, m.y FROM reached r JOIN m ON m.x BETWEEN r.x - 1 AND r.x + 1 AND m.y BETWEEN r.y - 1 AND r.y + 1) SELECT CAST(x AS INTEGER) x, CAST(y AS INTEGER) y, 255 s FROM reached"

# -- paint --------------------------------------------------------------------------------------------------------


def _sql_paint(color: tuple[str, str, str], alpha: str) -> str:
    """A colour (SQL doubles) over the source layer with coverage alpha."""
    keep = f"SELECT *, {alpha} k, a / 255.0::DOUBLE ab FROM ({S_SRC})"
    out = ", ".join(f"CASE WHEN k = 0 THEN {c} ELSE {sq(_div(f'({s}) * k + (({c} / 255.0::DOUBLE) * ab) * (1.0::DOUBLE - k)', 'k + ab * (1.0::DOUBLE - k)'))} END out_{c}" for c, s in zip(_RGB, color, strict=True))
    raw = f"SELECT x, y, {out}, CASE WHEN k = 0 THEN a ELSE {sq('k + ab * (1.0::DOUBLE - k)')} END oa FROM ({keep})"
    return f"SELECT x, y, {', '.join(f'CAST(CASE WHEN oa = 0 THEN 0 ELSE out_{c} END AS INTEGER) {c}' for c in _RGB)}, CAST(oa AS INTEGER) a FROM ({raw})"


_E = "(CASE WHEN x >= 5 AND x < 45 AND y >= 1 AND y < 7 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
QUERIES["fill_selection"] = _rendered("s", _RECT, {"op": "fill_selection", "layer": "src", "color": "#C08040E0", "opacity": 0.7})
ORACLES["fill_selection"] = _sql_paint(tuple(f"{v} / 255.0::DOUBLE" for v in (192, 128, 64)), f"((224 / 255.0::DOUBLE) * 0.7::DOUBLE) * {_E}")
for _type, _t in (("linear", "(((x + 0.5::DOUBLE) - 4.0::DOUBLE) * 70.0::DOUBLE + ((y + 0.5::DOUBLE) - 1.0::DOUBLE) * 6.0::DOUBLE) / 4936.0::DOUBLE"), ("radial", "sqrt(((x + 0.5::DOUBLE) - 4.0::DOUBLE) * ((x + 0.5::DOUBLE) - 4.0::DOUBLE) + ((y + 0.5::DOUBLE) - 1.0::DOUBLE) * ((y + 0.5::DOUBLE) - 1.0::DOUBLE)) / sqrt(4936.0::DOUBLE)")):
    _ct = f"least(greatest({_t}, 0.0::DOUBLE), 1.0::DOUBLE)"
    _ramp = [f"({a} / 255.0::DOUBLE + ({b} / 255.0::DOUBLE - {a} / 255.0::DOUBLE) * {_ct})" for a, b in ((16, 240), (32, 200), (48, 16), (255, 64))]
    QUERIES[f"gradient_{_type}"] = _rendered("s", _RECT, {"op": "gradient", "layer": "src", "type": _type, "p0": [4, 1], "p1": [74, 7], "c0": "#102030FF", "c1": "#F0C81040", "opacity": 0.8})
    ORACLES[f"gradient_{_type}"] = _sql_paint(tuple(_ramp[:3]), f"({_ramp[3]} * 0.8::DOUBLE) * {_E}")
QUERIES["clear"] = _rendered("s", _RECT, {"op": "clear", "layer": "src"})
ORACLES["clear"] = f"SELECT x, y, {', '.join(f'CAST(CASE WHEN {_E} = 1 THEN 0 ELSE {c} END AS INTEGER) {c}' for c in 'rgba')} FROM ({S_SRC})"
QUERIES["layer_via_copy"] = _rendered("s", _RECT, {"op": "layer_via_copy", "id": "copy", "layer": "src"}, {"op": "set_visible", "layer": "src", "value": False})
ORACLES["layer_via_copy"] = ORACLES["clear"].replace("= 1 THEN 0 ELSE", "= 0 THEN 0 ELSE")
QUERIES["apply_mask"] = _rendered("s", {"op": "add_mask", "layer": "src", "fill": "noise", "seed": 3}, {"op": "apply_mask", "layer": "src"})
ORACLES["apply_mask"] = f"SELECT x, y, {', '.join(f'CASE WHEN oa = 0 THEN 0 ELSE {c} END {c}' for c in _RGB)}, oa a FROM (SELECT *, {sq('(a / 255.0::DOUBLE) * (m / 255.0::DOUBLE)')} oa FROM (SELECT *, CAST({sql_hash(3, 4)} >> 56 AS INTEGER) m FROM ({S_SRC})))"

# -- fills --------------------------------------------------------------------------------------------------------

_SPINE = "SELECT CAST(i % 90 AS INTEGER) x, CAST(i // 90 AS INTEGER) y FROM range(5400) t(i)"


def _procedural(*ops: dict[str, Any]) -> Query:
    return lambda spark, sf: script.pixels(spark, {"canvas": {"w": 90, "h": 60}, "ops": list(ops), "out": "png8"})


QUERIES["fill_noise"] = _procedural({"op": "add_layer", "id": "n", "fill": "noise", "seed": 11})
ORACLES["fill_noise"] = f"SELECT x, y, {', '.join(f'CASE WHEN a = 0 THEN 0 ELSE {c} END {c}' for c in _RGB)}, a FROM (SELECT x, y, {', '.join(f'CAST({sql_hash(11, k)} >> 56 AS INTEGER) {c}' for k, c in enumerate('rgba'))} FROM ({_SPINE}))"
QUERIES["fill_checker"] = _procedural({"op": "add_layer", "id": "n", "fill": "checker", "a": "#FF0000", "b": "#00FF0080", "cell": 7, "rect": [3, 5, 70, 40]})
_in = "x >= 3 AND x < 73 AND y >= 5 AND y < 45"
_odd = "((x - 3) // 7 + (y - 5) // 7) % 2 = 1"
ORACLES["fill_checker"] = f"SELECT x, y, CASE WHEN {_in} AND NOT {_odd} THEN 255 ELSE 0 END r, CASE WHEN {_in} AND {_odd} THEN 255 ELSE 0 END g, 0 b, CASE WHEN {_in} THEN CASE WHEN {_odd} THEN 128 ELSE 255 END ELSE 0 END a FROM ({_SPINE})"
QUERIES["fill_gradient"] = _procedural({"op": "add_layer", "id": "n", "fill": "gradient", "from": "#10203040", "to": "#F0C020FF", "dir": "v"})
ORACLES["fill_gradient"] = f"SELECT x, y, {', '.join(sq(f'{a} / 255.0::DOUBLE + (y / 59.0::DOUBLE) * ({b} / 255.0::DOUBLE - {a} / 255.0::DOUBLE)') + ' ' + c for c, a, b in (('r', 16, 240), ('g', 32, 192), ('b', 48, 32), ('a', 64, 255)))} FROM ({_SPINE})"

# -- geometry -----------------------------------------------------------------------------------------------------

_H = S_SIZE
QUERIES["flip_h"] = _rendered("s", {"op": "flip", "axis": "h"})
ORACLES["flip_h"] = f"SELECT CAST(99 - x AS INTEGER) x, y, r, g, b, a FROM ({S_SRC})"
QUERIES["flip_v"] = _rendered("s", {"op": "flip", "axis": "v", "layer": "src"})
ORACLES["flip_v"] = f"SELECT x, CAST({_H} - 1 - y AS INTEGER) y, r, g, b, a FROM ({S_SRC})"
QUERIES["rot90"] = _rendered("s", {"op": "rotate_canvas", "angle": 90})
ORACLES["rot90"] = f"SELECT CAST({_H} - 1 - y AS INTEGER) x, x y, r, g, b, a FROM ({S_SRC})"
QUERIES["rot180"] = _rendered("s", {"op": "rotate_canvas", "angle": -180})
ORACLES["rot180"] = f"SELECT CAST(99 - x AS INTEGER) x, CAST({_H} - 1 - y AS INTEGER) y, r, g, b, a FROM ({S_SRC})"
QUERIES["crop"] = _rendered("s", {"op": "crop", "x": 10, "y": 2, "w": 50, "h": 6})
ORACLES["crop"] = f"SELECT CAST(x - 10 AS INTEGER) x, CAST(y - 2 AS INTEGER) y, r, g, b, a FROM ({S_SRC}) WHERE x >= 10 AND x < 60 AND y >= 2 AND y < 8"
QUERIES["offset_wrap"] = _rendered("s", {"op": "filter_offset", "layer": "src", "dx": 33, "dy": -4, "mode": "wrap"})
ORACLES["offset_wrap"] = f"SELECT CAST((x + 33) % 100 AS INTEGER) x, CAST((y - 4 + {_H}) % {_H} AS INTEGER) y, r, g, b, a FROM ({S_SRC})"
QUERIES["offset_repeat"] = _rendered("s", {"op": "filter_offset", "layer": "src", "dx": 7, "dy": -3, "mode": "repeat"})
ORACLES["offset_repeat"] = f"SELECT p.x, p.y, s.r, s.g, s.b, s.a FROM ({S_SRC}) p JOIN ({S_SRC}) s ON s.x = least(greatest(p.x - 7, 0), 99) AND s.y = least(greatest(p.y + 3, 0), {_H} - 1)"
QUERIES["warp_translate"] = _rendered("s", {"op": "transform", "layer": "src", "matrix": [1, 0, 3, 0, 1, 2, 0, 0, 1]})
ORACLES["warp_translate"] = f"SELECT p.x, p.y, coalesce(s.r, 0) r, coalesce(s.g, 0) g, coalesce(s.b, 0) b, coalesce(s.a, 0) a FROM ({S_SRC}) p LEFT JOIN ({S_SRC}) s ON s.x = p.x - 3 AND s.y = p.y - 2"
QUERIES["resize_nearest"] = _rendered("s", {"op": "image_size", "w": 50, "h": 5, "interp": "nearest"})
ORACLES["resize_nearest"] = f"SELECT p.x, p.y, s.r, s.g, s.b, s.a FROM (SELECT CAST(i % 50 AS INTEGER) x, CAST(i // 50 AS INTEGER) y FROM range(250) t(i)) p JOIN ({S_SRC}) s ON s.x = least(floor((p.x + 0.5::DOUBLE) * (100 / 50.0::DOUBLE)), 99) AND s.y = least(floor((p.y + 0.5::DOUBLE) * ({_H} / 5.0::DOUBLE)), {_H} - 1)"
QUERIES["resize_bicubic"] = _rendered("s", {"op": "image_size", "w": 50, "h": 5})
QUERIES["warp_rotate"] = _rendered("s", {"op": "transform", "layer": "src", "rotate": 20, "scale": [1.2, 0.9]})
QUERIES["warp_quad"] = _rendered("s", {"op": "transform", "layer": "src", "quad": [[2, 1], [90, 0], [95, 9], [5, 8]]})

# -- filters ------------------------------------------------------------------------------------------------------


def _sql_blur(radius: float, clamp: bool) -> str:
    df = f"SELECT x, y, CAST(r * a AS BIGINT) r, CAST(g * a AS BIGINT) g, CAST(b * a AS BIGINT) b, CAST(a * 255 AS BIGINT) a FROM ({S_SRC})"
    for along, size in (("x", "100"), ("y", _H)):
        for width in selections.box_widths(radius):
            df = _box_sql(df, along, size, width, clamp, tuple("rgba"), lambda v, width=width: f"(({v}) + {(width - 1) // 2}) // {width}")
    raw = f"SELECT x, y, {', '.join(sq(f'coalesce({c} / nullif(a, 0)::DOUBLE, 0.0::DOUBLE)') + ' ' + c for c in _RGB)}, {sq('a / 65025.0::DOUBLE')} a FROM ({df})"
    return f"SELECT x, y, {', '.join(f'CASE WHEN a = 0 THEN 0 ELSE {c} END {c}' for c in _RGB)}, a FROM ({raw})"


def _sql_against(expr: Callable[[str, str], str], radius: float) -> str:
    return f"SELECT o.x, o.y, {', '.join(f'CAST(CASE WHEN o.a = 0 THEN 0 ELSE {expr(f"o.{c}", f"f.{c}")} END AS INTEGER) {c}' for c in _RGB)}, o.a FROM ({S_SRC}) o JOIN ({_sql_blur(radius, True)}) f ON o.x = f.x AND o.y = f.y"


QUERIES["flt_gaussian"] = _rendered("s", {"op": "filter_gaussian_blur", "layer": "src", "radius": 3})
ORACLES["flt_gaussian"] = _sql_blur(3.0, True)
QUERIES["flt_gaussian_transparent"] = _rendered("s", {"op": "filter_gaussian_blur", "layer": "src", "radius": 1.5, "edge": "transparent"})
ORACLES["flt_gaussian_transparent"] = _sql_blur(1.5, False)
QUERIES["flt_unsharp"] = _rendered("s", {"op": "filter_unsharp_mask", "layer": "src", "amount": 150, "radius": 2, "threshold": 8})
ORACLES["flt_unsharp"] = _sql_against(lambda o, f: f"CASE WHEN abs({o} - {f}) < 8 THEN {o} ELSE {sq(f'({o} + 1.5::DOUBLE * ({o} - {f})) / 255.0::DOUBLE')} END", 2.0)
QUERIES["flt_high_pass"] = _rendered("s", {"op": "filter_high_pass", "layer": "src", "radius": 2})
ORACLES["flt_high_pass"] = _sql_against(lambda o, f: sq(f"({o} - {f}) / 255.0::DOUBLE + 0.5::DOUBLE"), 2.0)
QUERIES["flt_noise_uniform"] = _rendered("s", {"op": "filter_add_noise", "layer": "src", "amount": 25, "seed": 7})
ORACLES["flt_noise_uniform"] = f"SELECT x, y, {', '.join(f'CASE WHEN a = 0 THEN 0 ELSE {sq(f"({c} + 63.75::DOUBLE * (2.0::DOUBLE * (CAST({sql_hash(7, i)} >> 11 AS DOUBLE) * 1.1102230246251565e-16::DOUBLE) - 1.0::DOUBLE)) / 255.0::DOUBLE")} END {c}' for i, c in enumerate(_RGB))}, a FROM ({S_SRC})"
QUERIES["flt_noise_gaussian"] = _rendered("s", {"op": "filter_add_noise", "layer": "src", "amount": 25, "seed": 7, "distribution": "gaussian", "monochromatic": True})
QUERIES["flt_motion"] = _rendered("s", {"op": "filter_motion_blur", "layer": "src", "angle": 30, "distance": 7.5})

# -- aggregates ---------------------------------------------------------------------------------------------------


def bbox(spark: SparkSession, sf: str) -> DataFrame:
    state = document(spark, sf, "s").state
    box = inspect.content_box(spark, state, Rel(source(spark, sf)))
    return spark.createDataFrame([box], "x int, y int, w int, h int")


def tile_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles of 64 x 64 pixels of each layer that have any."""
    return inspect.tile_statistics(spark, document(spark, sf, "bs").state).select("allocated", "total")


def mip(spark: SparkSession, sf: str) -> DataFrame:
    """The next level of the display pyramid, from premultiplied bytes."""
    df = source(spark, sf).select("x", "y", *(unpack(C("v"), c).alias(c) for c in "rgba"))
    return render.mean_by(df, lambda c: F.floor(c / F.lit(2.0)).cast("int"))


def stroke_dabs(spark: SparkSession, sf: str) -> DataFrame:
    """Dabs of one stroke for each user: the events in time order are its samples."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "value")
    samples = e.select(C("user_id").alias("stroke_id"), C("event_id").cast("int").alias("k"), (C("value") % 100.0).alias("x"), (C("event_id") % 100).cast("double").alias("y"), (C("value") / 500.0).alias("pressure"), (F.unix_micros(C("ts").cast("timestamp")) / 1000.0).alias("t_ms"), F.lit(False).alias("last"))
    return batch_dabs(samples, stroke.Brush(size=12.0, smoothing=0.3, size_lut=tuple(stroke.pressure_lut([[0.0, 0.2], [1.0, 1.0]]))))


QUERIES |= {f.__name__: f for f in (bbox, tile_stats, mip, stroke_dabs)}
ORACLES["bbox"] = f"SELECT min(x) x, min(y) y, max(x) - min(x) + 1 w, max(y) - min(y) + 1 h FROM ({S_SRC}) WHERE a > 0"
_tiles = "SELECT count(DISTINCT (x // 64, y // 64)) allocated, CAST(2 * (SELECT (max(y) + 64) // 64 FROM ({0})) AS BIGINT) total FROM ({1}) WHERE a > 0"
ORACLES["tile_stats"] = f"{_tiles.format(S_BACK, S_BACK)} UNION ALL {_tiles.format(S_BACK, S_SRC)}"
ORACLES["mip"] = f"SELECT CAST(x // 2 AS INTEGER) x, CAST(y // 2 AS INTEGER) y, {', '.join(f'CAST((sum(({c} * a + 127) // 255) + 2) // 4 AS INTEGER) {c}' for c in _RGB)}, CAST((sum(a) + 2) // 4 AS INTEGER) a FROM ({S_SRC}) GROUP BY 1, 2"
_POINTS_STROKE = [{"x": 5, "y": 2, "pressure": 0.4}, {"x": 60, "y": 8, "pressure": 1.0}, {"x": 90, "y": 1, "pressure": 0.7}]
QUERIES["stroke_paint"] = _rendered("s", {"op": "brush_stroke", "layer": "src", "color": "#D02090", "size": 9, "hardness": 0.4, "flow": 0.6, "opacity": 0.9, "samples": _POINTS_STROKE})
QUERIES["stroke_erase"] = _rendered("s", {"op": "eraser_stroke", "layer": "src", "size": 7, "samples": _POINTS_STROKE})
QUERIES["stroke_clone"] = _rendered("s", {"op": "clone_stroke", "layer": "src", "size": 7, "source": [40, 4], "samples": _POINTS_STROKE})
QUERIES["bucket"] = _rendered("s", {"op": "bucket_fill", "layer": "src", "x": 3, "y": 2, "color": "#3366CC", "tolerance": 90})
