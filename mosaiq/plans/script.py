"""The script language: strict validation on the driver, and the fold of ops over a document.

A script is {"canvas": {"w", "h", "bg"}, "ops": [...], "out": "png8"}. Unknown keys, duplicate keys, wrong types and
values out of range are errors before any job runs. Every op but undo pushes one history record.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions import adjust, blend
from ..functions.rules import color, packed_color
from ..operators import fills, filters, geometry, paint, render, selections, stroke
from ..sources.png import decode_base64
from .document import Document, Mask, Node, ScriptError, State, empty_root
from .relation import EMPTY, Rel, tabled

SEED = (0, 2**53 - 1)
_NONE = object()
Handler = Callable[[SparkSession, Document, "Fields"], None]
OPS: dict[str, Handler] = {}


def op(name: str) -> Callable[[Handler], Handler]:
    """Registers an op; names are unique."""

    def add(f: Handler) -> Handler:
        if name in OPS:
            raise ValueError(f"op {name!r} is there already")
        OPS[name] = f
        return f

    return add


class Fields:
    """Typed access to an object's keys; done() complains about keys that nothing read."""

    def __init__(self, values: Any, where: str) -> None:
        if not isinstance(values, dict):
            raise ScriptError(f"{where}: an object is needed")
        self.values, self.where, self.read = values, where, {"op"}

    def _get(self, key: str, default: Any) -> Any:
        self.read.add(key)
        if key in self.values:
            return self.values[key]
        if default is _NONE:
            raise ScriptError(f"{self.where}: {key} is missing")
        return default

    def _fail(self, key: str, value: Any) -> ScriptError:
        return ScriptError(f"{self.where}: {key} cannot be {value!r}")

    def has(self, key: str) -> bool:
        return key in self.values

    def text(self, key: str, default: Any = _NONE) -> Any:
        v = self._get(key, default)
        if v is not default and not isinstance(v, str):
            raise self._fail(key, v)
        return v

    def choice(self, key: str, options: tuple[str, ...], default: Any = _NONE) -> Any:
        v = self.text(key, default)
        if v is not default and v not in options:
            raise self._fail(key, v)
        return v

    def number(self, key: str, low: float, high: float, default: Any = _NONE) -> Any:
        v = self._get(key, default)
        if v is default and not isinstance(v, (int, float)):
            return v
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v) or not low <= v <= high:
            raise self._fail(key, v)
        return float(v)

    def whole(self, key: str, low: int, high: int, default: Any = _NONE) -> Any:
        v = self._get(key, default)
        if v is default and not isinstance(v, int):
            return v
        if isinstance(v, bool) or not isinstance(v, int) or not low <= v <= high:
            raise self._fail(key, v)
        return v

    def flag(self, key: str, default: Any = _NONE) -> Any:
        v = self._get(key, default)
        if not isinstance(v, bool):
            raise self._fail(key, v)
        return v

    def color(self, key: str, default: Any = _NONE) -> str:
        v = self._get(key, default)
        try:
            color(v)
        except ValueError:
            raise self._fail(key, v) from None
        return v

    def numbers(self, key: str, n: int, default: Any = _NONE, low: float = -math.inf, high: float = math.inf) -> Any:
        v = self._get(key, default)
        if v is default and v is not _NONE:
            return v
        if not isinstance(v, list) or len(v) != n or any(isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) or not low <= x <= high for x in v):
            raise self._fail(key, v)
        return [float(x) for x in v]

    def rect(self, s: State) -> tuple[int, int, int, int]:
        v = self._get("rect", None)
        if v is None and not self.has("rect"):
            return (0, 0, s.w, s.h)
        if not isinstance(v, list) or len(v) != 4 or any(isinstance(x, bool) or not isinstance(x, int) for x in v) or v[2] < 1 or v[3] < 1:
            raise self._fail("rect", v)
        return tuple(v)  # type: ignore[return-value]

    def raw(self, key: str, default: Any = _NONE) -> Any:
        return self._get(key, default)

    def done(self) -> None:
        if unread := sorted(set(self.values) - self.read):
            raise ScriptError(f"{self.where}: unknown {', '.join(unread)}")


def _unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ScriptError("a key stands twice in one object")
    return out


def _no_constant(name: str) -> Any:
    raise ScriptError(f"{name} is not a JSON number")


def parse(text: str) -> dict[str, Any]:
    try:
        script = json.loads(text, object_pairs_hook=_unique, parse_constant=_no_constant)
    except json.JSONDecodeError as e:
        raise ScriptError(f"not JSON: {e}") from None
    top = Fields(script, "script")
    canvas = Fields(top.raw("canvas"), "canvas")
    for key in ("w", "h"):
        canvas.whole(key, 1, 16384)
    canvas.color("bg", "#00000000")
    canvas.done()
    if not isinstance(top.raw("ops"), list) or top.raw("out") != "png8":
        raise ScriptError("script: ops must be a list and out png8")
    top.done()
    return script


def run(spark: SparkSession, script: str | dict[str, Any]) -> Document:
    """The document after all ops; pixels stay lazy."""
    script = parse(script if isinstance(script, str) else json.dumps(script))
    c = script["canvas"]
    doc = Document(c["w"], c["h"], packed_color(c.get("bg", "#00000000")))
    for i, values in enumerate(script["ops"]):
        apply(spark, doc, values, f"op {i}")
    return doc


def apply(spark: SparkSession, doc: Document, values: dict[str, Any], where: str = "op") -> None:
    """One op; the document is as before if it fails."""
    f = Fields(values, where)
    name = f.text("op")
    if name not in OPS:
        raise ScriptError(f"{where}: no op {name!r}")
    before = (doc.state, list(doc.past), list(doc.future), dict(doc.tool))
    if name != "undo":
        doc.push()
    try:
        OPS[name](spark, doc, f)
        f.done()
    except Exception as e:
        doc.state, doc.past, doc.future, doc.tool = before
        if isinstance(e, adjust.BadParams):
            raise ScriptError(f"{where}: {e}") from None
        raise


def pixels(spark: SparkSession, script: str | dict[str, Any]) -> DataFrame:
    """x, y, r, g, b, a of a script's rendered document."""
    doc = run(spark, script)
    return render.render(spark, doc.state)


def clean_name(name: str) -> str:
    """A valid layer name: no control characters, at most 255 code points."""
    if len(name) > 255 or any(ord(c) < 32 or 0x7F <= ord(c) < 0xA0 for c in name) or any(0xD800 <= ord(c) < 0xE000 for c in name):
        raise ScriptError(f"name {name[:40]!r} is not valid")
    return name


# -- layers and structure -----------------------------------------------------------------------------------------


@op("add_layer")
def _add_layer(spark: SparkSession, doc: Document, f: Fields) -> None:
    s = doc.state
    node_id, parent = s.check_new(f.text("id")), f.text("parent", "root")
    kind = f.choice("fill", ("empty", "solid", "gradient", "checker", "noise"), "empty")
    rect = f.rect(s) if kind != "empty" else None
    rel = EMPTY
    if kind == "solid":
        rel = fills.solid(f.color("color", "#000000FF"), rect)
    elif kind == "gradient":
        rel = fills.gradient(f.color("from", "#000000FF"), f.color("to", "#FFFFFFFF"), f.choice("dir", ("h", "v"), "h"), rect)
    elif kind == "checker":
        rel = fills.checker(f.color("a", "#FFFFFFFF"), f.color("b", "#CCCCCCFF"), f.whole("cell", 1, 4096, 8), rect)
    elif kind == "noise":
        alpha = f.raw("alpha", "random")
        rel = fills.noise(f.whole("seed", *SEED, 0), None if alpha == "random" else f.whole("alpha", 0, 255), rect)
    doc.state = s.insert(parent, None, Node(node_id, "raster", node_id, pixels=rel))


@op("add_group")
def _add_group(spark: SparkSession, doc: Document, f: Fields) -> None:
    s = doc.state
    mode = f.choice("mode", ("pass", "isolated", *blend.MODES), "pass")
    node = Node(s.check_new(f.text("id")), "group", f.values["id"], passes=mode == "pass", mode="norm" if mode in ("pass", "isolated") else mode)
    doc.state = s.insert(f.text("parent", "root"), None, node)


@op("move_layer")
def _move_layer(spark: SparkSession, doc: Document, f: Fields) -> None:
    s = doc.state
    node = s.require(f.text("id"))
    parent = f.text("parent", s.parent_of(node.id)[0].id)
    if parent == node.id or any(n.id == parent for n in node.walk()):
        raise ScriptError("a group cannot move into itself")
    s = s.remove(node.id)
    size = len(s.container(parent).children)
    doc.state = s.insert(parent, f.whole("index", 0, size, size), node)


def _set(key: str, read: Callable[[Fields], Any], *kinds: str) -> Handler:
    def handler(spark: SparkSession, doc: Document, f: Fields) -> None:
        node = doc.state.require(f.text("layer"), *kinds)
        doc.state = doc.state.change(node.id, **{key: read(f)})

    return handler


_LEAF = ("raster", "adjustment")
op("set_opacity")(_set("opacity", lambda f: f.number("value", 0, 1)))
op("set_fill")(_set("fill", lambda f: f.number("value", 0, 1), *_LEAF))
op("set_visible")(_set("visible", lambda f: f.flag("value")))
op("set_clip")(_set("clip", lambda f: f.flag("value"), *_LEAF))
op("set_clbl")(_set("clbl", lambda f: f.flag("value"), *_LEAF))
op("lock_transparency")(_set("lock", lambda f: f.flag("value", True), "raster"))
op("set_name")(_set("name", lambda f: clean_name(f.text("name"))))


@op("set_blend")
def _set_blend(spark: SparkSession, doc: Document, f: Fields) -> None:
    node = doc.state.require(f.text("layer"))
    mode = f.choice("mode", ("pass", *blend.MODES))
    if mode == "pass" and node.kind != "group":
        raise ScriptError("only groups pass through")
    changes = {"passes": mode == "pass"} | ({} if mode == "pass" else {"mode": mode})
    doc.state = doc.state.change(node.id, seed=f.whole("seed", *SEED, node.seed), **changes)


@op("set_group_mode")
def _set_group_mode(spark: SparkSession, doc: Document, f: Fields) -> None:
    node = doc.state.require(f.text("layer"), "group")
    doc.state = doc.state.change(node.id, passes=f.choice("mode", ("pass", "isolated")) == "pass")


@op("add_mask")
def _add_mask(spark: SparkSession, doc: Document, f: Fields) -> None:
    s = doc.state
    node = s.require(f.text("layer"))
    kind, rect, outside = f.choice("fill", ("solid", "gradient", "noise"), "solid"), f.rect(s), f.whole("outside", 0, 255, 0)
    if kind == "solid":
        rel = fills.mask_solid(f.whole("value", 0, 255, 255), rect, outside)
    elif kind == "gradient":
        rel = fills.mask_gradient(f.whole("from", 0, 255, 0), f.whole("to", 0, 255, 255), f.choice("dir", ("h", "v"), "h"), rect, outside)
    else:
        rel = fills.mask_noise(f.whole("seed", *SEED, 0), rect, outside)
    doc.state = s.change(node.id, mask=Mask(rel, True, outside))


def _masked(doc: Document, f: Fields, *kinds: str) -> Node:
    node = doc.state.require(f.text("layer"), *kinds)
    if node.mask is None:
        raise ScriptError(f"{node.id!r} has no mask")
    return node


@op("set_mask_enabled")
def _set_mask_enabled(spark: SparkSession, doc: Document, f: Fields) -> None:
    node = _masked(doc, f)
    doc.state = doc.state.change(node.id, mask=replace(node.mask, enabled=f.flag("value")))


@op("delete_mask")
def _delete_mask(spark: SparkSession, doc: Document, f: Fields) -> None:
    doc.state = doc.state.change(_masked(doc, f).id, mask=None)


@op("apply_mask")
def _apply_mask(spark: SparkSession, doc: Document, f: Fields) -> None:
    node = _masked(doc, f, "raster")
    doc.state = doc.state.change(node.id, pixels=paint.apply_mask(spark, doc.state, node), mask=None)


@op("merge_down")
def _merge_down(spark: SparkSession, doc: Document, f: Fields) -> None:
    upper, lower = render.check_merge(doc.state, f.text("layer"))
    rel = render.merge_pair(spark, doc.state, upper, lower)
    doc.state = doc.state.change(lower.id, pixels=rel, fill=1.0, mask=None).remove(upper.id)


@op("merge_visible")
def _merge_visible(spark: SparkSession, doc: Document, f: Fields) -> None:
    s, node_id = doc.state, f.text("id", "merged")
    top = s.root.children
    if not any(n.visible for n in top):
        return
    rel = render.rendered(spark, s, False)
    kept = tuple(n for n in top if not n.visible)
    at = next(i for i, n in enumerate(top) if n.visible)
    s = s.put(replace(s.root, children=kept))
    doc.state = s.insert("root", at, Node(s.check_new(node_id), "raster", node_id, pixels=rel))


@op("flatten")
def _flatten(spark: SparkSession, doc: Document, f: Fields) -> None:
    s, node_id = doc.state, f.text("id", "flattened")
    rel = render.rendered(spark, s, True)
    s = replace(s, root=empty_root(), bg=0)
    doc.state = s.insert("root", None, Node(s.check_new(node_id), "raster", node_id, pixels=rel))


@op("undo")
def _undo(spark: SparkSession, doc: Document, f: Fields) -> None:
    doc.undo(f.whole("steps", 1, 1000, 1))


@op("delete_layer")
def _delete_layer(spark: SparkSession, doc: Document, f: Fields) -> None:
    doc.state = doc.state.remove(doc.state.require(f.text("layer")).id)


@op("duplicate_layer")
def _duplicate_layer(spark: SparkSession, doc: Document, f: Fields) -> None:
    s = doc.state
    node, new = s.require(f.text("layer")), s.check_new(f.text("id"))

    def copy(n: Node) -> Node:
        return replace(n, id=s.check_new(f"{new}/{n.id}"), children=tuple(map(copy, n.children)))

    made = replace(node, id=new, name=(node.name + " copy")[:255], children=tuple(map(copy, node.children)))
    parent, i = s.parent_of(node.id)
    doc.state = s.insert(f.text("parent"), None, made) if f.has("parent") else s.insert(parent.id, i + 1, made)


@op("add_adjustment")
def _add_adjustment(spark: SparkSession, doc: Document, f: Fields) -> None:
    s, kind = doc.state, f.choice("type", adjust.TYPES)
    node = Node(s.check_new(f.text("id")), "adjustment", f.values["id"], adjustment=kind, params=adjust.read(kind, f.raw("params", {})))
    doc.state = s.insert(f.text("parent", "root"), None, node)


@op("set_adjustment")
def _set_adjustment(spark: SparkSession, doc: Document, f: Fields) -> None:
    node = doc.state.require(f.text("layer"), "adjustment")
    doc.state = doc.state.change(node.id, params=adjust.read(node.adjustment, f.raw("params")))


# -- filters ------------------------------------------------------------------------------------------------------


def _coverage(f: Fields) -> dict | None:
    if not f.has("coverage"):
        return None
    c = Fields(f.raw("coverage"), f"{f.where}: coverage")
    src = c.choice("src", ("selection", "rect", "ramp"))
    out: dict[str, Any] = {"src": src}
    if src == "rect":
        out |= {k: c.whole(k, -(2**31), 2**31) for k in ("x", "y")} | {k: c.whole(k, 0, 2**31) for k in ("w", "h")} | {"value": c.whole("value", 0, 255, 255)}
    elif src == "ramp":
        out["dir"] = c.choice("dir", ("h", "v"))
    c.done()
    return out


def _filter(name: str, make: Callable[[SparkSession, State, Rel, Fields], Rel]) -> None:
    @op(name)
    def handler(spark: SparkSession, doc: Document, f: Fields) -> None:
        s = doc.state
        node = s.require(f.text("layer"), "raster")
        coverage = _coverage(f)
        new = make(spark, s, node.pixels, f)
        doc.state = s.change(node.id, pixels=filters.apply(spark, s, node, new, coverage))


def _edge(f: Fields) -> bool:
    return f.choice("edge", ("clamp", "transparent"), "clamp") == "clamp"


_filter("filter_gaussian_blur", lambda k, s, p, f: filters.gaussian(k, s, p, f.number("radius", 0.1, 250, 1.0), _edge(f)))
_filter("filter_motion_blur", lambda k, s, p, f: filters.motion(k, s, p, f.number("angle", -360, 360, 0.0), f.number("distance", 1, 2000, 10.0), _edge(f)))
_filter("filter_unsharp_mask", lambda k, s, p, f: filters.unsharp(k, s, p, f.number("amount", 1, 500, 50.0), f.number("radius", 0.1, 250, 1.0), f.whole("threshold", 0, 255, 0), _edge(f)))
_filter("filter_add_noise", lambda k, s, p, f: filters.noise(k, s, p, f.number("amount", 0, 400, 10.0), f.choice("distribution", ("uniform", "gaussian"), "uniform") == "gaussian", f.flag("monochromatic", False), f.whole("seed", *SEED, 0)))
_filter("filter_high_pass", lambda k, s, p, f: filters.high_pass(k, s, p, f.number("radius", 0.1, 250, 10.0), _edge(f)))
_filter("filter_offset", lambda k, s, p, f: filters.offset(k, s, p, f.whole("dx", -65536, 65536, 0), f.whole("dy", -65536, 65536, 0), f.choice("mode", ("transparent", "repeat", "wrap"), "transparent")))


# -- selections ---------------------------------------------------------------------------------------------------

_BIG = 1e9


def _mode(f: Fields) -> str:
    return f.choice("mode", ("new", "add", "subtract", "intersect"), "new")


def _shape(name: str, make: Callable[..., Rel], antialias: bool) -> None:
    @op(name)
    def handler(spark: SparkSession, doc: Document, f: Fields) -> None:
        x, y = f.number("x", -_BIG, _BIG), f.number("y", -_BIG, _BIG)
        w, h = f.number("w", 0, 65536), f.number("h", 0, 65536)
        if w <= 0 or h <= 0:
            raise ScriptError(f"{f.where}: w and h must be above 0")
        doc.state = selections.combine(spark, doc.state, make(x, y, w, h, f.flag("antialias", antialias)), _mode(f))


_shape("select_rect", selections.rect, False)
_shape("select_ellipse", selections.ellipse, True)


@op("select_polygon")
def _select_polygon(spark: SparkSession, doc: Document, f: Fields) -> None:
    points = f.raw("points")
    good = isinstance(points, list) and 3 <= len(points) <= 4096 and all(isinstance(p, list) and len(p) == 2 and all(isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) for v in p) for p in points)
    if not good:
        raise ScriptError(f"{f.where}: 3 to 4096 points are needed")
    doc.state = selections.combine(spark, doc.state, selections.polygon([[float(v) for v in p] for p in points], f.flag("antialias", True)), _mode(f))


_INT = (-(2**31), 2**31 - 1)


@op("select_wand")
def _select_wand(spark: SparkSession, doc: Document, f: Fields) -> None:
    s = doc.state
    node = s.require(f.text("layer"), "raster")
    rel = selections.region(spark, s, node, f.whole("x", *_INT), f.whole("y", *_INT), f.whole("tolerance", 0, 255, 32), f.flag("contiguous", True), f.flag("antialias", True))
    doc.state = selections.combine(spark, s, rel, _mode(f))


@op("select_alpha")
def _select_alpha(spark: SparkSession, doc: Document, f: Fields) -> None:
    s = doc.state
    doc.state = selections.combine(spark, s, selections.of_alpha(spark, s, s.require(f.text("layer"), "raster")), _mode(f))


@op("select_all")
def _select_all(spark: SparkSession, doc: Document, f: Fields) -> None:
    doc.state = replace(doc.state, selection=selections.ALL, active=True)


@op("deselect")
def _deselect(spark: SparkSession, doc: Document, f: Fields) -> None:
    s = doc.state
    doc.state = replace(s, saved=s.selection if s.active else s.saved, selection=EMPTY, active=False)


@op("reselect")
def _reselect(spark: SparkSession, doc: Document, f: Fields) -> None:
    s = doc.state
    if not s.saved.is_empty:
        doc.state = replace(s, selection=s.saved, active=True)


@op("select_inverse")
def _select_inverse(spark: SparkSession, doc: Document, f: Fields) -> None:
    doc.state = selections.selected(spark, doc.state, _closed(spark, doc.state, selections.inverse(doc.state)))


def _closed(spark: SparkSession, s: State, rel: Rel) -> Rel:
    return tabled(spark, s.w, s.h, rel) if rel.default == 0 else _plain(spark, s, rel)


def _plain(spark: SparkSession, s: State, rel: Rel) -> Rel:
    """The relation with 0 for absent rows."""
    from .relation import frame, table

    df = frame(spark, s.w, s.h, {"v_": rel})
    return table(df, df["v_"])


@op("feather")
def _feather(spark: SparkSession, doc: Document, f: Fields) -> None:
    doc.state = selections.selected(spark, doc.state, selections.feather(spark, doc.state, f.number("radius", 0, 250)))


@op("expand")
def _expand(spark: SparkSession, doc: Document, f: Fields) -> None:
    doc.state = selections.selected(spark, doc.state, selections.spread(spark, doc.state, f.whole("by", 1, 100), True))


@op("contract")
def _contract(spark: SparkSession, doc: Document, f: Fields) -> None:
    doc.state = selections.selected(spark, doc.state, selections.spread(spark, doc.state, f.whole("by", 1, 100), False))


# -- painting and copies ------------------------------------------------------------------------------------------


@op("fill_selection")
def _fill_selection(spark: SparkSession, doc: Document, f: Fields) -> None:
    node = doc.state.require(f.text("layer"), "raster")
    doc.state = doc.state.change(node.id, pixels=paint.fill_selection(spark, doc.state, node, f.color("color"), f.number("opacity", 0, 1, 1.0)))


@op("gradient")
def _gradient(spark: SparkSession, doc: Document, f: Fields) -> None:
    node = doc.state.require(f.text("layer"), "raster")
    rel = paint.gradient(spark, doc.state, node, f.choice("type", ("linear", "radial")), f.numbers("p0", 2), f.numbers("p1", 2), f.color("c0"), f.color("c1"), f.number("opacity", 0, 1, 1.0), f.flag("reverse", False))
    doc.state = doc.state.change(node.id, pixels=rel)


@op("bucket_fill")
def _bucket_fill(spark: SparkSession, doc: Document, f: Fields) -> None:
    node = doc.state.require(f.text("layer"), "raster")
    rel = paint.bucket(spark, doc.state, node, f.whole("x", *_INT), f.whole("y", *_INT), f.color("color"), f.number("opacity", 0, 1, 1.0), f.whole("tolerance", 0, 255, 32), f.flag("contiguous", True), f.flag("antialias", True))
    doc.state = doc.state.change(node.id, pixels=rel)


@op("clear")
def _clear(spark: SparkSession, doc: Document, f: Fields) -> None:
    node = doc.state.require(f.text("layer"), "raster")
    doc.state = doc.state.change(node.id, pixels=paint.clear(spark, doc.state, node))


def _place(s: State, f: Fields, node: Node, above: str | None = None) -> State:
    if f.has("above") and f.has("parent"):
        raise ScriptError(f"{f.where}: either above or parent")
    if f.has("parent"):
        return s.insert(f.text("parent"), None, node)
    above = f.text("above", above)
    if above is None:
        return s.insert("root", None, node)
    parent, i = s.parent_of(s.require(above).id)
    return s.insert(parent.id, i + 1, node)


@op("place_image")
def _place_image(spark: SparkSession, doc: Document, f: Fields) -> None:
    s = doc.state
    node_id = s.check_new(f.text("id"))
    w, h, image = decode_base64(spark, f.text("png"))
    x, y = (f.whole(k, -32768, 32768, None) for k in ("x", "y"))
    if (x is None) != (y is None):
        raise ScriptError(f"{f.where}: x and y belong together")
    x, y = ((s.w - w) // 2, (s.h - h) // 2) if x is None else (x, y)
    from .relation import moved

    rel = moved(image, s.w, s.h, lambda a, b: a + x, lambda a, b: b + y)
    doc.state = _place(s, f, Node(node_id, "raster", clean_name(f.text("name", "")), pixels=rel))


@op("layer_via_copy")
def _layer_via_copy(spark: SparkSession, doc: Document, f: Fields) -> None:
    s, merged, cut = doc.state, f.flag("merged", False), f.flag("cut", False)
    node_id = s.check_new(f.text("id"))
    if merged and (cut or f.has("layer")):
        raise ScriptError(f"{f.where}: a merged copy has no layer and cuts nothing")
    layer = None if merged else s.require(f.text("layer"), "raster")
    rel = paint.copied(spark, s, render.rendered(spark, s, True) if merged else layer.pixels)
    if rel.df.isEmpty():
        raise ScriptError(f"{f.where}: there is nothing to copy")
    if cut:
        s = s.change(layer.id, pixels=paint.clear(spark, s, layer))
    doc.state = _place(s, f, Node(node_id, "raster", clean_name(f.text("name", "")), pixels=rel), layer.id if layer else None)


# -- geometry -----------------------------------------------------------------------------------------------------


@op("transform")
def _transform(spark: SparkSession, doc: Document, f: Fields) -> None:
    s = doc.state
    node = s.require(f.text("layer"), "raster")
    nearest = f.choice("interp", ("bicubic", "nearest"), "bicubic") == "nearest"
    params = ("translate", "scale", "rotate", "skew", "pivot")
    if f.has("matrix") + f.has("quad") + any(map(f.has, params)) != 1:
        raise ScriptError(f"{f.where}: one of matrix, quad or parameters is needed")
    if f.has("matrix"):
        m = f.numbers("matrix", 9)
    elif f.has("quad"):
        quad = f.raw("quad")
        if not isinstance(quad, list) or len(quad) != 4:
            raise ScriptError(f"{f.where}: quad needs four corners")
        corners = [Fields({"p": p}, f.where).numbers("p", 2) for p in quad]
        r = f.numbers("rect", 4, [0.0, 0.0, float(s.w), float(s.h)])
        if r[2] <= 0 or r[3] <= 0:
            raise ScriptError(f"{f.where}: rect is empty")
        m = geometry.from_quad(corners, r)
    else:
        scale = f.numbers("scale", 2, [1.0, 1.0], -1000, 1000)
        if 0.0 in scale:
            raise ScriptError(f"{f.where}: scale is 0")
        m = geometry.from_params(f.numbers("translate", 2, [0.0, 0.0]), scale, f.number("rotate", -3600, 3600, 0.0), f.numbers("skew", 2, [0.0, 0.0], -89, 89), f.numbers("pivot", 2, [s.w / 2.0, s.h / 2.0]))
    geometry.inverse(m)
    doc.state = s.change(node.id, pixels=EMPTY if node.pixels.is_empty else geometry.warp(spark, node.pixels, s.w, s.h, s.w, s.h, m, nearest))


@op("image_size")
def _image_size(spark: SparkSession, doc: Document, f: Fields) -> None:
    doc.state = geometry.image_size(spark, doc.state, f.whole("w", 1, 16384), f.whole("h", 1, 16384), f.choice("interp", ("bicubic", "nearest"), "bicubic") == "nearest")


@op("canvas_size")
def _canvas_size(spark: SparkSession, doc: Document, f: Fields) -> None:
    doc.state = geometry.canvas_size(spark, doc.state, f.whole("w", 1, 16384), f.whole("h", 1, 16384), f.choice("anchor", ("tl", "t", "tr", "l", "c", "r", "bl", "b", "br"), "c"))


@op("crop")
def _crop(spark: SparkSession, doc: Document, f: Fields) -> None:
    doc.state = geometry.crop(spark, doc.state, f.whole("x", *_INT), f.whole("y", *_INT), f.whole("w", 1, 16384), f.whole("h", 1, 16384))


@op("rotate_canvas")
def _rotate_canvas(spark: SparkSession, doc: Document, f: Fields) -> None:
    doc.state = geometry.rotate_canvas(spark, doc.state, f.number("angle", -3600, 3600))


@op("flip")
def _flip(spark: SparkSession, doc: Document, f: Fields) -> None:
    s, axis = doc.state, f.choice("axis", ("h", "v"))
    if f.has("layer"):
        node = s.require(f.text("layer"), "raster")
        doc.state = s if node.pixels.is_empty else s.change(node.id, pixels=geometry.flip_rel(spark, s, node.pixels, axis))
    else:
        doc.state = geometry.flip(spark, s, axis)


# -- strokes ------------------------------------------------------------------------------------------------------


def _curve(f: Fields, key: str) -> tuple[int, ...] | None:
    c = f.raw(key, None)
    if c is None:
        return None
    good = isinstance(c, list) and 2 <= len(c) <= 16 and all(isinstance(p, list) and len(p) == 2 and all(isinstance(v, (int, float)) and not isinstance(v, bool) and 0 <= v <= 1 for v in p) for p in c)
    if not good or any(a[0] >= b[0] for a, b in zip(c, c[1:])) or c[0][0] != 0 or c[-1][0] != 1:
        raise ScriptError(f"{f.where}: {key} must rise from 0 to 1")
    return tuple(stroke.pressure_lut([[float(v) for v in p] for p in c]))


def _samples(f: Fields) -> list[dict[str, float]]:
    raw = f.raw("samples")
    if not isinstance(raw, list) or not raw:
        raise ScriptError(f"{f.where}: samples are needed")
    out: list[dict[str, float]] = []
    for i, k in enumerate(raw):
        g = Fields(k, f"{f.where}: sample {i}")
        sample = {"x": g.number("x", -_BIG, _BIG), "y": g.number("y", -_BIG, _BIG), "pressure": g.number("pressure", -_BIG, _BIG, 1.0)}
        g.number("tilt_x", -90, 90, 0.0), g.number("tilt_y", -90, 90, 0.0)
        sample["t_ms"] = g.number("t_ms", 0, 1e15, out[-1]["t_ms"] if out else 0.0)
        g.done()
        out.append(sample)
    return out


def _stroke(kind: str) -> Handler:
    def handler(spark: SparkSession, doc: Document, f: Fields) -> None:
        s = doc.state
        node = s.require(f.text("layer"))
        on_mask = kind == "brush" and f.choice("target", ("pixels", "mask"), "pixels") == "mask"
        if not on_mask and node.kind != "raster":
            raise ScriptError(f"{f.where}: {node.id!r} has no pixels")
        ink = f.color("color", "#000000") if kind == "brush" else "#000000"
        if color(ink)[3] != 255:
            raise ScriptError(f"{f.where}: a brush colour is opaque")
        brush = stroke.Brush(
            f.number("size", 1, 5000, 20.0), f.number("hardness", 0, 1, 1.0), f.number("spacing", 0.01, 10, 0.25), f.number("opacity", 0, 1, 1.0),
            f.number("flow", 0, 1, 1.0), f.number("angle", -360, 360, 0.0), f.number("roundness", 0.01, 1, 1.0), f.choice("mode", ("wash", "buildup"), "wash"),
            f.number("dabs_per_second", 0, 1000, 0.0), f.number("smoothing", 0, 0.99, 0.0), _curve(f, "size_curve"), _curve(f, "opacity_curve"),
        )
        if f.number("view_zoom", 0, 256, 1.0) <= 0:
            raise ScriptError(f"{f.where}: view_zoom must be above 0")
        samples = _samples(f)
        target = stroke.Target(kind, ink, on_mask)
        if kind == "clone":
            target = _clone(doc, f, node, samples[0])
        dabs = stroke.dabs_df(spark, brush, samples)
        doc.state = s.put(stroke.commit(spark, s, node, stroke.buffer(dabs, brush, s.w, s.h), target))

    return handler


def _clone(doc: Document, f: Fields, node: Node, first: dict[str, float]) -> stroke.Target:
    source = f.numbers("source", 2, None)
    aligned, layer = f.flag("aligned", True), doc.state.require(f.text("source_layer", node.id), "raster")
    if source is not None:
        doc.tool = {"clone_src": source}
    if "clone_src" not in doc.tool:
        raise ScriptError(f"{f.where}: there is no source to clone from")
    if not aligned or "clone_off" not in doc.tool:
        doc.tool = doc.tool | {"clone_off": tuple(math.floor((a - b) + 0.5) for a, b in zip(doc.tool["clone_src"], (first["x"], first["y"]), strict=True))}
    return stroke.Target("clone", source=layer.pixels, offset=doc.tool["clone_off"])


for _kind in ("brush", "eraser", "clone"):
    op(f"{_kind}_stroke")(_stroke(_kind))
