"""Procedural contents of layers and masks, as expressions of x and y."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rules
from ..plans.relation import Rel

Rect = tuple[int, int, int, int]


def within(x: Column, y: Column, rect: Rect) -> Column:
    rx, ry, rw, rh = rect
    return (x >= rx) & (x < rx + rw) & (y >= ry) & (y < ry + rh)


def _in(rect: Rect, value, default: int = 0) -> Rel:
    return Rel(fn=lambda x, y: F.when(within(x, y, rect), value(x, y)).otherwise(F.lit(default)).cast("long"), default=default)


def _ramp(x: Column, y: Column, rect: Rect, direction: str) -> Column:
    place, extent = (x - rect[0], rect[2]) if direction == "h" else (y - rect[1], rect[3])
    return F.lit(0.0) if extent == 1 else place / F.lit(float(extent - 1))


def solid(color: str, rect: Rect) -> Rel:
    return _in(rect, lambda x, y: F.lit(rules.packed_color(color)).cast("long"))


def gradient(first: str, last: str, direction: str, rect: Rect) -> Rel:
    a, b = rules.color(first), rules.color(last)

    def value(x: Column, y: Column) -> Column:
        t = _ramp(x, y, rect, direction)
        byte = [rules.q(u / 255.0 + t * (v / 255.0 - u / 255.0)) for u, v in zip(a, b, strict=True)]
        return rules.pack(*byte)

    return _in(rect, value)


def checker(first: str, second: str, cell: int, rect: Rect) -> Rel:
    one, two = rules.packed_color(first), rules.packed_color(second)
    part = lambda v, at: F.floor((v - at) / F.lit(float(cell)))
    return _in(rect, lambda x, y: F.when((part(x, rect[0]) + part(y, rect[1])) % 2 == 0, one).otherwise(two))


def noise(seed: int, alpha: int | None, rect: Rect) -> Rel:
    def value(x: Column, y: Column, h: list[Column]) -> Column:
        byte = [rules.top_byte(k) for k in h]
        return F.when(within(x, y, rect), rules.pack(*byte, *([] if alpha is None else [F.lit(alpha)]))).otherwise(0)

    return Rel(fn=value, streams=(seed, (0, 1, 2, 3) if alpha is None else (0, 1, 2)))


def mask_solid(value: int, rect: Rect, outside: int) -> Rel:
    return _in(rect, lambda x, y: F.lit(value), outside)


def mask_gradient(first: int, last: int, direction: str, rect: Rect, outside: int) -> Rel:
    return _in(rect, lambda x, y: rules.q(first / 255.0 + _ramp(x, y, rect, direction) * (last / 255.0 - first / 255.0)), outside)


def mask_noise(seed: int, rect: Rect, outside: int) -> Rel:
    return Rel(fn=lambda x, y, h: F.when(within(x, y, rect), rules.top_byte(h[0])).otherwise(outside), default=outside, streams=(seed, (4,)))
