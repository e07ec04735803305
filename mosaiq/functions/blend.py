"""Blend functions as Column expressions: 27 modes.

`separable(mode)` maps backdrop and source channel values in [0, 1]; `vector(mode)` maps whole colours. The guards' order
is part of the definition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the modes (fixed values).
SEPARABLE = ("dark", "lite", "mul", "scrn", "over", "hLit", "div", "idiv", "sLit", "diff", "smud", "lbrn", "lddg", "fsub", "fdiv", "vLit", "lLit", "pLit", "hMix")
VECTOR = ("dkCl", "lgCl", "hue", "sat", "colr", "lum")
MODES = ("norm", "diss", *SEPARABLE, *VECTOR)

Rgb = tuple[Column, Column, Column]


def _clamp(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def _screen(b: Column, s: Column) -> Column:
    return 1.0 - (1.0 - b) * (1.0 - s)


def _dodge(b: Column, s: Column) -> Column:
    return F.when(b == 0.0, F.lit(0.0)).when(s == 1.0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), b / F.nullif(1.0 - s, F.lit(0.0))))


def _burn(b: Column, s: Column) -> Column:
    return F.when(b == 1.0, F.lit(1.0)).when(s == 0.0, F.lit(0.0)).otherwise(1.0 - F.least(F.lit(1.0), (1.0 - b) / F.nullif(s, F.lit(0.0))))


def _hard(b: Column, s: Column) -> Column:
    return F.when(s <= 0.5, b * (2.0 * s)).otherwise(_screen(b, 2.0 * s - 1.0))


def _soft(b: Column, s: Column) -> Column:
    d = F.when(b <= 0.25, ((16.0 * b - 12.0) * b + 4.0) * b).otherwise(F.sqrt(b))
    return F.when(s <= 0.5, b - (1.0 - 2.0 * s) * b * (1.0 - b)).otherwise(b + (2.0 * s - 1.0) * (d - b))


_TABLE: dict[str, Callable[[Column, Column], Column]] = {
    "dark": F.least,
    "lite": F.greatest,
    "mul": lambda b, s: b * s,
    "scrn": _screen,
    "over": lambda b, s: _hard(s, b),
    "hLit": _hard,
    "div": _dodge,
    "idiv": _burn,
    "sLit": _soft,
    "diff": lambda b, s: F.abs(b - s),
    "smud": lambda b, s: (b + s) - (2.0 * b) * s,
    "lbrn": lambda b, s: F.greatest(F.lit(0.0), (b + s) - 1.0),
    "lddg": lambda b, s: F.least(F.lit(1.0), b + s),
    "fsub": lambda b, s: F.greatest(F.lit(0.0), b - s),
    "fdiv": lambda b, s: F.when(b == 0.0, F.lit(0.0)).when(s == 0.0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), b / F.nullif(s, F.lit(0.0)))),
    "vLit": lambda b, s: F.when(s <= 0.5, _burn(b, 2.0 * s)).otherwise(_dodge(b, 2.0 * s - 1.0)),
    "lLit": lambda b, s: _clamp((b + 2.0 * s) - 1.0),
    "pLit": lambda b, s: F.when(s <= 0.5, F.least(b, 2.0 * s)).otherwise(F.greatest(b, 2.0 * s - 1.0)),
}


def separable(mode: str, b: Column, s: Column, b8: Column, s8: Column) -> Column:
    """One channel, values in [0, 1] and as bytes; clamped."""
    if mode == "hMix":
        return F.when(b8 + s8 >= 255, F.lit(1.0)).otherwise(F.lit(0.0))
    return _clamp(_TABLE[mode](b, s))


def lum(c: Rgb) -> Column:
    return (0.3 * c[0] + 0.59 * c[1]) + 0.11 * c[2]


def _sat(c: Rgb) -> Column:
    return F.greatest(*c) - F.least(*c)


def _set_sat(c: Rgb, s: Column) -> Rgb:
    """The greatest channel (the first of equals) becomes s, the least 0, the third in proportion."""
    r, g, b = c
    high, low = F.greatest(*c), F.least(*c)
    top = F.when(r == high, 0).when(g == high, 1).otherwise(2)
    bottom = F.when(r == low, 0).when(g == low, 1).otherwise(2)
    between = lambda v: (v - low) * s / F.nullif(high - low, F.lit(0.0))
    return tuple(F.when(~(high > low), F.lit(0.0)).when(top == i, s).when(bottom == i, F.lit(0.0)).otherwise(between(v)) for i, v in enumerate(c))  # type: ignore[return-value]


def steps(mode: str, b: Rgb, s: Rgb, b8: Rgb, s8: Rgb) -> list[Callable[[Callable[[str], Column]], dict[str, Column]]]:
    """The blended colour in steps of a Project each: functions of a column getter to new columns; the last gives
    _bl0.._bl2. Steps keep long expressions from being copied into each other."""
    if mode in _TABLE or mode == "hMix":
        return [lambda _: {f"_bl{i}": separable(mode, b[i], s[i], b8[i], s8[i]) for i in range(3)}]
    if mode in ("dkCl", "lgCl"):
        luma = lambda c: 30 * c[0] + 59 * c[1] + 11 * c[2]
        take = luma(s8) < luma(b8) if mode == "dkCl" else luma(s8) > luma(b8)
        return [lambda _: {f"_bl{i}": F.when(take, s[i]).otherwise(b[i]) for i in range(3)}]
    base: Rgb = {"hue": s, "sat": b, "colr": s, "lum": b}[mode]
    target = lum(s) if mode == "lum" else lum(b)

    def first(_: Callable[[str], Column]) -> dict[str, Column]:
        c = _set_sat(s, _sat(b)) if mode == "hue" else _set_sat(b, _sat(s)) if mode == "sat" else base
        return {**{f"_c{i}": v for i, v in enumerate(c)}, "_target": target}

    def shift(c: Callable[[str], Column]) -> dict[str, Column]:
        d = c("_target") - lum((c("_c0"), c("_c1"), c("_c2")))
        return {f"_d{i}": c(f"_c{i}") + d for i in range(3)}

    def facts(c: Callable[[str], Column]) -> dict[str, Column]:
        d = (c("_d0"), c("_d1"), c("_d2"))
        return {"_l": lum(d), "_n": F.least(*d), "_x": F.greatest(*d)}

    def low(c: Callable[[str], Column]) -> dict[str, Column]:
        d1 = c("_l") - c("_n")
        return {f"_e{i}": F.when((c("_n") < 0.0) & (d1 > 0.0), c("_l") + (c(f"_d{i}") - c("_l")) * c("_l") / F.nullif(d1, F.lit(0.0))).otherwise(c(f"_d{i}")) for i in range(3)}

    def high(c: Callable[[str], Column]) -> dict[str, Column]:
        d2 = c("_x") - c("_l")
        return {f"_bl{i}": _clamp(F.when((c("_x") > 1.0) & (d2 > 0.0), c("_l") + (c(f"_e{i}") - c("_l")) * (1.0 - c("_l")) / F.nullif(d2, F.lit(0.0))).otherwise(c(f"_e{i}"))) for i in range(3)}

    return [first, shift, facts, low, high]
