"""Rules that every operator shares: encoding, canonical pixels, packed values, and the pixel hash.

A pixel is one BIGINT, alpha << 24 | red << 16 | green << 8 | blue; 0 is transparent, and such rows may be absent.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNELS = "rgb"
_M64 = (1 << 64) - 1


def dec(v: Column) -> Column:
    return v / F.lit(255.0)


def clamp(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def half_up(y: Column) -> Column:
    """Nearest integer of a non-negative double; halves go up. floor(2 y) is exact, and y is written once."""
    return F.shiftright(F.floor(y * 2.0).cast("int") + 1, 1)


def q(v: Column) -> Column:
    """The one encoder: [0, 1] to a byte."""
    return half_up(clamp(v) * 255.0)


def pack(r: Column, g: Column, b: Column, a: Column) -> Column:
    """A canonical pixel from bytes."""
    whole = ((a.cast("long") * 256 + r) * 256 + g) * 256 + b
    return F.when(a == 0, F.lit(0).cast("long")).otherwise(whole)


def unpack(v: Column, channel: str) -> Column:
    shift = {"a": 24, "r": 16, "g": 8, "b": 0}[channel]
    return F.shiftright(v, shift).bitwiseAND(F.lit(255).cast("long")).cast("int")


def q_float(v: float) -> int:
    y = min(max(v, 0.0), 1.0) * 255.0
    low = int(y)
    return low + (y - low >= 0.5)


def color(text: str) -> tuple[int, int, int, int]:
    """Bytes r, g, b, a of #RRGGBB or #RRGGBBAA."""
    if not isinstance(text, str) or len(text) not in (7, 9) or text[0] != "#" or any(c not in "0123456789abcdefABCDEF" for c in text[1:]):
        raise ValueError(f"not a colour: {text!r}")
    return tuple(int((text + "FF")[i : i + 2], 16) for i in (1, 3, 5, 7))  # type: ignore[return-value]


def packed_color(text: str) -> int:
    r, g, b, a = color(text)
    return a << 24 | r << 16 | g << 8 | b if a else 0


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """BIGINT arithmetic of DataFrames built within wraps around, as hashes need it."""
    key = "spark.sql.ansi.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _big(n: int) -> Column:
    n &= _M64
    return F.lit(n - (1 << 64) if n >> 63 else n).cast("long")


def _split_mix(df: DataFrame, names: list[str]) -> DataFrame:
    """splitmix64 of columns, in place; each step is a Project of its own, so nothing is computed twice."""
    each = lambda f: df.withColumns({n: f(F.col(n)) for n in names})
    df = each(lambda z: z + _big(0x9E3779B97F4A7C15))
    df = each(lambda z: z.bitwiseXOR(F.shiftrightunsigned(z, 30)) * _big(0xBF58476D1CE4E5B9))
    df = each(lambda z: z.bitwiseXOR(F.shiftrightunsigned(z, 27)) * _big(0x94D049BB133111EB))
    return each(lambda z: z.bitwiseXOR(F.shiftrightunsigned(z, 31)))


def pixel_hash(df: DataFrame, seed: int, streams: dict[str, int]) -> DataFrame:
    """Adds 64 hash bits of each pixel (x, y) for each stream; build it under wrapping()."""
    place = F.shiftleft(F.col("y").cast("long"), 32).bitwiseOR(F.col("x").cast("long"))
    df = _split_mix(df.withColumn("_place", place), ["_place"])
    df = df.withColumns({n: F.col("_place").bitwiseXOR(_big(seed)).bitwiseXOR(_big(k * 0xD1B54A32D192ED03)) for n, k in streams.items()})
    return _split_mix(df, list(streams)).drop("_place")


def unit(h: Column) -> Column:
    return F.shiftrightunsigned(h, 11).cast("double") * F.lit(2.0**-53)


def top_byte(h: Column) -> Column:
    return F.shiftrightunsigned(h, 56)
