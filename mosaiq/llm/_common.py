"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import materialize, shared_dir  # noqa: F401

#: ASCII white space as the word pattern [^\x20\x09-\x0D]+ sees it.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+ (empty for null or blank text)."""
    stripped = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, "[ \\t-\\r]+"))


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


# -- vectorised word hashing --------------------------------------------------------------------------------------

_M64 = (1 << 64) - 1
_Q = 0xC2B2AE3D27D4EB4F | 1
_QI = pow(_Q, -1, 1 << 64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[tuple[int, int], np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by doubling."""
    size = 1 << max(10, (n - 1).bit_length())
    if (base, 0) not in _powers or len(_powers[base, 0]) < size:
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        _powers[base, 0] = np.cumprod(steps)
    return _powers[base, 0][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEED = np.uint64(0x2545F4914F6CDD1D)
_PLACED = mix(np.arange(64 * 256, dtype=np.uint64) * np.uint64(2) + _SEED)


def _placed(at: np.ndarray) -> np.ndarray:
    """A random number for each place and byte (256 * place + byte). They are summed to a word's hash, so, unlike with powers
    of a base modulo 2**64, no pattern of letters makes different words equal."""
    if not len(at) or at.max() < len(_PLACED):
        return _PLACED[at]
    return mix(at.astype(np.uint64) * np.uint64(2) + _SEED)


class Words:
    """The words of some texts laid end to end: byte bounds, bytes, 64-bit hashes, and the first word of each text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False) -> None:
        self.data, self.bounds = data, bounds
        full = ~_IS_SPACE[data]
        begin, end = full.copy(), full.copy()
        begin[1:] &= ~full[:-1]
        end[:-1] &= ~full[1:]
        inner = bounds[(bounds > 0) & (bounds < len(data))]
        begin[inner] |= full[inner]
        end[inner - 1] |= full[inner - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.body = _LOWER[data[full]] if lower else data[full]
        self.first = np.searchsorted(self.start, bounds)
        self._sums: np.ndarray | None = None

    @cached_property
    def hash(self) -> np.ndarray:
        size = self.end - self.start
        after = np.cumsum(size)
        place = np.arange(len(self.body)) - np.repeat(after - size, size)
        total = np.zeros(len(self.body) + 1, dtype=np.uint64)
        np.cumsum(_placed((place << 8) + self.body), out=total[1:])
        return mix(total[after] - total[after - size] + size.astype(np.uint64) * _SEED)

    def windows(self, k: int) -> np.ndarray:
        """The hash of each k words in a row; windows that cross two texts are there too (see ok)."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, dtype=np.uint64)
        if self._sums is None:
            self._sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(self.hash * _power(_Q, n), out=self._sums[1:])
        return mix((self._sums[k:] - self._sums[: n - k + 1]) * _power(_QI, n - k + 1) + np.uint64(k))

    def spans(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The hash of length[i] words from start[i] on."""
        self.windows(1)
        if self._sums is None:
            return np.zeros(0, dtype=np.uint64)
        return mix((self._sums[start + length] - self._sums[start]) * _power(_QI, len(self.hash) + 1)[start] + length.astype(np.uint64))

    def doc(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.first))


def text_slices(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about `most` bytes (a longer text is a run of its own): first row, end
    row, the UTF-8 bytes end to end, and the bounds of the texts in them. Null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
