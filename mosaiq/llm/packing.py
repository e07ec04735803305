"""Best-fit packing of token sequences with exact-complement hashing.

Documents become pieces of at most `capacity` tokens. Only the histogram of piece lengths (at most `capacity` rows)
reaches the driver. There the plan is made: one other length that is exactly the gap of a length is looked up and consumed
under the availability counts, for all lengths, the longest first; then two and then three others for what is left; what
has no exact complement is packed best-fit decreasing, whole groups of equal bins at a time. Of several such plans the one
with fewest sequences is taken. A plan row gives a range of ranks of one length its place, so
every piece finds its sequence from its rank within its length, without a shuffle of the tokens.

Cases: null and empty text become the one end token; texts of any length are tokenized whole; repeated rows are packed
each; ties of rank are broken by document, piece and checksum; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import byte_of_char, materialize

#: White space other than blank and newline, as Python or the library may see it.
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
_kept: dict[str, _Encoder] = {}


#: The byte-level pre-token pattern (a fixed value of such vocabularies).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _fast_merges(tokenizer: Any) -> Callable[[str], list[int]] | None:
    """The same merges in a library with less cost a call, for byte-level vocabularies whose ids are their merge ranks;
    None for any other."""
    try:
        import tiktoken
    except ImportError:  # then the first library does it all
        return None
    made = json.loads(tokenizer.to_str())
    model, pre = made["model"], made["pre_tokenizer"] or {}
    if made["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or model.get("ignore_merges"):
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    added = {t["content"] for t in made["added_tokens"]}
    byte = byte_of_char()
    ranks = {bytes(byte[c] for c in token): n for token, n in model["vocab"].items() if token not in added}
    return tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class _Encoder:
    """Token ids of texts as little-endian 32-bit bytes. A blank-separated chunk never shares a token with another one,
    so chunks are encoded once and remembered (up to `most` of them)."""

    def __init__(self, path: str, most: int = 700_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.fast = _fast_merges(self.tokenizer)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _chunks(self, texts: list[str]) -> Iterator[bytes]:
        if self.fast:
            return (struct.pack(f"<{len(ids)}I", *ids) for ids in map(self.fast, texts))
        return (np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.known) > self.most:
            self.known.clear()
        for text in texts:
            if not text:
                yield b""
                continue
            if text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or _ODD.search(text) or any(s in text for s in self.special):
                yield self._whole(text)
                continue
            first, *chunks = text.split(" ")
            if new := list(set(chunks).difference(self.known)):
                self.known.update(zip(new, self._chunks([f" {c}" for c in new]), strict=True))
            yield next(iter(self._chunks([first]))) + b"".join(map(self.known.__getitem__, chunks))


def _encoder(path: str) -> _Encoder:
    """This worker's encoder: what it has learned stays from task to task."""
    if path not in _kept:
        _kept[path] = _Encoder(path)
    return _kept[path]


def token_pieces(documents: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, binary, if asked for). A document longer than capacity is cut so
    that only its first piece is shorter."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                keys = batch.column(0)[i : i + 256]
                row, piece, start, length, crc, raw = [], [], [], [], [], []
                for r, ids in enumerate(encoder.encode(batch.column(1)[i : i + 256].fill_null("").to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    at, k = 0, 0
                    while at < n:
                        m = capacity if k else (n - 1) % capacity + 1
                        part = ids[4 * at : 4 * (at + m)]
                        row.append(r), piece.append(k), start.append(at), length.append(m), crc.append(zlib.crc32(part))
                        if with_ids:
                            raw.append(part)
                        at, k = at + m, k + 1
                arrays = [keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(raw, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with the number of sequences of each pattern, for so many pieces of each length: of the plans
    that complete lengths with up to three others, two, or one, and of those that do so with several for large gaps alone,
    the one with fewest sequences, and with most others among equals. An exact complement wastes nothing itself, but pairs
    and triples use up short pieces that would have filled other gaps, so none of these plans is best for all lengths."""
    plans = [_plan(counts, capacity, most, floor) for most, floor in ((3, 0), (2, 0), (3, capacity // 4), (2, capacity // 4), (3, capacity // 2), (2, capacity // 2), (1, 0))]
    return min(plans, key=lambda plan: sum(n for _, n in plan))


def _plan(counts: dict[int, int], capacity: int, most: int, floor: int) -> list[tuple[tuple[int, ...], int]]:
    """Exact complements of one other length first, for all lengths, then of two and of three (up to `most`, for gaps of at
    least `floor`) for what is left; the rest is packed best-fit decreasing."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    done: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        done.append(((capacity,), int(left[capacity])))
        left[capacity] = 0

    def times(lengths: tuple[int, ...]) -> int:
        return min(int(left[x]) // lengths.count(x) for x in set(lengths))

    def pair(total: int, first: int = 0) -> tuple[int, int] | None:
        """Two lengths of that sum, the longest there is among them; first: a length that is spoken for already."""
        a = np.arange(1, total // 2 + 1)
        if not len(a):
            return None
        have = left.copy()
        if first:
            have[first] -= 1
        there = np.where(a == total - a, have[a] // 2, np.minimum(have[a], have[total - a])) > 0
        best = int(np.argmax(there))
        return (total - int(a[best]), int(a[best])) if there[best] else None

    def complement(long: int, others: int) -> tuple[int, ...] | None:
        """That many other lengths that fill the gap of `long` exactly."""
        gap = capacity - long
        left[long] -= 1
        try:
            if others == 1:
                return (gap,) if left[gap] > 0 else None
            if others == 2:
                return pair(gap)
            for a in np.flatnonzero(left[: gap - 1])[::-1] if gap > 2 else ():
                if found := pair(gap - int(a), int(a)):
                    return (int(a), *found)
            return None
        finally:
            left[long] += 1

    for others in range(1, most + 1):
        for long in range(capacity - (floor if others > 1 else 1), 0, -1):
            while left[long] > 0 and (found := complement(long, others)):
                pattern = (long, *found)
                n = times(pattern)
                for x in pattern:
                    left[x] -= n
                done.append((pattern, n))
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for long in range(capacity, 0, -1):
        n = int(left[long])
        while n:
            gap = min((g for g, groups in open_.items() if g >= long and groups), default=None)
            if gap is None:
                per = capacity // long
                for k, m in ((per, n // per), (n % per, 1)):
                    if k and m:
                        open_.setdefault(capacity - k * long, []).append(((long,) * k, m))
                n = 0
            else:
                pattern, m = open_[gap].pop()
                used = min(n, m)
                if m > used:
                    open_[gap].append((pattern, m - used))
                open_.setdefault(gap - long, []).append(((*pattern, long), used))
                n -= used
    return done + [x for groups in open_.values() for x in groups]


def pack(pieces: DataFrame, capacity: int = 1024, rows_per_block: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset to the pieces of token_pieces(). Ranks within a length are counted in blocks of about
    rows_per_block rows, so that a length which a third of all pieces have is no single task's work."""
    spark = pieces.sparkSession
    pieces = materialize(spark, pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    key, low, base, offset = [], [], [], []
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, n in plan_bins(counts, capacity):
        at = 0
        for length in pattern:
            first = taken.get(length, 0)
            key.append((length << 40) + first), low.append(first), base.append(sequence), offset.append(at)
            taken[length] = first + n
            at += length
        sequence += n
    order = np.argsort(np.array(key, dtype=np.int64))
    plan = spark.sparkContext.broadcast(tuple(np.array(x, dtype=np.int64)[order] for x in (key, low, base, offset)))  # rows: a bound of `capacity` alone

    blocks = max(1, sum(counts.values()) // rows_per_block)
    blocked = pieces.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    sizes = blocked.groupBy("length", "_block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_block").orderBy("doc_id", "piece", "ids_crc32", "start"))
    ranked = blocked.withColumn("_rank", within).join(sizes, ["length", "_block"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_before"))
    names = [*pieces.columns, "sequence_id", "offset"]

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, low, base, offset = plan.value
        for batch in batches:
            rank, length = batch.column("_rank").to_numpy(), batch.column("length").to_numpy()
            at = np.searchsorted(key, (length << 40) + rank, side="right") - 1
            extra = [pa.array(base[at] + rank - low[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names[:-2]] + extra, names=names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.select(*pieces.columns, F.col("_rank").cast("long").alias("_rank")).mapInArrow(place, schema)
