"""Removal of repeated word spans over a compacted de Bruijn graph.

The edges of the graph are the k-mers (windows of k words), its nodes the (k-1)-mers they join. A k-mer of many edges is
never shuffled alone: in each document, consecutive edges that share a minimizer (the least hash among their seeds of
`seed` words) form one path, known by the hash of all its words, so equal passages are cut into equal paths wherever they
stand. Spark joins then compact and resolve:

1. minimizers found in one document only carry no repeated edge, and their paths go (pre-aggregated, then a join);
2. a path found in a document with a smaller id is repeated as a whole, all its edges with it;
3. where a minimizer branches into several paths (the ends of passages), only the first copy of each path is opened into
   its edges, and those are resolved one by one.

Each repeated path or edge keeps its source coordinates: its own and those in the earliest document. Both places are read
again: the words at the earliest place are digested (BLAKE2b), the digest is joined to the repeats, and a document loses
words only where the digest of its own words is the same. A path that fails this test stays whole.

Every edge has exactly one minimizer, so equal edges always meet; nothing is sampled. Paths meet by hashes of 64 bits and are
held to digests of 64 more. A path has at most 256 edges (a longer one, in periodic text, is cut; pieces that don't agree
are opened like other branches), which is shorter than any two word sequences built to share a power sum modulo 2**64.

Cases: null and empty text have no words; documents with a null id remove nothing and cause no removal; rows of one id
are one document (a copy within it isn't repeated); of equal texts the smallest id keeps its words; texts of any length
are taken whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Words, materialize, signed, text_slices

_SHIFT = 22  # of the first word in a coordinate, before the number of edges
_MOST = 256  # edges of a path; longer ones are cut


def _paths(words: Words, k: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first word, edges, minimizer and text number of each path."""
    none = np.zeros(0, dtype=np.int64)
    n = len(words.hash)
    if n < k:
        return none, none, none.view(np.uint64), none
    seeds = words.windows(seed)
    span = k - seed + 1
    least, wide = seeds, 1
    while 2 * wide <= span:
        least = np.minimum(least[: len(least) - wide], least[wide:])
        wide *= 2
    m = n - k + 1
    least = np.minimum(least[:m], least[span - wide : span - wide + m])
    doc = words.doc()
    inside = doc[:m] == doc[k - 1 :]
    fresh = inside.copy()
    fresh[1:] &= (least[1:] != least[:-1]) | (doc[1:m] != doc[: m - 1]) | ~inside[:-1]
    begin = np.flatnonzero(fresh)
    stop = np.append(begin[1:], m)
    edges = np.searchsorted(np.flatnonzero(inside), stop) - np.searchsorted(np.flatnonzero(inside), begin)
    pieces = -(-edges // _MOST)
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin, edges = np.repeat(begin, pieces) + nth * _MOST, np.minimum(np.repeat(edges, pieces) - nth * _MOST, _MOST)
    return begin, edges, least[begin], doc[begin]


def paths(documents: DataFrame, k: int, seed: int) -> DataFrame:
    """v (minimizer), s (hash of the path's words), doc_id, pos (first word << 22 | edges); one pass, no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, bounds in text_slices(batch.column(1)):
                words = Words(data, bounds)
                begin, edges, least, doc = _paths(words, k, seed)
                pos = ((begin - words.first[doc]) << _SHIFT) | edges
                yield pa.RecordBatch.from_arrays([signed(least), signed(words.spans(begin, edges + k - 1)), pa.array(ids[i + doc]), pa.array(pos)], names=["v", "s", "doc_id", "pos"])

    return documents.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, "v long, s long, doc_id long, pos long")


def _placed(places: pa.ListArray, words: Words, k: int) -> tuple[np.ndarray, ...]:
    """Text number, first word, edges, hash and number in the flat list of the places whose words have the hash that they
    claim (rows of one id can differ); places: a list of structs with pos and s for each text, or null."""
    flat = places.flatten()
    row = np.repeat(np.arange(len(places)), pc.fill_null(pc.list_value_length(places), 0).to_numpy())
    pos, s = (flat.field(c).to_numpy() for c in ("pos", "s"))
    begin, edges = words.first[row] + (pos >> _SHIFT), pos & ((1 << _SHIFT) - 1)
    nth = np.flatnonzero(begin + edges + k - 1 <= words.first[row + 1])
    nth = nth[words.spans(begin[nth], edges[nth] + k - 1).view(np.int64) == s[nth]]
    return row[nth], begin[nth], edges[nth], s[nth], nth


def _digests(words: Words, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A digest of length[i] words from begin[i] on, each followed by a blank."""
    if not len(begin):
        return np.zeros(0, dtype=np.int64)
    size = words.end - words.start
    stop = np.cumsum(size + 1)
    out = np.full(int(stop[-1]), 0x20, dtype=np.uint8)
    out[np.arange(len(words.body)) + np.repeat(np.arange(len(size)), size)] = words.body
    raw = memoryview(out.tobytes())
    at = np.concatenate([[0], stop])
    found = [hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(at[begin].tolist(), at[begin + length].tolist(), strict=True)]
    return np.frombuffer(b"".join(found), dtype="<i8")


def edges_of(documents: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """s, doc_id, pos of each single edge of the chosen paths (doc_id, pos, s), opened at their source coordinates."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, data, bounds in text_slices(batch.column(1)):
                words = Words(data, bounds)
                row, begin, edges, _, _ = _placed(batch.column(2)[i:j], words, k)
                row, total = np.repeat(row, edges), int(edges.sum())
                at = np.repeat(begin - (np.cumsum(edges) - edges), edges) + np.arange(total)
                hashes = words.spans(at, np.full(total, k)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(ids[i + row]), pa.array(((at - words.first[row]) << _SHIFT) | 1)], names=["s", "doc_id", "pos"])

    lists = chosen.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "s")).alias("places"))  # within one document
    return documents.select("doc_id", "text").join(lists, "doc_id").select("doc_id", "text", "places").mapInArrow(run, "s long, doc_id long, pos long")


def sources(documents: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """s and digest of the words at the chosen places (doc_id, pos, s)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in text_slices(batch.column(0)):
                words = Words(data, bounds)
                _, begin, edges, s, _ = _placed(batch.column(1)[i:j], words, k)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(_digests(words, begin, edges + k - 1))], names=["s", "digest"])

    lists = chosen.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "s")).alias("places"))  # within one document
    read = documents.select("doc_id", "text").join(lists, "doc_id").select("text", "places").mapInArrow(run, "s long, digest long")
    return read.groupBy("s").agg(F.min("digest").alias("digest"))


def repeated(documents: DataFrame, k: int = 13, seed: int = 5) -> DataFrame:
    """doc_id, pos, s of all paths and edges that a document with a smaller id has too, and the digest of its words."""
    spark = documents.sparkSession
    rows = paths(documents, k, seed)
    # what is joined is a written table each time: a join of two plain exchanges is one whose hot keys Spark can split
    shared = materialize(spark, rows.groupBy("v").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("v"), "shared")
    rows = materialize(spark, rows.join(shared, "v"), "paths")
    first = materialize(spark, rows.groupBy("s").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")), "earliest")
    rows = materialize(spark, rows.join(first, "s"), "firsts")
    whole = rows.where("lo < doc_id").select("doc_id", "pos", "s")
    heads = rows.where("lo = doc_id").groupBy("v", "s", "doc_id", "hi").agg(F.min("pos").alias("pos"))
    branching = materialize(spark, heads.groupBy("v").agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a < b").select("v"), "branching")
    opened = rows.where("lo = doc_id").join(branching, "v", "left_semi").select("doc_id", "pos", "s")
    edges = materialize(spark, edges_of(documents, opened, k), "edges")
    earliest = materialize(spark, edges.groupBy("s").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("s", "lo"), "edges_of_several")
    single = materialize(spark, edges.join(earliest, "s"), "single")
    begun = heads.where("doc_id < hi").select("doc_id", "pos", "s").unionByName(single.where("lo = doc_id").groupBy("s", "doc_id").agg(F.min("pos").alias("pos")).select("doc_id", "pos", "s"))
    digests = materialize(spark, sources(documents, begun, k), "sources")
    again = materialize(spark, whole.unionByName(single.where("lo < doc_id").select("doc_id", "pos", "s")), "again")
    return materialize(spark, again.join(digests, "s"), "repeated")


def remove_repeated(documents: DataFrame, k: int = 13, seed: int = 5, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept words as text, if asked for) of every row."""
    found = repeated(documents, k, seed).groupBy("doc_id").agg(F.collect_list(F.struct("pos", "s", "digest")).alias("places"))  # within one document

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in text_slices(batch.column(1)):
                words, places = Words(data, bounds), batch.column(2)[i:j]
                row, begin, edges, _, nth = _placed(places, words, k)
                same = _digests(words, begin, edges + k - 1) == places.flatten().field("digest").to_numpy()[nth]
                row, begin, edges = row[same], begin[same], edges[same]
                cover = np.zeros(len(words.hash) + 1, dtype=np.int64)
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + edges + k - 1, -1)
                left = np.cumsum(cover)[:-1] == 0
                raw, n, gone, sha, kept = data.tobytes(), np.diff(words.first), [], [], []
                touched = np.zeros(j - i, dtype=bool)
                touched[row] = True
                for r in range(j - i):
                    own = raw[bounds[r] : bounds[r + 1]].split()
                    rest = list(compress(own, left[words.first[r] : words.first[r + 1]])) if touched[r] else own
                    text = b" ".join(rest)
                    gone.append(len(own) - len(rest)), sha.append(hashlib.sha256(text).hexdigest())
                    if with_text:
                        kept.append(text.decode())
                arrays = [batch.column(0)[i:j], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)] + [pa.array(kept)] * with_text
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * with_text)

    joined = documents.select("doc_id", "text").join(found, "doc_id", "left").select("doc_id", "text", "places")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text)
