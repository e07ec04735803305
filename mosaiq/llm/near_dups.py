"""Near-duplicates by Order MinHash of labelled shingles, verified by banded alignment.

A text is the sequence of its shingles of five words, each labelled with its number of earlier occurrences in the text. A
sketch keeps the `few` least labelled shingles under one hash, in the order in which they stand in the text, so moved
blocks change it. Two sketches make a band; texts that agree in a band are candidates.

Links are decided by alignment alone: the longest common subsequence of two shingle sequences (labelled shingles are
unique within a text, so it is the longest increasing run of positions), found within a band of diagonals. With a and b
shingles and r of them aligned the similarity is r / (a + b - r), and 0.8 or more is a link. The band is max(a, b) less
the run that a link needs, and no aligned place of a link lies outside it, so no link is lost to the band. The shingles
aligned in both texts stand in one order, so two sketches agree with a chance of at least s (m s - 1) / (m - 1) at
similarity s and m shingles in both texts together; at 0.8 the chance that no band agrees is 3e-6 for long texts and
below 3e-5 for any.

Exact copies are merged first. Then groups of candidates (cells) are resolved without comparing all pairs:

1. In each band's group the text with the most candidates leads (an original among its copies); the others are compared
   with it. A text linked to the leader is in its class.
2. Let l be the leader, and u a text that shares too few shingles with l for a link (far). If a member x near u shares no
   shingle with it that l lacks, then of u's shingles that l has (U, and N that l lacks; X and M of x) at least
   t / (1 + t) (U + N + X + M) must be common, so 5 U - 4 N >= 4 (X + M) and 5 X - 4 M >= 4 (U + N) (at t = 0.8).
   So the cell falls into smaller ones: by each shingle that l lacks, and one of those texts that pass this bound.
3. A text that shares enough shingles with l, but in another order (moved), is sketched again with fresh hashes and four
   shingles a sketch, together with the texts linked to l, and cells of these keys follow.

A text of n shingles, h of which l has, can only be linked to one that shares t n - h or more of those that l lacks. So,
with these in one order for all texts of the cell (smallest group first), two linked texts meet by one of the first
(1 - t) n + 1 of each (prefix filter), and a text gets cells by these alone; most are of no group, and give no row. Where
t n - h is 0 or less, a text keeps all of them.

Cells of at most 4 `small` texts are compared pairwise, so a row has a bounded number of pairs, but only pairs that can
share enough of those shingles by their places in that order; larger ones get a leader again, without the leaders before.
The bound is four times as large at each further level, so this ends soon even where no member of a cell is central. Pairs
whose classes are known to be one are passed over.

A class is a connected component of links, and its id is its least doc_id.

Cases: null and empty texts, and those without words, only equal each other (null counts as empty); texts of one to four
words have one shingle; rows with a null id are returned with a null class and compare with nothing; rows of one id are
one document; ties of hashes can't occur within a text but by a collision of 64 bits; texts of any length are taken
whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Words, materialize, mix, signed, text_slices

_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_SALTS = 16


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled hashes of the shingles of each text in order, and the texts' bounds in them."""
    n = np.diff(words.first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    start = words.first[:-1][doc] + np.arange(bounds[-1]) - bounds[:-1][doc]
    h = words.spans(start, np.minimum(n, k)[doc])
    keyed = mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keyed, kind="stable")
    new = np.ones(len(h), dtype=bool)
    new[1:] = keyed[order][1:] != keyed[order][:-1]
    place = np.arange(len(h))
    nth = np.empty(len(h), dtype=np.uint64)
    nth[order] = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64)
    return mix(h + nth * np.uint64(0xD1B54A32D192ED03)), bounds


def band_keys(h: np.ndarray, bounds: np.ndarray, bands: int, per_band: int = 2, few: int = 2, seed: int = 97) -> np.ndarray:
    """A key for each text with shingles (rows) and band (columns)."""
    rng = np.random.default_rng(seed)
    starts = bounds[:-1]
    size = np.diff(bounds)
    keys = np.zeros((len(size), bands), dtype=np.uint64)
    for band in range(bands):
        for _ in range(per_band):
            x = h * np.uint64(rng.integers(1, 1 << 62) * 2 + 1)
            found = np.zeros((len(size), few), dtype=np.int64)
            for f in range(few):
                low = np.minimum.reduceat(x, starts)
                at = np.flatnonzero(x == np.repeat(low, size))
                owner = np.searchsorted(bounds, at, side="right") - 1
                found[owner[::-1], f] = at[::-1]
                x[found[:, f]] = np.where(size > f + 1, _TOP, x[found[:, f]])  # a text that has no further one keeps its last
            for kept in h[np.sort(found, axis=1)].T:  # in the order of the text
                keys[:, band] = mix(keys[:, band] * np.uint64(0x9FB21C651E98DF25) + kept)
        keys[:, band] = mix(keys[:, band] + np.uint64(band + 1))
    return keys


def sketch(documents: DataFrame, bands: int, k: int, per_band: int = 2, few: int = 2, seed: int = 97) -> DataFrame:
    """doc_id, same (digest of the text), n (shingles), keys (array, empty without words) of rows with an id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in text_slices(batch.column(2)):
                h, at = shingles(Words(data, bounds), k)
                n = np.diff(at)
                some = np.flatnonzero(n)
                lists = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))])
                keys = band_keys(h, np.append(at[:-1][some], at[-1]), bands, per_band, few, seed) if len(some) else np.zeros((0, bands), dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(n), pa.ListArray.from_arrays(pa.array(lists, pa.int32()), signed(keys.ravel()))], names=["doc_id", "same", "n", "keys"])

    rows = documents.where("doc_id is not null").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("same"), "text")
    return rows.mapInArrow(run, "doc_id long, same string, n long, keys array<long>")


def needed(a: int, b: int, least: float) -> int:
    """The least run of aligned shingles that makes texts of a and b shingles a link."""
    return math.ceil(least / (1.0 + least) * (a + b) - 1e-9)


def aligned(a: np.ndarray, b: np.ndarray, least: float) -> tuple[int, np.ndarray]:
    """Shingles aligned in order within the band, and a mask of b's shingles that a has; both hold labelled shingles."""
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    mask = np.zeros(len(b), dtype=bool)
    mask[j] = True
    if not len(common):
        return 0, mask
    band = max(len(a), len(b)) - needed(len(a), len(b), least)
    order = np.argsort(i)
    i, j = i[order], j[order]
    near = j[np.abs(j - i) <= band]
    if np.all(near[1:] > near[:-1]):
        return len(near), mask
    tails: list[int] = []
    for x in near.tolist():
        p = bisect_left(tails, x)
        tails[p : p + 1] = [x]
    return len(tails), mask


_COMPARED = "cell long, a long, b long, na long, nb long, run long, shared long, linked boolean, novel array<long>"


def compare(pairs: DataFrame, texts: DataFrame, least: float, k: int) -> DataFrame:
    """For pairs (cell, a, b): the numbers of their shingles, of those aligned and of those shared, whether they are linked,
    and, where cell is not 0, the shingles of b that a lacks. texts: doc_id, text. Texts move in sorted exchanges, whatever
    their number: they grow with the data, so they are never broadcast."""

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                rows = batch.slice(i, 64)
                both = pa.concat_arrays([rows.column(c).cast(pa.large_string()) for c in (3, 4)])
                m, cells = rows.num_rows, rows.column(0).to_numpy()
                [(_, _, data, bounds)] = text_slices(both, 1 << 62)
                h, cut = shingles(Words(data, bounds), k)
                na, nb = np.diff(cut)[:m], np.diff(cut)[m:]
                run, shared, novel = [], [], []
                for r in range(m):
                    a, b = h[cut[r] : cut[r + 1]], h[cut[m + r] : cut[m + r + 1]]
                    n, mask = aligned(a, b, least)
                    run.append(n), shared.append(int(mask.sum())), novel.append(b[~mask] if cells[r] else b[:0])
                linked = np.array(run) >= np.ceil(least / (1.0 + least) * (na + nb) - 1e-9)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in novel])]), pa.int32()), signed(np.concatenate(novel)))
                numbers = [pa.array(x, pa.int64()) for x in (na, nb, run, shared)]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in range(3)), *numbers, pa.array(linked), lists], names=["cell", "a", "b", "na", "nb", "run", "shared", "linked", "novel"])

    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("_ta"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("_tb"))
    both = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b")
    return both.select("cell", "a", "b", "_ta", "_tb").mapInArrow(verify, _COMPARED)


def components(edges: DataFrame) -> DataFrame:
    """node, comp (least node of its component) for every node of the edges (a, b): least labels of neighbours, then
    labels of labels, until nothing changes. Every round is a written table."""
    spark = edges.sparkSession
    both = materialize(spark, edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    label = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).select(F.col("a").alias("node"), "comp")
    label = materialize(spark, label, "labels")
    while True:
        seen = both.join(label.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        near = label.join(seen, "node").select("node", "comp", F.least("comp", "near").alias("low"))
        jump = label.select(F.col("node").alias("low"), F.col("comp").alias("further"))
        grown = materialize(spark, near.join(jump, "low", "left").select("node", F.least("low", F.coalesce("further", "low")).alias("comp"), (F.col("comp") > F.least("low", F.coalesce("further", "low"))).alias("moved")), "labels")
        label = grown.select("node", "comp")
        if grown.where("moved").isEmpty():
            return label


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """The classes (node, comp) after more links (a, b): components of the classes that the links join."""
    spark = label.sparkSession
    end = lambda c: label.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}"))
    joins = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    low = components(joins).select(F.col("node").alias("comp"), F.col("comp").alias("low"))
    known = label.join(low, "comp", "left").select("node", F.coalesce("low", "comp").alias("comp"))
    fresh = low.select(F.col("comp").alias("node"), F.col("low").alias("comp")).join(label.select("node"), "node", "left_anti")
    return materialize(spark, known.unionByName(fresh), "classes")


def _leaders(rows: DataFrame) -> DataFrame:
    """Pairs (cell, a, b) of the leader of each group (cell, key, c members) and its other members; the new cell is known by
    the old one and the leader. Of active members the one in the largest groups leads."""
    spark = rows.sparkSession
    rows = rows.join(rows.groupBy("cell", "node").agg(F.sum("c").alias("score")), ["cell", "node"])
    best = F.max(F.when(F.col("active"), F.struct("score", (-F.col("node")).alias("minus"))))
    leads = materialize(spark, rows.groupBy("cell", "key").agg(best.alias("_l")).select("cell", "key", (-F.col("_l.minus")).alias("lead")), "leads")
    pairs = rows.drop("score").join(leads, ["cell", "key"]).where("lead <> node")
    return pairs.select(F.xxhash64("cell", "lead").alias("cell"), F.col("lead").alias("a"), F.col("node").alias("b")).distinct()


def _open_groups(cells: DataFrame) -> DataFrame:
    """The rows, with c members, of groups (cell, key) in which two texts of different classes meet and one is active."""
    groups = cells.groupBy("cell", "key").agg(F.count("*").alias("c"), F.max("active").alias("open"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("c > 1 and open and x < y").select("cell", "key", "c")
    return cells.join(materialize(cells.sparkSession, groups, "groups"), ["cell", "key"])


def _prefixes(rows: DataFrame, least: float) -> DataFrame:
    """Of the rows of open groups those by which a text must meet one that it is linked to, and room: how many more of the
    shingles that the leader lacks can be common after this one. Shingles in no open group are common to no pair, and come
    first in the order. Key 0 stands for no shingle, so it stays, with room for none."""
    lack, zero = F.col("n") - F.col("have"), F.col("key") == 0
    own = Window.partitionBy("cell", "node", "have", zero)
    rows = rows.withColumn("room", F.count("*").over(own) - F.row_number().over(own.orderBy("c", "key")))
    must = F.ceil(least * F.col("n") - F.col("have") - 1e-9)
    kept = rows.where(zero | (must <= 0) | (F.col("room") + 1 >= must))
    return kept.withColumn("room", F.when(zero & (lack > 0), -1).otherwise(F.col("room"))).drop("c")


def _pairwise(rows: DataFrame, least: float) -> DataFrame:
    """Pairs (cell 0, a, b) within small groups, but for those of one class or with no active member, and those that can't
    share enough: at most what each shares with the old cell's leader, the shingle of the group, and those after it."""
    x, y = (rows.select("cell", "key", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "have", "comp", "active", "room"))) for s in ("x", "y"))
    met = x.join(y, ["cell", "key"]).where((F.col("node_x") < F.col("node_y")) & (F.col("comp_x") != F.col("comp_y")) & (F.col("active_x") | F.col("active_y")))
    most = F.least("have_x", "have_y") + 1 + F.least("room_x", "room_y")
    pairs = met.where(most >= least / (1.0 + least) * (F.col("n_x") + F.col("n_y")) - 1e-9)
    return pairs.select(F.lit(0).cast("long").alias("cell"), F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()


def _smaller(done: DataFrame, texts: DataFrame, least: float, k: int, bands: int, level: int) -> DataFrame | None:
    """The smaller cells (cell, key, node, n, have, active) of compared ones with members that aren't linked to the leader."""
    spark = done.sparkSession
    g = least / (1.0 + least)
    have, lack = F.col("shared"), F.col("nb") - F.col("shared")
    reach = (1.0 - g) * have - g * lack  # must be g times the other text's shingles, if they share none that the leader lacks
    far = ~F.col("linked") & (have < g * (F.col("na") + F.col("nb")) - 1e-9)
    cells = done.where("cell <> 0").select("cell", F.col("b").alias("node"), F.col("nb").alias("n"), have.alias("have"), "linked", "novel", far.alias("far"), reach.alias("reach"))
    bounds = cells.groupBy("cell").agg(F.max("far").alias("any_far"), F.max(~F.col("linked") & ~F.col("far")).alias("any_moved"), F.max(F.when(F.col("far"), F.col("reach"))).alias("most_far"), F.min(F.when(F.col("far"), F.col("n"))).alias("least_far"), F.max("reach").alias("most"), F.min("n").alias("least"))
    bounds = materialize(spark, bounds.where("any_far or any_moved"), "open")
    some = bounds.agg(F.max("any_far"), F.max("any_moved")).first()
    out = []
    if some[0]:
        open_ = cells.join(bounds.where("any_far").select("cell", "most_far", "least_far", "most", "least"), "cell")
        low = F.lit(g - 1e-9)
        bound = F.when(F.col("far"), (F.col("reach") >= low * F.col("least")) & (F.col("most") >= low * F.col("n"))).otherwise((F.col("most_far") >= low * F.col("n")) & (F.col("reach") >= low * F.col("least_far")))
        keys = F.when(bound, F.concat("novel", F.array(F.lit(0).cast("long")))).otherwise(F.col("novel"))
        out.append(open_.select("cell", F.explode(keys).alias("key"), "node", "n", "have", F.col("far").alias("active")))
    if some[1]:
        open_ = cells.where("not far").join(bounds.where("any_moved").select("cell"), "cell").select("cell", "node", "n", (~F.col("linked")).alias("active"))
        open_ = materialize(spark, open_, "moved")
        again = sketch(texts.join(open_.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi"), bands, k, 1, 4, 1000 + level)
        out.append(open_.join(again.select(F.col("doc_id").alias("node"), F.explode("keys").alias("key")), "node").select("cell", "key", "node", "n", F.col("n").alias("have"), "active"))
    if not out:
        return None
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def _salted(df: DataFrame, salt: Column) -> DataFrame:
    return df.withColumn("_salt", F.pmod(salt, F.lit(_SALTS)))


def _every_salt(df: DataFrame) -> DataFrame:
    """One row for each salt, so that a hot key's rows on the other side of a join spread over tasks."""
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))


def near_duplicates(documents: DataFrame, least: float = 0.8, k: int = 5, bands: int = 24, small: int = 64) -> DataFrame:
    """doc_id, text_id (least id with exactly this text), class_id, n_links (links found from this text) of every row."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = materialize(spark, sketch(docs, bands, k), "sketches")
    heads = _every_salt(made.groupBy("same").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").select("same", "rep"))
    member = _salted(made.select("doc_id", "same", "n", "keys"), F.xxhash64("doc_id")).join(heads, ["same", "_salt"], "left")
    member = materialize(spark, member.select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), "n", F.when(F.coalesce("rep", "doc_id") == F.col("doc_id"), F.col("keys")).alias("keys")), "members")
    nodes = member.where("keys is not null").select(F.col("doc_id").alias("node"), "n", "keys").distinct()
    rows = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = materialize(spark, rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "sizes")
    # written tables: the joins below are such whose hot keys Spark can split
    rows = materialize(spark, rows.join(shared, "key").select(F.lit(0).cast("long").alias("cell"), "key", "node", "n", F.lit(True).alias("active"), "c"), "rows")
    ids = rows.select(F.col("node").alias("doc_id")).distinct()
    texts = materialize(spark, docs.join(ids.hint("merge"), "doc_id", "left_semi").distinct(), "texts")
    # rows of one id with different texts are one document
    own = member.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).join(nodes.select(F.col("node").alias("a")), "a", "left_semi")
    done = materialize(spark, compare(_leaders(rows), texts, least, k), "compared")
    tables = [done.where("linked").select("a", "b")]
    label = materialize(spark, components(tables[0].unionByName(own)), "classes")
    level, most = 0, small
    while (cells := _smaller(done, texts, least, k, bands, level)) is not None:
        level, most = level + 1, 4 * most
        cells = materialize(spark, cells.distinct().join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "cells")
        cells = materialize(spark, _prefixes(_open_groups(cells), least), "prefixes")
        cells = materialize(spark, _open_groups(cells), "groups")
        pairs = _pairwise(cells.where(F.col("c") <= most), least)
        if not cells.where(F.col("c") > most).isEmpty():
            pairs = pairs.unionByName(_leaders(cells.where(F.col("c") > most)))
        done = materialize(spark, compare(pairs, texts, least, k), "compared")
        more = done.where("linked").select("a", "b")
        if not more.isEmpty():
            tables.append(more)
            label = merged(label, more)
    links = tables[0]
    for x in tables[1:]:
        links = links.unionByName(x)
    links = links.distinct()
    n_links = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    found = label.withColumnRenamed("node", "rep").join(n_links, "rep", "left")
    out = _salted(member.select("doc_id", "rep"), F.xxhash64("doc_id")).join(_every_salt(found), ["rep", "_salt"], "left")
    out = out.groupBy("doc_id").agg(F.min("rep").alias("text_id"), F.min(F.coalesce("comp", "rep")).alias("class_id"), F.max(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"))
    return docs.select("doc_id").join(out, "doc_id", "left").select("doc_id", "text_id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
