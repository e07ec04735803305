"""Language-model scoring by context-tree weighting over the bytes of whole texts.

A text is its words, lower-cased in A-Z, then one end. It is spelled as one run of bytes: every word is followed by a
blank, and the end is a line feed, which no word holds. The model gives each byte from the `depth` bytes before it,
whatever words they belong to; before a text stand line feeds. Each byte is eight binary decisions. In the tree of
contexts, every node keeps the zeros and ones that followed it and the Krichevsky-Trofimov probability of them; its
weighted probability is the even mixture of that and the product of its children's. The probability of a decision along a
context path is then kt * gamma + (deeper) * (1 - gamma) with gamma the node's posterior weight, which is exactly the
quotient of two weighted probabilities: estimates of all depths are mixed.

All training documents count. A gram is a context with the byte after it, packed into a long; each task counts the grams of
its texts before they are shuffled. Nodes of the same last four context bytes meet in one task (at most 2**24 grams at
depth 6, whatever the corpus), where the deep levels are computed; the levels above are one grouped aggregation and one
join each. Nothing is collected but the `head` most frequent grams and the `head_words` most frequent words, which are most
of the text and would be hot keys: they are broadcast, a bounded table. Documents get the others by a join.

Cases: null and empty text have the end alone; ids are hashed as text, a null id as the empty string; documents that share
an id share its fold; words never seen in training have c = 0, and bytes never seen are given by what the shorter contexts
say; with no training text all bits cost one bit; texts of any length are scored whole; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Words, materialize, signed, text_slices

END = 0x0A
_LN2, _LN10 = math.log(2.0), math.log(10.0)
_NEAR = 4  # context bytes that nodes computed in one task share
_WORD = np.uint64(1 << 63)  # set in the keys of words, not in those of grams


def _kinds(documents: DataFrame, folds: int, fold: int) -> DataFrame:
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold
    return documents.select("doc_id", held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))


def spelled(words: Words, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams of the texts' bytes in order, and the number of the text that each belongs to."""
    n, size = np.diff(words.first), words.end - words.start
    doc = words.doc()
    after = np.cumsum(size)
    begin = after - size + np.arange(len(size)) + (depth + 1) * doc + depth
    out = np.full(len(words.body) + len(size) + (depth + 1) * len(n), 0x20, dtype=np.uint8)
    out[np.repeat(begin - (after - size), size) + np.arange(len(words.body))] = words.body
    length = np.bincount(doc, weights=size + 1, minlength=len(n)).astype(np.int64) + depth + 1
    stop = np.cumsum(length)
    for k in range(depth):
        out[stop - length + k] = END
    out[stop - 1] = END
    wide = out.astype(np.uint64)
    grams = np.zeros(max(0, len(out) - depth), dtype=np.uint64)
    for k in range(depth + 1):
        grams = (grams << np.uint64(8)) | wide[k : len(out) - depth + k]
    owner = np.repeat(np.arange(len(n)), length - depth)
    return grams[np.arange(len(owner)) + depth * owner], owner


def counts(documents: DataFrame, depth: int, most: int = 1 << 21) -> DataFrame:
    """key, n: how often each gram, and each word, is in the training texts (0: in held-out ones alone)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            held = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, bounds in text_slices(batch.column(1)):
                words = Words(data, bounds, lower=True)
                grams, owner = spelled(words, depth)
                trained = ~held[i : i + len(bounds) - 1]
                for found, of in ((grams, owner), (words.hash | _WORD, words.doc())):
                    used = trained[of]
                    for part, weight in ((found[used], 1), (found[~used], 0)):
                        u, c = np.unique(part, return_counts=True)
                        key, n = np.concatenate([key, u]), np.concatenate([n, c * weight])
                if len(key) > most:
                    key, n = _summed(key, n)
                    if len(key) > most // 2:
                        yield from rows(key, n)
                        key, n = key[:0], n[:0]
        yield from rows(*_summed(key, n))

    def rows(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(key), 1 << 17):
            yield pa.RecordBatch.from_arrays([signed(key[i : i + (1 << 17)]), pa.array(n[i : i + (1 << 17)])], names=["key", "n"])

    return documents.select("held_out", "text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their numbers."""
    if not len(key):
        return key, n
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[at], np.add.reduceat(n[order], at)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series at x + 8, stepped back; its error is below 1e-12."""
    y = x + 8.0
    back = x
    for i in range(1, 8):
        back = back * (x + i)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1.0 / (12.0 * y) - 1.0 / (360.0 * y * y * y) + 1.0 / (1260.0 * y * y * y * y * y) - np.log(back)


class _Level:
    """Nodes of one context length, for each number k of bits known of the next byte: `at[k]` holds context and bits in
    order, a and b the zeros and ones that followed."""

    def __init__(self, grams: np.ndarray, n: np.ndarray) -> None:
        self.grams, self.n = grams, n
        self.at, self.a, self.b, self.row = [], [], [], []
        for k in range(8):
            prefix = grams >> np.uint64(8 - k)
            new = np.ones(len(grams), dtype=bool)
            new[1:] = prefix[1:] != prefix[:-1]
            first = np.flatnonzero(new)
            one = ((grams >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64)
            self.at.append(prefix[first])
            self.a.append(np.add.reduceat(n * (1 - one), first).astype(float))
            self.b.append(np.add.reduceat(n * one, first).astype(float))
            self.row.append(np.cumsum(new) - 1)
        self.lw: list[np.ndarray] = []
        self.gamma: list[np.ndarray] = []

    def above(self, d: int) -> _Level:
        """The level of contexts of d bytes."""
        return _Level(*_summed(self.grams & np.uint64((1 << (8 * d + 8)) - 1), self.n))

    def parents(self, up: _Level, d: int, k: int) -> np.ndarray:
        """For each node of k bits its place in the level of contexts of d bytes."""
        return np.searchsorted(up.at[k], self.at[k] & np.uint64((1 << (8 * d + k)) - 1))

    def weigh(self, below: _Level | None, d: int) -> None:
        """Sets the weighted probabilities (ln) and posterior weights, from those of the level below."""
        for k in range(8):
            a, b = self.a[k], self.b[k]
            kt = _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - math.log(math.pi) - _log_gamma(a + b + 1.0)
            if below is None:
                self.lw.append(kt), self.gamma.append(np.ones(len(kt)))
                continue
            kids = np.bincount(below.parents(self, d, k), weights=below.lw[k], minlength=len(kt))
            lw = np.logaddexp(kt, kids) - _LN2
            self.lw.append(lw), self.gamma.append(np.exp(kt - _LN2 - lw))

    def one(self, k: int) -> np.ndarray:
        return (self.b[k] + 0.5) / (self.a[k] + self.b[k] + 1.0)


def _deep(grams: np.ndarray, n: np.ndarray, depth: int) -> list[_Level]:
    """Levels of `depth` down to _NEAR context bytes, weighed."""
    levels = [_Level(grams, n)]
    levels[0].weigh(None, depth)
    for d in range(depth - 1, _NEAR - 1, -1):
        levels.append(levels[-1].above(d))
        levels[-1].weigh(levels[-2], d)
    return levels


def _chunks(batches: Iterable[pa.RecordBatch], least: int = 1 << 19) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first one, in chunks that end where its value changes."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if sum(len(x[0]) for x in held) >= least:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            if cut:
                yield [x[:cut] for x in columns]
            held = [[x[cut:] for x in columns]]
    if held and sum(len(x[0]) for x in held):
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _near(key: Column) -> Column:
    """The last _NEAR context bytes of a gram."""
    return F.shiftright(key, 8).bitwiseAND(F.lit((1 << (8 * _NEAR)) - 1))


def _log_kt(a: Column, b: Column) -> Column:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones: G(a+1/2) G(b+1/2) / (pi G(a+b+1))."""

    def log_gamma(x: Column) -> Column:
        y = x + 8.0
        back = x
        for i in range(1, 8):
            back = back * (x + float(i))
        return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1.0 / (12.0 * y) - 1.0 / (360.0 * y * y * y) + 1.0 / (1260.0 * y * y * y * y * y) - F.log(back)

    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - math.log(math.pi) - log_gamma(a + b + 1.0)


def byte_model(grams: DataFrame, depth: int) -> DataFrame:
    """key, n, lp: log10 probability of the last byte of each gram after the bytes before it.

    Bottom up, a level's nodes are those of the level below without their oldest byte; top down, the mixture so far and the
    weight left for deeper nodes are handed on."""
    spark = grams.sparkSession

    def up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key, n in _chunks(batches):
            order = np.argsort(key)
            level = _deep(key[order].view(np.uint64), n[order], depth)[-1]
            for k in range(8):
                at = level.at[k].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at >> k), pa.array(((at & ((1 << k) - 1)) | (1 << k)).astype(np.int32)), *(pa.array(x[k]) for x in (level.a, level.b, level.lw))], names=["ctx", "node", "a", "b", "lw"])

    def down(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for near, key, n, node, p, left in _chunks(batches):
            is_gram = node == 0
            order = np.argsort(key[is_gram])
            grams, n = key[is_gram][order].view(np.uint64), n[is_gram][order]
            levels = _deep(grams, n, depth)
            lp = np.zeros(len(grams))
            for k in range(8):
                here = (node >> k) == 1
                bits = (near[here].view(np.uint64) << np.uint64(k)) | (node[here] - (1 << k)).astype(np.uint64)
                place = np.argsort(bits)
                place = place[np.searchsorted(bits, levels[-1].at[k], sorter=place)]
                mixed, rest = p[here][place], left[here][place]
                for i in range(len(levels) - 1, -1, -1):
                    level = levels[i]
                    if i < len(levels) - 1:
                        at = level.parents(levels[i + 1], _NEAR + len(levels) - 2 - i, k)
                        mixed, rest = mixed[at], rest[at]
                    mixed, rest = mixed + rest * level.gamma[k] * level.one(k), rest * (1.0 - level.gamma[k])
                row = levels[0].row[k]
                one = ((grams >> np.uint64(7 - k)) & np.uint64(1)) == 1
                lp += np.log10(np.where(one, mixed[row], 1.0 - mixed[row]))
            yield pa.RecordBatch.from_arrays([signed(grams), pa.array(n), pa.array(lp)], names=["key", "n", "lp"])

    near = grams.select(_near(F.col("key")).alias("near"), "key", "n")
    below = materialize(spark, near.repartition("near").sortWithinPartitions("near").mapInArrow(up, "ctx long, node int, a double, b double, lw double"), f"level{_NEAR}")
    deepest, levels = below, {}
    for d in range(_NEAR - 1, -1, -1):
        here = below.groupBy(F.col("ctx").bitwiseAND(F.lit((1 << (8 * d)) - 1)).alias("ctx"), "node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("lw").alias("kids"))
        here = here.withColumn("kt", _log_kt(F.col("a"), F.col("b"))).withColumn("top", F.greatest("kt", "kids"))
        here = here.withColumn("lw", F.col("top") + F.log(F.exp(F.col("kt") - F.col("top")) + F.exp(F.col("kids") - F.col("top"))) - _LN2)
        here = here.select("ctx", "node", "a", "b", "lw", F.exp(F.col("kt") - _LN2 - F.col("lw")).alias("gamma"))
        below = levels[d] = materialize(spark, here, f"level{d}")
    above = None
    for d in range(_NEAR):
        one = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1.0)
        here = levels[d].select("ctx", "node", one.alias("one"), "gamma", F.lit(0.0).alias("_p"), F.lit(1.0).alias("_left"))
        if above is not None:
            here = _under(here.drop("_p", "_left"), above, d - 1)
        here = here.select("ctx", "node", (F.col("_p") + F.col("_left") * F.col("gamma") * F.col("one")).alias("p"), (F.col("_left") * (1.0 - F.col("gamma"))).alias("left"))
        above = materialize(spark, here, f"mixed{d}")
    paths = _under(deepest.select("ctx", "node"), above, _NEAR - 1)
    paths = paths.select(F.col("ctx").alias("near"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("n"), "node", F.col("_p").alias("p"), F.col("_left").alias("left"))
    nothing = F.lit(0.0)
    rows = near.select("near", "key", "n", F.lit(0).alias("node"), nothing.alias("p"), nothing.alias("left")).unionByName(paths)
    return materialize(spark, rows.repartition("near").sortWithinPartitions("near").mapInArrow(down, "key long, n long, lp double"), "model")


def _under(nodes: DataFrame, above: DataFrame, d: int) -> DataFrame:
    """nodes with _p and _left of their parents, whose contexts have d bytes."""
    over = above.select(F.col("ctx").alias("_up"), "node", F.col("p").alias("_p"), F.col("left").alias("_left"))
    return nodes.withColumn("_up", F.col("ctx").bitwiseAND(F.lit((1 << (8 * d)) - 1))).join(over, ["_up", "node"]).drop("_up")


class Lookup:
    """Values of up to some million 64-bit keys, in open addressing; key 0 is never there."""

    def __init__(self, key: np.ndarray, value: np.ndarray) -> None:
        self.bits = max(4, int(1.5 * len(key)).bit_length())  # at least a third of the slots stay empty
        self.key, self.value = np.zeros(1 << self.bits, dtype=np.uint64), np.zeros(1 << self.bits)
        there = key != 0
        key, value = key[there], value[there]
        at = self._slot(key)
        while len(key):
            empty = np.flatnonzero(self.key[at] == 0)
            _, first = np.unique(at[empty], return_index=True)
            set_ = empty[first]
            self.key[at[set_]], self.value[at[set_]] = key[set_], value[set_]
            left = np.ones(len(key), dtype=bool)
            left[set_] = False
            key, value, at = key[left], value[left], (at[left] + 1) & (len(self.key) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, key: np.ndarray) -> np.ndarray:
        """The values; nan for keys that aren't there."""
        out = np.full(len(key), np.nan)
        todo, at = np.arange(len(key)), self._slot(key)
        while len(todo):
            found = self.key[at]
            hit = (found == key) & (found != 0)
            out[todo[hit]] = self.value[at[hit]]
            on = ~hit & (found != 0)
            todo, key, at = todo[on], key[on], (at[on] + 1) & (len(self.key) - 1)
        return out


_kept: dict[str, Lookup] = {}


def _frequent(entries: DataFrame, most: int) -> DataFrame:
    """The entries of the greatest size classes (16 for each doubling of n) that hold at most `most` rows together."""
    sized = entries.withColumn("_size", F.floor(F.log2(F.col("n") + 1) * 16).cast("int"))
    left, least = most, 1 << 20
    for r in sized.groupBy("_size").agg(F.count("*").alias("n")).orderBy(F.desc("_size")).collect():  # about 1000 classes at most
        left -= r["n"]
        if left < 0:
            break
        least = r["_size"]
    return sized.where(F.col("_size") >= least).select("key", "v")


def score(documents: DataFrame, folds: int = 7, fold: int = 2, depth: int = 6, head: int = 1 << 21, head_words: int = 1 << 18) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row; depth: 4 to 6."""
    if not _NEAR <= depth <= 6:
        raise ValueError("depth must be 4 to 6")
    spark = documents.sparkSession
    docs = _kinds(documents, folds, fold)
    counted = materialize(spark, counts(docs, depth), "counts")
    trained = docs.where(~F.col("held_out")).count()
    words = counted.where("key < 0")
    total, distinct = words.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = total + trained, distinct + (trained > 0)
    floor = math.log10(total + distinct + 1)
    words = words.select("key", "n", F.log10(F.col("n") + 1).alias("v"))
    grams = byte_model(counted.where("key >= 0"), depth).withColumnRenamed("lp", "v")
    entries = words.select("key", "v").unionByName(grams.select("key", "v"))
    top = _frequent(words, head_words).unionByName(_frequent(grams, head)).toArrow()  # head + head_words rows at most
    frequent = spark.sparkContext.broadcast((top.column("key").to_numpy().view(np.uint64), top.column("v").to_numpy()))
    name = uuid.uuid4().hex  # of this table among those that a worker has made

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each document one row of its frequent entries' sums (own is set), and one for each other distinct entry."""
        if name not in _kept:
            _kept.clear()
            _kept[name] = Lookup(*frequent.value)
        table = _kept[name]
        names = ["tokens", "known", "gain", "s", "letters"]
        for batch in batches:
            for i, j, data, bounds in text_slices(batch.column(3)):
                text, n = Words(data, bounds, lower=True), j - i
                sums, rest = [], []
                for key, of in ((text.hash | _WORD, text.doc()), spelled(text, depth)):
                    v = table.get(key)
                    no = np.isnan(v)
                    sums.append(np.bincount(of, weights=np.where(no, 0.0, v), minlength=n))
                    if not len(sums) - 1:
                        known = np.bincount(of, weights=~no & (v > 0), minlength=n)
                        letters = np.bincount(of, weights=text.end - text.start + 1, minlength=n) + 1.0
                    order = np.lexsort((key[no], of[no]))
                    key, of = key[no][order], of[no][order]
                    new = np.ones(len(key), dtype=bool)
                    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
                    at = np.flatnonzero(new)
                    rest.append((key[at], of[at], np.diff(np.append(at, len(key)))))
                other, of, k = (np.concatenate(x) for x in zip(*rest, strict=True))
                own = [np.diff(text.first) + 1.0, known, *sums, letters]
                row = np.concatenate([np.arange(n), of])
                keys = batch.slice(i, n)
                struct = pa.StructArray.from_arrays([pa.array(np.concatenate([x, np.zeros(len(k))])) for x in own], names=names, mask=pa.array(np.arange(len(row)) >= n))
                ids = [keys.column(x).take(pa.array(row)) for x in range(3)]
                spread = pa.array(np.concatenate([keys.column(2).to_numpy(), other.view(np.int64)]))  # a row of sums uses no entry; its key is any
                yield pa.RecordBatch.from_arrays([*ids, spread, pa.array(np.concatenate([np.zeros(n, dtype=np.int64), k])), struct], names=["doc_id", "held_out", "t", "key", "n", "own"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    sums = "own struct<tokens: double, known: double, gain: double, s: double, letters: double>"
    rows = docs.select("doc_id", "held_out", F.xxhash64("text").alias("t"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, t long, key long, n long, {sums}")
    rows = rows.join(entries, "key", "left")
    part = lambda name, tail: F.sum(F.when(F.col("own").isNull(), tail).otherwise(F.col(f"own.{name}"))).alias(name)
    word, gained = F.col("key") < 0, F.col("n") * F.col("v")
    by = rows.groupBy("doc_id", "held_out", "t").agg(F.count("own").alias("copies"), F.sum("own.tokens").alias("tokens"), F.sum("own.letters").alias("letters"), part("known", F.when(word & (F.col("v") > 0), F.col("n")).otherwise(0)), part("gain", F.when(word, gained).otherwise(0.0)), part("s", F.when(word, 0.0).otherwise(gained)))
    one = lambda name: F.col(name) / F.col("copies")
    out = by.select(
        "doc_id",
        "held_out",
        one("tokens").cast("long").alias("n_tokens"),
        (F.round(one("known")).cast("long") + int(trained > 0)).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (one("gain") + math.log10(trained + 1) - one("tokens") * floor).alias("base_score"),
        one("s").alias("score"),
        (-one("s") / math.log10(2.0) / one("letters")).alias("bits_per_byte"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    )
    return out.drop("_copy")
