"""Quality classifier: evidence of each document, combined with its site by hierarchical empirical Bayes.

A logistic model over a document's shape and hashed words is fitted on a bounded sample of labelled documents (`most`
rows, the least by a hash of their id; their features, not their texts, go to the driver), once for good quality and once for toxicity. Each document's probability is its
evidence. Grouped aggregation over all documents gives the sums of every host and of every path within a host; the
global mean and the spread between hosts (and between paths of a host) come from these by the method of moments. A host's
posterior mean is shrunk toward the global mean, a path's toward its host's, the more the fewer documents there are. A
document is kept when its evidence, moved by its path's posterior odds against the global odds, says good and not toxic.
The site's means leave the document itself out, so its evidence counts once. The table has no addresses: `source` stands
for the host, and `lang`, the part of a source that a document is in, for the path.

Hosts and paths are rows that are joined, never collected; only the global moments (one row) are broadcast.

Cases: null and empty texts have no words and go by their shape; null hosts and paths are a site of their own; with no
labels of both kinds, or none at all, everything is kept; repeated labels count once (the better one); repeated rows are
scored each; texts of any length are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import _IS_SPACE, Words, materialize, text_slices

BUCKETS = 1 << 16
SHAPE = 10


def shape(words: Words) -> np.ndarray:
    """SHAPE features of each text, each about 0 to 1."""
    data, bounds, n = words.data, words.bounds, np.diff(words.first)
    cum = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[bounds])
    per = lambda x, y: x / np.maximum(y, 1)
    letters = cum(~_IS_SPACE[data])
    size = words.end - words.start
    long = np.concatenate([[0], np.cumsum(size > 15)])[words.first]
    again = np.concatenate([[0], np.cumsum(np.concatenate([[False], words.hash[1:] == words.hash[:-1]]))]) if len(size) else np.zeros(1)
    symbol = np.isin(data, np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
    return np.stack(
        [
            np.log1p(n) / 10,
            (n < 20).astype(float),
            per(cum((data >= 65) & (data <= 90)), letters),
            per(cum((data >= 48) & (data <= 57)), letters),
            per(cum(symbol), letters),
            per(cum(data == 33), letters) * 4,
            per(np.diff(again[words.first]), n),
            per(np.diff(long), n),
            np.minimum(per(letters, n), 20) / 20,
            per(cum(data == 10), n) * 4,
        ],
        axis=1,
    )


def _columns(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word, and its weight: one over the root of its text's length."""
    n = np.diff(words.first)
    return (words.hash >> np.uint64(48)).astype(np.int64) % BUCKETS, np.repeat(1.0 / np.sqrt(np.maximum(n, 1)), n)


Sample = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def sample_features(documents: DataFrame) -> DataFrame:
    """quality, toxic, form (SHAPE numbers), cols and sums (a text's buckets and their weights) of labelled texts (quality,
    toxic, text), so that no text goes to the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in text_slices(batch.column(2)):
                words = Words(data, bounds, lower=True)
                col, value = _columns(words)
                key, where = np.unique(words.doc() * BUCKETS + col, return_inverse=True)
                sums = np.bincount(where, weights=value, minlength=len(key)).astype(np.float32)
                at = pa.array(np.searchsorted(key, np.arange(j - i + 1) * BUCKETS), pa.int32())
                form = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * SHAPE, pa.int32()), pa.array(shape(words).ravel()))
                lists = [pa.ListArray.from_arrays(at, x) for x in (pa.array((key % BUCKETS).astype(np.int32)), pa.array(sums))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], form, *lists], names=["quality", "toxic", "form", "cols", "sums"])

    kind = {f.name: f.dataType.simpleString() for f in documents.schema}
    return documents.select("quality", "toxic", "text").mapInArrow(run, f"quality {kind['quality']}, toxic {kind['toxic']}, form array<double>, cols array<int>, sums array<float>")


def _arrays(rows: pa.Table) -> Sample:
    """Shape, and row number, bucket and weight of the buckets of each row."""
    lists = [rows.column(c).combine_chunks() for c in ("form", "cols", "sums")]
    n = np.diff(lists[1].offsets.to_numpy())
    form, col, value = (x.flatten().to_numpy() for x in lists)
    return form.reshape(-1, SHAPE), np.repeat(np.arange(len(n), dtype=np.int32), n), col, value


def fit(sample: Sample, y: np.ndarray, rounds: int = 300, ridge: float = 1e-3) -> np.ndarray:
    """Weights (intercept, shape, buckets) of a logistic model by Adam on all rows at once."""
    form, row, col, value = sample
    dense = np.concatenate([np.ones((len(y), 1)), form], axis=1)
    m = dense.shape[1]
    w = np.zeros(m + BUCKETS)
    first, second = np.zeros_like(w), np.zeros_like(w)
    rate = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for i in range(1, rounds + 1):
        z = dense @ w[:m] + np.bincount(row, weights=w[m:][col] * value, minlength=len(y))
        error = (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - y) * rate
        g = np.concatenate([dense.T @ error, np.bincount(col, weights=error[row] * value, minlength=BUCKETS)]) + ridge * w / len(y)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= 0.05 * first / (1 - 0.9**i) / (np.sqrt(second / (1 - 0.999**i)) + 1e-8)
    return w


def predict(words: Words, w: np.ndarray) -> np.ndarray:
    col, value = _columns(words)
    n = len(words.bounds) - 1
    z = w[0] + shape(words) @ w[1 : SHAPE + 1]
    return z + (np.bincount(words.doc(), weights=w[SHAPE + 1 :][col] * value, minlength=n) if len(col) else 0.0)


def train(documents: DataFrame, labels: DataFrame, most: int = 6000) -> dict[str, np.ndarray]:
    """Weights for "good" and "toxic", where the sample has both kinds. The sample is bounded by `most` rows."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    labelled = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("quality", "toxic", F.coalesce("text", F.lit("")).alias("text"))
    sample = sample_features(labelled).toArrow()
    out = {}
    for name, column in (("good", "quality"), ("toxic", "toxic")):
        rows = sample.filter(sample.column(column).is_valid())
        y = rows.column(column).to_numpy().astype(float)
        if 0 < y.sum() < len(y):
            out[name] = fit(_arrays(rows), y)
    return out


def evidence(documents: DataFrame, model: dict[str, np.ndarray], host_col: str, path_col: str) -> DataFrame:
    """doc_id, host, path, good and toxic (log odds) of every row; no shuffle. The weights have a fixed size."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in text_slices(batch.column(3)):
                words = Words(data, bounds, lower=True)
                z = [np.clip(predict(words, sent.value[k]), -12, 12) if k in sent.value else np.full(j - i, 12.0 if k == "good" else -12.0) for k in ("good", "toxic")]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[i:j] for c in range(3)), *map(pa.array, z)], names=["doc_id", "host", "path", "good", "toxic"])

    site = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((host_col, "host"), (path_col, "path"))]
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", *site, "text").mapInArrow(run, f"doc_id {kind}, host string, path string, good double, toxic double")


def _odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1.0 - 1e-6))
    return F.log(p / (1.0 - p))


def _strength(mean: Column, n: Column, s: Column, center: Column) -> Column:
    """Prior rows of a Beta prior: center (1 - center) / variance between groups, less one, by moments; 1 to 10000."""
    noise = F.avg(center * (1.0 - center) / n)
    between = F.greatest(F.avg((s / n - center) * (s / n - center)) - noise, F.lit(1e-9))
    return F.least(F.greatest(F.avg(center * (1.0 - center)) / between - 1.0, F.lit(1.0)), F.lit(10_000.0))


def sites(scored: DataFrame) -> DataFrame:
    """host, path, n and s (sum of good) of the path, host_n, host_s, the prior strengths host_k and path_k, the global mean,
    and site (posterior mean of good of the path)."""
    p = 1.0 / (1.0 + F.exp(-F.col("good")))
    paths = materialize(scored.sparkSession, scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    one = hosts.agg(F.sum("host_s").alias("_s"), F.sum("host_n").alias("_n")).select((F.col("_s") / F.col("_n")).alias("mean"))
    hosts = hosts.crossJoin(F.broadcast(one))  # one row
    prior = hosts.agg(_strength(F.col("mean"), F.col("host_n"), F.col("host_s"), F.col("mean")).alias("host_k"))
    hosts = hosts.crossJoin(F.broadcast(prior)).withColumn("host_mean", (F.col("host_k") * F.col("mean") + F.col("host_s")) / (F.col("host_k") + F.col("host_n")))
    paths = paths.join(hosts, "host")
    inner = paths.agg(_strength(F.col("host_mean"), F.col("n"), F.col("s"), F.col("host_mean")).alias("path_k"))
    paths = paths.crossJoin(F.broadcast(inner))  # one row
    return paths.select("host", "path", "n", "s", "host_n", "host_s", "host_k", "path_k", "mean", site_mean(F.lit(0.0), F.lit(0)).alias("site"))


def site_mean(own: Column, rows: Column) -> Column:
    """Posterior mean of good of a path, from the columns of sites(), without `rows` rows that sum to `own`."""
    host = (F.col("host_k") * F.col("mean") + F.col("host_s") - own) / (F.col("host_k") + F.col("host_n") - rows)
    return (F.col("path_k") * host + F.col("s") - own) / (F.col("path_k") + F.col("n") - rows)


def classify(documents: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", most: int = 6000) -> DataFrame:
    """doc_id, evidence, site, posterior, toxic (probabilities) and kept of every row."""
    spark = documents.sparkSession
    scored = materialize(spark, evidence(documents, train(documents, labels, most), host_col, path_col), "evidence")
    sigmoid = lambda z: 1.0 / (1.0 + F.exp(-z))
    out = scored.join(sites(scored).drop("site"), ["host", "path"])
    out = out.withColumn("site", site_mean(sigmoid(F.col("good")), F.lit(1)))
    shift = _odds(F.col("site")) - _odds(F.col("mean"))
    out = out.select("doc_id", sigmoid(F.col("good")).alias("evidence"), "site", sigmoid(F.col("good") + shift).alias("posterior"), sigmoid(F.col("toxic")).alias("toxic"))
    return out.withColumn("kept", (F.col("posterior") >= 0.5) & (F.col("toxic") < 0.5))
