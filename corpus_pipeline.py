"""The corpus pipeline: five stages, each written and read again before the next.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs, the documents that its predecessor kept. All but
the last return the columns of documents. Null and repeated rows: see the operators; of repeated rows of one id, one
stays after the second stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import decontaminate, near_dups, packing, quality_classifier, queries, secrets
from mosaiq.llm._common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    verdicts = quality_classifier.classify(docs, table(spark, sf_dir, "labels"))
    rejected = verdicts.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays."""
    classes = near_dups.near_duplicates(docs)
    gone = classes.where("class_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    again = materialize(spark, docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept
    one = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(one)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which an item of the benchmark leaked go."""
    return decontaminate.clean(docs, decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))).select(docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced."""
    ratios = secrets.train(secrets.labelled_samples(docs, table(spark, sf_dir, "labels")))
    out = secrets.redact(secrets.find_secrets(docs, ratios))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every document, packed into sequences."""
    return packing.pack(packing.token_pieces(docs, queries._tokenizer("byte_bpe_50k.json")))


STAGES = [("quality_classifier", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secret_scans", secret_scans), ("packing", packs)]

#: A trained classifier, sketches and a tokenizer aren't SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
