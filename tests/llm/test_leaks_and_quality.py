"""Decontamination, the quality classifier and the pipeline."""

import random

import duckdb
import pytest
from brute import op4, words
from test_contracts import documents

from mosaiq.llm import decontaminate, quality_classifier, secrets
from mosaiq.llm._common import table

SF = "/root/testdata/sf0.001"


def pairs(df):
    return {(r["doc_id"], r["item_id"]): r["exact"] for r in df.collect()}


def test_templates(spark):
    rows = [(1, "Sold 12 apples to Mary for 3.50 dollars, and Bob paid 5 km away in 10kg."), (2, None), (3, ""), (4, "§ 1,000.5 x2 é!")]
    got = {r["doc_id"]: (r["_m"], r["_t"]) for r in decontaminate.templates(documents(spark, rows)).collect()}
    assert " ".join(got[1][1]) == "sold §n apples to §a for §u and §a paid §u away in §u"
    assert got[1][0].split(" ")[4] == "§amary" and "§u10¦kg" in got[1][0]
    assert got[2][1] == [] and got[3][1] == [] and got[4][1] == ["§n", "x2", "é"]


def test_op3_planted(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 7)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(12)]
    question = "the farmer {a} has {n} red apples and buys {m} more apples, then {a} gives {k} kg of them to {b} who sold {n} of the apples again"
    items.append((50, question.format(a="Anna", b="Bob", n=12, m=5, k=3)))
    items.append((51, "short item of six words"))
    items += [(52, None), (53, ""), (54, "12 13 14 15 16 17 18 19 20 21 22")]
    noise = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, f"{noise(40)} {items[i][1]} {noise(10)}") for i in range(12)]
    rows += [(100, f"{noise(5)}. " + question.format(a="Zoe", b="Max", n=77, m=9, k=8.5) + " " + noise(5))]
    rows += [(101, question.format(a="Zoe", b="Max", n=77, m=9, k=8).replace("sold 77", "sold 78"))]  # one number stands for two
    rows += [(102, f"{noise(4)} short item of six words {noise(4)}"), (103, None), (104, ""), (105, noise(300)), (106, "1 2 3 4 5 6 7 8 9 10 11 12 13"), (107, " ".join(items[0][1].split()[:10])), (0, rows[0][1])]
    got = pairs(decontaminate.leaks(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")))
    assert {k for k in got} == {(i, i) for i in range(12)} | {(100, 50), (102, 51)}
    assert got[100, 50] is False and got[3, 3] is True


def _leaked(spark, item, *texts):
    got = pairs(decontaminate.leaks(documents(spark, list(enumerate(texts))), spark.createDataFrame([(0, item)], "item_id long, text string")))
    return sorted(d for d, _ in got)


def test_op3_passages_and_broken_copies(spark):
    w = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    passage = "so it goes on " + " ".join(w[20:33]) + " and then ends"
    inserted = " ".join([*w[:20], "quite", *w[20:40], "so", "very", *w[40:]])
    broken = " ".join(x for i in range(0, 60, 12) for x in [*w[i : i + 10], "xx", "yy"])  # runs of ten, 50 of 60 tokens
    item = "the tall old farmer from the far north {a} sold some green apples there and then went home {b} carried them out again"
    assert _leaked(spark, " ".join(w), passage, inserted, broken, " ".join(w[20:32])) == [0, 1, 2]
    assert _leaked(spark, item.format(a="anna", b="bob"), item.format(a="anna of kent", b="mary jane smith")) == [0]


def test_op3_names_that_begin_sentences(spark):
    item = "{a} has 12 apples. {b} buys 5 apples. {a} gives 3 to {b}. \"{a} has how many apples now?\" asks {b}."
    other = item.format(a="Zoe", b="Max").replace("12", "70").replace("5", "8").replace("3", "9")
    assert _leaked(spark, item.format(a="Anna", b="Bob"), other, other.replace("Max buys", "Zoe buys"), f"question: {other}") == [0, 2]


def test_op3_exact_copies_of_short_and_slot_rich_items(spark):
    assert _leaked(spark, "What is the capital city of France", "we were asked in the question: What is the capital city of France and more") == [0]
    assert _leaked(spark, "12 + 13 = 25, 14 + 15 = 29", "see 12 + 13 = 25, 14 + 15 = 29 here", "see 13 + 13 = 26, 14 + 16 = 30 here") == [0]
    assert _leaked(spark, "Anna Bob Carl", "then Anna Bob Carl left", "then Anna Bob Max left") == [0]


def test_op3_finds_whole_items_and_spares_the_rest(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    got = set(pairs(decontaminate.leaks(docs, bench)))
    d, b = ([tuple(r) for r in x.select(*c).collect()] for x, c in ((docs, ("doc_id", "text")), (bench, ("item_id", "text"))))
    whole = {(i, j) for i, t in d for j, u in b if u in t and len(words(u)) >= 10}
    assert whole and whole <= got
    share = lambda t, u: len({tuple(words(t)[i : i + 4]) for i in range(len(words(t)) - 3)} & {tuple(words(u)[i : i + 4]) for i in range(len(words(u)) - 3)}) / max(1, len(words(u)) - 3)
    texts, items = dict(d), dict(b)
    assert all(share(texts[i], items[j]) > 0.2 for i, j in got)


def test_op7_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    part = labels.where("doc_id % 2 = 0")
    got = quality_classifier.classify(docs, part).select("doc_id", "kept").toPandas()
    truth = labels.where("doc_id % 2 = 1").toPandas().merge(got, on="doc_id")
    clean, bad = truth[(truth.quality == 1) & (truth.toxic == 0)], truth[(truth.quality == 0)]
    assert clean.kept.mean() > 0.93
    assert (~bad.kept).mean() > 0.8


def test_op7_difficult_rows(spark):
    rows = [(1, None), (2, ""), (None, "x y"), (3, "word " * 5000), (3, "word " * 5000), (4, "a\x00é")]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_classifier.classify(documents(spark, rows), none).collect()
    assert len(got) == len(rows) and all(r["kept"] for r in got)
    assert quality_classifier.classify(documents(spark, []), none).count() == 0


def test_op7_shrinkage(spark):
    from pyspark.sql import functions as F

    rows = [("big", "p", 3.0)] * 400 + [("big", "q", 3.0)] * 2 + [("bad", "p", -3.0)] * 400 + [("tiny", "p", -3.0)]
    got = {(r["host"], r["path"]): r["site"] for r in quality_classifier.sites(spark.createDataFrame(rows, "host string, path string, good double").withColumn("doc_id", F.lit(1))).collect()}
    assert got["bad", "p"] < got["tiny", "p"] < got["big", "q"] <= got["big", "p"] + 1e-6


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    names = docs.columns
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in seen.select("doc_id").collect()}
        seen = stage(spark, seen, SF).cache()
        assert seen.columns == names
        after = {r["doc_id"]: r for r in seen.collect()}
        assert set(after) <= before
        if name == "secret_scans":
            assert set(after) == before
            for i, r in after.items():
                assert op4(r["text"])[:3] == (0, 0, 0) and r["n_chars"] == len(r["text"])
                assert r["text"] == text[i] or secrets.MARK in r["text"]
    out = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == set(after)
    assert duckdb.__version__ and pytest


def test_pipeline_repeated_rows(spark):
    import corpus_pipeline

    rows = [(i, " ".join(f"w{i}_{j}" for j in range(40))) for i in range(5)] * 2 + [(9, " ".join(f"w1_{j}" for j in range(40)) + " z"), (None, "a b"), (None, "a b")]
    kept = corpus_pipeline.near_duplicates(spark, documents(spark, rows).drop("n_words", "key"), SF)
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect() if r["doc_id"] is not None) == [(False, i) for i in range(5)]
