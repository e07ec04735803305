"""Quality rules with risk-controlled cutoffs, in DataFrame operations alone.

text_stats() measures every text. Each rule rejects a text whose score reaches a cutoff. The cutoffs come from labelled
good documents: in every stratum, the cutoffs of a rule are tested from lenient to strict, each by the exact binomial
test of "the share of good documents rejected is at least alpha / rules" (the Clopper-Pearson bound, turned around), and
the strictest cutoff before the first failure is taken. Testing in that fixed order needs no correction within a rule;
over rules and strata the level is divided (Bonferroni). So with probability 1 - delta no stratum loses more than alpha
of its good documents to the rules. A stratum with too few labels to prove anything has no cutoff, and loses none.

Cases: null and empty text have no words (and fail the base rule of 20 words); a null stratum is a stratum of its own;
repeated label rows count once, by their best quality; labels of unknown documents and null labels are ignored; an empty
table gives no rows; scores equal to the cutoff are rejected; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACES, materialize, words_of

SYMBOLS = "#*$%&|<>"
#: score of a rule in hundredths, from the columns of text_stats()
RULES = {
    "symbols": "100 * n_symbols div greatest(word_chars, 1)",
    "dup_lines": "100 * n_dup_lines div greatest(n_lines, 1)",
    "repeats": "100 * n_repeat_words div greatest(n_words, 1)",
    "capitals": "100 * n_upper div greatest(word_chars, 1)",
}
LEVELS = 101


def _repeat_words(dup: Column, h8: Column) -> list[tuple[str, Column]]:
    """Steps that count the words under windows found twice; each is null where there is no such window."""
    with_at = F.transform(h8, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    same = lambda x, k: F.coalesce(x["h"] == F.get("_sorted", k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("_sorted", k + 1)["h"], F.lit(False))
    places = F.array_compact(F.transform("_sorted", lambda x, k: F.when(same(x, k), x["i"])))
    start = F.struct(F.lit(-8).alias("at"), F.lit(0).cast("long").alias("n"))
    step = lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(8), i - a["at"])).cast("long").alias("n"))
    total = F.aggregate("_places", start, step, lambda a: a["n"])
    return [("_sorted", F.when(dup, F.sort_array(with_at))), ("_places", F.when(dup, F.sort_array(places))), ("n_repeat_words", F.when(dup, total).otherwise(F.lit(0).cast("long")))]


def text_stats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `keep`, and of each whole text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
    n_upper. One pass, no shuffle; windows are compared by 64-bit hashes within their text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = documents.select(F.col(id_col).alias("doc_id"), *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], text.alias("_text"))
    n = lambda c: F.length(c).cast("long")
    drop = lambda c, chars: F.translate(c, chars, "")
    kept = ["doc_id", *(f"_keep{i}" for i in range(len(keep)))]
    df = df.select(*kept, "_text", words_of(F.col("_text")).alias("_words"), F.filter(F.split("_text", "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "").alias("_lines"))
    df = df.select(
        *kept,
        F.size("_words").alias("_n"),
        n(drop(F.col("_text"), SPACES)).alias("word_chars"),
        (n(F.col("_text")) - n(drop(F.col("_text"), SYMBOLS))).alias("n_symbols"),
        (n(F.col("_text")) - n(drop(F.col("_text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).alias("n_upper"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h1"),
    )
    rest = [c for c in df.columns if c != "_h1"]
    for k in (1, 2, 4):  # the hash of 2k words from those of k words
        m = F.greatest(F.col("_n") - (2 * k - 1), F.lit(0))
        pairs = F.zip_with(F.slice(f"_h{k}", F.lit(1), m), F.slice(f"_h{k}", F.lit(k + 1), m), lambda a, b: F.xxhash64(a, b))
        df = df.select(*rest, F.when(F.col("_n") >= 8, pairs).alias(f"_h{2 * k}"))
    df = df.withColumn("_dup", F.coalesce(F.size(F.array_distinct("_h8")) < F.size("_h8"), F.lit(False)) & (F.col("_n") >= 8))
    for name, column in _repeat_words(F.col("_dup"), F.col("_h8")):
        df = df.withColumn(name, column)
    out = ["word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper"]
    return df.select("doc_id", *(F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)), F.col("_n").cast("long").alias("n_words"), *out)


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, stepped back; x >= 1. Its error is below 1e-12."""
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1.0 / (12.0 * y) - 1.0 / (360.0 * y * y * y) + 1.0 / (1260.0 * y * y * y * y * y)
    back = x
    for i in range(1, 8):
        back = back * (x + float(i))
    return series - F.log(back)


def binomial_tail(k: Column, n: Column, p: float, terms: int = 4000) -> Column:
    """P(Bin(n, p) <= k), or 1 where k >= n p. Terms fall geometrically below k; what comes after `terms` of them is
    bounded from above, so a bound is never too good."""
    k, n = k.cast("double"), n.cast("double")
    log_mass = _log_gamma(n + 1.0) - _log_gamma(k + 1.0) - _log_gamma(n - k + 1.0) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1.0 - p))
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(a: Column, j: Column) -> Column:
        i = k - j + 1.0
        t = a["t"] * i * (1.0 - p) / ((n - i + 1.0) * p)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    ratio = k * (1.0 - p) / ((n - k + 1.0) * p)
    steps = F.when(k >= 1, F.sequence(F.lit(1), F.least(k, F.lit(float(terms))).cast("int"))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, start, step, lambda a: a["s"] + F.when(k > terms, a["t"] * ratio / (1.0 - ratio)).otherwise(0.0))
    return F.when(k >= n * p, 1.0).otherwise(F.least(F.lit(1.0), F.exp(log_mass) * total))


def cutoffs(scored: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    """stratum and, for each rule, the strictest proven cutoff (null: none). scored: doc_id, stratum, text_hash and a score of 0
    to 100 for each rule. Good documents are counted, once for each text in a stratum (copies are no further evidence), by stratum, rule and score: at most 101 rows for each of those."""
    good = labels.select("doc_id", "quality").where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("q")).where("q = 1").select("doc_id")
    known = scored.join(good, "doc_id").dropDuplicates(["stratum", "text_hash"])
    held = known.select("stratum", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("score")) for r in RULES])).alias("_s"))
    counts = held.groupBy("stratum", "_s.rule", "_s.score").agg(F.count("*").alias("n"))
    by = counts.groupBy("stratum", "rule").agg(F.map_from_entries(F.collect_list(F.struct("score", "n"))).alias("_n"), F.sum("n").alias("n"))
    at = lambda t: F.aggregate(F.map_entries(F.map_filter("_n", lambda s, _: s >= t)), F.lit(0).cast("long"), lambda a, e: a + e["value"])
    tests = by.select("stratum", "rule", "n", F.explode(F.transform(F.sequence(F.lit(1), F.lit(LEVELS - 1)), lambda t: F.struct(t.alias("cutoff"), at(t).alias("k")))).alias("_t"))
    tests = tests.select("stratum", "rule", "_t.cutoff", binomial_tail(F.col("_t.k"), F.col("n"), alpha / len(RULES)).alias("p"))
    strata = F.greatest(F.lit(1), F.col("_strata"))
    tests = tests.crossJoin(F.broadcast(by.agg(F.countDistinct("stratum").alias("_strata"))))  # one row
    failed = F.max(F.when(F.col("p") > delta / (strata * len(RULES)), F.col("cutoff"))).alias("f")  # the strictest order ends at the first failure from above
    first = tests.groupBy("stratum", "rule").agg(failed, F.min("cutoff").alias("low"))
    first = first.select("stratum", "rule", F.coalesce(F.col("f") + 1, F.col("low")).alias("cutoff")).where(F.col("cutoff") < LEVELS)
    return first.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff")).select("stratum", *(F.col(r).alias(f"cut_{r}") for r in RULES))


def quality_rules(documents: DataFrame, labels: DataFrame, alpha: float = 0.04, delta: float = 0.05, stratum_col: str = "lang", most_strata: int = 10_000) -> DataFrame:
    """The stats of each document, base_failed, the cutoffs' verdicts (rejected_by, an array of rules) and kept."""
    spark = documents.sparkSession
    known = documents.select("doc_id", "text", F.col(stratum_col).alias("stratum"), F.xxhash64("text").alias("text_hash"))
    stats = materialize(spark, text_stats(known, keep=("stratum", "text_hash")), "stats")
    scored = stats.withColumn("stratum", F.coalesce(F.col("stratum").cast("string"), F.lit("")))
    scored = scored.withColumns({r: F.least(F.greatest(F.expr(e), F.lit(0)), F.lit(LEVELS - 1)).cast("int") for r, e in RULES.items()})
    found = materialize(spark, cutoffs(scored, labels, alpha, delta), "cutoffs")
    found = F.broadcast(found) if found.count() <= most_strata else found
    out = scored.join(found, "stratum", "left")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rejected = F.array_compact(F.array(*[F.when(F.col(r) >= F.col(f"cut_{r}"), F.lit(r)) for r in RULES]))
    out = out.withColumn("base_failed", base).withColumn("rejected_by", rejected)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")
