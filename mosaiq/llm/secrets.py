"""Secret scans: three fixed patterns, and character Markov models for what they miss, in DataFrame operations alone.

Two first-order models are trained from labelled samples: random strings and ordinary identifiers. Each pair of
characters of a run (RUN) adds its log-likelihood ratio. The models alone decide: a run is a secret when the sum over it
reaches `evidence` nats and the mean `threshold`, and no piece of it of four characters or more looks ordinary. Other runs
are cut into pieces at / _ - =, and neighbouring ones whose means reach the threshold are a secret when they hold the
evidence together. So a key in a path is found as well as one alone, in any
alphabet. The ratios make one literal array of a bigram's size (the alphabet squared), so scoring is a map over the
text without any join. Runs shorter than RUN says can't hold the evidence at the threshold's mean.

Spans are counted in code points, end exclusive, kind:start:end, ordered by start and then kind.

Cases: null and empty text have no spans; long texts are scanned whole, with positions from prefix sums (n log n in
their matches; more than 2**24 matches of a pattern in one text raise an error); repeated rows are scanned each; with no
labelled sample the models are even and add no span; other columns, whatever their names, are kept by redact().
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import words_of

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
RUN = r"[A-Za-z0-9+/_=-]{12,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KINDS = ("assign", "access", "hex", "markov")
MARK = "[SECRET]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sums(x: Column) -> Column:
    """Running sums of an int array by doubling; more than 2**24 entries are an error."""
    x = F.when(F.size(x) > 1 << 24, F.raise_error(F.lit("too many matches in one text")).cast("array<int>")).otherwise(x)

    def step(d: int) -> Callable[[Column], Column]:
        shifted = lambda a: F.concat(F.transform(F.slice(a, 1, d), lambda _: F.lit(0)), F.slice(a, F.lit(1), F.size(a) - d))
        return lambda a: F.when(F.size(a) <= d, a).otherwise(F.zip_with(a, shifted(a), lambda p, q: p + q))

    for k in range(24):
        x = _let(x, step(1 << k))
    return x


def _spans(text: Column, found: Column, pattern: str, kind: int) -> Column:
    """Array of (start, kind, end, value) of all matches `found` of the pattern; null where there is none."""
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), F.concat(F.array(F.lit("")), F.slice(found, F.lit(1), F.size(found) - 1)), lambda p, m: p + F.length(m))
    spans = F.zip_with(_sums(steps), found, lambda s, m: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + F.length(m)).alias("end"), m.alias("value")))
    return F.when(F.size(found) > 0, spans)


_NONE = "array<struct<start:int,kind:int,end:int,value:string>>"


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """The spans of all matches of a pattern."""
    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.coalesce(_spans(text, m, pattern, kind), F.array().cast(_NONE)))


def base_spans(text: Column) -> Column:
    """The spans of the three fixed patterns."""
    text = F.coalesce(text, F.lit(""))
    found = [_matches(text, p, k) for k, p in enumerate((ASSIGN, ACCESS, HEX))]
    return F.concat(F.filter(found[0], lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 8), *found[1:])


def bigrams(samples: DataFrame) -> DataFrame:
    """is_secret, a, b, n of labelled samples (value, is_secret, and n, how often): at most twice the alphabet squared."""
    clean = samples.where("value is not null and is_secret is not null").select("is_secret", "n", F.regexp_replace("value", r"[^A-Za-z0-9+/_=-]", "").alias("v"))
    pairs = clean.where(F.length("v") >= 2).select("is_secret", "n", F.explode(F.expr("transform(sequence(1, length(v) - 1), i -> substring(v, i, 2))")).alias("pair"))
    pairs = pairs.groupBy("is_secret", "pair").agg(F.sum("n").alias("n"))
    return pairs.select("is_secret", F.substring("pair", 1, 1).alias("a"), F.substring("pair", 2, 1).alias("b"), "n")


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios (nats) of b after a, at [a * size + b]; add-half smoothing."""
    size = len(ALPHABET)
    counts = {s: [[0.5] * size for _ in range(size)] for s in (True, False)}
    samples = samples if "n" in samples.columns else samples.withColumn("n", F.lit(1))
    for r in bigrams(samples).collect():  # bounded by the alphabet
        counts[r["is_secret"]][ALPHABET.index(r["a"])][ALPHABET.index(r["b"])] += r["n"]
    log = {s: [[math.log(x / sum(row)) for x in row] for row in counts[s]] for s in counts}
    return [log[True][a][b] - log[False][a][b] for a in range(size) for b in range(size)]


def labelled_samples(documents: DataFrame, labels: DataFrame, most: int = 1000, made: int = 6000) -> DataFrame:
    """value, is_secret, n. Ordinary: the words, and pairs of words written as identifiers, of at most `most` labelled
    documents of good quality (the least by a hash of their id) without a base match. Secret: what the base patterns found
    in them, and `made` strings from a hash in the usual alphabets (base 64, hexadecimal, letters of one case with digits)."""
    spark = documents.sparkSession
    ids = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    text = documents.select("doc_id", F.col("text").alias("text")).join(F.broadcast(ids), "doc_id", "left_semi").select("text", base_spans(F.col("text")).alias("base"))
    words = text.where(F.size("base") == 0).select(F.explode(words_of(F.col("text"))).alias("w")).where(F.length("w") > 3).groupBy("w").agg(F.count("*").alias("n"))
    ordinary = words.select("n", F.explode(F.array("w", F.concat("w", F.lit("_"), "w"), F.concat("w", F.initcap("w")), F.upper("w"), F.concat("w", F.lit("/"), "w"), F.concat("w", F.lit("-"), "w"))).alias("value"))
    caught = text.select(F.explode("base").alias("s")).select(F.when(F.col("s.kind") == 0, F.regexp_extract("s.value", ASSIGN, 2)).otherwise(F.col("s.value")).alias("value"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    mixed = F.base64(F.unhex(digest))
    letters = F.regexp_replace(mixed, "[+/=]", "")
    made_up = spark.range(made).select(F.explode(F.array(mixed, mixed, digest, F.upper(letters), F.lower(letters))).alias("value"))
    secret = caught.unionByName(made_up).withColumn("n", F.lit(1).cast("long"))
    return ordinary.withColumn("is_secret", F.lit(False)).unionByName(secret.withColumn("is_secret", F.lit(True)))


def _ratio_sum(run: Column, ratios: list[float], least: float | None = None) -> Column:
    """Sum of the log-likelihood ratios over a run's pairs of characters; with `least`, of those above it alone."""
    model = F.from_json(F.lit(json.dumps([round(x, 6) if least is None else max(least, round(x, 6)) for x in ratios])), "array<double>")
    place = F.from_json(F.lit(json.dumps([ALPHABET.find(chr(c)) for c in range(128)])), "array<int>")
    codes = F.transform(F.split(run, ""), lambda c: F.get(place, F.ascii(c)))
    pairs = lambda c: F.when(F.size(c) > 1, F.sequence(F.lit(1), F.size(c) - 1)).otherwise(F.array().cast("array<int>"))
    return _let(codes, lambda c: F.aggregate(pairs(c), F.lit(0.0), lambda a, i: a + F.get(model, F.get(c, i - 1) * len(ALPHABET) + F.get(c, i))))


def _random_parts(run: Column, ratios: list[float], evidence: float, threshold: float) -> Column:
    """Array of (from, to), offsets in a run, of its parts that the models call random."""
    pieces = F.transform(F.split(run, "[/_=-]", -1), lambda p: F.struct(F.length(p).alias("n"), _ratio_sum(p, ratios).alias("sum")))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("from"), F.lit(0).alias("to"), F.lit(0.0).alias("sum"), F.array().cast("array<struct<from:int,to:int>>").alias("parts"))
    closed = lambda a: F.when(a["sum"] >= evidence, F.concat(a["parts"], F.array(F.struct(a["from"].alias("from"), a["to"].alias("to"))))).otherwise(a["parts"])

    def step(a: Column, p: Column) -> Column:
        good, short = (p["n"] > 1) & (p["sum"] >= threshold * (p["n"] - 1)), p["n"] < 2
        return F.struct(
            (a["at"] + p["n"] + 1).alias("at"),
            F.when(good & (a["sum"] == 0), a["at"]).otherwise(a["from"]).alias("from"),
            F.when(good, a["at"] + p["n"]).otherwise(a["to"]).alias("to"),
            F.when(good, a["sum"] + p["sum"]).when(short, a["sum"]).otherwise(0.0).alias("sum"),
            F.when(good | short, a["parts"]).otherwise(closed(a)).alias("parts"),
        )

    enough = _let(_ratio_sum(run, ratios), lambda s: (s >= evidence) & (s >= threshold * (F.length(run) - 1)))
    whole = lambda x: enough & ~F.exists(x, lambda p: (p["n"] >= 4) & (p["sum"] < 0))
    return _let(pieces, lambda x: F.when(whole(x), F.array(F.struct(F.lit(0).alias("from"), F.length(run).alias("to")))).otherwise(F.aggregate(x, start, step, closed)))


def find_secrets(documents: DataFrame, ratios: list[float], threshold: float = 2.0, evidence: float = 24.0, text_col: str = "text") -> DataFrame:
    """row (all columns of the input), text, base and spans (base spans, and what the models call random), each ordered by
    start and kind."""
    df = documents.select(F.struct("*").alias("row")).select("row", F.col(f"row.{text_col}").alias("text"))
    df = df.withColumn("base", base_spans(F.col("text")))
    text = F.coalesce(F.col("text"), F.lit(""))
    clear = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    parts = lambda s: F.transform(_random_parts(s["value"], ratios, evidence, threshold), lambda p: F.struct((s["start"] + p["from"]).alias("start"), F.lit(3).alias("kind"), (s["start"] + p["to"]).alias("end"), F.substring(s["value"], p["from"] + 1, p["to"] - p["from"]).alias("value")))
    hopeful = lambda run: _ratio_sum(run, ratios, 0.0) >= evidence  # noqa: E731  no part of another run can reach it
    runs = F.when(F.exists(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), hopeful), F.filter(_matches(text, RUN, 3), lambda s: hopeful(s["value"])))
    df = df.withColumn("runs", F.coalesce(runs, F.array().cast(_NONE)))
    df = df.withColumn("random", F.flatten(F.transform("runs", parts))).withColumn("random", F.filter("random", clear))
    return df.select("row", "text", F.sort_array("base").alias("base"), F.sort_array(F.concat("base", "random")).alias("spans"))


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added of find_secrets()."""
    n = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as long)").alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    return found.select("row.doc_id", *n, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))


def redact(found: DataFrame, text_col: str = "text") -> DataFrame:
    """The input's rows with every span of the text replaced by [SECRET] (spans that meet become one each)."""
    ends = F.transform("spans", lambda s: s["end"])
    reach = F.transform(ends, lambda _, i: F.array_max(F.slice(ends, F.lit(1), i + 1)))
    outer = _let(reach, lambda m: F.filter(F.transform("spans", lambda s, i: F.struct(s["start"].alias("start"), F.get(m, i).alias("end"), F.coalesce(F.get(m, i - 1), F.lit(0)).alias("before"))), lambda s: s["start"] >= s["before"]))
    # a span that begins under an earlier one only carries the end on
    last = F.array_max(ends)
    pieces = _let(outer, lambda o: F.concat(F.transform(o, lambda s: F.substring(F.col("text"), s["before"] + 1, s["start"] - s["before"])), F.array(F.substring(F.col("text"), last + 1, F.length("text")))))
    clean = F.when(F.size("spans") > 0, F.array_join(pieces, MARK)).otherwise(F.col("text"))
    names = found.schema["row"].dataType.names
    return found.select(*(clean.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names))
