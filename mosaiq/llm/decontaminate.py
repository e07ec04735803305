"""Benchmark decontamination by template canonicalisation, in DataFrame operations alone.

Every text is read in three views. In two of them numbers, quantities with units, and names become typed slots, and what
is left is lower case without punctuation; names are capitalised words inside a sentence in the first view, and all
capitalised words in the second. The third view is the plain lower-case words. Windows of `window` tokens of the
documents are hash-joined with those of the benchmark in each view, and hits are grouped by document, item and offset.

An item leaks into a document by `run` tokens in a row, or when the windows of one offset, or of offsets that follow each
other by at most `window`, cover the share `cover` of it. In the views with slots these must agree: within the covered
part each value of the item always stands for the same value of the document, and the other way round. So a question is
found again when its numbers, names and units have been exchanged, but not when only a pattern of slots recurs: windows
with few literal words aren't indexed there. The plain words find exact copies whatever they are made of.

The benchmark's windows, and the ids of documents whose slots are compared, are broadcast up to `most` of them, and joined
by a shuffle beyond that.

Cases: null and empty texts and items match nothing; an item shorter than a window is matched by one window of its own
length, with exchanged slots only if it has `literals` literal words; repeated items and rows give one row each pair of ids; rows with a null id
are reported with a null id; texts of any length are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

#: Names of units (fixed values, one list).
UNITS = "mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal s sec min h hr hrs ms kb mb gb tb hz khz mhz ghz v w kw kwh j kj cal kcal pa kpa bar usd eur gbp dollars euros pounds cents meters metres kilometers kilometres miles inches feet yards grams kilograms ounces liters litres gallons seconds minutes hours days weeks months years percent degrees".split()


def marked(text: Column, every: bool = False) -> Column:
    """The template tokens of a text, joined by blanks; a slot is § with its type (n, u, a) and its value. With `every`,
    capitalised words in any other place have the type b."""
    t = F.translate(F.coalesce(text, F.lit("")), "§", " ")
    t = F.regexp_replace(t, r"(?=\p{Lu})(?<=[\p{Ll},;:] )\p{Lu}[\p{Ll}'’]+", "§a$0")
    t = F.regexp_replace(t, rf"(?=[0-9])(?<![\p{{L}}\p{{N}}§.,])([0-9][0-9.,]*)[ ]?(?i:({'|'.join(sorted(UNITS, key=len, reverse=True))})|%)(?![\p{{L}}\p{{N}}])", "§u$1¦$2")
    t = F.regexp_replace(t, r"(?=[0-9])(?<![\p{L}\p{N}§.,])[0-9](?:[0-9.,]*[0-9])?(?![\p{L}\p{N}¦])", "§n$0")
    if every:
        t = F.regexp_replace(t, r"(?=\p{Lu})(?<![\p{L}\p{N}§¦])\p{Lu}[\p{Ll}'’]+", "§b$0")
    return F.trim(F.regexp_replace(F.lower(t), r"(?s)(?:(?![\p{L}\p{N}§¦]|(?<=[0-9])[.,](?=[0-9])).)+", " "))


def _tokens(m: Column) -> Column:
    return F.when(m == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(m, "§([nua])[^ ]*", "§$1"), " "))


def templates(texts: DataFrame) -> DataFrame:
    """Adds _m (marked text) and _t (array of template tokens, empty for no tokens)."""
    return texts.withColumn("_m", marked(F.col("text"))).withColumn("_t", _tokens(F.col("_m")))


def _views(texts: DataFrame) -> DataFrame:
    """Adds _m0, _m1 (marked text with names inside a sentence, and with all capitalised words, as slots), _m2 (plain
    words) and the token arrays _t0, _t1, _t2."""
    df = texts.withColumn("_full", marked(F.col("text"), every=True))
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    df = df.select(*texts.columns, F.replace("_full", F.lit("§b"), F.lit("")).alias("_m0"), F.replace("_full", F.lit("§b"), F.lit("§a")).alias("_m1"), plain.alias("_m2"))
    for v in range(2):
        df = df.withColumn(f"_t{v}", _tokens(F.col(f"_m{v}")))
    return df.withColumn("_t2", F.when(F.col("_m2") == "", F.array().cast("array<string>")).otherwise(F.split("_m2", " ")))  # no slots


def _windows(df: DataFrame, shapes: list[tuple[int, int]], keep: list[str]) -> DataFrame:
    """keep, _n0, _n1, _n2 (tokens by view) and _w{k}, the hashes of all windows of each shape (view, size), by doubling
    where that fits. Hashes of different views differ."""
    sizes = [f"_n{v}" for v in range(3)]
    hashes = lambda v: F.transform(f"_t{v}", lambda w: F.xxhash64(w, F.lit(v)))
    df = df.select(*keep, *(F.size(f"_t{v}").alias(f"_n{v}") for v in range(3)), *(hashes(v).alias(f"_h{v}") for v in range(3)))
    made = {(v, 1): f"_h{v}" for v in range(3)}  # columns by view and size
    for view, size in sorted({(v, min(1 << i, s)) for v, s in shapes for i in range(1, s.bit_length() + 1)} - set(made)):
        half = 1 << ((size - 1).bit_length() - 1)  # two windows of this size, shifted, are one of `size`
        long, n = F.col(made[view, half]), F.greatest(F.col(f"_n{view}") - (size - 1), F.lit(0))
        made[view, size] = f"_v{view}_{size}"
        df = df.select("*", F.zip_with(F.slice(long, F.lit(1), n), F.slice(long, F.lit(size - half + 1), n), lambda a, b: F.xxhash64(a, b)).alias(made[view, size]))
    return df.select(*keep, *sizes, *(F.col(made[shape]).alias(f"_w{k}") for k, shape in enumerate(shapes)))


def leaks(documents: DataFrame, benchmark: DataFrame, window: int = 8, cover: float = 0.5, literals: int = 4, most: int = 1 << 20, run: int = 13) -> DataFrame:
    """doc_id, item_id, covered (tokens of the item), item_tokens, exact (no slot was exchanged) of each leak."""
    spark = documents.sparkSession
    items = materialize(spark, _views(benchmark.select("item_id", "text").distinct()).withColumn("_i", F.xxhash64("item_id", "text")), "items")
    shapes = [(v, window) for v in range(3)]
    for v in range(3):  # sizes of items of fewer than `window` tokens
        n = F.size(f"_t{v}")
        shapes += sorted((v, r["n"]) for r in items.where((n < window) & (n >= (1 if v == 2 else literals))).select(n.alias("n")).distinct().collect())
    literal = lambda a, i, size: F.size(F.filter(F.slice(a, i + 1, F.lit(size)), lambda w: ~w.startswith("§"))) >= literals
    # outer generators: an inner one makes Spark infer a filter on the array, which is pushed down with its whole formula
    index = None
    for k, (v, size) in enumerate(shapes):
        own = items.where(F.size(f"_t{v}") >= window if size == window else F.size(f"_t{v}") == size)
        own = _windows(own, [(v, size)], ["item_id", "_i", "_t0", "_t1", "_t2"]).select("item_id", "_i", f"_t{v}", F.posexplode_outer("_w0").alias("at", "h")).where("h is not null")
        own = own if v == 2 else own.where(literal(F.col(f"_t{v}"), F.col("at"), size))
        own = own.select("h", "item_id", "_i", "at", F.lit(k).alias("k"), F.lit(v).alias("v"), F.lit(size).alias("size"))
        index = own if index is None else index.unionByName(own)
    index = materialize(spark, index, "windows")
    index = F.broadcast(index) if index.count() <= most else index
    docs = _views(documents.select("doc_id", F.xxhash64("text").alias("t"), "text")).select("doc_id", "t", "_t0", "_t1", "_t2")
    docs = _windows(docs, shapes, ["doc_id", "t"]).select("doc_id", "t", "_n0", "_n1", "_n2", F.posexplode_outer(F.concat(*(f"_w{k}" for k in range(len(shapes))))).alias("pos", "h"))
    first = F.lit(0)  # of each shape's windows in the concatenation
    begins = []
    for v, size in shapes:
        begins.append(first)
        first = first + F.greatest(F.col(f"_n{v}") - (size - 1), F.lit(0))
    begin = F.coalesce(*(F.when(F.col("k") == k, b) for k, b in enumerate(begins)))
    hits = docs.join(index, "h").select("doc_id", "t", "item_id", "_i", "v", "size", (F.col("pos") - begin - F.col("at")).alias("off"), "at")
    pair = ["doc_id", "t", "item_id", "_i", "v"]
    runs = hits.groupBy(*pair, "off").agg(F.array_sort(F.collect_set("at")).alias("at"), F.max("size").alias("size"))  # at most an item's windows
    runs = runs.withColumn("place", F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x, x + F.col("size") - 1)))))
    grow = lambda a, x: F.when((F.size(a) > 0) & (x <= F.coalesce(F.try_element_at(a, F.lit(-1))["to"], F.lit(-1))), F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(a, F.lit(-1))["from"].alias("from"), (x + F.col("size")).alias("to"))))).otherwise(F.concat(a, F.array(F.struct(x.alias("from"), (x + F.col("size")).alias("to")))))
    runs = runs.withColumn("parts", F.aggregate("at", F.array().cast("array<struct<from:int,to:int>>"), grow))
    tokens = items.select("_i", F.explode(F.array(*(F.struct(F.lit(v).alias("v"), F.size(f"_t{v}").alias("item_tokens"), F.col(f"_m{v}").alias("item_m")) for v in range(3)))).alias("s")).select("_i", "s.*")
    runs = runs.join(tokens.drop("item_m"), ["_i", "v"])
    near = Window.partitionBy(*pair).orderBy("off")
    runs = runs.withColumn("new", F.when(F.col("off") - F.lag("off").over(near) > window, 1).otherwise(0)).withColumn("cluster", F.sum("new").over(near)).drop("new")
    runs = materialize(spark, runs, "runs")
    enough = lambda n: n >= cover * F.col("item_tokens")
    mapped = lambda place: F.transform(place, lambda i: F.struct(i.alias("i"), (i + F.col("off")).alias("j")))
    long = runs.select(*pair, "item_tokens", "off", F.explode(F.filter("parts", lambda p: p["to"] - p["from"] >= run)).alias("p")).select(*pair, "item_tokens", mapped(F.sequence(F.col("p.from"), F.col("p.to") - 1)).alias("map"))
    whole = runs.where(enough(F.size("place"))).select(*pair, "item_tokens", mapped(F.col("place")).alias("map"))
    # of a place that several neighbouring offsets cover, the offset that covers most counts
    several = runs.groupBy(*pair, "cluster", "item_tokens").agg(F.count("*").alias("c"), F.size(F.array_distinct(F.flatten(F.collect_list("place")))).alias("n")).where((F.col("c") > 1) & enough(F.col("n")))
    same_pair = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in [*pair, "cluster"]]
    joined = runs.alias("x").join(several.alias("y"), same_pair, "left_semi")
    places = joined.select(*pair, "cluster", "item_tokens", "off", F.size("place").alias("n"), F.explode("place").alias("i"))
    places = places.groupBy(*pair, "cluster", "item_tokens", "i").agg(F.max(F.struct("n", "off")).alias("best"))
    spread = places.groupBy(*pair, "cluster", "item_tokens").agg(F.collect_list(F.struct("i", (F.col("i") + F.col("best.off")).alias("j"))).alias("map")).drop("cluster")
    units = materialize(spark, long.unionByName(whole).unionByName(spread), "units")
    copied = units.where("v = 2").select("doc_id", "item_id", F.size("map").alias("covered"), "item_tokens", F.lit(False).alias("templated"), F.lit(True).alias("same"))
    units = units.where("v < 2")
    texts = documents.select("doc_id", F.xxhash64("text").alias("t"), "text")
    chosen = materialize(spark, units.select(F.col("doc_id").alias("d"), F.col("t").alias("u")).distinct(), "chosen")
    chosen = F.broadcast(chosen) if chosen.count() <= most else chosen  # two longs a row
    texts = texts.join(chosen, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("u")), "left_semi").select(F.col("doc_id").alias("d"), F.col("t").alias("u"), marked(F.col("text"), every=True).alias("doc_m")).distinct()
    both = units.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("u"))).join(tokens.drop("item_tokens"), ["_i", "v"])
    doc_m = F.replace("doc_m", F.lit("§b"), F.when(F.col("v") == 0, "").otherwise("§a"))
    # bound to a variable, since Spark would else put the splitting into the lambdas, once for each place
    sides = F.array(F.struct(F.split("item_m", " ").alias("item"), F.split(doc_m, " ").alias("doc")))
    pairs = lambda s: F.transform("map", lambda p: F.struct(F.get(s["item"], p["i"]).alias("a"), F.get(s["doc"], p["j"]).alias("b")))
    slots = F.transform(sides, lambda s: F.array_distinct(F.filter(pairs(s), lambda p: p["a"].startswith("§"))))
    one = lambda s, side: F.size(F.array_distinct(F.transform(s, lambda p: p[side]))) == F.size(s)
    verdict = F.transform(slots, lambda s: F.when(one(s, "a") & one(s, "b"), ~F.exists(s, lambda p: p["a"] != p["b"])))
    both = both.select("doc_id", "item_id", F.size("map").alias("covered"), "item_tokens", F.lit(True).alias("templated"), F.explode_outer(verdict).alias("same"))
    found = both.where("same is not null")
    best = F.max(F.struct((F.col("covered") / F.col("item_tokens")).alias("share"), "templated", "covered", "item_tokens"))
    out = found.unionByName(copied).groupBy("doc_id", "item_id").agg(best.alias("b"), F.max("same").alias("exact"))
    return out.select("doc_id", "item_id", F.col("b.covered").cast("long").alias("covered"), F.col("b.item_tokens").cast("long").alias("item_tokens"), "exact")


def clean(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents without any leak (rows with a null id stay)."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
