"""Benchmark decontamination by template windows, which also finds questions with changed values.

Columns only. Numbers, units next to numbers, and names (capitalised words that follow a lower-case
letter or a comma) become typed placeholders; other words are lower-cased. Every run of `WINDOW`
template tokens is hashed, by three rounds of pairing neighbours, and joined with the hashes of the
benchmark's windows. A document leaks an item if it has at least `min_share` of the item's distinct windows
and its values stand consistently for the item's: of the item's values, at least `min_consistent`
must meet one and the same value of the document wherever they occur. If they don't in the whole
document, each occurrence of the item is judged by itself, with its own share: windows that stand at one
distance from the item's, and runs of such distances that are at most a window apart. Windows of which more than
half are placeholders say nothing and are left out, unless an item has no other.

Items of fewer tokens than a window are matched as a whole, each length by windows of its own.
The benchmark's windows are broadcast if a count shows at most `MAX_BROADCAST` of them, and joined by
a shuffle beyond that. Documents are only read; what moves is the windows that matched.

Null or empty texts, and texts and items without a word, match nothing. Repeated rows of an id count
as one document, repeated items as items of their own; ties do not matter; nor do further columns.
Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atlasforge.llm.common import staged

WINDOW = 8
MAX_BROADCAST = 500_000
_NAME, _NUMBER, _UNIT = "\u0001", "\u0002", "\u0003"
#: Units that are placeholders where they follow a number.
UNITS = "km|cm|mm|m|kg|mg|g|ml|l|ms|s|h|min|minutes?|seconds?|hours?|days?|weeks?|months?|years?|miles?|feet|foot|inch|inches|pounds?|dollars?|euros?|cents?|percent|degrees?"


def tokens(text: Column) -> Column:
    """Words of a text in lower case; a placeholder's mark stands before its value."""
    named = F.regexp_replace(text, r"(?<=[\p{Ll},;] )\p{Lu}[\p{L}'’]*", _NAME + "$0")
    number = F.regexp_replace(named, r"(?<=\p{Nd})[.,:/](?=\p{Nd})", "_")
    number = F.regexp_replace(number, r"[$€£](?=\p{Nd})", f" {_UNIT}cur ")
    number = F.regexp_replace(number, r"(?<=\p{Nd})\s*%", f" {_UNIT}pct ")
    number = F.regexp_replace(number, rf"(?<=\p{{Nd}})\s*(?={_NAME}?(?:{UNITS})(?![\p{{L}}\p{{Nd}}]))", f" {_UNIT}")
    number = F.regexp_replace(number, r"(?<![\p{L}\p{Nd}_])\p{Nd}[\p{Nd}_]*", _NUMBER + "$0")
    marked = F.when(text.rlike(r"\p{Nd}"), number).otherwise(named)
    return F.filter(F.split(F.lower(marked), rf"[^\p{{L}}\p{{Nd}}_{_NAME}-{_UNIT}]+"), lambda t: t != "")


def _hashes(df: DataFrame, size: int) -> DataFrame:
    """Adds __h: hashes of all windows of `size` template tokens of __tokens, in order."""
    df = df.withColumn("__h", F.transform("__tokens", lambda t: F.xxhash64(F.when(t < "\u0004", F.substring(t, 1, 1)).otherwise(t))))
    span = 1  # what an entry covers; doubled while it fits, then one overlapping pair
    while span < size:
        step = min(span, size - span)
        df = df.withColumn("__n", F.size("__h"))
        df = df.withColumn("__h", F.when(F.col("__n") > step, F.zip_with(F.slice("__h", F.lit(1), F.col("__n") - step), F.slice("__h", F.lit(step + 1), F.col("__n") - step), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>")))
        span += step
    return df.drop("__n")


def template_windows(df: DataFrame, key: str, text_col: str, size: int = WINDOW) -> DataFrame:
    """(key, place, w): hashed windows of every text; places count from 0."""
    split = df.select(F.col(key).alias("key"), F.col(text_col).alias("__text")).where("__text is not null").select("key", tokens(F.col("__text")).alias("__tokens"))
    return _hashes(split, size).select("key", F.posexplode_outer("__h").alias("place", "w")).where("w is not null")  # the outer form: Spark infers a filter from the other, which would compute the windows twice at each level


def _slots(tokens_: Column) -> Column:
    return F.size(F.filter(tokens_, lambda t: t < "\u0004"))


def leaks(docs: DataFrame, benchmark: DataFrame, min_share: float = 0.5, min_consistent: float = 0.75, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, share, n_values, n_consistent, changed): the items that each document
    leaks; changed tells whether a value differs."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("__text")).where("__text is not null").select("item_id", tokens(F.col("__text")).alias("item_tokens")).where(F.size("item_tokens") > 0)
    lengths = sorted(r["n"] for r in items.select(F.least(F.size("item_tokens"), F.lit(WINDOW)).alias("n")).distinct().collect())  # at most WINDOW values
    found = None
    for size in lengths:
        own = items.where(F.size("item_tokens") == size) if size < WINDOW else items.where(F.size("item_tokens") >= WINDOW)
        hashed = _hashes(own.withColumnRenamed("item_tokens", "__tokens"), size).select("item_id", F.posexplode_outer("__h").alias("item_place", "w"), F.col("__tokens").alias("item_tokens"))
        part = F.slice("item_tokens", F.col("item_place") + 1, F.lit(size))
        hashed = hashed.select("item_id", "item_place", "w", part.alias("item_part"), _slots(part).alias("slots"))
        telling = hashed.groupBy("item_id").agg(F.min("slots").alias("fewest"))
        hashed = hashed.join(telling, "item_id").where(F.col("slots") * 2 <= F.greatest(F.lit(size), F.col("fewest") * 2)).drop("fewest")
        total = hashed.groupBy("item_id").agg(F.countDistinct("w").alias("n_item"))
        hashed = staged(hashed.join(total, "item_id"), "leak-items")
        keys = hashed.select("w", "item_id", "item_place", "n_item", "slots")
        if keys.count() <= MAX_BROADCAST:
            keys = F.broadcast(keys)
        windows = template_windows(docs, id_col, text_col, size).withColumnRenamed("key", "doc_id")
        met = staged(windows.join(keys, "w"), "leak-windows")
        shares = met.groupBy("doc_id", "item_id").agg(F.countDistinct("w").alias("n_windows"), F.first("n_item").alias("n_item")).withColumn("share", F.col("n_windows") / F.col("n_item")).where(F.col("share") >= min_share)
        each_pair = W.partitionBy("doc_id", "item_id")
        spots = met.join(shares.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_semi").withColumn("at", F.col("place") - F.col("item_place"))
        spots = spots.withColumn("apart", (F.col("at") - F.lag("at").over(each_pair.orderBy("at")) > WINDOW).cast("int"))
        spots = spots.withColumn("run", F.coalesce(F.sum("apart").over(each_pair.orderBy("at")), F.lit(0))).withColumn("several", F.min("at").over(each_pair) < F.max("at").over(each_pair))
        spot = lambda kind, at: F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("at"))
        whole, run, line = spot(0, F.lit(0)), spot(1, F.col("run")), spot(2, F.col("at"))
        spots = spots.withColumn("spot", F.explode(F.when(F.col("several"), F.array(whole, run, line)).otherwise(F.array(whole))))
        enough = spots.groupBy("doc_id", "item_id", "spot").agg((F.countDistinct("w") / F.first("n_item")).alias("here")).where(F.col("here") >= min_share).drop("here")
        values = spots.where("slots > 0").join(enough, ["doc_id", "item_id", "spot"], "left_semi")
        if values.limit(1).count():
            texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text")).join(values.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", tokens(F.col("__text")).alias("__tokens"))
            pairs = values.join(hashed.select("item_id", "item_place", "item_part"), ["item_id", "item_place"]).join(texts, "doc_id")
            pairs = pairs.select("doc_id", "item_id", "spot", F.explode(F.arrays_zip(F.col("item_part").alias("a"), F.slice("__tokens", F.col("place") + 1, F.lit(size)).alias("b"))).alias("p")).where("p.a < '\u0004'")
            each = pairs.groupBy("doc_id", "item_id", "spot", F.col("p.a").alias("a")).agg(F.countDistinct("p.b").alias("kinds"), F.max((F.col("p.a") != F.col("p.b")).cast("int")).alias("differs"))
            agree = each.groupBy("doc_id", "item_id", "spot").agg(F.count("*").alias("n_values"), F.sum((F.col("kinds") == 1).cast("int")).alias("n_consistent"), F.max("differs").alias("differs"))
            # the whole document if it is consistent, else the most consistent occurrence
            rank = F.struct((F.col("n_consistent") >= F.col("n_values") * min_consistent).alias("holds"), (F.col("spot.kind") == 0).alias("whole"), "n_consistent", (-F.col("n_values")).alias("fewer"), "n_values")
            agree = agree.groupBy("doc_id", "item_id").agg(F.max(rank).alias("best"), F.max("differs").alias("differs")).select("doc_id", "item_id", "best.n_values", "best.n_consistent", "differs")
            shares = shares.join(agree, ["doc_id", "item_id"], "left")
        else:
            shares = shares.withColumns({c: F.lit(None).cast("long") for c in ("n_values", "n_consistent", "differs")})
        shares = shares.select("doc_id", "item_id", "n_windows", "share", F.coalesce("n_values", F.lit(0)).cast("long").alias("n_values"), F.coalesce("n_consistent", F.lit(0)).cast("long").alias("n_consistent"), (F.coalesce("differs", F.lit(0)) > 0).alias("changed"))
        shares = shares.where(F.col("n_consistent") >= F.col("n_values") * min_consistent)
        found = shares if found is None else found.unionByName(shares)
    if found is None:  # no item has a word
        kinds = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
        found = docs.sparkSession.createDataFrame([], f"doc_id {kinds[0]}, item_id {kinds[1]}, n_windows bigint, share double, n_values bigint, n_consistent bigint, changed boolean")
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each document that leaks an item: doc_id, n_items, the items, n_windows and whether
    a value of any was changed."""
    return leaks(docs, benchmark, **options).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("item_ids"), F.sum("n_windows").alias("n_windows"), F.max("changed").alias("changed"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that leak nothing."""
    gone = contaminated(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias("__id"))
    return docs.join(gone, F.col(id_col) == F.col("__id"), "left_anti")
