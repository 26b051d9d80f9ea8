"""URL filters: host and path rules, and an exact list of URLs behind a blocked Bloom filter.

Columns only. Listed URLs are brought to a canonical form: host without a leading www or m, path
without closing slashes, query without tracking parameters, no scheme and no fragment. Their hashes
set four bits in one 64-bit word each; the words are a table (block, mask) whose length is at most
`MAX_BLOCKS`, so it may be broadcast whatever the list's length: a longer list only passes more
false hits. Possible hits go to an exact hash join on the canonical URL, which removes those; all
other rows never meet the list.

A null URL, or one without `://`, has an empty host and path, no rule, and is not listed. Repeated
URLs on either side do not multiply rows. Empty tables give empty results; an empty list blocks
nothing. Of rules that fit the longest wins, the first of equally long ones. Further columns of the
input stay, but for those that the result names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BLOCKS = 1 << 18
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = "^(utm_[a-z]+|ref|gclid|fbclid)="


def after_scheme(url: Column) -> Column:
    """What follows the first ://, or null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The canonical form; null where there is no ://."""
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)), "&")
    bare = F.concat(F.regexp_replace(host_of(url), r"^(www|m)\.", ""), F.regexp_replace(path_of(url), r"/+$", ""))
    return F.when(after_scheme(url).isNotNull(), F.concat(bare, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host/path) that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (says, text) in sorted(enumerate(rules), key=lambda x: (len(x[1][1]), -x[0])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _mask(url: Column) -> Column:
    h = F.xxhash64(url, F.lit("bits"))
    mask = F.lit(0).cast("bigint")
    for k in range(4):
        bit = F.pmod(F.shiftrightunsigned(h, 8 * k), F.lit(64)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return mask


def bloom(listed: DataFrame, url: str = "canonical") -> tuple[DataFrame, int]:
    """The filter as rows (block, mask), and over how many blocks it is dealt."""
    n, blocks = listed.agg(F.approx_count_distinct(url).alias("n")).first()["n"] or 0, 1
    while blocks < MAX_BLOCKS and blocks * 64 < n * 16:
        blocks *= 2
    words = listed.where(F.col(url).isNotNull()).groupBy(_block(F.col(url), blocks).alias("block")).agg(F.bit_or(_mask(F.col(url))).alias("mask"))
    return words, blocks


def judge(pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame, url_col: str = "url", list_col: str = "url") -> DataFrame:
    """The rows with host, path, rule, listed and verdict: the rule's, else block if the canonical URL
    is listed, else allow."""
    names = ("host", "path", "rule", "listed", "verdict")
    keep = [c for c in pages.columns if c not in names]
    url = F.col(url_col)
    host, path = F.col("__host"), F.col("__path")
    known = listed.select(canonical(F.col(list_col)).alias("__known")).where("__known is not null").distinct()
    words, blocks = bloom(known, "__known")
    rule, says = rule_of(host, path, rules)
    rows = pages.select(*(F.col(f"`{c}`") for c in keep), host_of(url).alias("__host"), path_of(url).alias("__path"), canonical(url).alias("__url"))
    rows = rows.withColumn("__block", F.coalesce(_block(F.col("__url"), blocks), F.lit(-1)))
    words = words.select(F.col("block").alias("__block"), F.col("mask").alias("__mask"))
    probed = rows.join(F.broadcast(words), "__block", "left")  # at most MAX_BLOCKS rows
    possible = F.coalesce(F.col("__mask").bitwiseAND(_mask(F.col("__url"))) == _mask(F.col("__url")), F.lit(False))
    hits = probed.where(possible).join(known, F.col("__url") == F.col("__known"), "left").withColumn("__listed", F.col("__known").isNotNull())
    rest = probed.where(~possible).withColumn("__listed", F.lit(False))
    columns = [*(F.col(f"`{c}`") for c in keep), host.alias("host"), path.alias("path"), rule.alias("rule"), F.col("__listed").alias("listed")]
    verdict = F.coalesce(says, F.when(F.col("__listed"), "block").otherwise("allow")).alias("verdict")
    return hits.select(*columns, verdict).unionByName(rest.select(*columns, verdict))
