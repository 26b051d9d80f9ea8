"""The registered queries of the corpus operators over the driver's tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasforge.llm import bpe, decontam, fingerprint, langid, linededup, pii, quality, setjoin, suffixtree, urlfilter
from atlasforge.llm.common import documents, fold


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document's whole text."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(documents(spark, sf_dir), path, public_tokenizers.PATTERN, with_ids=False)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from four of five rows with a language and predicts every whole text's language."""
    docs = documents(spark, sf_dir)
    model = langid.learn(docs, fold() != 0)
    texts = docs.select("doc_id", (fold() == 0).alias("held_out"), "text")
    return langid.identify(texts, model).drop("text")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns labels.quality from four of five labelled rows and scores every whole text."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label")).where((fold() != 0) & F.col("label").isNotNull())
    weights = quality.learn(docs, labels)
    scored = quality.score(docs, weights)
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness."""
    return fingerprint.edited_fingerprints(documents(spark, sf_dir))


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
JUNK_HOSTS = ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")
LIST_NUMBERS = 4000


def listed_urls(spark: SparkSession) -> DataFrame:
    """The list of junk URLs: pages by number on six hosts under three top domains in four languages,
    written in forms that only the canonical one makes equal to a page's."""
    of = lambda values: F.explode(F.array(*map(F.lit, values)))
    rows = spark.range(LIST_NUMBERS).withColumn("host", of(JUNK_HOSTS)).withColumn("top", of(("com", "net", "org"))).withColumn("lang", of(("en", "de", "fr", "es")))
    site = F.concat("host", F.lit(".EXAMPLE."), "top", F.lit("/"), "lang", F.lit("/"), "id")
    forms = [F.concat(F.lit("http://www."), site, F.lit("/?utm_source=list")), F.concat(F.lit("https://m."), site, F.lit("#listed")), F.concat(F.lit("ftp://"), site, F.lit("//"))]
    return rows.select(F.when(F.col("id") % 3 == 0, forms[0]).when(F.col("id") % 3 == 1, forms[1]).otherwise(forms[2]).alias("url"))


def op8_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every page's url by the rules, and else by the list of junk URLs, which is a table of its own."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return urlfilter.judge(pages, RULES, listed_urls(spark)).select("page_id", "host", "path", "rule", "verdict", "listed")


def op2_suffixtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every whole text; learns from four of five documents."""
    docs = documents(spark, sf_dir)
    scored = suffixtree.score(docs, fold() != 1)
    return scored.select("doc_id", (fold() == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_setjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of five-word shingles link at a Jaccard similarity of 0.8."""
    return setjoin.link_groups(documents(spark, sf_dir), size=5, percent=80)


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines that stay: their number, and a hash of the text that they make."""
    left = linededup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leak benchmark items, and which."""
    return decontam.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text."""
    return pii.summary(documents(spark, sf_dir))
