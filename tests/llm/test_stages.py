"""Single stages of the pipeline against brute force and on awkward rows."""

import random
import re

import corpus_pipeline as P
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in ("h", "gone", "component_id", "ids")})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def kept(rows):
    """By all pairs: ids that stay."""
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return {i for i in root if find(i) == i}


def test_near_duplicates(spark):
    rnd = random.Random(2)
    rows = []
    for k in range(12):
        base = [f"w{rnd.randrange(400)}" for _ in range(90)]
        for m in range(4):
            w = list(base)
            for _ in range(m):
                w[rnd.randrange(90)] = "new"
            rows.append((len(rows) * 3 + 1, " ".join(w)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, ""), (904, "two words"), (905, "Two  words"), (904, "two words")]
    rnd.shuffle(rows)
    got = P.near_duplicates(spark, table(spark, rows), "").collect()
    stay = kept(rows)
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted((i, t or "") for i, t in rows if i in stay)
    assert [f for f in got[0].__fields__] == P.COLUMNS and 12 <= len(stay) < 48


def test_near_duplicates_of_shared_and_missing_ids(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    got = P.near_duplicates(spark, table(spark, [(3, a), (5, a), (5, b), (None, b + " x"), (8, "q")]), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, b + " x"), (3, a), (8, "q")]


def test_tokens_of_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "word " * 20_000), (4, "same"), (4, "same"), (None, "no id")]
    got = P.tokenize(spark, table(spark, rows), "").collect()
    assert sorted((r.doc_id or 0, r.n_tokens > 0) for r in got) == [(0, True), (1, False), (2, False), (3, True), (4, True), (4, True)]
    assert P.tokenize(spark, table(spark, rows).where("false"), "").count() == 0
