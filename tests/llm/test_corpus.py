"""Corpus operators against brute force on small tables, and on awkward rows."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from atlasforge.llm import bpe, decontam, fingerprint, langid, linededup, pii, quality, queries, setjoin, suffixtree, urlfilter

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return WORD.findall((t or "").translate(LOW))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r[0]: r[1] or "" for r in docs.select("doc_id", "text").collect()}


LONG = " ".join(f"word{k % 997} and" for k in range(30_000))
ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, LONG, "en", None, 5),
    (4, LONG + " end", None, "a", 5),
    (5, "one two three four five six seven", "en", "a", None),
    (5, "one two three four five six seven", "en", "a", None),  # a repeated row
    (6, "One  two\tthree four\nfive six seven", None, "b", 3),
    (7, "short line\n\nshort line\nother", "en", "b", 3),
    (8, " \n\t ", "en", "b", 3),
    (9, "x" * 70_000, "en", "b", 3),
    (10, "naïve 🙂 e\u0301 \x00 \u2028 ß İ mail a@b.example.com +1 (555) 123-4567 http", "de", "b", 3),
    (11, "12 34 !!", "de", "b", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in ("h", "score", "block", "part", "item_id", "lines", "kind")})


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("doc_id < 0")


def test_bpe_matches_tiktoken(spark, odd, none, texts, docs):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df, rows in ((odd, [(r[0], r[1]) for r in ODD]), (docs, list(texts.items()))):
        got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.ids)) for r in bpe.encode_documents(df, path, P.PATTERN).collect())
        want = []
        for i, t in rows:
            ids = enc.encode_ordinary(t or "")
            want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
        assert got == sorted(want)
    assert bpe.encode_documents(none, path, P.PATTERN).count() == 0
    assert base64.b64encode(next(iter(ranks)))


def test_bpe_on_random_pieces():
    import random

    import public_tokenizers as P
    import tiktoken

    c = bpe.Coder(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    rnd = random.Random(5)
    signs = [chr(k) for k in [*range(0x250), 0x85, 0x2028, 0x3000, 0x4E00, 0x1F600]]
    for _ in range(2000):
        t = "".join(rnd.choice(rnd.choice((signs, "abetion s", "aA1 "))) for _ in range(rnd.randint(0, 60)))
        assert c.encode(t) == enc.encode_ordinary(t), repr(t)


def test_language_of_held_out_rows(spark, docs, odd, none):
    got = queries.op5_langid(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got) and all(0 <= r.score <= 1 for r in got)
    model = langid.learn(docs, F.col("doc_id") % 5 != 0)
    rows = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert {i for i, r in rows.items() if r.lang_pred == "und"} == {1, 2, 8, 11} and rows[1].score == 0
    assert langid.identify(odd, model).count() == len(ODD) and langid.identify(none, model).count() == 0
    assert rows[9].rejected and not any(r.rejected for r in langid.identify(docs, model).collect())
    empty = langid.learn(none, F.lit(True))
    assert {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    import numpy as np
    import pandas as pd

    codes, _ = langid.prepared(["abab abba cab abc", "bca aab"], 3)
    g = collections.Counter(tuple(codes[k : k + 3].tolist()) for k in range(len(codes) - 2))
    rows = pd.DataFrame([{"lang": "x", "a": 0, "b": (a << 42) | (b << 21) | c, "n": n} for (a, b, c), n in g.items()])
    m = langid.fit(rows, 3)
    alphabet = sorted({c for k in g for c in k[2:]})
    total = 0.0
    for c in [*alphabet, 0x4E00]:
        codes = np.array([ord("a"), ord("b"), c], dtype=np.uint32)
        h = langid.gram_hashes(codes, 3)
        p, k = 0.0, 2
        while True:
            at = min(np.searchsorted(m.grams[k], h[k][0]), len(m.grams[k]) - 1)
            if m.grams[k][at] == h[k][0]:
                p += m.logp[k][at, 0]
                break
            ctx = langid._hash_rows(codes[None, 2 - k : 2]) if k else None
            if k:
                at = min(np.searchsorted(m.contexts[k], ctx[0]), len(m.contexts[k]) - 1)
                p += m.backoff[k][at, 0] if m.contexts[k][at] == ctx[0] else 0
            else:
                p += m.unknown[0]
                break
            k -= 1
        total += math.exp(p)
    assert total == pytest.approx(1, abs=0.02)


def test_quality_on_held_out_rows(spark, odd, none):
    data = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{data}/labels.parquet")
    got = queries.op4_quality(spark, data).join(labels, "doc_id").where("held_out and quality is not null").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert sum(g > b for g in good for b in bad) > 0.97 * len(good) * len(bad)
    weights = quality.learn(odd, odd.select("doc_id", F.lit(None).cast("int").alias("label")))
    assert {r.score for r in quality.score(odd, weights).collect()} == {0.5} and quality.score(none, weights).count() == 0


def test_fingerprints(spark, odd, none, texts):
    got = {r.doc_id: r for r in queries.op6_fingerprint(spark, DATA).collect()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        t, nxt = texts[i], texts[order[(k + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        same = next((j for j, (a, b) in enumerate(zip(t, edited)) if a != b), min(len(t), len(edited)))
        assert r.lce_edited == same
    by_text = collections.defaultdict(set)
    for i, t in texts.items():
        by_text[t].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and len({min(v) for v in by_text.values()}) == len(by_text)
    assert fingerprint.edited_fingerprints(odd).count() == len(ODD) and fingerprint.edited_fingerprints(none).count() == 0
    assert {r.n_chars for r in fingerprint.fingerprints(odd).where("doc_id = 9").collect()} == {70_000}


def test_suffix_tree_base_and_gain(spark, odd, none, texts):
    got = {r.doc_id: r for r in queries.op2_suffixtree(spark, DATA).collect()}
    c = collections.Counter()
    toks = {i: [*words(t), "\n"] for i, t in texts.items()}
    for i, w in toks.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(w)
    n, v = sum(c.values()), len(c)
    for i, w in toks.items():
        r = got[i]
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert r.base_score == pytest.approx(base, rel=1e-9) and (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    rows = suffixtree.score(odd, F.col("doc_id") % 2 == 1).collect()
    assert len(rows) == len(ODD) and {r.n_tokens for r in rows if r.doc_id in (1, 2, 8)} == {1} and suffixtree.score(none, F.lit(True)).count() == 0


def test_suffix_tree_keeps_telling_contexts(spark):
    """b follows a, and d follows c, always: contexts of one token make both certain."""
    import random

    rnd = random.Random(1)
    rows = [(k, " ".join(rnd.choice(("a b", "c d")) for _ in range(200))) for k in range(20)]
    out = suffixtree.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True)).collect()
    assert all(r.score > r.base_score * 0.62 for r in out)


def sets_of(t):
    w = words(t)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def near_rows():
    import random

    rnd = random.Random(3)
    rows = []
    for g in range(6):
        base = [f"w{rnd.randrange(4000)}" for _ in range(rnd.choice((12, 60, 200)))]
        for _ in range(7):
            t = list(base)
            for _ in range(rnd.choice((0, 0, 1, 2, 3))):
                t[rnd.randrange(len(t))] = f"x{rnd.randrange(99)}"
            rows.append((len(rows), " ".join(t)))
    return rows


@pytest.mark.parametrize("chunk", [2000, 2])
def test_near_groups(spark, odd, none, docs, texts, chunk, monkeypatch):
    monkeypatch.setattr(setjoin, "CHUNK", chunk)
    near = near_rows()
    for df, rows in ((spark.createDataFrame(near, "doc_id long, text string"), near), (odd, [(r[0], r[1]) for r in ODD]), (docs, list(texts.items()))):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.link_groups(df).collect()}
        sets = {i: sets_of(t) for i, t in rows}
        low = {i: i for i in sets}
        changed = True
        ids = sorted(sets)
        edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if linked(sets[a], sets[b])]
        while changed:
            changed = False
            for a, b in edges:
                m = min(low[a], low[b])
                changed |= low[a] != m or low[b] != m
                low[a] = low[b] = m
        assert got == {i: (len(s), low[i]) for i, s in sets.items()}
    assert setjoin.link_groups(none).count() == 0


@pytest.mark.parametrize(("hot", "split"), [(1024, 1 << 15), (4, 1 << 15), (1, 8)])
def test_line_dedup(spark, odd, none, docs, texts, hot, split, monkeypatch):
    """Against brute force over sets of words; with low bounds most words go by pairs and triples, and groups are split."""
    monkeypatch.setattr(linededup, "HOT", hot)
    monkeypatch.setattr(linededup, "SPLIT", split)
    rnd = random.Random(7)
    vocabulary = [f"v{k}" for k in range(60)]
    made = []
    for k in range(60):
        some = []
        for _ in range(8):
            w = rnd.choices(vocabulary, k=rnd.randrange(1, 30)) if not some or rnd.random() < 0.4 else list(rnd.choice(some))
            if w and rnd.random() < 0.7:
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            some.append(w)
        made.append((k, "\n".join(" ".join(w) for w in some)))
    probe = " ".join(f"p{k}" for k in range(20))
    made += [(60, probe), (61, probe.replace("p9 ", "other ") + "\n" + " ".join(reversed(probe.split()))), (62, None)]
    tables = [(spark.createDataFrame(made, "doc_id long, text string"), made)]
    if hot == 1024:
        tables += [(odd.dropDuplicates(["doc_id"]), sorted({r[0]: r[1] for r in ODD}.items())), (docs, sorted(texts.items()))]
    for df, rows in tables:
        got = {r.doc_id: (r.text, r.n_removed) for r in linededup.dedup_lines(df).collect()}
        seen, having, want = [], collections.defaultdict(set), {}
        for i, t in rows:
            kept = []
            for line in (t or "").split("\n"):
                s = frozenset(words(line))
                near = collections.Counter(k for w in s for k in having[w])
                if s and not any(100 * both >= 80 * (len(s) + len(seen[k]) - both) for k, both in near.items()):
                    kept.append(line)
                elif not s:
                    kept.append(line)
                for w in s:
                    having[w].add(len(seen))
                seen.append(s)
            want[i] = (None if t is None else "\n".join(kept), 0 if t is None else len(t.split("\n")) - len(kept))
        assert got == want
    assert hot == 1024 or got[61] == ("", 2)
    assert linededup.dedup_lines(none).count() == 0


def test_decontamination(spark, odd, none, docs, texts):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    norm = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    items = [norm(r.text) for r in bench.collect()]
    want = {i for i, t in texts.items() if any(x in norm(t) for x in items)}
    assert {r.doc_id for r in queries.op1_decontam(spark, DATA).collect()} == want
    assert decontam.leaks(odd, bench).count() == 0 and decontam.leaks(none, bench).count() == 0 and decontam.leaks(docs, bench.where("item_id < 0")).count() == 0
    q = "if Maria buys 12 apples for 3.50 dollars and walks 5km to Berlin, how many apples does Maria have left today?"
    other = q.replace("Maria", "Peter").replace("12", "99").replace("3.50", "8").replace("5km", "7 km").replace("Berlin", "Rome")
    mixed = other.replace("does Peter", "does Anna").replace("99 apples", "12 pears")
    rows = [(1, "Well, " + q), (2, "so " + other), (3, None), (4, ""), (5, mixed + " unrelated words follow here")]
    found = {r.doc_id: r for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, "Say, " + q), (8, None), (9, "tiny one")], "item_id long, text string")).collect()}
    assert not found[1].changed and found[2].changed and found[2].n_consistent == found[2].n_values and set(found) <= {1, 2, 5}


def brute_pii(t):
    out, n = [], {}
    for k, p in {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}.items():
        n[k] = 0
        for m in re.finditer(p, t):
            h, g = m.group(0), re.sub("[^0-9]", "", m.group(0))
            if k == "ip" and any(int(x) > 255 for x in h.split(".")):
                continue
            if k == "card":
                q = [int(c) for c in reversed(g)]
                if not 16 <= len(g) <= 19 or sum(c if j % 2 == 0 else c * 2 - 9 * (c > 4) for j, c in enumerate(q)) % 10:
                    continue
            if k == "phone" and not 8 <= len(g) <= 15:
                continue
            n[k] += 1
            out.append(f"{k}:{m.start()}:{m.end()}")
    return n, out


def test_personal_data(spark, odd, none, docs, texts):
    extra = [(21, "a@b.c_d@e.f x@y.zz, 1.2.3.4.5.6.7.8 256.1.1.1 4111 1111 1111 1111 " + "9" * 30_000), (22, "é" * 50 + "🙂 4111-1111-1111-1111 a.b" * 3), (23, "x" * 90_000 + "@a.b"), (24, "%@-.- a@b..c @x.y 000.000.000.0255 password=hunter22x token: \"ab12cd34ef56\"")]
    for df, rows in ((odd, [(r[0], r[1]) for r in ODD]), (spark.createDataFrame(extra, "doc_id long, text string"), extra), (docs, list(texts.items()))):
        got = collections.defaultdict(list)
        for r in pii.summary(df).collect():
            got[r.doc_id].append(r)
        assert sum(map(len, got.values())) == len(rows)
        for i, t in rows:
            n, base = brute_pii(t or "")
            for r in got[i]:
                assert {k: r[f"n_{k}"] for k in n} == n and r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
                spans = [s for s in r.spans.split(",") if s]
                assert set(base) <= set(spans) and len(spans) - len(base) == r.n_added
                own = sorted((int(s.split(":")[1]), int(s.split(":")[2])) for s in set(spans) - set(base))
                assert all(a[1] <= b[0] for a, b in zip(own, own[1:]))
    assert pii.summary(none).count() == 0


def test_personal_data_added(spark, docs, texts):
    """Numbers that fail the card's check and values behind token are added; texts without any of the shapes get no span."""
    shapes = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+|(?<!\d)\d{16}(?!\d)|\+\d[ ().0-9-]+\d|token\s*=|\d+\.\d+\.\d+\.\d+"
    rows = {r.doc_id: r for r in pii.summary(docs).collect()}
    want = {i for i, t in texts.items() if re.search(shapes, t)}
    found = {i for i, r in rows.items() if r.n_spans}
    assert len(want & found) >= 0.9 * len(want) and len(found - want) <= 0.01 * len(rows)
    for i, r in rows.items():
        spans = [s for s in r.spans.split(",") if s]
        assert r.n_spans == len(spans) and r.n_account == sum(s.startswith("account:") for s in spans) and r.n_secret == sum(s.startswith("secret:") for s in spans)
        for s in spans:
            kind, a, b = s.split(":")
            hit = texts[i][int(a) : int(b)]
            assert kind != "account" or 16 <= sum(c.isdigit() for c in hit) <= 19
            assert kind != "secret" or texts[i][max(0, int(a) - 12) : int(a)].strip() and len(hit) >= 6


def test_em_finds_the_reliable_labelers():
    import random

    rnd = random.Random(2)
    true = [0.95, 0.9, 0.9, 0.6, 0.9, 0.55]
    counts = collections.Counter()
    for _ in range(20_000):
        y = rnd.random() < 0.5
        counts[tuple(-1 if rnd.random() < 0.2 else int(y if rnd.random() < r else not y) for r in true)] += 1
    right, share, _ = pii.estimate(list(counts.items()))
    assert all(abs(a - b) < 0.05 for a, b in zip(right, true)) and abs(share - 0.5) < 0.05


def test_url_filter(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://WWW.A.example.org/en/1?x#f"), (4, "https://b.com/de/"), (5, "http://spam.net/p/?utm_source=q&z=1"), (5, "http://spam.net/p/?utm_source=q&z=1"), (6, "http://spam.net/p?z=1#t"), (7, "http://spam.net/p?z=2"), (8, "://"), (9, "x://h?u"), (10, "http://example.org/es/1")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("clash"))
    listed = spark.createDataFrame([("https://m.spam.net/p/?z=1",), (None,), ("bad",)], "url string")
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in urlfilter.judge(pages, queries.RULES, listed).collect())
    assert got == [(1, "", "", "", "allow"), (2, "", "", "", "allow"), (3, "www.a.example.org", "/en/1", "example.org/en/1", "block"), (4, "b.com", "/de/", "com/de/", "block"), (5, "spam.net", "/p/", "", "block"), (5, "spam.net", "/p/", "", "block"), (6, "spam.net", "/p", "", "block"), (7, "spam.net", "/p", "", "allow"), (8, "", "", "", "allow"), (9, "h", "", "", "allow"), (10, "example.org", "/es/1", "example.org/es/", "block")]
    assert urlfilter.judge(pages.where("page_id < 0"), queries.RULES, listed).count() == 0
    assert {r.verdict for r in urlfilter.judge(pages.where("page_id in (5, 7)"), queries.RULES, listed.where("url = 'x'")).collect()} == {"allow"}


def test_url_filter_matches_duckdb(spark):
    import duckdb

    from atlasforge.llm.oracles import SQL

    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    want = duckdb.sql(SQL["op8_urlfilter"])
    got = queries.op8_urlfilter(spark, DATA).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_pipeline(spark, odd, none):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_duplicates", "decontamination", "bpe"]
    out = corpus_pipeline.run(spark, DATA)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) > 100
    leaked = {r.doc_id for r in queries.op1_decontam(spark, DATA).collect()}
    assert not leaked & set(ids)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, DATA).columns == corpus_pipeline.COLUMNS
        assert stage(spark, none, DATA).count() == 0
