"""Corpus operators do the whole job: cases that a cut would lose."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasforge.llm import suffixtree
from atlasforge.llm.textcore import order_of


def tree_scores(rows, least=2, sigmas=4.0, depth=3):
    """(base, score) of each text, by dictionaries; all rows are training."""
    seqs = []
    for t in rows:
        w = [*t.lower().split(), "\n"]
        past = ["^", *["$"] * depth]  # nearest first
        seqs.append([])
        for x in w:
            seqs[-1].append((x, [tuple(past[:k]) for k in range(1, depth + 1)]))
            past = [x, *past]
    one, ctx, gram = collections.Counter(), collections.Counter(), collections.Counter()
    for s in seqs:
        for x, cs in s:
            one[x] += 1
            for c in cs:
                ctx[c] += 1
                gram[c, x] += 1
    n, v = sum(one.values()), len(one)
    kinds, gain = collections.Counter(), collections.Counter()
    for (c, x), m in gram.items():
        kinds[c] += 1
        up, up_n = (gram[c[:-1], x], ctx[c[:-1]]) if len(c) > 1 else (one[x], n)
        gain[c] += m * math.log(m * up_n / (up * ctx[c]))
    state = {c for c in ctx if ctx[c] >= least and 2 * gain[c] > kinds[c] + sigmas * math.sqrt(2 * kinds[c])}
    out = []
    for s in seqs:
        base = score = 0.0
        for x, cs in s:
            p = (one[x] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            deep = max((len(c) for c in cs if c in state), default=0)
            for c in cs[:deep]:
                p = (gram[c, x] + kinds[c] * p) / (ctx[c] + kinds[c])
            score += math.log10(p)
        out.append((base, score))
    return out, {c: ctx[c] / n for c in state}


def test_suffix_tree_keeps_rare_and_long_contexts(spark, monkeypatch):
    """States that hold far less than 1/1024 of the training tokens, and ones of three words, in several blocks."""
    monkeypatch.setattr(suffixtree, "BLOCK_BYTES", 20_000)
    rnd = random.Random(5)
    texts = []
    for k in range(120):
        w = [f"w{rnd.randrange(3000)}" for _ in range(200)]
        w[100:100] = [f"q{k % 7}", "z", f"q{k % 7}e"] if k % 2 else [f"r{k % 5}", "x", "y", f"r{k % 5}e"]
        texts.append(" ".join(w))
    want, state = tree_scores(texts)
    assert {len(c) for c in state} == {1, 2, 3} and min(state.values()) < 1 / 4096
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.base_score, r.score) for r in suffixtree.score(df, F.lit(True)).collect()}
    for k, (base, score) in enumerate(want):
        assert got[k] == (pytest.approx(base, rel=1e-9), pytest.approx(score, rel=1e-9))


def test_order_of_hashes():
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 63, 400, dtype=np.uint64)
    for keys in (base, np.concatenate((base, base)), (base >> np.uint64(30) << np.uint64(30)) + rnd.integers(0, 60, 400, dtype=np.uint64), base % np.uint64(50), np.zeros(0, np.uint64), base[:1]):
        near = np.concatenate((keys, keys + np.uint64(3), keys))
        assert order_of(near).tolist() == np.argsort(near, kind="stable").tolist()
