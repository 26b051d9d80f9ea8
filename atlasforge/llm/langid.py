"""Language identification by interpolated Kneser-Ney character models.

One model a language, over lower-cased letters; every run of other characters is one space. The
highest order counts occurrences, lower orders count distinct preceding characters; each order
discounts by n1 / (n1 + 2 n2) and hands the freed mass to the next lower one, down to a uniform
distribution over the alphabet and one unknown character. The models of all languages share sorted
arrays of hashed n-grams; a row holds each language's interpolated log probability, so most
characters take one binary search for all languages together.

A text's language is that of the lowest cross-entropy per character. `score` is a softmax of the
cross-entropies with a temperature fitted on rows kept from the counts. `rejected` is true for a text
whose cross-entropy lies further above its language's mean on those rows than `reject_sigmas` of
the spread expected at its length.

The counts come from labelled rows, sampled by a hash of the id so that all languages together have
about `train_chars` characters at every input size; that bounds the model, its broadcast and what
the driver holds. Everything else reads every row and whole texts.

Null texts and texts without a letter are `und` with score 0, and count as rejected. Rows without a
language are not learned from. Ties between languages go to the first in order of name. With no
labelled row every text is `und`. Repeated rows and further columns do not matter.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from atlasforge.llm.common import modest_batches
from atlasforge.llm.textcore import U, lean, mix

SLICE_CHARS = 120_000
_SEED = [U(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA6B27D4EB2F)]
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(k).isalpha() for k in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1))
    return _letters[0]


def prepared(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after order - 1 spaces and before one; and where each ends.
    Rows without a letter get nothing."""
    lead = " " * (order - 1)
    lowered = [t.lower() for t in texts]
    at = np.cumsum([0, *(len(t) + order for t in lowered)])
    codes = np.frombuffer("".join(f"{lead}{t} " for t in lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    codes[~letter_table()[codes]] = 32
    space = codes == 32
    lead_at = np.zeros(len(codes), dtype=bool)
    for k in range(order - 1):
        lead_at[at[:-1] + k] = True
    keep = ~space
    keep[1:] |= ~space[:-1]  # of a run of spaces only the first
    keep |= lead_at
    keep[at[:-1] + order - 1] &= codes[at[:-1] + order - 1] != 32  # leading white space joins the lead
    kept = np.concatenate(([0], np.cumsum(keep)))[at]
    return codes[keep], kept


def gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the k-grams that end at each position from order - 1 on, for k = 1..order, by k."""
    n = len(codes) - order + 1
    wide = codes.astype(U)
    total, out = np.zeros(n, dtype=U), []
    for k in range(order):
        total = total + mix(wide[order - 1 - k : order - 1 - k + n] + U(k << 32)) * _SEED[k]
        out.append(mix(total))
    return out


@dataclass
class Model:
    """Sorted hashes and log probabilities by order, sorted context hashes and log back-off weights."""

    order: int
    langs: list[str]
    grams: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    unknown: np.ndarray | None = None
    beta: float = 1.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    per_char: np.ndarray | None = None

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character of each text in each language, and the number of characters."""
        codes, at = prepared(texts, self.order)
        lead = self.order - 1
        if len(codes) <= lead:
            return np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        total = np.zeros((len(codes) - lead, len(self.langs)))
        hashes = gram_hashes(codes, self.order)
        left = np.arange(len(total))
        for k in range(self.order - 1, -1, -1):
            keys = self.grams[k]
            h = hashes[k][left]
            found = np.searchsorted(keys, h)
            np.minimum(found, len(keys) - 1, out=found)
            hit = keys[found] == h
            total[left[hit]] += self.logp[k][found[hit]]
            left = left[~hit]
            if not len(left):
                break
            if k:
                before = left - 1  # the context ends one character earlier
                c = np.where(before >= 0, hashes[k - 1][np.maximum(before, 0)], U(0))
                keys = self.contexts[k]
                found = np.minimum(np.searchsorted(keys, c), len(keys) - 1)
                hit = keys[found] == c
                total[left[hit]] += self.backoff[k][found[hit]]
            else:
                total[left] += self.unknown
        total = np.vstack((total, np.zeros((1, total.shape[1]))))
        sums = np.concatenate((np.zeros((1, total.shape[1])), np.cumsum(total, axis=0)))
        first, last = np.minimum(at[:-1], len(total) - 1), np.maximum(at[1:] - lead, at[:-1])
        n = (last - first).astype(float)
        bits = -(sums[last] - sums[first]) / np.maximum(n, 1)[:, None]
        return bits, n

    def predict(self, texts: list[str], reject_sigmas: float) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and rejection of each text."""
        table = letter_table()
        some = np.array([bool(t) and bool(table[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].any()) for t in texts], dtype=bool)
        if not self.langs:
            z = np.zeros(len(texts))
            return ["und"] * len(texts), z, z, np.ones(len(texts), bool)
        bits, n = self.entropies([t if s else "" for t, s in zip(texts, some, strict=True)])
        best = bits.argmin(axis=1)
        low = bits[np.arange(len(bits)), best]
        odds = np.exp(-self.beta * (bits - low[:, None]) * np.sqrt(np.maximum(n, 1))[:, None])
        score = np.where(some, 1 / odds.sum(axis=1), 0.0)
        room = np.sqrt(self.spread[best] ** 2 + self.per_char[best] ** 2 / np.maximum(n, 1))
        rejected = ~some | (low > self.mean[best] + reject_sigmas * room)
        return [self.langs[b] if s else "und" for b, s in zip(best, some, strict=True)], score, np.where(some, low, 0.0), rejected


def _levels(chars: np.ndarray, counts: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """N-grams as rows of code points with their counts, for k = 1..order: occurrences at the highest
    order, distinct preceding characters below."""
    out = [(chars, counts.astype(float))]
    while chars.shape[1] > 1:
        chars, counts = np.unique(chars[:, 1:], axis=0, return_counts=True)
        out.append((chars, counts.astype(float)))
    return out[::-1]


def _hash_rows(chars: np.ndarray) -> np.ndarray:
    total = np.zeros(len(chars), dtype=U)
    width = chars.shape[1]
    for k in range(width):
        total = total + mix(chars[:, width - 1 - k].astype(U) + U(k << 32)) * _SEED[k]
    return mix(total)


def _discount(counts: np.ndarray) -> float:
    n1, n2 = (counts == 1).sum(), (counts == 2).sum()
    return float(n1 / (n1 + 2 * n2)) if n1 and n2 else 0.5


def fit(grams: pd.DataFrame, order: int) -> Model:
    """The model from rows (lang, a, b, n): the code points of a highest-order n-gram in two longs."""
    langs = sorted(grams["lang"].unique())
    model = Model(order, langs)
    if not langs:
        return model
    by_lang = []
    for lang in langs:
        g = grams[grams["lang"] == lang]
        a, b = g["a"].to_numpy().astype(U), g["b"].to_numpy().astype(U)
        wide = np.stack([a >> U(42), (a >> U(21)) & U(0x1FFFFF), a & U(0x1FFFFF), b >> U(42), (b >> U(21)) & U(0x1FFFFF), b & U(0x1FFFFF)], axis=1).astype(np.uint32)
        by_lang.append(_levels(wide[:, 6 - order :], g["n"].to_numpy(), order))
    size = len(np.unique(np.concatenate([x[0][0] for x in by_lang]))) + 1
    model.unknown = np.zeros(len(langs))
    lower: list[dict] = []
    for k in range(order):  # k + 1 characters
        keys = np.unique(np.concatenate([_hash_rows(x[k][0]) for x in by_lang]))
        every = np.unique(np.concatenate([x[k][0] for x in by_lang]), axis=0)
        hashed = _hash_rows(every)
        every = every[np.argsort(hashed)]
        ctx_keys = np.unique(_hash_rows(every[:, :-1])) if k else np.zeros(1, dtype=U)
        logp, back = np.zeros((len(keys), len(langs))), np.zeros((len(ctx_keys), len(langs)))
        for j, x in enumerate(by_lang):
            chars, counts = x[k]
            d = _discount(counts)
            own = np.zeros(len(keys))
            own[np.searchsorted(keys, _hash_rows(chars))] = counts
            ctx_of = np.searchsorted(ctx_keys, _hash_rows(every[:, :-1])) if k else np.zeros(len(keys), dtype=int)
            total = np.bincount(ctx_of, own, minlength=len(ctx_keys))
            kinds = np.bincount(ctx_of, own > 0, minlength=len(ctx_keys))
            gamma = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            if k:
                base = lower[k - 1]
                p_low = base[j][np.searchsorted(model.grams[k - 1], _hash_rows(every[:, 1:]))]
            else:
                p_low = np.full(len(keys), 1 / size)
                model.unknown[j] = np.log(gamma[0] / size)
            p = np.maximum(own - d, 0) / np.maximum(total, 1)[ctx_of] + gamma[ctx_of] * p_low
            logp[:, j], back[:, j] = p, np.log(gamma)
        lower.append(logp.T.copy())
        model.grams.append(keys)
        model.logp.append(np.log(logp))
        model.contexts.append(ctx_keys)
        model.backoff.append(back)
    return model


def calibrate(model: Model, bits: np.ndarray, n: np.ndarray, truth: np.ndarray) -> None:
    """Temperature by likelihood over a grid; each language's mean cross-entropy and its spread, the
    part that shrinks with length apart."""
    k = len(model.langs)
    model.mean, model.spread, model.per_char = np.full(k, 2.5), np.full(k, 0.3), np.full(k, 2.0)
    if not len(bits):
        return
    gap = (bits - bits.min(axis=1, keepdims=True)) * np.sqrt(np.maximum(n, 1))[:, None]
    loss = lambda b: -np.mean(-b * gap[np.arange(len(gap)), truth] - np.log(np.exp(-b * gap).sum(axis=1)))
    model.beta = float(min((0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0), key=loss))
    for j in range(k):
        own = (truth == j) & (n > 0)
        if own.sum() < 20:
            continue
        h, m = bits[own, j], n[own]
        model.mean[j] = np.median(h)
        dev = (h - model.mean[j]) ** 2
        long = m >= np.median(m)
        model.spread[j] = max(0.05, float(np.sqrt(dev[long].mean())))
        short = ~long
        if short.sum() >= 10:
            model.per_char[j] = max(1.0, float(np.sqrt(np.mean(dev[short] * m[short]))))


def learn(docs: DataFrame, training: Column, order: int = 4, train_chars: int = 16_000_000, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on the rows where `training` holds and the language is known; a tenth of the sampled rows
    goes to calibration instead of the counts."""
    if not 2 <= order <= 6:
        raise ValueError("order must be from 2 to 6")
    modest_batches(docs.sparkSession)
    rows = docs.where(training & F.col(lang_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}
    if not sizes:
        return fit(pd.DataFrame({"lang": [], "a": [], "b": [], "n": []}), order)
    share = {k: min(1.0, train_chars / len(sizes) / max(n or 1, 1)) for k, n in sizes.items()}
    u = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1_000_000.0
    limit = F.lit(0.0)
    for k, s in share.items():
        limit = F.when(F.col("lang") == k, F.lit(s)).otherwise(limit)
    sample = rows.where(u < limit)
    held = F.pmod(F.xxhash64("id", F.lit("calibration")), F.lit(10)) == 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                own = [texts[k] for k in np.flatnonzero(langs == lang) if texts[k]]
                for group in sliced(own):
                    codes, at = prepared([t for t in group], order)
                    n = len(codes) - order + 1
                    if n <= 0:
                        continue
                    a, b = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
                    for k in range(6):
                        c = codes[k - 6 + order :][:n].astype(np.int64) if k >= 6 - order else 0
                        a, b = (a << 21 | c, b) if k < 3 else (a, b << 21 | c)
                    # an n-gram that reaches back over a text's lead belongs to no text
                    inside = np.ones(n, dtype=bool)
                    for k in range(order - 1):
                        edge = at[1:-1] + k
                        inside[np.maximum(edge - order + 1, 0)] = False
                    both = np.empty(int(inside.sum()), dtype=[("a", np.int64), ("b", np.int64)])
                    both["a"], both["b"] = a[inside], b[inside]
                    keys, counts = np.unique(both, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys["a"]), pa.array(keys["b"]), pa.array(counts, pa.int64())], names=["lang", "a", "b", "n"])

    grams = sample.where(~held).select("text", "lang").mapInArrow(lean(count), "lang string, a bigint, b bigint, n bigint").groupBy("lang", "a", "b").agg(F.sum("n").alias("n")).toPandas()
    model = fit(grams, order)
    if not model.langs:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = [t or "" for t in batch.column("text").to_pylist()], batch.column("lang").to_pylist()
            at = 0
            for group in sliced(texts):
                bits, n = shared.value.entropies(group)
                yield pa.RecordBatch.from_arrays([pa.array(langs[at : at + len(group)], pa.string()), pa.array(bits.tolist(), pa.list_(pa.float64())), pa.array(n)], names=["lang", "bits", "n"])
                at += len(group)

    seen = sample.where(held).select("text", "lang").mapInArrow(lean(measure), "lang string, bits array<double>, n double").where("n > 0").toPandas()
    seen = seen[seen["lang"].isin(model.langs)]
    calibrate(model, np.array(seen["bits"].tolist()).reshape(-1, len(model.langs)), seen["n"].to_numpy(), np.array([model.langs.index(x) for x in seen["lang"]], dtype=int))
    shared.unpersist()
    return model


def sliced(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[list[str]]:
    """Runs of texts of bounded length together; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > limit:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def identify(docs: DataFrame, model: Model, reject_sigmas: float = 8.0, text_col: str = "text") -> DataFrame:
    """The rows with lang_pred, score, cross_entropy (nats a character) and rejected after them.
    A column of one of these names is replaced."""
    modest_batches(docs.sparkSession)
    added = ("lang_pred", "score", "cross_entropy", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop(*added)
    where = rest.columns.index(text_col)
    schema = StructType(list(rest.schema)).add("lang_pred", "string").add("score", "double").add("cross_entropy", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for group in sliced([t or "" for t in batch.column(where).to_pylist()]):
                lang, score, bits, rejected = shared.value.predict(group, reject_sigmas)
                part = batch.slice(at, len(group))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64()), pa.array(rejected, pa.bool_())], names=[*part.schema.names, *added])
                at += len(group)

    return rest.mapInArrow(lean(run), schema)
