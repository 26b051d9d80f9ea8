"""Document fingerprints from prefix polynomial hashes.

For a text of code points c, the modular prefix array S[i] = sum of c[j] * B**j for j < i lets
any two spans be compared in constant time: (S[r] - S[l]) * B**-l is a span's hash wherever it
stands. Two primes of 31 bits make 62 bits; every product stays within 64. Longest common
extensions are a binary search over such comparisons, one for all pairs at once.

A fingerprint is the length, the whole text's hash and a one-permutation MinHash of the hashes of
all windows of `WINDOW` code points, in hexadecimal: equal texts have equal ones. The likeness of
two is 2J / (1 + J), J the share of equal slots among those that either fills: about the share
of the text that both have in common. Two empty texts have likeness 1, an empty and another 0.

`neighbours` pairs every document with the next in descending id, by one shuffle of the texts: ids
are cut at quantiles into ranges, each range is sorted and streamed, and the head of a range is sent
to the range before it as well. Nothing is collected but the quantiles and one id for a range. Ties
of id are ordered by text; null ids come last; a single document is its own next one. An empty table
gives an empty table; further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasforge.llm.textcore import lean

WINDOW, SLOTS, SLOT_BITS = 12, 64, 24
U = np.uint64
_MODULI = ((2147483647, 1103515245), (2147483629, 747796405))  # prime, base
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_EMPTY = (1 << SLOT_BITS) - 1


def _tables(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, by doubling."""
    p, b = _MODULI[k]
    if k not in _powers or len(_powers[k][0]) < n:
        size = max(n, 1 << 18)
        made = []
        for base in (b, pow(b, -1, p)):
            t = np.ones(1, dtype=U)
            while len(t) < size:
                t = np.concatenate((t, t * U(pow(base, len(t), p)) % U(p)))
            made.append(t)
        _powers[k] = (made[0], made[1])
    return _powers[k]


class PrefixHash:
    """Prefix arrays over code points; texts may stand one after another."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.sums = []
        for k, (p, _) in enumerate(_MODULI):
            up, _ = _tables(k, self.n + 1)
            s = np.zeros(self.n + 1, dtype=U)
            np.cumsum((codes.astype(U) + U(1)) * up[: self.n] % U(p), out=s[1:])
            self.sums.append(s % U(p))

    def spans(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hashes of spans, 62 bits, free of where they stand."""
        out = None
        for k, (p, _) in enumerate(_MODULI):
            _, down = _tables(k, self.n + 1)
            s = self.sums[k]
            h = (s[hi] + U(p) - s[lo]) % U(p) * down[lo] % U(p)
            out = h if out is None else out << U(31) | h
        return out

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all windows of one width."""
        n = self.n - width + 1
        out = None
        for k, (p, _) in enumerate(_MODULI):
            _, down = _tables(k, self.n + 1)
            s = self.sums[k]
            h = (s[width:] + U(p) - s[:n]) % U(p) * down[:n] % U(p)
            out = h if out is None else out << U(31) | h
        return out


def longest_common_extension(a: PrefixHash, at: np.ndarray, end: np.ndarray, b: PrefixHash, b_at: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """For each pair of positions, how many code points agree from there on, within the ends."""
    lo, hi = np.zeros(len(at), dtype=np.int64), np.minimum(end - at, b_end - b_at).astype(np.int64)
    while (lo < hi).any():
        mid = (lo + hi + 1) >> 1
        same = a.spans(at, at + mid) == b.spans(b_at, b_at + mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def sketches(texts: list[str]) -> tuple[list[str], np.ndarray, PrefixHash, np.ndarray]:
    """Fingerprints of texts, their slots, the prefix arrays and where each text begins."""
    joined = "".join(texts)
    at = np.cumsum([0, *map(len, texts)])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    prefix = PrefixHash(codes)
    slots = np.full(len(texts) * SLOTS, _EMPTY, dtype=np.int64)
    size = np.diff(at)
    whole = prefix.spans(at[:-1], at[1:])
    if len(codes) >= WINDOW:
        h = _mix(prefix.windows(WINDOW))
        row = np.repeat(np.arange(len(texts)), size)
        inside = np.repeat(at[1:], size) - np.arange(len(codes)) >= WINDOW
        row, h = row[: len(h)][inside[: len(h)]], h[inside[: len(h)]]
        _least(slots, row, h)
    short = np.flatnonzero((size > 0) & (size < WINDOW))
    _least(slots, short, _mix(whole[short] + size[short].astype(U)))
    slots = slots.reshape(-1, SLOTS)
    raw = slots.astype(">u4").view(np.uint8).reshape(len(texts), SLOTS, 4)[:, :, 4 - SLOT_BITS // 8 :].reshape(len(texts), -1)
    prints = [f"{n:08x}{w:016x}{r.tobytes().hex()}" for n, w, r in zip(size.tolist(), whole.tolist(), raw, strict=True)]
    return prints, slots, prefix, at


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _least(slots: np.ndarray, row: np.ndarray, h: np.ndarray) -> None:
    value = (h >> U(6) & U(_EMPTY)).astype(np.int64)
    np.minimum.at(slots, row * SLOTS + (h & U(SLOTS - 1)).astype(np.int64), np.minimum(value, _EMPTY - 1))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of slots, row by row."""
    some = ((a != _EMPTY) | (b != _EMPTY)).sum(axis=1)
    j = ((a == b) & (a != _EMPTY)).sum(axis=1) / np.maximum(some, 1)
    return np.where(some == 0, 1.0, 2 * j / (1 + j))


def slots_of(fingerprint: str) -> np.ndarray:
    """The MinHash slots of a fingerprint."""
    raw = np.frombuffer(bytes.fromhex(fingerprint[24:]), dtype=np.uint8).reshape(SLOTS, -1).astype(np.int64)
    return raw @ (256 ** np.arange(raw.shape[1])[::-1])


def neighbours(docs: DataFrame, run, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Applies run(rows) to the rows (id, text, next id, next text) of every range, as a stream."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lowest = -(1 << 63)
    key = F.coalesce("doc_id", F.lit(lowest))
    cuts = rows.select(F.percentile_approx(key, F.array(*(F.lit(k / parts) for k in range(1, parts))), 10_000).alias("c")).first()["c"] if parts > 1 else []
    cuts = sorted(set(cuts or []))
    # Ranges count from the highest ids, so that the next document is in the same range or a later one.
    # A cut is found by its place among every step-th cut, then within that step.
    step = max(1, math.isqrt(len(cuts)))
    array = lambda x: F.array(*map(F.lit, x)) if x else F.array().cast("array<bigint>")
    coarse = F.size(F.filter(array(cuts[step - 1 :: step]), lambda c: c < key))
    ranged = rows.withColumn("coarse", coarse)
    fine = F.size(F.filter(F.slice(array(cuts), F.col("coarse") * step + 1, F.lit(step)), lambda c: c < key)) if cuts else F.lit(0)
    ranged = ranged.withColumn("part", F.lit(len(cuts)) - F.col("coarse") * step - fine).drop("coarse")
    heads = {r["part"]: r["head"] for r in ranged.groupBy("part").agg(F.max(key).alias("head")).collect()}
    order = sorted(heads)
    sends = {heads[p]: order[k - 1] for k, p in enumerate(order)}  # the first range's head follows the last
    extra = F.lit(-1)
    if sends:
        moved = F.create_map(*(F.lit(x) for pair in sends.items() for x in pair))
        extra = F.coalesce(moved[key], F.lit(-1))
    dealt = ranged.withColumn("to", F.explode(F.when(extra >= 0, F.array(F.struct(F.col("part"), F.lit(0).alias("head")), F.struct(extra.alias("part"), F.lit(1).alias("head")))).otherwise(F.array(F.struct(F.col("part"), F.lit(0).alias("head"))))))
    dealt = dealt.select("doc_id", "text", F.col("to.part").alias("part"), F.col("to.head").alias("head"))
    sorted_rows = dealt.repartition(parts, "part").sortWithinPartitions("part", "head", F.col("doc_id").desc_nulls_last(), "text")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def paired():
            last = None
            for batch in batches:
                for i, t, p, h in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    if last and last[2] == p:
                        yield last[0], last[1], i, t
                        last = None if h else (i, t, p)
                    elif not h:
                        last = (i, t, p)

        return run(paired())

    return sorted_rows.mapInArrow(lean(stream), schema)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars and fingerprint of every row, without a shuffle."""
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in _cuts(list(map(len, texts))):
                prints, *_ = sketches(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(list(map(len, texts[lo:hi])), pa.int64()), pa.array(prints)], names=["doc_id", "n_chars", "fingerprint"])

    return slim.mapInArrow(lean(run), f"doc_id {dict(slim.dtypes)['doc_id']}, n_chars bigint, fingerprint string")


def _cuts(sizes: list[int], limit: int = 400_000) -> Iterator[tuple[int, int]]:
    lo = total = 0
    for k, n in enumerate(sizes):
        if k > lo and total + n > limit:
            yield lo, k
            lo, total = k, 0
        total += n
    if len(sizes) > lo:
        yield lo, len(sizes)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with the text that has its last third (rounded down) replaced by the beginning of
    the next document: fingerprints of both, their likeness, the likeness to the next document, and
    lce_edited, how many leading code points text and edited text share."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        texts = [r[1] for r in rows]
        edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for _, t, _, n in rows]
        nexts = [r[3] for r in rows]
        k = len(rows)
        # a document's next one is mostly the following row, which needs no second sketch
        same = all(nexts[j] is texts[j + 1] for j in range(k - 1))
        own, slots, prefix, at = sketches([*texts, nexts[-1]] if same else [*texts, *nexts])
        changed, edited_slots, edited_prefix, edited_at = sketches(edited)
        shared = longest_common_extension(prefix, at[:k], at[1 : k + 1], edited_prefix, edited_at[:-1], edited_at[1:])
        next_slots = slots[1 : k + 1] if same else slots[k:]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(own[:k]), pa.array(changed), pa.array(likeness(slots[:k], edited_slots)), pa.array(likeness(slots[:k], next_slots)), pa.array(shared)],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "lce_edited"],
        )

    def run(rows) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for r in rows:
            held.append(r)
            size += len(r[1])
            if size > 250_000:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return neighbours(docs, run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, lce_edited bigint", id_col, text_col)
