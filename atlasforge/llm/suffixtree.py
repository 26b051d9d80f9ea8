"""Probabilistic suffix tree over words: variable-length contexts, kept by a divergence test.

Tokens are words (A-Z lower-cased) and one end a text. A context is the last one to `DEPTH` tokens; a
text's first token follows a begin mark. A context that training has at least `least` times is a
candidate, and a state if its next tokens differ from its parent's (the context without its first
token): twice the log-likelihood gain must exceed what a chi-squared variable with as many degrees as
there are distinct next tokens would reach by `sigmas`. The states are not bounded: they grow with the
corpus. A context that is as frequent as its parent stands wherever that stands and has the same next
tokens: its gain is 0, so it is no state, and nothing is asked about it.

Smoothing goes down the tree: P(w | s) = (n(s, w) + t(s) P(w | parent)) / (n(s) + t(s)), with t(s)
the number of distinct next tokens; at the root (c(w) + 0.5) / (N + 0.5 (V + 1)). A token is scored
in the longest suffix of what precedes it that is a state; all shorter suffixes smooth it.

Scale: texts are dealt to blocks of about `BLOCK_BYTES` by a hash of the row. Twice each block asks for
what it needs, every distinct key once, as sorted arrays dealt by ranges of the key's hash: how often
runs of up to `DEPTH` tokens occur, which are the contexts of the tokens after them; then whether
candidates are states, and with each longest candidate how often tokens follow it. For that, a block
sums what its training tokens add to a context's gain and distinct next tokens,
log(n(s, w) n(parent) / (n(parent, w) n(s))) and 1 / n(s, w) each; for longest contexts, whose n(s, w) no
block knows yet, the part that has the pairs adds n(s, w) log n(s, w) and counts the tokens. Both sums
move as 32-bit floats and are added up as 64-bit ones: numbers of next tokens are exact to a few million,
and to seven digits beyond. No key has more than one row a block, whatever its frequency, and no table of contexts is
broadcast or reaches the driver. What moves is proportional to the text. Tokens, contexts and their
pairs are 64-bit hashes.

A null text counts as empty: one end token. Repeated rows count as often as they occur. Further
columns do not matter; an empty table gives an empty one. With no training row every token has the
probability of an unknown one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasforge.llm.common import modest_batches, shuffle_parts, staged
from atlasforge.llm.textcore import U, distinct_counts, lean, mix, ordered, parted, press, slices, small, unpress, words

BLOCK_BYTES = 9_000_000
#: Texts that a task holds to compress a block's rows together.
HELD_BYTES = 16_000_000
DEPTH = 3
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BEGIN, _END, _PAIR = U(0x0123456789ABCDEF), U(0x7FEDCBA987654321), U(0x9E3779B97F4A7C15)
#: Keys of the contexts of a text's first token, by length and in order.
_STARTS = np.sort(mix(np.arange(1, DEPTH + 1, dtype=U) * _PAIR + _BEGIN))


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Tokens of a slice with their ends, the contexts of one to `DEPTH` tokens before each, and where
    each row's tokens begin."""
    w = words(raw, offsets)
    t = np.insert(w.hash, w.first[1:], _END)
    first = w.first + np.arange(len(w.first))
    back, contexts = t, []
    for k in range(DEPTH):
        before = np.empty_like(t)
        before[1:] = back[:-1]
        before[first[:-1]] = _END if k else _BEGIN
        contexts.append(mix(before * _PAIR + contexts[-1]) if k else before)
        back = before
    return t, contexts, first


def _press_keys(keys: np.ndarray) -> bytes:
    return press(np.diff(keys, prepend=U(0)))


def _unpress_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpress(data), dtype=U)


def _blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """Rows dealt to blocks by a hash; a task gathers those of a block and compresses them before they move."""
    keyed = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for b in sorted(held):
                some, sink = held.pop(b), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, some[0].schema) as out:
                    for part in some:
                        out.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([zstandard.compress(sink.getvalue(), 3)], pa.binary())], names=["block", "docs"])

        for batch in batches:
            block = batch.column(3).to_numpy()
            rows = pa.RecordBatch.from_arrays(batch.columns[:3], names=["doc_id", "text", "learn"])
            for b in np.unique(block).tolist():
                held.setdefault(b, []).append(rows.filter(pa.array(block == b)))
            size += rows.nbytes
            if size > HELD_BYTES:
                yield from flush()
                size = 0
        yield from flush()

    return keyed.mapInArrow(lean(run), "block int, docs binary")


def _opened(column: pa.ChunkedArray) -> pa.Table:
    """The rows of a block, in an order that does not depend on how they came."""
    parts = sorted(x.as_py() for x in column)
    return pa.concat_tables([pa.ipc.open_stream(zstandard.decompress(x)).read_all() for x in parts])


class Distinct:
    """The sorted distinct keys of an array, and the number of each entry's key."""

    def __init__(self, keys: np.ndarray):
        order, s = ordered(keys)
        new = np.ones(len(keys), dtype=bool)
        new[1:] = s[1:] != s[:-1]
        self.keys = s[new]
        self.which = np.empty(len(keys), np.int32)
        self.which[order] = np.cumsum(new, dtype=np.int32) - 1

    def sums(self, which: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(which, weights, len(self.keys))


class Block:
    """A block's tokens and contexts, and what replies told of them."""

    def __init__(self, docs: pa.Table):
        learn = np.asarray(docs.column("learn").combine_chunks().fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)
        t, use, counts, contexts = [], [], [], [[] for _ in range(DEPTH)]
        for lo, hi, raw, offsets in slices(docs.column("text").combine_chunks()):
            here, before, first = tokens(raw, offsets)
            n = np.diff(first)
            t.append(here)
            use.append(np.repeat(learn[lo:hi], n))
            counts.append(n)
            for k in range(DEPTH):
                contexts[k].append(before[k])
        self.t, self.use, self.counts = np.concatenate(t), np.concatenate(use), np.concatenate(counts)
        contexts = [np.concatenate(x) for x in contexts]
        self.last = contexts[-1]
        self.first = np.concatenate(([0], np.cumsum(self.counts)))[:-1]
        self.runs = Distinct(np.concatenate((self.t | U(1), *(mix(c * _PAIR + self.t) & ~U(1) for c in contexts[:-1]))))

    def told_runs(self, replies: list[bytes], texts: int, least: int) -> None:
        """follows: how often each token occurs, then after its contexts; n: how often those occur;
        at: tokens whose context of each length is a candidate that is not as frequent as its parent."""
        n = np.concatenate([unpress(x).astype(np.int64) for x in replies])
        if len(n) != len(self.runs.keys):
            raise RuntimeError("a block's keys changed between two passes")
        self.follows = list(n[self.runs.which].reshape(DEPTH, -1))
        self.n, self.at = [], []
        for f in self.follows:  # a run of tokens is the context of the token after it; texts begin alike
            c = np.empty_like(f)
            c[1:] = f[:-1]
            c[self.first] = texts
            self.n.append(c)
            self.at.append(np.flatnonzero((c >= least) & (c != self.n[-2]) if len(self.n) > 1 else c >= least))
        self._number()
        last = self.at[-1]
        self.pairs = Distinct(mix(self.last[last] * _PAIR + self.t[last]))
        owner = np.empty(len(self.pairs.keys), np.int32)
        owner[self.pairs.which] = self.number[-1]
        order = np.argsort(owner, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.owner, self.pairs.keys, self.pairs.which = owner[order], self.pairs.keys[order], place[self.pairs.which]

    def _number(self) -> None:
        """states: the candidates' sorted keys, and number: which of them is the context of each length of
        the tokens in `at`. A context is the run that ends before the token, so the runs' order serves
        again; those of a text's first token are no runs and get keys of their own."""
        place = np.searchsorted(self.runs.keys, _STARTS)
        which = self.runs.which.reshape(DEPTH, -1)
        number, used = [], np.zeros(len(self.runs.keys) + DEPTH, bool)
        begins = np.zeros(len(self.t), bool)
        begins[self.first] = True
        for k, at in enumerate(self.at):
            run = which[k, at - 1]
            own = run + sum((run >= p).astype(np.int32) for p in place)
            own[begins[at]] = place[k] + k
            used[own] = True
            number.append(own)
        self.states = np.insert(self.runs.keys, place, _STARTS)[used]
        dense = np.cumsum(used, dtype=np.int32) - 1
        self.number = [dense[own] for own in number]

    def told_pairs(self, replies: list[bytes]) -> None:
        """follows: also how often each token occurs after its longest context."""
        n = np.zeros(len(self.t), np.int64)
        if replies:
            n[self.at[-1]] = np.concatenate([unpress(x).astype(np.int64) for x in replies])[self.pairs.which]
        self.follows.append(n)

    def told_states(self, replies: list[bytes]) -> None:
        """kinds and kept: distinct next tokens of the candidates, and whether they are states."""
        told = np.concatenate([np.zeros(0, np.int64), *(unpress(x).astype(np.int64) for x in replies)])
        self.kinds, self.kept = told >> 1, told & 1 == 1

    def evidence(self, total: int) -> tuple[np.ndarray, np.ndarray]:
        """What the block's training tokens add to each candidate's gain and distinct next tokens; of the
        longest ones, to the gain without log n(s, w) alone."""
        gain, kinds = np.zeros(len(self.states)), np.zeros(len(self.states))
        for k, (at, number) in enumerate(zip(self.at, self.number, strict=True)):
            a, which = at[self.use[at]], number[self.use[at]]
            up, n = (x[a].astype(float) for x in (self.follows[k], self.n[k]))
            m = self.follows[k + 1][a].astype(float) if k + 1 < DEPTH else 1.0
            gain += np.bincount(which, np.log(m * (self.n[k - 1][a] if k else total) / (up * n)), len(gain))
            if k + 1 < DEPTH:
                kinds += np.bincount(which, 1 / m, len(kinds))
        return gain.astype(np.float32), kinds.astype(np.float32)

    def graded(self, total: int, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
        """The probability of each token by itself and by the tree."""
        base = (self.follows[0] + 0.5) / (total + 0.5 * (vocabulary + 1))
        deepest = np.full(len(self.t), -1)
        for k, (at, number) in enumerate(zip(self.at, self.number, strict=True)):
            deepest[at[self.kept[number]]] = k
        p, t = base.copy(), np.zeros(len(self.t), np.int64)
        for k, (at, number) in enumerate(zip(self.at, self.number, strict=True)):
            t[at] = self.kinds[number]  # elsewhere the parent's: one as frequent has the same next tokens
            a = np.flatnonzero(deepest >= k)
            p[a] = (self.follows[k + 1][a] + t[a] * p[a]) / (self.n[k][a] + t[a])
        return base, p


def _requests(block: int, keys: np.ndarray, parts: int, *values: np.ndarray) -> pa.Table:
    """Sorted keys and their values, dealt to parts."""
    out = [(p, _press_keys(keys[s]), [press(v[s] if v.dtype.kind == "f" else small(v[s])) for v in values]) for p, s in parted(keys, parts)]
    columns = {f"v{k}": pa.array([x[2][k] for x in out], pa.binary()) for k in range(len(values))}
    return pa.table({"block": pa.array([block] * len(out), pa.int32()), "part": pa.array([x[0] for x in out], pa.int32()), "keys": pa.array([x[1] for x in out], pa.binary()), **columns})


def _states_asked(block: int, b: Block, total: int, parts: int) -> pa.Table:
    """The evidence on a block's candidates, and with each the pairs that it makes with the tokens after
    it: how many, their keys, and how often training has them."""
    table, n = _requests(block, b.states, parts, *b.evidence(total)), b.pairs.sums(b.pairs.which, b.use[b.at[-1]]).astype(np.int64)
    columns = {"many": [], "pairs": [], "held": []}
    for _, s in parted(b.states, parts):
        own = slice(*np.searchsorted(b.owner, (s.start, s.stop)))
        columns["many"].append(press(small(np.bincount(b.owner[own] - s.start, minlength=s.stop - s.start))))
        columns["pairs"].append(press(b.pairs.keys[own]))
        columns["held"].append(press(small(n[own])))
    for name, values in columns.items():
        table = table.append_column(name, pa.array(values, pa.binary()))
    return table


def _summed(table: pa.Table) -> tuple[pa.Table, list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """A part's requests by block, the keys of each, all distinct keys, and the sums of their values."""
    table = table.sort_by("block")
    keys = [_unpress_keys(x.as_py()) for x in table.column("keys")]
    whole, sums = np.concatenate(keys), []
    for name in sorted(c for c in table.column_names if c.startswith("v")):
        v = np.concatenate([unpress(x.as_py()) for x in table.column(name)])
        every, total = distinct_counts(whole, v.astype(np.float64 if v.dtype.kind == "f" else np.int64))
        sums.append(total)
    return table, keys, every, sums


_REPLIES = "step int, block int, part int, data binary, n bigint, kinds bigint"


def _replies(step: int, table: pa.Table, data: list[bytes], n: int = 0, kinds: int = 0) -> pa.Table:
    """Replies to a part's blocks, and a row of the part's own sums."""
    m, part = len(data), table.column("part")[0].as_py()
    return pa.table({
        "step": pa.array([step] * (m + 1), pa.int32()), "block": pa.array([*table.column("block").to_pylist(), None], pa.int32()), "part": pa.array([part] * (m + 1), pa.int32()),
        "data": pa.array([*data, None], pa.binary()), "n": pa.array([*[None] * m, n], pa.int64()), "kinds": pa.array([*[None] * m, kinds], pa.int64()),
    })


def score(docs: DataFrame, training: Column, least: int = 2, sigmas: float = 4.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known (tokens that training has), train_tokens, base_score (log10 by single
    tokens) and score (log10 by the tree) of every row; learns from the rows where `training` holds."""
    if least < 1:
        raise ValueError("least must be at least 1")
    modest_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("learn"))
    kind = dict(rows.dtypes)["doc_id"]
    size, texts = (x or 0 for x in rows.agg(F.sum(F.octet_length("text")), F.count_if("learn")).first())
    blocks, parts = max(1, -(-size // BLOCK_BYTES)), shuffle_parts(spark)
    packed = _blocks(rows, blocks)

    def ask_runs(table: pa.Table) -> pa.Table:
        b = Block(_opened(table.column("docs")))
        return _requests(table.column("block")[0].as_py(), b.runs.keys, parts, b.runs.sums(b.runs.which, np.tile(b.use, DEPTH)).astype(np.int64))

    def tell_runs(table: pa.Table) -> pa.Table:
        table, keys, every, (n,) = _summed(table)
        single = (every & U(1)) == 1
        return _replies(0, table, [press(small(n[np.searchsorted(every, k)])) for k in keys], int(n[single].sum()), int((n[single] > 0).sum()))

    def tell_states(table: pa.Table) -> pa.Table:
        table, keys, every, (gain, kinds) = _summed(table)
        at = [np.searchsorted(every, k) for k in keys]
        asked = [unpress(x.as_py()) for x in table.column("pairs")]
        held = np.concatenate([unpress(x.as_py()).astype(np.int64) for x in table.column("held")])
        pairs, m = distinct_counts(np.concatenate(asked), held)
        place = [np.searchsorted(pairs, x) for x in asked]
        owner = np.empty(len(pairs), np.int64)
        for own, own_place, many in zip(at, place, table.column("many"), strict=True):
            owner[own_place] = np.repeat(own, unpress(many.as_py()))
        owner, seen = owner[m > 0], m[m > 0]
        gain += np.bincount(owner, seen * np.log(seen), len(every))
        kinds = np.rint(kinds).astype(np.int64) + np.bincount(owner, minlength=len(every))
        told = kinds * 2 + (2 * gain > kinds + sigmas * np.sqrt(2.0 * kinds))
        return pa.concat_tables([_replies(1, table, [press(small(m[p])) for p in place]), _replies(2, table, [press(small(told[own])) for own in at])])

    def answered(asked: DataFrame, tell, name: str) -> DataFrame:
        before = spark.conf.get(_CLEANUP)
        spark.conf.set(_CLEANUP, "true")  # a pass's shuffle files go with it: the next one reads what is staged
        try:
            return staged(asked.groupBy("part").applyInArrow(tell, _REPLIES), name)
        finally:
            spark.conf.set(_CLEANUP, before)

    def with_replies(replies: DataFrame):
        return packed.groupBy("block").cogroup(replies.where("block is not null").select("step", "block", "part", "data").groupBy("block"))

    def told_block(docs: pa.Table, replies: pa.Table) -> tuple[Block, list[list[bytes]]]:
        """A block that knows its runs, and the replies on its pairs and states."""
        b = Block(docs)
        rows = sorted(zip(replies.column("step").to_pylist(), replies.column("part").to_pylist(), replies.column("data").to_pylist(), strict=True))
        runs, *others = ([d for s, _, d in rows if s == k] for k in range(3))
        b.told_runs(runs, texts, least)
        return b, others

    request = "block int, part int, keys binary, v0 binary"
    told = answered(packed.groupBy("block").applyInArrow(ask_runs, request), tell_runs, "suffix-runs")
    sums = told.agg(F.sum("n"), F.sum("kinds")).first()
    total, vocabulary = int(sums[0] or 0), int(sums[1] or 0)

    def ask_states(left: pa.Table, right: pa.Table) -> pa.Table:
        b, _ = told_block(_opened(left.column("docs")), right)
        return _states_asked(left.column("block")[0].as_py(), b, total, parts)

    told = told.unionByName(answered(with_replies(told).applyInArrow(ask_states, request + ", v1 binary, many binary, pairs binary, held binary"), tell_states, "suffix-states"))

    def grade(left: pa.Table, right: pa.Table) -> pa.Table:
        docs = _opened(left.column("docs"))
        b, (pairs, states) = told_block(docs, right)
        b.told_pairs(pairs)
        b.told_states(states)
        base, p = b.graded(total, vocabulary)
        sums = [np.add.reduceat(x, b.first) for x in (np.log10(base), np.log10(p), (b.follows[0] > 0).astype(np.int64))]
        return pa.table({"doc_id": docs.column("doc_id"), "n_tokens": pa.array(b.counts, pa.int64()), "n_known": pa.array(sums[2], pa.int64()), "train_tokens": pa.array(np.full(len(b.counts), total), pa.int64()), "base_score": pa.array(sums[0]), "score": pa.array(sums[1])})

    schema = f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return with_replies(told).applyInArrow(grade, schema)
