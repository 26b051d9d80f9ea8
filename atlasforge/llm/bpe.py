"""Byte-level BPE that reproduces rank-ordered merges exactly, in time linear in the text.

Text is cut by the vocabulary's pattern. A piece's bytes are read as Latin-1, so an Aho-Corasick
automaton over the vocabulary finds the longest token at every byte in one pass. Encoding takes
longest tokens from the left; a token is kept only if the merges would have left that very border
between it and the token before, which the two tokens' own merge trees decide, and that verdict is
memoised by pair. On a clash it falls back to the longest token that is a prefix of the one tried,
and from there to the token before; bytes at which nothing fits are marked and never tried again.

Nulls and empty texts give no tokens. Rows are independent: repeated ids, ties and further columns
of any name do not matter, an empty table gives an empty table. Memory: one document's tokens and
two caches of bounded size; the caches only save time.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from atlasforge.llm.common import modest_batches
from atlasforge.llm.textcore import lean

PIECES_KEPT = 120_000  # in each of two generations
PAIRS_KEPT = 1_000_000
LONG_PIECE = 256  # characters; longer pieces are not kept in the cache

_coders: dict[str, "Coder"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Coder:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        n = max(ranks.values()) + 1
        self.bytes: list[bytes] = [b""] * n
        for b, r in ranks.items():
            self.bytes[r] = b
        self.text = [str(k) for k in range(n)]
        self.size = [len(b) for b in self.bytes]
        self.left, self.right, self.joined = list(range(n)), list(range(n)), {}
        reachable = ahocorasick.Automaton()
        usable = {}
        for token, r in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                halves = self._halves(token, r)
                if halves is None:
                    continue  # no merge makes it: only a piece that equals it becomes this token
                self.left[r], self.right[r] = halves
                self.joined[halves] = r
            usable[token] = r
            reachable.add_word(token.decode("latin-1"), r)
        reachable.make_automaton()
        self.automaton = reachable
        self.shorter: list[int] = [-1] * n
        for token, r in usable.items():
            for k in range(len(token) - 1, 0, -1):
                if (p := usable.get(token[:k])) is not None:
                    self.shorter[r] = p
                    break
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge is `token`: what lower-ranked merges leave of its bytes."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for k in range(len(parts) - 1):
                r = self.ranks.get(parts[k] + parts[k + 1], rank)
                if r < best:
                    best, at = r, k
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        found = [self.ranks.get(p) for p in parts]
        return None if None in found else (found[0], found[1])

    def _fits(self, a: int, b: int) -> bool:
        """Whether the merges leave a border between tokens a and b. Walks both merge trees back along
        the border, later merge first: a token across it that ranks below the merges undone so far
        would have been made instead."""
        joined, left, right = self.joined, self.left, self.right
        made = len(left) + 1
        while True:
            across = joined.get((a, b))
            if across is not None and across < made:
                return False
            if a > b and right[a] != a:
                made, a = a, right[a]
            elif left[b] != b and (a <= b or right[a] == a):
                made, b = b + 1, left[b]
            elif right[a] != a:
                made, a = a, right[a]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, size, shorter, pairs = len(piece), self.size, self.shorter, self.pairs
        longest = [0] * n
        for end, r in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size[r] + 1] = r  # ends come in order, so the longest stays
        if len(pairs) > PAIRS_KEPT:
            pairs.clear()
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while True:
            end = at + size[token]
            fits = not dead[end]
            if fits and out:
                key = (out[-1], token)
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self._fits(*key)
            if fits:
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead[at] = 1
                token = out.pop()
                at -= size[token]

    def encode(self, text: str) -> list[int]:
        cache, ids = self.pieces, []
        get, extend = cache.get, ids.extend
        for piece in self.find(text):
            known = get(piece)
            if known is None:
                known = self.older.get(piece)
                if known is None:
                    known = tuple(self.encode_piece(piece.encode()))
                if len(piece) <= LONG_PIECE:
                    if len(cache) >= PIECES_KEPT:
                        self.older, self.pieces = cache, {}
                        cache = self.pieces
                        get = cache.get
                    cache[piece] = known
            extend(known)
        return ids

    def forget(self) -> None:
        """Empties the caches."""
        self.pieces, self.older = {}, {}
        self.pairs.clear()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def coder_of(packed: bytes, pattern: str) -> Coder:
    """One coder a Python worker and vocabulary."""
    key = hashlib.sha256(packed + pattern.encode()).hexdigest()
    if key not in _coders:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in packed.splitlines() if line.strip())}
        _coders[key] = Coder(ranks, pattern)
    return _coders[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, n_tokens, ids (array of int, if with_ids), ids_sha256 (of the decimal ids,
    joined by commas) and decoded_sha256 (of the bytes that the ids decode to). The rank file is read
    by the driver and broadcast; a vocabulary's size does not depend on the documents."""
    modest_batches(docs.sparkSession)
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = dict(slim.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(shared.value, pattern)
        try:
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    part = batch.slice(lo, 512)
                    counts, id_sums, text_sums, lists = [], [], [], []
                    for text in part.column(1):
                        ids = coder.encode(text.as_py() or "")
                        counts.append(len(ids))
                        id_sums.append(hashlib.sha256(",".join(map(coder.text.__getitem__, ids)).encode()).hexdigest())
                        text_sums.append(hashlib.sha256(coder.decode(ids)).hexdigest())
                        if with_ids:
                            lists.append(np.array(ids, dtype=np.int32))
                    cols = [part.column(0), pa.array(counts, pa.int64())]
                    names = ["doc_id", "n_tokens"]
                    if with_ids:
                        cols.append(pa.array(lists, pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())], names=[*names, "ids_sha256", "decoded_sha256"])
        finally:  # the worker lives on for other tasks
            coder.forget()

    ids = ", ids array<int>" if with_ids else ""
    return slim.mapInArrow(lean(run), f"doc_id {kind}, n_tokens bigint{ids}, ids_sha256 string, decoded_sha256 string")
