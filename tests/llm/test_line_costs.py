"""What line dedup compares and reads: pairs that may link, and lines at known places."""

import collections
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from atlasforge.llm import linededup
from atlasforge.llm.textcore import shingle_sets, words


def met(text, monkeypatch):
    """Pairs of the first round, and how many were compared in full."""
    compared, compare = [], linededup._compare

    def counted(e, x, y, percent):
        compared.append(len(x))
        return compare(e, x, y, percent)

    monkeypatch.setattr(linededup, "_compare", counted)
    column = pa.array([text])
    (_, _, s, cls), *_ = linededup._sets(column)
    rarity = SimpleNamespace(value=linededup.level(np.bincount(linededup._slot(s.values), minlength=linededup.SLOTS)))
    held = [d for b in linededup._send(rarity, 80, 1)(iter([pa.RecordBatch.from_arrays([pa.array([7], pa.int64()), column], names=["doc_id", "text"])])) for d in b.column(1).to_pylist()]
    out = linededup._meet(80)(pa.table({"part": pa.array([0] * len(held), pa.int32()), "data": pa.array(held, pa.list_(pa.binary()))}))
    return out, sum(compared), s, cls


def test_lines_that_share_too_few_words_are_not_compared(monkeypatch):
    """Each line has 4 words of its own and 16 of all: the place of the common word rules out every pair."""
    rest = [f"all{k}" for k in range(16)]
    out, compared, _, _ = met("\n".join(" ".join([*(f"own{n}_{k}" for k in range(4)), *rest]) for n in range(600)), monkeypatch)
    assert out.num_rows == 0 and compared <= 1000


def test_first_pairs_are_those_of_a_plain_loop(monkeypatch):
    rng = np.random.default_rng(8)
    bases = [rng.choice(60, rng.integers(6, 24), replace=False) for _ in range(40)]
    text = "\n".join(" ".join(f"w{x}" for x in rng.permutation(np.append(rng.permutation(b)[rng.integers(0, 2) :], rng.integers(0, 60, rng.integers(0, 3))))) for b in bases for _ in range(10))
    out, _, s, cls = met(text, monkeypatch)
    sets = [set(s.row(k).tolist()) for k in range(len(cls))]
    own = {}
    for k, c in enumerate(cls.tolist()):
        own.setdefault(c, k)
    lines = sorted(own.values())
    links = {(int(cls[b]), int(cls[a])) for a in lines for b in lines if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    pairs, more = collections.defaultdict(set), set()
    for u, v, m in zip(*(out.column(k).to_pylist() for k in ("u", "v", "more")), strict=True):
        pairs[u].add(v)
        more |= {u} if m else set()
        assert own[v] <= own[u]
    assert links and all(v in pairs[u] or u in more for u, v in links)
    at = {c: int(linededup._at(np.array([7]), np.array([k]))[0]) for c, k in own.items()}
    assert all(at[r["u"]] == r["u_at"] and at[r["v"]] == r["v_at"] for r in out.to_pylist())


@pytest.mark.parametrize("wanted", [[(5, 0)], [(5, 2), (None, 1)], [(-3, 0), (5, 1)]])
def test_lines_are_picked_by_their_places(wanted):
    rows = [(5, "a b c\nd e\nf g h i"), (None, "x\ny Y z\n"), (-3, ""), (5, "only\nof the same id"), (9, "never\nread")]
    at = lambda d, n: int(linededup._at(np.array([-(1 << 63) if d is None else d]), np.array([n]))[0])
    bits = 1 << 16
    spots = np.zeros(bits // 64, np.uint64)
    for x in (at(*w) for w in wanted):
        for b in (x % bits, (x % (1 << 64) >> 32) % bits):
            spots[b >> 6] |= np.uint64(1 << (b & 63))
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])], names=["doc_id", "text"])
    got = sorted(s.row(k).tolist() for s, _ in linededup._picked(batch, spots.view(np.int64)) for k in range(len(s.first) - 1))
    texts = [line for d, t in rows for n, line in enumerate(t.split("\n")) if (d, n) in wanted]
    want = []
    for line in texts:
        raw = np.frombuffer(line.encode(), np.uint8)
        want.append(shingle_sets(words(raw, np.array([0, len(raw)])), 1).row(0).tolist())
    assert got == sorted(want)
