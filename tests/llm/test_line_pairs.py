"""The pairs of lines that line dedup makes: none is lost, and few come more than once."""

import collections
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from atlasforge.llm import linededup
from atlasforge.llm.setjoin import maybe


def parts_of(send, batch):
    held = collections.defaultdict(list)
    for b in send(iter([batch])):
        for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held[part].append(data)
    return [pa.table({"part": pa.array([p] * len(d), pa.int32()), "data": pa.array(d, pa.list_(pa.binary()))}) for p, d in held.items()]


def pairs(tables, meet):
    return [(u, v) for t in tables for u, v in zip(*(meet(t).column(k).to_pylist() for k in ("u", "v")), strict=True) if u != v]


@pytest.mark.parametrize("hot", [1, 1024])
def test_a_pair_goes_out_once(hot, monkeypatch):
    monkeypatch.setattr(linededup, "HOT", hot)
    rng, made = np.random.default_rng(5), []
    for k in range(12):
        base = [f"w{k}_{j}" for j in range(24)]
        for _ in range(8):  # near copies
            made.append(" ".join([*base[:-2], *(f"x{x}" for x in rng.integers(0, 1000, 2))]))
    text = pa.array(["\n".join(made)])
    batch = pa.RecordBatch.from_arrays([pa.array([7], pa.int64()), text], names=["doc_id", "text"])
    (_, _, s, cls), *_ = linededup._sets(text)
    count = np.bincount(linededup._slot(s.values), minlength=linededup.SLOTS)
    rarity = SimpleNamespace(value=linededup.level(count))
    first = pairs(parts_of(linededup._send(rarity, 80, 1), batch), linededup._meet(80))
    assert first and len(first) == len(set(first))
    every = SimpleNamespace(value=np.full(1024, -1, np.int64))
    assert maybe(every.value, cls).all()
    n, own = s.sizes(), [set(s.row(k).tolist()) for k in range(len(cls))]
    linked = {(cls[b], cls[a]) for a in range(len(cls)) for b in range(a + 1, len(cls)) if 100 * len(own[a] & own[b]) >= 80 * (n[a] + n[b] - len(own[a] & own[b]))}
    for parts in (1, 50):
        second = pairs(parts_of(linededup._send(rarity, 80, parts, every, every), batch), linededup._meet(80, every))
        assert linked <= set(second) and len(second) <= 2 * len(set(second))
