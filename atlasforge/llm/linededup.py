"""Line dedup: an exact set-similarity join of lines, after which later matches go.

A line's tokens are its distinct words (A-Z lower-cased, runs of other than white space). A line goes if
an earlier one, by id and place, has the same words or a Jaccard similarity of `percent` / 100 or more,
whether or not that earlier line stays itself. The first of a group of copies stays. Lines with equal
sets are one class, and only classes are joined:

1. One pass counts how many lines have each word, by slots of the word's hash (`SLOTS`, so the table
   has a fixed size; words that share a slot only look more frequent), and notes each line's class.
2. A line's words are ordered by rarity. Of two lines that link, the rarest common word is among the
   n - ceil(n * percent / 100) + 1 rarest words of each (prefix filter), so lines meet by those. A word
   that more than `HOT` lines have brings too many together; as lines that link share as many as two
   (three) words if the prefix is one (two) words longer, it meets by pairs or triples that begin with
   it. Groups stay small whatever the corpus's size, unless their lines are alike.
3. In a group, in order of appearance, a line looks for the first earlier one that length, position of
   the common word and a parity sketch of the words (wider for longer lines) do not rule out: |x ^ y| is
   at least the number of bits in which two sketches differ. Where that is not far below what a link
   allows, it looks for up to `TRIES` such lines.
4. The sets of the pairs left are gathered, from a place of each class alone, and their similarity verified. A line whose pairs all fail
   but that had more to compare gets all its pairs in a second round. Words that more than `SPLIT`
   lines have are dealt to several groups by a hash of the class; lines without a match there meet the
   other groups in the second round, so no link is lost. Lines that are much alike meet in many groups: a
   part sends a pair once, and the second round sends it from the first or last group of its lines alone
   where they share that one.

Lines without a word are never removed. Null texts stay null and empty ones empty. Very long lines are
sets like others. Rows that repeat an id count as one document's; of lines with one id and number the
class with the smaller hash is the earlier one. A null id comes before all others. Further columns stay
as they are; an empty table gives an empty one. Ids must be integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasforge.llm.common import modest_batches, shuffle_parts, staged
from atlasforge.llm.setjoin import bloom_words, links, maybe
from atlasforge.llm.textcore import Sets, U, lean, lines, mix, pack, part_of, parted, set_classes, shingle_sets, slices, unpress, words

SLOTS = 1 << 22
RANGES = 16
HOT = 1024
SPLIT = 1 << 15
TRIES = 4
WIDEST = 8  # words of 64 bits in a sketch
FLUSH = 400_000  # entries sent at once
_STEP = U(0x9E3779B97F4A7C15)


def level(count: np.ndarray) -> np.ndarray:
    """Rarity in steps of an eighth of a doubling; 0 for none."""
    return np.floor(8 * np.log2(np.asarray(count, float) + 1)).astype(np.uint8)


def _sets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, Sets, np.ndarray]]:
    """For slices of texts: the row and the number of every line, its set of words and its class."""
    for lo, _, raw, offsets in slices(column):
        cut, row, number = lines(raw, offsets)
        s = shingle_sets(words(raw, cut), 1)
        yield row + lo, number, s, set_classes(s)


def _at(doc: np.ndarray, number: np.ndarray) -> np.ndarray:
    """A hash of a line's place, as a long."""
    return mix(mix(doc.astype(np.int64).view(U)) + number.astype(U)).view(np.int64)


def _picked(batch: pa.RecordBatch, spots: np.ndarray) -> Iterator[tuple[Sets, np.ndarray]]:
    """For slices of (doc_id, text): sets and classes of the lines whose places the filter may hold; no other is read
    into words."""
    ids = _ids(batch)
    for lo, _, raw, offsets in slices(batch.column(1)):
        cut, row, number = lines(raw, offsets)
        some = np.flatnonzero(maybe(spots, _at(ids[row + lo], number)))
        if len(some):
            start, end = cut[some], cut[some + 1]
            held = np.concatenate([raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)])
            s = shingle_sets(words(held, np.concatenate(([0], np.cumsum(end - start)))), 1)
            yield s, set_classes(s)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    """Ids of rows; a null one comes before all others."""
    return batch.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> U(32)).astype(np.int64) * SLOTS >> 32


def _key(sig: np.ndarray, parts: int) -> np.ndarray:
    """What stands for a signature within its part: 32 bits that rise with it."""
    return (sig * U(parts) >> U(32)).astype(np.uint32)


def _classes(rows: DataFrame) -> DataFrame:
    """(doc_id, number, h) of every line with a word, and counts of lines by slots of words (slots, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, held, total = np.zeros(SLOTS, np.int64), [], 0
        for batch in batches:
            for row, number, s, cls in _sets(batch.column(1)):
                held.append(_slot(s.values))
                total += len(s.values)
                if total > SLOTS:
                    count += np.bincount(np.concatenate(held), minlength=SLOTS)
                    held, total = [], 0
                full = cls != 0
                none = pa.nulls(int(full.sum()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[full])), pa.array(number[full]), pa.array(cls[full]), none.cast(pa.int32()), none.cast(pa.binary())], names=["doc_id", "number", "h", "slots", "data"])
        if held:
            count += np.bincount(np.concatenate(held), minlength=SLOTS)
        some = [(k, c) for k, c in enumerate(count.reshape(RANGES, -1)) if c.any()]
        none = pa.nulls(len(some)).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array([k for k, _ in some], pa.int32()), pa.array([pack(c) for _, c in some], pa.binary())], names=["doc_id", "number", "h", "slots", "data"])

    return rows.mapInArrow(lean(run), "doc_id bigint, number bigint, h bigint, slots int, data binary")


def _rarity(every: DataFrame) -> np.ndarray:
    """The level of each slot: a table of fixed size."""

    def total(table: pa.Table) -> pa.Table:
        count = sum(unpress(x.as_py()).astype(np.int64) for x in table.column("data"))
        return pa.table({"slots": table.column("slots").slice(0, 1), "data": pa.array([level(count).tobytes()], pa.binary())})

    out = np.zeros((RANGES, SLOTS // RANGES), np.uint8)
    for r in every.where("slots is not null").select("slots", "data").groupBy("slots").applyInArrow(total, "slots int, data binary").collect():
        out[r["slots"]] = np.frombuffer(r["data"], np.uint8)
    return out.ravel()


def _order(keys: np.ndarray) -> np.ndarray:
    """The stable order; the faster sort is enough where no key comes twice."""
    order = np.argsort(keys)
    s = keys[order]
    return np.argsort(keys, kind="stable") if (s[1:] == s[:-1]).any() else order


class Entries:
    """What lines send: a signature for each word of the prefix, or for pairs or triples that begin with a
    frequent one; the line, and the place of the first word in the line's order by rarity."""

    def __init__(self, s: Sets, rarity: np.ndarray, percent: int):
        n = s.sizes()
        rows = len(n)
        row = np.repeat(np.arange(rows), n)
        lev = rarity[_slot(s.values)]
        bits = max(1, rows.bit_length())
        order = _order(row.astype(U) << U(64 - bits) | lev.astype(U) << U(56 - bits) | s.values >> U(8 + bits))
        tok, lev = s.values[order], lev[order]
        place = np.arange(len(tok)) - np.repeat(s.first[:-1], n)
        # a set links with another one only if it may with itself and one word more
        prefix = np.where(100 * n >= percent * (n + 1), n + (-n * percent // 100) + 1, 0)
        words_ = 1 + (lev > level(HOT)).astype(np.int64) + (lev > level(64 * HOT))
        begins = np.flatnonzero((place < prefix[row]) & (lev > level(1)))  # a word of one line alone meets nothing
        size = n[row]
        sig, first = [], []
        for many in (1, 2, 3):
            at = begins[words_[begins] == many]
            h, last = tok[at], at
            ends = np.minimum(prefix[row[at]] + many - 1, size[at]) + at - place[at]  # of the longer prefix
            for _ in range(many - 1):
                wide = np.maximum(ends - last - 1, 0)
                rep = np.repeat(np.arange(len(last)), wide)
                last = last[rep] + 1 + np.arange(len(rep)) - np.repeat(np.cumsum(wide) - wide, wide)
                at, ends, h = at[rep], ends[rep], mix(h[rep] * _STEP + tok[last])
            sig.append(h)
            first.append(at)
        self.sig, at = np.concatenate(sig), np.concatenate(first)
        self.row, self.place = row[at], place[at]
        over = np.maximum(0, (lev[at].astype(np.int64) - int(level(SPLIT))) >> 3)
        self.salts = np.where(lev[at] > level(SPLIT), 2 << over, 1)
        bit = mix(s.values * _STEP)
        word, bit = bit >> U(6) & U(WIDEST - 1), U(1) << (bit & U(63))
        wide = int(widths(n).max(initial=1))
        #: a row a line: its sketch folded to the words that its size needs
        self.sketch = np.stack([_parity(np.where(word & U(wide - 1) == k, bit, U(0)), s.first) for k in range(wide)], axis=1)
        for w in (4, 2, 1):
            if w < wide:
                some = widths(n) == w
                self.sketch[some, :w] = folded(self.sketch[some], w)


def _parity(bits: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The exclusive or of each row's values."""
    run = np.concatenate((np.zeros(1, U), np.bitwise_xor.accumulate(bits))) if len(bits) else np.zeros(1, U)
    return run[first[1:]] ^ run[first[:-1]]


def widths(n: np.ndarray) -> np.ndarray:
    """Words of a line's sketch, so that sketches of unlike lines of its size tell them apart."""
    return np.where(n <= 48, 1, np.where(n <= 180, 2, np.where(n <= 360, 4, WIDEST)))


def folded(sketch: np.ndarray, w: int) -> np.ndarray:
    """Sketches of fewer words: the parity of a hash's lower bits alone."""
    return np.bitwise_xor.reduce(sketch.reshape(len(sketch), sketch.shape[1] // w, w), axis=1)


_FIELDS = ("sig", "h", "doc", "number", "n", "place", "role")
_ENDS = ("low", "low_at", "high", "high_at")  # of a line that goes with others, its first and last group and its place there


def _send(rarity, percent: int, parts: int, wanted=None, probes=None):
    """Arrow batches of (doc_id, text) to packed entries (part, data). With the filters `wanted` (of
    signatures) and `probes` (of classes) only those signatures are sent, and probes to all groups of them."""
    fields = _FIELDS if probes is None else _FIELDS + _ENDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        total = 0

        def flush() -> pa.RecordBatch:
            whole = dict(zip(fields, (np.concatenate([x[j] for x in held]) for j in range(len(fields))), strict=True))
            wide = np.array([x[-1].shape[1] for x in held])  # words of a slice's sketches, one after another
            many = np.array([len(x[0]) for x in held])
            sketch = np.concatenate([x[-1].ravel() for x in held])
            begin = np.repeat(np.cumsum(many * wide) - many * wide, many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * np.repeat(wide, many)
            order = np.argsort(whole["sig"])
            whole = {k: v[order] for k, v in whole.items()}
            used = widths(whole["n"])
            upto = np.concatenate(([0], np.cumsum(used)))
            sketch = sketch[np.repeat(begin[order] - upto[:-1], used) + np.arange(upto[-1])]
            out = [(p, [pack(np.diff(_key(whole["sig"][s], parts), prepend=np.uint32(0))), *(pack(whole[k][s]) for k in fields[1:]), pack(sketch[upto[s.start] : upto[s.stop]])]) for p, s in parted(whole["sig"], parts)]
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([x for _, x in out], pa.list_(pa.binary()))], names=["part", "data"])

        for batch in batches:
            ids = _ids(batch)
            for row, number, s, cls in _sets(batch.column(1)):
                own = np.unique(cls, return_index=True)[1]  # a class once a slice
                if len(own) < len(cls):
                    own.sort()
                    row, number, s, cls = row[own], number[own], s.some(own), cls[own]
                e = Entries(s, rarity.value, percent)
                use = slice(None) if wanted is None else _wanted(wanted.value, e.sig, e.salts, parts)
                sig, r, place, salts = e.sig[use], e.row[use], e.place[use], e.salts[use]
                home = (cls[r].view(U) % salts.astype(U)).astype(np.int64)
                role, ends = np.ones(len(r), np.uint8), []
                if probes is not None:
                    ends = _ends(sig, r, place, salts, parts, len(cls))
                    far = np.flatnonzero(maybe(probes.value, cls[r]) & (salts > 1))
                    rep = np.repeat(far, salts[far])
                    to = np.arange(len(rep)) - np.repeat(np.cumsum(salts[far]) - salts[far], salts[far])
                    rep, to = rep[to != home[rep]], to[to != home[rep]]
                    sig, r, place, salts, home, role = (np.concatenate((a, b)) for a, b in ((sig, sig[rep]), (r, r[rep]), (place, place[rep]), (salts, salts[rep]), (home, to), (role, np.zeros(len(rep), np.uint8))))
                key = np.where(salts > 1, mix(sig + home.astype(U) * _STEP), sig)
                held.append([key, cls[r], ids[row[r]], number[r], s.sizes()[r], place, role | (salts > 1).astype(np.uint8) << 1, *(x[r] for x in ends), e.sketch[r]])
                total += len(key)
                if total > max(FLUSH, 32 * parts):
                    yield flush()
                    held.clear()
                    total = 0
        if total:
            yield flush()

    return lean(run)


def _group(sig: np.ndarray, parts: int) -> np.ndarray:
    """What tells a signature's group from all others."""
    return _key(sig, parts).astype(np.int64) | part_of(sig, parts) << 32


def _ends(sig: np.ndarray, row: np.ndarray, place: np.ndarray, salts: np.ndarray, parts: int, rows: int) -> list[np.ndarray]:
    """The lowest and the highest of each row's whole groups, and the place in each; -1 for none."""
    one = np.flatnonzero(salts == 1)
    group, row, place, out = _group(sig[one], parts), row[one], place[one], []
    for best, least in ((np.minimum, np.iinfo(np.int64).max), (np.maximum, -1)):
        end, at = np.full(rows, least, np.int64), np.full(rows, np.iinfo(np.int32).max, np.int64)
        best.at(end, row, group)
        here = group == end[row]
        np.minimum.at(at, row[here], place[here])
        none = np.bincount(row, minlength=rows) == 0
        end[none], at[none] = -1, 0
        out += [end, at]
    return out


def _elsewhere(e: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, group: np.ndarray, percent: int) -> np.ndarray:
    """Whether a pair that may link goes out from another group: from the lines' lowest one if they share it and
    their places there allow a link, else from their highest one likewise, else from each group."""
    n, m = e["n"][x], e["n"][y]
    least = -(-percent * (n + m) // (100 + percent))
    out, free = np.zeros(len(x), bool), np.ones(len(x), bool)
    for k in ("low", "high"):
        home = free & (e[k][x] >= 0) & (e[k][x] == e[k][y]) & (np.minimum(n - e[k + "_at"][x], m - e[k + "_at"][y]) >= least)
        out |= home & (e[k][x] != group)
        free &= ~home
    return out


def _wanted(words_: np.ndarray, sig: np.ndarray, salts: np.ndarray, parts: int) -> np.ndarray:
    """Signatures that the filter may hold, or any of their groups."""
    held = lambda x: maybe(words_, _group(x, parts))
    out = held(sig) & (salts == 1)
    split = np.flatnonzero(salts > 1)
    rep = np.repeat(split, salts[split])
    home = np.arange(len(rep)) - np.repeat(np.cumsum(salts[split]) - salts[split], salts[split])
    out[rep[held(mix(sig[rep] + home.astype(U) * _STEP))]] = True
    return out


def _groups(rarity, percent: int, parts: int):
    """Arrow batches of classes and their sets (h, data) to the groups (h) that they are sent to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, rows = batch.column(0).to_numpy().view(U), [np.frombuffer(x, U) for x in batch.column(1).to_pylist()]
            if not rows:
                continue
            e = Entries(Sets(np.concatenate(rows), np.concatenate(([0], np.cumsum([len(x) for x in rows])))), rarity.value, percent)
            key = np.where(e.salts > 1, mix(e.sig + cls[e.row] % e.salts.astype(U) * _STEP), e.sig)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_group(key, parts)))], names=["h"])

    return lean(run)


def _compare(e: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether length, position and sketches allow a link, and whether the sketches are much alike."""
    n, m = e["n"][x], e["n"][y]
    least = -(-percent * (n + m) // (100 + percent))
    ok = np.minimum(n - e["place"][x], m - e["place"][y]) >= least
    most = n + m - 2 * least
    at = np.flatnonzero(ok)
    x, y, most = x[at], y[at], most[at]
    w = np.minimum(e["width"][x], e["width"][y])
    differ = np.bitwise_count(e["f1"][x] ^ e["f1"][y]).astype(np.int64)
    for k in (2, 4, WIDEST):
        some = np.flatnonzero(w == k)
        if len(some):
            differ[some] = np.bitwise_count(folded(e["sketch"][x[some]], k) ^ folded(e["sketch"][y[some]], k)).sum(axis=1)
    alike = np.zeros(len(ok), bool)
    ok[at], alike[at] = differ <= most, 10 * differ <= 7 * most
    return ok, alike


def _appearance(e: dict[str, np.ndarray]) -> np.ndarray:
    """Entries in order of appearance: by document, number and class."""
    low, wide = int(e["doc"].min()), int(e["number"].max()) + 1
    if (int(e["doc"].max()) - low + 1) * wide < 1 << 62:  # one key sorts faster than three
        key = (e["doc"] - low) * wide + e["number"]
        order = np.argsort(key)
        key, h = key[order], e["h"][order]
        if not ((key[1:] == key[:-1]) & (h[1:] != h[:-1])).any():
            return order
    return np.lexsort((e["h"], e["number"], e["doc"]))


def _meet(percent: int, probes=None):
    """A part's entries to pairs (u, v), v the earlier one, each once, with hashes of a place of each and `more`
    where u has further lines to meet. Without probes each line's first pairs, with them all pairs of theirs."""
    fields = _FIELDS if probes is None else _FIELDS + _ENDS

    def run(table: pa.Table) -> pa.Table:
        blobs = table.column("data").to_pylist()
        e = {k: np.concatenate([unpress(b[j]).astype(np.int64) for b in blobs]) for j, k in enumerate(fields) if j}
        e["width"] = widths(e["n"])
        e["sketch"] = np.zeros((len(e["n"]), WIDEST), U)
        e["sketch"][np.arange(WIDEST) < e["width"][:, None]] = np.concatenate([unpress(b[-1]).astype(U) for b in blobs])
        e["f1"] = np.bitwise_xor.reduce(e["sketch"], axis=1)
        sig = np.concatenate([np.cumsum(unpress(b[0]), dtype=np.uint32) for b in blobs]).astype(U)
        by_place = _appearance(e)
        rank = np.empty(len(by_place), np.int64)
        rank[by_place] = np.arange(len(by_place))
        order = np.argsort(sig << U(32) | rank.astype(U)) if probes is None else np.lexsort((e["place"], rank, sig))
        e = {k: v[order] for k, v in e.items()}
        sig = sig[order]
        same = np.argsort(sig << U(32) | e["h"].view(U) >> U(32), kind="stable")  # a class once a group
        again = np.zeros(len(sig), bool)
        again[1:] = (sig[same][1:] == sig[same][:-1]) & (e["h"][same][1:] == e["h"][same][:-1])
        keep = np.ones(len(sig), bool)
        keep[same[again]] = False
        e, sig = {k: v[keep] for k, v in e.items()}, sig[keep]
        start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        long = np.diff(np.append(start, len(sig)))
        begin = np.repeat(start, long)
        at = np.arange(len(sig)) - begin
        u, v, more = [], [], []
        if probes is None:
            split, tried, done = (e["role"] & 2) > 0, np.zeros(len(sig), np.int64), np.zeros(len(sig), bool)
            # a line's words from the common one on must be `percent` of (n + m) / (100 + percent) at least
            rest, need = (100 + percent) * (e["n"] - e["place"]) - percent * e["n"], percent * e["n"]
            late = np.argsort(-at, kind="stable")  # those with the most earlier lines first
            begin_, rest_, need_ = begin[late], rest[late], need[late]
            left = len(sig) - np.cumsum(np.bincount(at))  # lines with more than so many earlier ones
            for k in range(len(left) - 1):
                y = begin_[: left[k]] + k
                some = np.flatnonzero((rest_[: left[k]] >= need[y]) & (rest[y] >= need_[: left[k]]))
                x, y = late[some], y[some]
                x, y = x[~done[x]], y[~done[x]]
                ok, alike = _compare(e, x, y, percent)
                x, y, alike = x[ok], y[ok], alike[ok]
                tried[x] += 1
                done[x] = alike | (tried[x] >= TRIES)
                u.append(x)
                v.append(y)
                more.append(done[x] & ((at[x] > k + 1) | split[x]))
            lone = np.flatnonzero(split)  # the group's other parts may hold a match
            u.append(lone)
            v.append(lone)
            more.append(np.ones(len(lone), bool))
        else:
            group = sig.astype(np.int64) | table.column("part")[0].as_py() << 32
            for x in np.flatnonzero(maybe(probes.value, e["h"]) & (at > 0)).tolist():
                y = np.arange(begin[x], x)
                y = y[(e["role"][y] & 1) > 0]
                y = y[_compare(e, np.full(len(y), x), y, percent)[0]]
                y = y[~_elsewhere(e, np.full(len(y), x), y, np.full(len(y), group[x]), percent)]
                u.append(np.full(len(y), x))
                v.append(y)
                more.append(np.zeros(len(y), bool))
        cat = lambda a, kind: np.concatenate(a) if a else np.zeros(0, kind)
        u, v, more = cat(u, np.int64), cat(v, np.int64), cat(more, bool)
        rows = np.stack((e["h"][u], e["h"][v]), axis=1)
        order = np.lexsort((~more, rows[:, 1], rows[:, 0]))
        rows, more = rows[order], more[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        at = [_at(e["doc"][x], e["number"][x]) for x in (u[order[new]], v[order[new]])]
        return pa.table({"u": rows[new, 0], "v": rows[new, 1], "more": more[new], "u_at": at[0], "v_at": at[1]})

    return run


def _verified(rows: DataFrame, met: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Classes u (h) of the pairs (u, v, u_at, v_at) that link, and the sets (h, data) of all that are named: only the
    lines at those places are read into words, and only the sets of those classes move."""
    spark, pairs = rows.sparkSession, met.where("u <> v").select("u", "v")
    ends = [met.select(F.col(k).alias("h"), F.col(f"{k}_at").alias("at")) for k in ("u", "v")]
    alive = staged(ends[0].union(ends[1]).groupBy("h").agg(F.first("at").alias("at")), "line-alive")
    either = spark.sparkContext.broadcast(bloom_words(alive.select(F.explode(F.array("h", "at")).alias("h"))))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, cls in _picked(batch, either.value):
                own, at = np.unique(cls, return_index=True)
                at = at[maybe(either.value, own) & (own != 0)]
                yield pa.RecordBatch.from_arrays([pa.array(cls[at]), pa.array([s.row(k).tobytes() for k in at.tolist()], pa.binary())], names=["h", "data"])

    found = rows.mapInArrow(lean(gather), "h bigint, data binary").join(alive.select("h"), "h", "left_semi")
    sets = staged(found.groupBy("h").agg(F.first("data").alias("data")), "line-sets")
    both = pairs.join(sets.select(F.col("h").alias("u"), F.col("data").alias("a")), "u").join(sets.select(F.col("h").alias("v"), F.col("data").alias("b")), "v")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(x, U) for x in batch.column(k).to_pylist()] for k in (1, 2))
            ok = [links(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)), percent) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok, pa.bool_()))], names=["h"])

    return staged(both.select("u", "a", "b").mapInArrow(lean(test), "h bigint").distinct(), "line-links"), sets


def _matched(rows: DataFrame, every: DataFrame, percent: int) -> DataFrame:
    """Classes (h) of which an earlier class is similar enough."""
    spark, parts = rows.sparkSession, shuffle_parts(rows.sparkSession)
    rarity = spark.sparkContext.broadcast(_rarity(every))
    packed, schema = "part int, data array<binary>", "u bigint, v bigint, more boolean, u_at bigint, v_at bigint"
    places = [F.first(c).alias(c) for c in ("u_at", "v_at")]
    met = rows.mapInArrow(_send(rarity, percent, parts), packed).groupBy("part").applyInArrow(_meet(percent), schema)
    met = staged(met.groupBy("u", "v").agg(F.max("more").alias("more"), *places), "line-pairs")
    linked, sets = _verified(rows, met, percent)
    left = staged(met.where("more").select(F.col("u").alias("h")).distinct().join(linked, "h", "left_anti"), "line-open")
    if left.limit(1).count():
        probes = spark.sparkContext.broadcast(bloom_words(left))
        groups = staged(sets.join(left, "h").select("h", "data").mapInArrow(_groups(rarity, percent, parts), "h bigint").distinct(), "line-groups")
        wanted = spark.sparkContext.broadcast(bloom_words(groups))
        more = rows.mapInArrow(_send(rarity, percent, parts, wanted, probes), packed).groupBy("part").applyInArrow(_meet(percent, probes), schema)
        more = staged(more.groupBy("u", "v").agg(*places).join(met.select("u", "v"), ["u", "v"], "left_anti"), "line-pairs")
        linked = linked.union(_verified(rows, more, percent)[0]).distinct()
    return linked


def removed_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the sorted numbers of its lines that go, for documents that lose any."""
    if not 75 <= percent <= 100:
        raise ValueError("percent must be from 75 to 100: below that, lines that link may share fewer than three words")
    if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("line ids must be integers")
    modest_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    every = staged(_classes(rows), "line-classes")
    own = every.where("h is not null").select("doc_id", "number", "h")
    matched = _matched(rows, every, percent).withColumn("matched", F.lit(True))
    first = own.groupBy("h").agg(F.min(F.struct("doc_id", "number")).alias("at"), F.count("*").alias("copies")).join(matched, "h", "left")
    first = first.where("copies > 1 or matched").select("h", F.when(F.col("matched"), None).otherwise(F.col("at")).alias("stays"))
    gone = own.join(first, "h").where(~F.col("stays").eqNullSafe(F.struct("doc_id", "number")))
    return gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("number")).alias("lines"))


def dedup_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with the text that is left, and n_lines and n_removed (long)."""
    gone = removed_lines(docs, percent, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("lines").alias("__gone"))
    # hashing the numbers saves sorting the texts
    joined = docs.join(gone.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("__id")), "left").drop("__id")
    split = F.split(F.col(text_col), "\n", -1)
    joined = joined.withColumn("__lines", split).withColumn("__gone", F.filter("__gone", lambda k: k < F.size("__lines")))
    # the runs of lines between those that go
    cut = lambda a, b: F.slice("__lines", (a + 2).cast("int"), (b - a - 1).cast("int"))
    starts, ends = F.concat(F.array(F.lit(-1).cast("long")), F.col("__gone")), F.concat(F.col("__gone"), F.array(F.size("__lines").cast("long")))
    kept = F.array_join(F.flatten(F.zip_with(starts, ends, cut)), "\n")
    counted = joined.withColumn("n_lines", F.coalesce(F.size("__lines"), F.lit(0)).cast("long")).withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
    out = counted.withColumn(text_col, F.when(F.col("n_removed") > 0, kept).otherwise(F.col(text_col)))
    return out.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.col("n_lines")).cast("long")).drop("__gone", "__lines")
