"""N-gram Jaccard join: exact links between documents and the groups they make.

A document's set holds the distinct hashes of its runs of `size` words. Two documents link when
100 |A & B| >= percent * |A | B|. Documents with equal sets are one class, and only classes are joined.

1. Every class sends the first part of its hashes, in the order of the hashes, so long that two
   classes that link share at least `need` of those they send. A class of which too few hashes are
   sent by another class has no link. This leaves a small part of a corpus, exactly.
2. The sets of the classes left are gathered once, and how many of them have each hash is counted
   exactly. A hash that one class alone has is in no intersection, so a class with too few others has
   no link; the rest are ordered by rarity.
3. Classes that share one of their rarest hashes (prefix filter) are candidates. Their connected
   components are dealt to buckets, so a set moves once; a component of more than `CHUNK` sets is
   dealt to several buckets, with the same few pivot sets in each.
4. A bucket is joined by an index with set-relation skipping. Index lists are ordered by size, so
   blocks of sizes that cannot link are skipped by position, and within them entries that stand too
   far behind in their own set. Sets already in one group are not compared. What a set has in
   common with a highly similar one that was answered before bounds its overlap with all sets
   that one was compared to: |x & z| lies within |x - y| + |y - x| of |y & z|, so most of its
   own comparisons need no look at the sets.
5. Where a component was dealt to several buckets and is not one group yet, the sets outside its
   largest group meet all others of it, bucket against bucket, so no link is lost.

Classes are 64-bit hashes of sets. Null and empty texts have empty sets and link with nothing.
Repeated rows and ties of id do not matter, nor do further columns. An empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasforge.llm.common import dropped, modest_batches, shuffle_parts, staged
from atlasforge.llm.components import components, local_components
from atlasforge.llm.textcore import Sets, U, lean, part_of, parted, set_classes, shingle_sets, slices, words

CHUNK = 2000  # sets of one candidate component in a bucket
PIVOTS = 4
BUCKET_BYTES = 24_000_000
FLUSH = 800_000  # hashes sent at once
MAX_FILTER_BITS = 1 << 26
LOW = U(0xFFFFFFFF)


def least_overlap(n: int, percent: int) -> int:
    """What a set of n must share with any set that it links with."""
    return -(-n * percent // 100)


def links(n: int, m: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (n + m - both)


def _sets(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, Sets, np.ndarray]]:
    """For slices of texts: the rows, their sets and the sets' classes."""
    for lo, hi, raw, offsets in slices(column):
        s = shingle_sets(words(raw, offsets), size)
        yield np.arange(lo, hi), s, set_classes(s)


def _survivors(texts: DataFrame, size: int, percent: int, parts: int) -> DataFrame:
    """Classes of which another class sends at least as many hashes as a link needs."""
    limit = max(FLUSH, 32 * parts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        total = 0

        def flush() -> pa.RecordBatch | None:
            tok, own, cls, need = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((own, tok))
            tok, own = tok[order], own[order]
            once = np.ones(len(tok), dtype=bool)
            once[1:] = (tok[1:] != tok[:-1]) | (own[1:] != own[:-1])
            tok, own = tok[once], own[once]
            start = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1])))
            length = np.diff(np.append(start, len(tok)))
            place = np.arange(len(tok)) - np.repeat(start, length)
            shared = np.repeat(length > 1, length)
            classes, counts = np.unique(own[shared], return_counts=True)  # met here already
            keep = place < 2
            tok, own, met = tok[keep], own[keep], shared[keep]
            at = [(p, (tok[s] & LOW).astype(np.uint32).tobytes(), own[s].tobytes(), np.packbits(met[s]).tobytes()) for p, s in parted(tok, parts)]
            cls, first = np.unique(cls, return_index=True)
            return pa.RecordBatch.from_arrays([pa.array([*(x[0] for x in at), -1, -2], pa.int32()), pa.array([*(x[1] for x in at), counts.astype(np.int64).tobytes(), need[first].tobytes()], pa.binary()), pa.array([*(x[2] for x in at), classes.tobytes(), cls.tobytes()], pa.binary()), pa.array([*(x[3] for x in at), None, None], pa.binary())], names=["part", "tok", "own", "met"])

        for batch in batches:
            for _, s, cls in _sets(batch.column(0), size):
                n = s.sizes()
                need = np.maximum(1, n // 10) if percent <= 90 else np.ones(len(n), np.int64)
                sent = np.minimum(n, n - -(-n * percent // 100) + need)
                place = np.arange(len(s.values)) - np.repeat(s.first[:-1], n)
                use = place < np.repeat(sent, n)
                some = n > 0
                held.append((s.values[use], np.repeat(cls, sent), cls[some], np.minimum(need, sent)[some]))
                total += int(use.sum())
                if total > limit:
                    yield flush()
                    held.clear()
                    total = 0
        if total:
            yield flush()

    sent = texts.select("text").mapInArrow(lean(send), "part int, tok binary, own binary, met binary")

    def meet(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        own = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("own")])
        if part < 0:
            n = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("tok")])
            zero = np.zeros(len(n), np.int64)
            return pa.table({"h": own, "met": n if part == -1 else zero, "need": n if part == -2 else zero})
        tok = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("tok")])
        met = np.concatenate([np.unpackbits(np.frombuffer(m.as_py(), np.uint8), count=len(t.as_py()) // 4).astype(bool) for m, t in zip(table.column("met"), table.column("tok"), strict=True)])
        order = np.lexsort((own, tok))
        tok, own, met = tok[order], own[order], met[order]
        first = np.concatenate(([True], (tok[1:] != tok[:-1]) | (own[1:] != own[:-1])))
        group = np.cumsum(np.concatenate(([True], tok[1:] != tok[:-1]))) - 1
        kinds = np.bincount(group, first)
        use = first & (kinds[group] > 1) & ~met
        classes, counts = np.unique(own[use], return_counts=True)
        return pa.table({"h": classes, "met": counts.astype(np.int64), "need": np.zeros(len(classes), np.int64)})

    # Parts below 0 hold what needs no meeting; a salt keeps them from landing in one task.
    salted = sent.withColumn("salt", F.when(F.col("part") < 0, F.pmod(F.xxhash64("own"), F.lit(parts))).otherwise(F.lit(0)))
    counted = salted.groupBy("part", "salt").applyInArrow(meet, "h bigint, met bigint, need bigint")
    return counted.groupBy("h").agg(F.sum("met").alias("met"), F.max("need").alias("need")).where("met >= need and need > 0").select("h")


def bloom_words(classes: DataFrame) -> np.ndarray:
    """A Bloom filter of classes, of bounded size: two bits each."""
    n, bits = classes.count(), 1 << 16
    while bits < MAX_FILTER_BITS and bits < 16 * n:
        bits *= 2
    at = F.explode(F.array(F.pmod(F.col("h"), F.lit(bits)), F.pmod(F.shiftrightunsigned("h", 32), F.lit(bits))))
    rows = classes.select(at.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("b", F.lit(64)).cast("int"))).alias("m")).toPandas()
    words_ = np.zeros(bits // 64, np.int64)
    words_[rows["w"].to_numpy(np.int64)] = rows["m"].to_numpy(np.int64)
    return words_


def maybe(words_: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Which classes the filter may hold."""
    bits, out = U(len(words_) * 64), np.ones(len(cls), dtype=bool)
    signed = cls % np.int64(bits)
    for at in (signed, ((cls.view(U) >> U(32)) % bits).astype(np.int64)):
        out &= (words_.view(U)[at >> 6] >> (at & 63).astype(U) & U(1)).astype(bool)
    return out


def _keys(tok: np.ndarray, parts: int) -> np.ndarray:
    """What stands for a hash between tasks: its part and its lower half."""
    return part_of(tok, parts).astype(U) << U(32) | tok & LOW


def _ranked(sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """The sets with `prefix`: each one's rarest hashes, of which any set that links with it has one,
    in the order of how many sets have them. Sets that share too few hashes for any link are left
    out, as are hashes that one set alone has. Counts are exact: every hash meets its like in a part,
    and what it counts is sent back to the sets."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            tok, own = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(tok, kind="stable")
            tok, own = tok[order], own[order]
            out = [(p, (tok[s] & LOW).astype(np.uint32).tobytes(), own[s].tobytes()) for p, s in parted(tok, parts)]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], names=["part", "tok", "own"])

        total = 0
        for batch in batches:
            for c, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append((tok := np.frombuffer(x.as_py(), U), np.full(len(tok), c, np.int64)))
                total += len(tok)
                if total > max(FLUSH, 32 * parts):
                    yield flush()
                    held.clear()
                    total = 0
        if held:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        tok = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("tok")])
        own = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("own")])
        order = np.argsort(tok, kind="stable")
        tok, own = tok[order], own[order]
        start = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1])))
        many = np.diff(np.append(start, len(tok)))
        many = np.repeat(many, many)
        tok, own, many = tok[many > 1], own[many > 1], many[many > 1]
        home = part_of(own.view(U), parts)
        order = np.lexsort((own, home))
        tok, own, many, home = tok[order], own[order], many[order], home[order]
        at = np.searchsorted(home, np.arange(parts + 1))
        some = np.flatnonzero(np.diff(at))
        cut = [slice(at[k], at[k + 1]) for k in some]
        return pa.table({"home": pa.array(some.astype(np.int32)), "part": pa.array([part] * len(some), pa.int32()), "own": pa.array([own[s].tobytes() for s in cut], pa.binary()), "tok": pa.array([tok[s].tobytes() for s in cut], pa.binary()), "many": pa.array([np.minimum(many[s], 0xFFFFFFFF).astype(np.uint32).tobytes() for s in cut], pa.binary())})

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        prefixes: list[bytes | None] = [None] * left.num_rows
        if right.num_rows:
            own = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in right.column("own")])
            tok = np.concatenate([np.frombuffer(x.as_py(), np.uint32).astype(U) | U(p) << U(32) for x, p in zip(right.column("tok"), right.column("part").to_pylist(), strict=True)])
            many = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in right.column("many")])
            order = np.lexsort((tok, own))
            own, tok, many = own[order], tok[order], many[order]
            for k, (c, x) in enumerate(zip(left.column("h").to_pylist(), left.column("data"), strict=True)):
                a, b = np.searchsorted(own, c), np.searchsorted(own, c, side="right")
                s = np.frombuffer(x.as_py(), U)
                least = least_overlap(len(s), percent)
                if b - a < least:
                    continue
                key = _keys(s, parts)
                at = np.minimum(np.searchsorted(tok[a:b], key), b - a - 1)
                seen = np.where(tok[a:b][at] == key, many[a:b][at], 1)
                if int((seen > 1).sum()) < least:
                    continue
                first = np.lexsort((s, seen))[: len(s) - least + 1]
                place = np.flatnonzero(seen[first] > 1)
                if len(place):
                    prefixes[k] = place.astype(np.int32).tobytes() + s[first][place].tobytes()
        keep = pa.array([x is not None for x in prefixes])
        return left.drop_columns(["home"]).append_column("prefix", pa.array(prefixes, pa.binary())).filter(keep)

    met = sets.select("h", "data").mapInArrow(lean(send), "part int, tok binary, own binary").groupBy("part").applyInArrow(meet, "home int, part int, own binary, tok binary, many binary")
    # the home of a class: equal ranges of the upper half of its bits, read as unsigned
    home = F.shiftrightunsigned(F.shiftrightunsigned("h", 32) * F.lit(parts), 32).cast("int")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sets.schema)
    return sets.withColumn("home", home).groupBy("home").cogroup(met.groupBy("home")).applyInArrow(rank, f"{kind}, prefix binary")


def read_prefix(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places in a set's order by rarity, and the hashes there."""
    n = len(x) // 12
    return np.frombuffer(x, np.int32, n), np.frombuffer(x, U, n, 4 * n)


def _candidates(sets: DataFrame, parts: int) -> DataFrame:
    """Edges (u, v) that connect all classes which share one of their rarest hashes."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            toks = [read_prefix(x.as_py())[1] for x in batch.column(1)]
            tok, cls = np.concatenate(toks), np.repeat(batch.column(0).to_numpy(), list(map(len, toks)))
            order = np.argsort(tok, kind="stable")
            tok, cls = tok[order], cls[order]
            # all classes of a hash here hang on the first of them, which alone is sent
            start = np.concatenate(([True], tok[1:] != tok[:-1]))
            lead = cls[np.maximum.accumulate(np.where(start, np.arange(len(tok)), 0))]
            off = ~start & (lead != cls)
            nodes, root = local_components(cls[off], lead[off])
            out = [(p, tok[start][s].tobytes(), cls[start][s].tobytes()) for p, s in parted(tok[start], parts)]
            yield pa.RecordBatch.from_arrays([pa.array([*(x[0] for x in out), -1], pa.int32()), pa.array([*(x[1] for x in out), nodes.tobytes()], pa.binary()), pa.array([*(x[2] for x in out), root.tobytes()], pa.binary())], names=["part", "tok", "own"])

    def meet(table: pa.Table) -> pa.Table:
        tok = np.concatenate([np.frombuffer(x.as_py(), U) for x in table.column("tok")])
        own = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("own")])
        if table.column("part")[0].as_py() < 0:
            return pa.table({"u": tok.view(np.int64), "v": own})
        order = np.argsort(tok, kind="stable")
        tok, own = tok[order], own[order]
        start = np.concatenate(([True], tok[1:] != tok[:-1]))
        lead = own[np.maximum.accumulate(np.where(start, np.arange(len(tok)), 0))]
        off = lead != own
        nodes, root = local_components(own[off], lead[off])
        return pa.table({"u": nodes, "v": root})

    sent = sets.select("h", "prefix").mapInArrow(lean(send), "part int, tok binary, own binary")
    salted = sent.withColumn("salt", F.when(F.col("part") < 0, F.pmod(F.xxhash64("own"), F.lit(parts))).otherwise(F.lit(0)))
    return salted.groupBy("part", "salt").applyInArrow(meet, "u bigint, v bigint").where("u <> v")


class Groups:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def join_bucket(sets: list[np.ndarray], prefixes: list[tuple[np.ndarray, np.ndarray]], percent: int, groups: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect whatever links connect at all among these sets; sets that are of one group
    already need no link."""
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    known, out = Groups(len(sets)), []
    first: dict[int, int] = {}
    for k, g in enumerate(groups.tolist()):
        known.join(k, first.setdefault(g, k))
    index: dict[int, list[tuple[int, int]]] = {}  # hash: (set, place of the hash in its order), by size
    answers: dict[int, dict[int, int]] = {}  # set: overlaps it was found to have
    for x in order:
        s = sets[x]
        n = len(s)
        met: dict[int, int] = {}
        for place, tok in zip(*(a.tolist() for a in prefixes[x]), strict=True):
            entries = index.setdefault(tok, [])
            lo, hi = 0, len(entries)  # skip the block of sets that are too small
            while lo < hi:
                mid = (lo + hi) // 2
                if 100 * len(sets[entries[mid][0]]) < percent * n:
                    lo = mid + 1
                else:
                    hi = mid
            for y, y_place in entries[lo:]:
                if y not in met:
                    # all before these places differ, so at most the rest can be shared
                    met[y] = 1 if links(n, len(sets[y]), min(n - place, len(sets[y]) - y_place), percent) else 0
            entries.append((x, place))
        near, near_gap, mine = -1, 0, {}
        for y in sorted((y for y, may in met.items() if may), key=lambda y: -len(sets[y])):
            if known.root(x) == known.root(y):
                continue
            m = len(sets[y])
            if near >= 0 and y in answers.get(near, ()):
                most = min(answers[near][y] + near_gap, n, m)
                if not links(n, m, most, percent):
                    continue
            both = len(np.intersect1d(s, sets[y], assume_unique=True))
            mine[y] = both
            if links(n, m, both, percent):
                out.append((x, y))
                known.join(x, y)
                gap = n - both  # what x has and y lacks bounds how much more x may share with others
                if y in answers and (near < 0 or gap < near_gap):
                    near, near_gap = y, gap
        answers[x] = mine
    return out


def _in_buckets(rows: DataFrame, percent: int) -> DataFrame:
    """Of the sets (bucket, h, data, prefix, grp) of each bucket: links (u, v) that make the groups."""

    def run(table: pa.Table) -> pa.Table:
        h, at = np.unique(table.column("h").to_numpy(), return_index=True)
        table = table.take(pa.array(at))
        sets = [np.frombuffer(x.as_py(), U) for x in table.column("data")]
        prefixes = [read_prefix(x.as_py()) for x in table.column("prefix")]
        found = np.array(join_bucket(sets, prefixes, percent, table.column("grp").to_numpy()), np.int64).reshape(-1, 2)
        return pa.table({"u": h[found[:, 0]], "v": h[found[:, 1]]})

    return rows.select("bucket", "h", "data", "prefix", "grp").groupBy("bucket").applyInArrow(run, "u bigint, v bigint")


def _placed(candidates: DataFrame) -> DataFrame:
    """Where the sets of each candidate component go: (h, component, pieces, piece). A component of
    more than CHUNK sets has several pieces, each with the same pivots."""
    sized = candidates.groupBy("component").agg(F.count("*").alias("k"), *(F.min(F.struct(F.xxhash64("node", F.lit(r)), "node"))["node"].alias(f"p{r}") for r in range(PIVOTS)))
    pieces = F.ceil(F.col("k") / CHUNK).cast("long").alias("pieces")
    own = candidates.join(sized.select("component", "k"), "component").select(F.col("node").alias("h"), "component", pieces).withColumn("piece", F.pmod(F.xxhash64("h"), F.col("pieces")))
    pivots = sized.where(F.col("k") > CHUNK).select(F.explode(F.array(*(f"p{r}" for r in range(PIVOTS)))).alias("h"), "component", pieces)
    return own.unionByName(pivots.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))))


def _rest(marked: DataFrame, buckets: int) -> DataFrame:
    """Places (bucket, h, grp) in which every set with `out` meets all others of its component
    (h, component, pieces, grp, out)."""
    lone = marked.where("out").groupBy("component").agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("outer"))
    pairs = marked.join(lone, "component")
    last = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    a = pairs.where("out").withColumn("i", F.pmod(F.xxhash64("h", F.lit("out")), F.col("outer"))).withColumn("j", last("pieces"))
    b = pairs.withColumn("j", F.pmod(F.xxhash64("h"), F.col("pieces"))).withColumn("i", last("outer"))
    return a.select("h", "component", "grp", "i", "j").unionByName(b.select("h", "component", "grp", "i", "j")).select(F.pmod(F.xxhash64("component", "i", "j"), F.lit(buckets)).cast("int").alias("bucket"), "h", "grp")


def _groups(sets: DataFrame, candidates: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(node, component) over the classes that link with another one."""
    placed = staged(_placed(candidates), "set-places")
    bucket = F.pmod(F.xxhash64("component", "piece"), F.lit(buckets)).cast("int")
    plain = placed.join(sets, "h").select(bucket.alias("bucket"), "h", "data", "prefix", F.col("h").alias("grp"))
    found = staged(_in_buckets(plain, percent), "set-links")
    groups = staged(components(found, "set-groups"), "set-groups")
    spread = placed.where("pieces > 1").select("h", "component", "pieces").distinct()
    if spread.limit(1).count():
        labelled = staged(spread.join(groups.select(F.col("node").alias("h"), F.col("component").alias("g")), "h", "left").select("h", "component", "pieces", F.coalesce("g", "h").alias("grp")), "set-spread")
        main = labelled.groupBy("component", "grp").agg(F.count("*").alias("k")).groupBy("component").agg(F.max(F.struct("k", "grp"))["grp"].alias("main"))
        marked = labelled.join(main, "component").withColumn("out", F.col("grp") != F.col("main"))
        more = staged(_in_buckets(_rest(marked, 4 * buckets).join(sets, "h"), percent), "set-links")
        groups = staged(components(found.union(more), "set-groups"), "set-groups")
    return groups


class Gathered:
    """What the join starts from: every row's class, the sets of classes that may link, their candidates."""

    def __init__(self, rows: DataFrame, size: int, percent: int):
        if not 50 <= percent <= 100:
            raise ValueError("percent must be from 50 to 100")
        spark = rows.sparkSession
        modest_batches(spark)
        parts, kind = shuffle_parts(spark), dict(rows.dtypes)["doc_id"]
        alive = staged(_survivors(rows, size, percent, parts), "set-survivors")
        words_ = spark.sparkContext.broadcast(bloom_words(alive))

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sent: set[int] = set()
            for batch in batches:
                for row, s, cls in _sets(batch.column(1), size):
                    data = [None] * len(cls)
                    for k in np.flatnonzero(maybe(words_.value, cls) & (cls != 0)).tolist():
                        c = int(cls[k])
                        if c not in sent:  # a class's set is needed once
                            if len(sent) > 200_000:
                                sent.clear()
                            sent.add(c)
                            data[k] = s.row(k).tobytes()
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(s.sizes()), pa.array(cls), pa.array(data, pa.binary())], names=["doc_id", "n_shingles", "h", "data"])

        #: doc_id, n_shingles, h (0: an empty set)
        self.every = staged(rows.mapInArrow(lean(gather), f"doc_id {kind}, n_shingles bigint, h bigint, data binary"), "set-classes")
        first = self.every.where("data is not null").join(alive, "h", "left_semi").groupBy("h").agg(F.first("data").alias("data"))
        sets = staged(first, "set-data")
        #: h, data, prefix
        self.sets = staged(_ranked(sets, percent, parts), "set-ranked")
        dropped(sets)
        total = self.sets.agg(F.sum(F.length("data")).alias("b")).first()["b"] or 0
        self.candidates = staged(components(_candidates(self.sets, parts), "set-candidates"), "set-candidates")
        self.buckets, self.percent = max(parts, -(-total // BUCKET_BYTES)), percent


def link_groups(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest id that links reach, for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    got = Gathered(rows, size, percent)
    groups = _groups(got.sets, got.candidates, got.percent, got.buckets)
    least = got.every.where("h <> 0").groupBy("h").agg(F.min("doc_id").alias("least"))
    label = least.join(groups.select(F.col("node").alias("h"), "component"), "h", "left").withColumn("component", F.coalesce("component", "h"))
    label = label.join(label.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("h", "component_id")
    slim = got.every.select("doc_id", "n_shingles", "h")
    linked = slim.where("h <> 0").join(label, "h").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return linked.unionByName(slim.where("h = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
