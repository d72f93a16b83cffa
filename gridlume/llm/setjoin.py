"""N-gram Jaccard join by universe partition and pigeonhole.

The shingle universe is hashed into segments. Two sets that link differ in at most D shingles,
where D follows from their sizes, so with segment weights that add up to more than D some
segment differs by less than its weight: weight 1 is an equal segment, weight 2 one that is equal
after at most one deletion on either side. A set's signatures are its segment subsets and, for
weight 2, their one-deletion neighbours. Two allocations keep the buckets small, and neither can
lose a link:

* for each band of sizes, how many segments take deletions, by a cost of rows and of chance meetings;
* for each set, which of its segments need to be probed: those whose signatures nobody shares are
  free, and of the others the dearest may be left out as long as enough weight stays.

Sets, not documents, are joined: copies of a set are one node. A bucket's members are first
compared with one of them, links merge, and then only members of different components are
compared; pairs whose parity sketches differ too much are left out unseen. No bucket emits all
pairs of a large group: hot buckets that share members form a group with a virtual centre, the
shingles that most of its sets have. With D the difference of a set to that centre, two sets
differ in |D1| + |D2| - 2 |D1 and D2| shingles. So either both link with the member nearest to the
centre, without any comparison, or D1 and D2 share some of their rarest elements: those make the
next, smaller buckets. Every other candidate pair is verified on the whole shingle sets, as 64-bit
hashes. A set is named by 64 of 128 bits; where two sets share those, they take the other 64.

No task gets all rows of a hot signature: signatures are first counted in chunks of a partition, a
filter of the shared ones keeps all others where they are, and rows meet their bucket's figures by
(signature, salt), where a signature that many share has many salts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import connected_components
from .scratch import Scratch
from .textbatch import U, mixed, shingles, slices

BAND_GROWTH = 1.7  #: sizes of a band grow by this
SLACK = 1.35  #: weight of a band's segments against what its largest sets need
CHANCE_COST = 50.0  #: what a chance meeting costs, in signature rows
COMMON = 0.3  #: chance that a shingle is one that many documents share
MAX_DELETION_SEGMENTS = 200
HOT = 12  #: probing members of a bucket from which it is split by differences to a centre
MAX_LEVELS = 3  #: times that hot buckets are split
EXHAUSTIVE = 10  #: after the first time, only while comparing the rest would meet more pairs than this times the first rows
MOST_COMMON = 3  #: common elements that pairs of a split bucket must show before they are compared
FILTER_PARTS, FILTER_HASHES = 64, 3
FILTER_BITS = (20, 29)  #: least and most of a filter: 16 bits an entry up to 64 MB; when that fills up, more rows than needed travel
CHUNK = 1 << 19  #: signature rows that are counted together before the shuffle
SALTED = 256  #: rows of a bucket for each of its salts, or more where
HOT_SHARE = 1e-5  #: that share of all rows is larger: so at most 1 / HOT_SHARE signatures are hot, which is what is broadcast
NODE_BITS = 64  #: of a set's name
MAX_CLASHES = 1 << 20  #: sets that share 64 bits with another one; N sets have about N^2 / 2^65
#: Bits of a row's meta value: set size, surplus weight, namespace, weight - 1, deletion segment + 1.
SIZE_BITS, SURPLUS_BITS, NAMESPACE_BITS = 28, 20, 6


def reach(size: int, percent: int) -> int:
    """The largest set that can link with one of ``size``."""
    return size * 100 // percent


def bound(a, b, percent: int):
    """How many shingles linked sets of sizes a and b can differ in."""
    return (a + b) * (100 - percent) // (100 + percent)


@lru_cache(None)
def bands(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(upper size, plain segments, deletion segments) of each band; bands in which links need equal sets have no segments."""
    tops, plain, deletion = [1], [0], [0]
    while bound(tops[-1] + 1, reach(tops[-1] + 1, percent), percent) == 0 and tops[-1] < 1 << SIZE_BITS:
        tops[-1] += 1
    while tops[-1] < 1 << SIZE_BITS:
        top = max(tops[-1] + 1, int(tops[-1] * BAND_GROWTH))
        need = int(np.ceil((bound(top, reach(top, percent), percent) + 1) * SLACK))
        options = []
        for d in range(min((need + 1) // 2, MAX_DELETION_SEGMENTS) + 1):
            p = max(0, need - 2 * d)
            each = top / (p + d)
            options.append((p + d * (1 + each) + CHANCE_COST * (p + d) * COMMON**each, d, p))
        _, d, p = min(options)
        tops.append(top)
        plain.append(p)
        deletion.append(d)
    return np.array(tops), np.array(plain), np.array(deletion)


def identities(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit identities of each set, which don't depend on its order."""
    sizes = np.diff(at).astype(U)
    out = []
    for salt in (U(0x2545F4914F6CDD1D), U(0x8CB92BA72F3D8DD7)):
        total = np.zeros(len(hashes) + 1, U)
        np.cumsum(mixed(hashes ^ salt), out=total[1:])
        out.append(mixed(total[at[1:]] - total[at[:-1]] + sizes * salt))
    return out[0], out[1]


def _signatures(hashes: np.ndarray, at: np.ndarray, nodes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, node, meta) rows of the sets, in all namespaces they need: their own band's and, where smaller sets of the band below can link, that one's."""
    tops, plain, deletion = bands(percent)
    sizes = np.diff(at)
    own = np.searchsorted(tops, sizes)
    rows = np.arange(len(sizes))
    below = np.flatnonzero((own > 1) & (-(-sizes * percent // 100) <= tops[np.maximum(own - 1, 0)]))
    row = np.concatenate([rows[own > 0], below])
    space = np.concatenate([own[own > 0], own[below] - 1])
    if not len(row):
        return (np.zeros(0, U),) * 3
    size = sizes[row]
    need = bound(size, np.minimum(size * 100 // percent, np.where(size > tops[space], tops[space], 1 << 62)), percent) + 1
    m, d = (plain + deletion)[space], deletion[space]
    # the tokens of each (set, namespace), by segment
    task = np.repeat(np.arange(len(row)), size)
    first = np.cumsum(size) - size
    token = hashes[np.arange(len(task)) - first[task] + at[row][task]]
    segment = ((mixed(token + U(0x632BE59BD9B4E019)) >> U(32)) * m[task].astype(U) >> U(32)).astype(np.int64)
    order = np.argsort(task << 32 | segment, kind="stable")
    task, segment, value = task[order], segment[order], mixed(token[order] ^ U(0x9FB21C651E98DF25))
    new = np.ones(len(task), bool)
    new[1:] = (task[1:] != task[:-1]) | (segment[1:] != segment[:-1])
    start = np.flatnonzero(new)
    total = np.add.reduceat(value, start)
    count = np.diff(np.append(start, len(task)))
    g_task, g_segment = task[start], segment[start]
    salt = lambda t, s: mixed(space[t].astype(U) << U(40) | s.astype(U))
    takes = g_segment < d[g_task]
    weight = 1 + (takes & (count > 1))
    surplus = np.bincount(g_task, weight, len(row)).astype(np.int64) - need
    # sets whose tokens fill too few segments also give their empty ones, and the empty neighbours of single tokens
    bare = surplus < 0
    surplus = np.where(bare, plain[space] + 2 * d - need, surplus)
    weight = np.where(bare[g_task] & takes, 2, weight)
    base = size.astype(np.int64) | np.minimum(surplus, (1 << SURPLUS_BITS) - 1) << SIZE_BITS | space << SIZE_BITS + SURPLUS_BITS
    meta = lambda t, s, w: base[t] | (w - 1) << SIZE_BITS + SURPLUS_BITS + NAMESPACE_BITS | np.where(s < d[t], s + 1, 0) << SIZE_BITS + SURPLUS_BITS + NAMESPACE_BITS + 1
    out = [(mixed(total + salt(g_task, g_segment)), nodes[row[g_task]], meta(g_task, g_segment, weight))]
    gone = np.flatnonzero(takes[group := np.cumsum(new) - 1] & (weight[group] == 2))
    if len(gone):
        g = group[gone]
        out.append((mixed(total[g] - value[gone] + salt(g_task[g], g_segment[g])), nodes[row[g_task[g]]], meta(g_task[g], g_segment[g], weight[g])))
    for t in np.flatnonzero(bare):
        s = np.setdiff1d(np.arange(m[t]), g_segment[g_task == t])
        t = np.full(len(s), t)
        out.append((mixed(salt(t, s)), nodes[row[t]], meta(t, s, np.where(s < d[t], 2, 1))))
    return tuple(np.concatenate(x) for x in zip(*out))


def _sets_of(batch: pa.RecordBatch, text: int, size: int, bits: int, clashes: Broadcast | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for row, data, offsets in slices(batch.column(text)):
        hashes, at = shingles(data, offsets, size)
        node, twin = identities(hashes, at)
        node = node >> U(64 - bits)
        if clashes is not None and len(clashes.value):
            node = np.where(np.isin(node, clashes.value), twin, node)
        yield row, hashes, at, node, twin


def _nodes(size: int, bits: int):
    """(id, text) to (id, n_shingles, node, twin); the node of a set without shingles is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(np.diff(at), a, b) for _, _, at, a, b in _sets_of(batch, 1, size, bits)]
            if parts:
                n, a, b = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(a.view(np.int64), mask=n == 0), pa.array(b.view(np.int64), mask=n == 0)], ["id", "n_shingles", "node", "twin"])

    return run


def _fresh_signatures(batches: Iterator[pa.RecordBatch], size: int, bits: int, percent: int, clashes: Broadcast) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(signature, node, meta) rows of the texts; of the copies of a set in one partition, the first counts."""
    seen: set[int] = set()
    for batch in batches:
        for _, hashes, at, a, _ in _sets_of(batch, 0, size, bits, clashes):
            fresh = np.zeros(len(a), bool)
            for k, x in enumerate(a.tolist()):
                if x not in seen:
                    seen.add(x)
                    fresh[k] = True
            kept = np.flatnonzero(fresh)
            counts = np.diff(at)
            yield _signatures(hashes[np.repeat(fresh, counts)], np.append(0, np.cumsum(counts[kept])), a[kept], percent)


def _counted_signatures(size: int, bits: int, percent: int, clashes: Broadcast):
    """(text) to (sig, node, n): a signature's rows of CHUNK rows or so are one, or two of different nodes, whose ``n`` add up to them."""

    def chunk(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        sig, node = (np.concatenate([p[c] for p in parts]) for c in (0, 1))
        order = np.argsort(sig)
        sig, node = sig[order], node[order]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        n = np.diff(np.append(start, len(sig)))
        low, high = np.minimum.reduceat(node, start), np.maximum.reduceat(node, start)
        two = np.flatnonzero(low != high)
        n = np.concatenate([n, np.ones(len(two), np.int64)])
        n[two] -= 1
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([sig[start], sig[start[two]]]).view(np.int64)), pa.array(np.concatenate([low, high[two]]).view(np.int64)), pa.array(n.astype(np.int32))], ["sig", "node", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for part in _fresh_signatures(batches, size, bits, percent, clashes):
            if len(part[0]):
                parts.append(part)
                held += len(part[0])
            if held >= CHUNK:
                yield chunk(parts)
                parts, held = [], 0
        if parts:
            yield chunk(parts)

    return run


def _signatures_in(size: int, bits: int, percent: int, clashes: Broadcast, wanted: Broadcast):
    """(text) to (sig, node, meta) of the signatures in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _fresh_signatures(batches, size, bits, percent, clashes):
            hits = _in_filter(part[0], wanted.value)
            if len(hits):
                yield pa.RecordBatch.from_arrays([pa.array(x[hits].view(np.int64)) for x in part], ["sig", "node", "meta"])

    return run


def _parities(hashes: np.ndarray) -> bytes:
    """One bit for each of a power of two of parts of the universe, no fewer than the set has shingles: the parity of its shingles there."""
    width = max(64, 1 << (len(hashes) - 1).bit_length())
    counts = np.bincount((mixed(hashes ^ U(0xC2B2AE3D27D4EB4F)) & U(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _places(values: np.ndarray, bits: int) -> np.ndarray:
    """The bits of the filter that stand for each value, a row for each hash."""
    salts = mixed(np.arange(1, FILTER_HASHES + 1, dtype=U))
    return np.stack([(mixed(values ^ s) >> U(64 - bits)).astype(np.int64) for s in salts])


def _in_filter(values: np.ndarray, filter_: np.ndarray) -> np.ndarray:
    places = _places(values, 3 + (len(filter_) - 1).bit_length())
    return np.flatnonzero((filter_[places >> 3] >> (places & 7) & 1).all(0))


def _filter_of(values: DataFrame) -> np.ndarray:
    """A Bloom filter of a column of longs, as large as their number asks for: built in FILTER_PARTS parts by the executors, of which the driver gets the bytes."""
    least, most = FILTER_BITS
    bits = min(most, max(least, (16 * values.count()).bit_length()))
    width = (1 << bits) // FILTER_PARTS

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = _places(batch.column(0).to_numpy().view(U), bits).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(place // width), pa.array(place)], ["part", "bit"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            part, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for p in np.unique(part).tolist():
                parts.setdefault(p, np.zeros(width, bool))[bit[part == p] - p * width] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in parts.values()], pa.binary())], ["part", "bits"])

    out = np.zeros((FILTER_PARTS, width // 8), np.uint8)
    for r in values.mapInArrow(places, "part long, bit long").repartition(FILTER_PARTS, "part").mapInArrow(packed, "part long, bits binary").collect():
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def _shingle_sets(size: int, bits: int, clashes: Broadcast, wanted: Broadcast):
    """(text) to (node, shingles, parity) of nodes in the filter: the sorted 64-bit hashes as bytes, and their parity sketch; once a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, hashes, at, a, _ in _sets_of(batch, 0, size, bits, clashes):
                hits = _in_filter(a, wanted.value)
                kept = [k for k in hits[np.diff(at)[hits] > 0].tolist() if not (a[k] in seen or seen.add(a[k]))]
                if kept:
                    sets = [hashes[at[k] : at[k + 1]] for k in kept]
                    yield pa.RecordBatch.from_arrays([pa.array(a[kept].view(np.int64)), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([_parities(x) for x in sets], pa.binary())], ["node", "shingles", "parity"])

    return run


def _apart(percent: int):
    """(a, b, parity_a, size_a, parity_b, size_b) to (a, b) without the pairs that differ in more parities than linked sets can differ in shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros(batch.num_rows, bool)
            most = bound(batch.column(3).to_numpy(), batch.column(5).to_numpy(), percent)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(4))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                while len(x) > len(y):
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                while len(y) > len(x):
                    y = y[: len(y) // 2] ^ y[len(y) // 2 :]
                near[k] = int(np.bitwise_count(x ^ y).sum()) <= most[k]
            yield batch.select([0, 1]).filter(pa.array(near))

    return run


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, shingles) to (group, element)."""
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
        if sets:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) for x in sets])), pa.array(np.concatenate(sets))], ["group", "element"])


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, node, size, shingles, centre) to (group, node, size, delta): the elements of just one of the set and the centre."""
    for batch in batches:
        out = []
        for x, centre in zip(batch.column(3), batch.column(4).to_pylist()):
            out.append(np.setxor1d(np.frombuffer(x.as_buffer(), np.int64), np.array(centre or [], np.int64), assume_unique=True))
        offsets = np.append(0, np.cumsum([len(x) for x in out])).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))], ["group", "node", "size", "delta"])


def _verify(percent: int):
    """(a, b, set_a, set_b) to (a, b, linked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                linked[k] = 100 * common >= percent * (len(both) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked)], ["a", "b", "linked"])

    return run


def _bits(column: Column, low: int, width: int) -> Column:
    return F.shiftright(column, low).bitwiseAND(F.lit((1 << width) - 1))


def _salted(rows: DataFrame) -> DataFrame:
    """Each bucket's row once for each of the bucket's ``parts``."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))


def _gathered(rows: DataFrame, **figures: Column) -> DataFrame:
    """The rows with aggregates of their buckets: partial ones before the shuffle, and met by (sig, salt)."""
    sums = rows.groupBy("sig").agg(F.max("parts").alias("parts"), *(c.alias(n) for n, c in figures.items()))
    return rows.join(_salted(sums).drop("parts"), ["sig", "salt"])


def _shared_rows(scratch: Scratch, texts: DataFrame, words: int, percent: int, clashes: Broadcast) -> DataFrame:
    """(sig, salt, parts, node, size, probed, need) of the rows in buckets of at least two nodes, once each; ``probed``: whether the node's allocation needs the bucket.

    Segments that nobody shares are free. Of the others, ordered from the dearest, those within
    the surplus weight are left out; ties go by the segment's number and signature.
    """
    # nearly all signatures occur once, for which sorting is cheaper than hash tables on both sides of the shuffle
    bucket = Window.partitionBy("sig")
    met = texts.mapInArrow(_counted_signatures(words, NODE_BITS, percent, clashes), "sig long, node long, n int")
    met = met.withColumns({"met": F.sum("n").over(bucket), "low": F.min("node").over(bucket), "high": F.max("node").over(bucket)}).where("low < high")
    shared = scratch.save(met.select("sig", "met").distinct(), "shared")
    wanted = texts.sparkSession.sparkContext.broadcast(_filter_of(shared.select("sig")))
    scratch.release()
    most = max(SALTED, int(HOT_SHARE * (shared.agg(F.sum("met")).first()[0] or 0)))
    hot = F.broadcast(shared.where(F.col("met") > most).select("sig", F.ceil(F.col("met") / most).cast("int").alias("parts")))  # at most 1 / HOT_SHARE rows
    parts = F.coalesce("parts", F.lit(1))
    signatures = texts.mapInArrow(_signatures_in(words, NODE_BITS, percent, clashes, wanted), "sig long, node long, meta long")
    dealt = signatures.join(hot, "sig", "left").withColumn("parts", parts).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    shared = _salted(shared.join(hot, "sig", "left").withColumn("parts", parts)).drop("parts")
    low = SIZE_BITS + SURPLUS_BITS
    rows = dealt.join(shared, ["sig", "salt"]).dropDuplicates(["sig", "salt", "node", "meta"])
    rows = rows.withColumns(
        {
            "size": _bits(F.col("meta"), 0, SIZE_BITS),
            "surplus": _bits(F.col("meta"), SIZE_BITS, SURPLUS_BITS),
            "space": _bits(F.col("meta"), low, NAMESPACE_BITS),
            "weight": _bits(F.col("meta"), low + NAMESPACE_BITS, 1) + 1,
            "segment": _bits(F.col("meta"), low + NAMESPACE_BITS + 1, 8),
        }
    ).withColumn("part", F.when(F.col("segment") == 0, F.col("sig")).otherwise(F.col("segment")))
    by_part = Window.partitionBy("node", "space", "segment", "part")
    by_cost = Window.partitionBy("node", "space").orderBy(F.desc("cost"), "segment", "part")
    rows = (
        rows.repartition(F.col("node"))
        .withColumns({"cost": F.sum("met").over(by_part), "turn": F.row_number().over(by_part.orderBy("sig"))})
        .withColumn("dearer", F.sum(F.when(F.col("turn") == 1, F.col("weight")).otherwise(0)).over(by_cost))
        .select("sig", "salt", "parts", "node", "size", (F.col("dearer") > F.col("surplus")).alias("probed"), F.lit(1).alias("need"))
    )
    return scratch.save(rows, "allotted")


class _Join:
    """The comparison of the nodes: what has been verified, and the components so far."""

    def __init__(self, scratch: Scratch, sets: DataFrame, percent: int) -> None:
        self.scratch, self.sets, self.percent = scratch, sets, percent
        self.verified: DataFrame | None = None
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None
        self.step = 0

    def add_links(self, links: DataFrame) -> None:
        self.links = links if self.links is None else self.links.unionByName(links)

    def relabel(self) -> None:
        self.step += 1
        if self.links is not None:
            self.labels = connected_components(self.scratch, self.links, f"labels-{self.step}")

    def labelled(self, rows: DataFrame) -> DataFrame:
        if self.labels is None:
            return rows.withColumn("comp", F.col("node"))
        return rows.join(self.labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    def verify(self, pairs: DataFrame) -> None:
        """Compare the pairs that aren't yet; links are added."""
        self.step += 1
        if self.verified is not None:
            pairs = pairs.join(self.verified, ["a", "b"], "left_anti")
        sketches = self.sets.select("node", "parity", "size")
        side = lambda x: sketches.select(F.col("node").alias(x), F.col("parity").alias(f"parity_{x}"), F.col("size").alias(f"size_{x}"))
        pairs = self.scratch.save(pairs, f"pairs-{self.step}")
        near = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "parity_a", "size_a", "parity_b", "size_b")
        near = self.scratch.save(near.mapInArrow(_apart(self.percent), "a long, b long"), f"near-{self.step}")
        whole = lambda x: self.sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}"))
        full = near.join(whole("b"), "b").join(whole("a"), "a").select("a", "b", "set_a", "set_b")
        found = self.scratch.save(full.mapInArrow(_verify(self.percent), "a long, b long, linked boolean"), f"found-{self.step}")
        self.verified = pairs if self.verified is None else self.verified.unionByName(pairs)
        self.add_links(found.where("linked").select("a", "b"))

    def compare_with_one(self, rows: DataFrame) -> None:
        """Each bucket's members with one of them, the same for groups that share many buckets."""
        met = _gathered(rows, c=F.min(F.struct(F.xxhash64("node").alias("h"), "node", "size", "probed")))
        met = met.where((F.col("node") != F.col("c.node")) & (F.col("probed") | F.col("c.probed")))
        met = met.where(100 * F.least("size", "c.size") >= self.percent * F.greatest("size", "c.size"))
        self.verify(met.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct())

    def compare_components(self, rows: DataFrame) -> None:
        """All pairs of a bucket's members, one of them probing, that are in different components so far."""
        now = _gathered(self.labelled(rows), one=F.min("comp"), other=F.max("comp")).where("one < other").drop("one", "other")
        now = self.scratch.save(now, f"open-{self.step}")
        one, two = now.alias("one"), _salted(now.where("probed").drop("salt")).alias("two")
        # each pair once a bucket: its second member probes, and the first is smaller or doesn't
        meets = F.expr("one.sig = two.sig AND one.salt = two.salt AND one.comp <> two.comp AND (NOT one.probed OR one.node < two.node)")
        alike = 100 * F.least("one.size", "two.size") >= self.percent * F.greatest("one.size", "two.size")
        met = one.join(two, meets & alike).select(F.least("one.node", "two.node").alias("a"), F.greatest("one.node", "two.node").alias("b"), F.greatest("one.need", "two.need").alias("need"))
        self.verify(met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"), F.max("need").alias("need")).where("met >= need").select("a", "b"))

    def hot_buckets(self, rows: DataFrame) -> DataFrame:
        """Link what is near a group's centre; the buckets in which all other links meet."""
        t, save = self.percent, lambda df, name: self.scratch.save(df, f"{name}-{self.step}")
        self.step += 1
        by_node = _gathered(rows, head=F.min("node")).groupBy("node").agg(F.min("head").alias("head"))
        headed = save(rows.join(by_node, "node"), "groups")
        members = save(_gathered(headed, group=F.min("head")).select("group", "node", "size").distinct(), "group-members")
        with_sets = save(members.join(self.sets.select("node", "shingles"), "node"), "group-sets")
        counts = with_sets.select("group", "shingles").mapInArrow(_elements, "group long, element long").groupBy("group", "element").agg(F.count(F.lit(1)).alias("n"))
        half = members.groupBy("group").agg(F.count(F.lit(1)).alias("all"))
        # a centre has at most twice as many elements as its sets have on average
        centres = save(counts.join(half, "group").where(2 * F.col("n") > F.col("all")).groupBy("group").agg(F.collect_list("element").alias("centre")), "centres")
        deltas = save(with_sets.join(centres, "group", "left").select("group", "node", "size", "shingles", "centre").mapInArrow(_differences, "group long, node long, size long, delta array<long>"), "deltas")
        deltas = deltas.withColumn("gap", (100 + t) * F.size("delta") - (100 - t) * F.col("size"))
        nearest = save(deltas.groupBy("group").agg(F.min(F.struct("gap", "node")).alias("best")), "nearest")
        measured = deltas.join(nearest, "group").withColumn("linked", F.col("gap") + F.col("best.gap") <= 0)
        outer = save(measured.where("NOT linked").groupBy("group").agg(F.min("gap").alias("outer_gap")), "outer")
        links = measured.where((F.col("node") != F.col("best.node")) & F.col("linked"))
        self.add_links(save(links.select(F.least("node", "best.node").alias("a"), F.greatest("node", "best.node").alias("b")).distinct(), "near-links"))
        # two sets that link share at least this many elements of their differences; what is linked with
        # the nearest member needs to meet only what isn't, and a group that is linked as a whole is done
        measured = measured.join(outer, "group").withColumn("least", F.when(F.col("linked"), F.col("outer_gap")).otherwise(F.col("best.gap")))
        farthest = ((F.col("size") + F.floor(F.col("size") * 100 / t)) * (100 - t) / (100 + t)).cast("long")
        common = F.greatest(F.lit(1), F.ceil((F.col("gap") + F.col("least")) / (2 * (100 + t))), F.size("delta") - farthest)
        # with as many common elements in the prefixes as they are longer by, and one more
        need = F.least(common, F.lit(MOST_COMMON))
        spread = save(measured.select("group", "node", "size", need.alias("need"), (F.size("delta") - common + need).alias("prefix"), F.explode("delta").alias("element")), "spread")
        rarity = save(spread.groupBy("group", "element").agg(F.count(F.lit(1)).alias("n")), "rarity")
        order = Window.partitionBy("group", "node").orderBy("n", "element")
        ranked = spread.join(rarity, ["group", "element"]).withColumn("place", F.row_number().over(order))
        parts = F.ceil(F.col("n") / SALTED).cast("int")
        dealt = ranked.where("place <= prefix AND n > 1").select(F.xxhash64("group", "element").alias("sig"), parts.alias("parts"), "node", "size", F.lit(True).alias("probed"), F.col("need").cast("int").alias("need"))
        return dealt.distinct().withColumn("salt", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))

    def run(self, rows: DataFrame) -> None:
        """``rows`` are open: their buckets have two nodes or more, of which some probe, with ``probers``."""
        budget = EXHAUSTIVE * rows.count()
        for level in range(MAX_LEVELS + 1):
            now = rows if level == 0 else self.scratch.save(opened(self.labelled(rows)), f"rows-{level}")
            hot = now.where(F.col("probers") > HOT)
            work = hot.agg(F.sum(F.col("probers").cast("double"))).first()[0] or 0.0
            more = level < MAX_LEVELS and work > (0 if level == 0 else budget)
            hot = hot.drop("probers")
            small = (now.where(F.col("probers") <= HOT) if more else now).drop("probers")
            if more:
                rows = self.scratch.save(self.hot_buckets(hot), f"split-{level}")
            if level == 0:
                self.compare_with_one(small)
                self.relabel()
            self.compare_components(small)
            if not more:
                break
        self.relabel()


def opened(rows: DataFrame) -> DataFrame:
    """The rows of buckets with more than one component in which some row probes, with the number of those."""
    found = _gathered(rows, one=F.min("comp"), other=F.max("comp"), probers=F.count_if("probed")).where("one < other AND probers > 0")
    return found.select("sig", "salt", "parts", "node", "size", "probed", "need", "probers")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Link documents whose shingle sets have a Jaccard similarity of at least ``percent`` / 100.

    Returns one row per input row: ``id_col``, ``n_shingles`` (size of its set), ``component_id``
    (smallest id that links reach, its own included). Other columns are ignored, so their names
    can't clash. Defined results: a null or empty text, or one of white space only, has an empty
    set and links with nothing; a text of fewer than ``words`` words has one shingle, the whole
    sequence; repeated rows stay repeated; rows with a null id take part, and a component of
    nothing but null ids has a null id; an empty table gives an empty result. Texts of any length
    are taken whole (a text's working memory is about 100 bytes a character).
    """
    if not 0 < percent <= 100:
        raise ValueError("percent is from 1 to 100")
    spark = docs.sparkSession
    scratch = Scratch(spark, "setjoin")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    members = scratch.save(docs.mapInArrow(_nodes(words, NODE_BITS), f"id {kind}, n_shingles long, node long, twin long"), "members")
    alike = members.where("node IS NOT NULL").groupBy("node").agg(F.min("twin").alias("low"), F.max("twin").alias("high")).where("low < high").select("node")
    found = alike.limit(MAX_CLASHES + 1).toArrow().column("node").to_numpy().view(U)
    if len(found) > MAX_CLASHES:
        raise ValueError("more sets share 64 bits of their identity than chance allows")
    clashes = spark.sparkContext.broadcast(found)
    if len(found):
        members = members.join(F.broadcast(alike.withColumn("clash", F.lit(True))), "node", "left").withColumn("node", F.when(F.col("clash"), F.col("twin")).otherwise(F.col("node")))
    texts = docs.where("text IS NOT NULL").select("text")
    rows = _shared_rows(scratch, texts, words, percent, clashes)
    rows = scratch.save(opened(rows.withColumn("comp", F.col("node"))), "rows")
    scratch.drop("allotted")

    involved = scratch.save(rows.select("node").distinct(), "involved")
    wanted = spark.sparkContext.broadcast(_filter_of(involved))
    scratch.release()
    sets = texts.mapInArrow(_shingle_sets(words, NODE_BITS, clashes, wanted), "node long, shingles binary, parity binary")
    sets = sets.dropDuplicates(["node"]).join(involved, "node", "left_semi")
    sets = scratch.save(sets.withColumn("size", (F.octet_length("shingles") / 8).cast("long")), "sets")
    scratch.release()
    join = _Join(scratch, sets, percent)
    join.run(rows)
    labels = join.labels

    nodes = members.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("low"))
    if labels is not None:
        nodes = scratch.save(nodes.join(labels, "node", "left").select("node", "low", F.coalesce("comp", "node").alias("comp")), "nodes")
        lows = scratch.save(nodes.groupBy("comp").agg(F.min("low").alias("component_id")), "lows")
        nodes = nodes.join(lows, "comp").select("node", "component_id")
    else:
        nodes = nodes.withColumnRenamed("low", "component_id")
    nodes = scratch.save(nodes, "classes")
    return members.join(nodes, "node", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    )
