"""Approximate nearest neighbours by cosine: inverted lists scanned with adaptive dimension tests.

Unit vectors are dealt to the lists of k-means centroids; from where a bounded sample can't give
enough of them, each list has finer parts by the nearest of a few common residuals. A query scans its
nearest list first and carries the k-th best distance on to the next ones, as many as a calibration
on the fitted sample asks for. Within a list the vectors are randomly rotated and held in column
blocks: after each block, the distance over the columns so far, scaled to all of them, estimates the
whole one, and candidates are abandoned once a test rejects that they beat the query's k-th best.
The queries of a list are tested together. What remains is scored exactly, on the original vectors
in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .learning import bounded_sample
from .scratch import Scratch

MAX_SAMPLE = 20_000  #: vectors that the index is fitted on
MAX_CENTROIDS = 2500  #: of the first level
MAX_FINE = 256  #: parts of a list
ITERATIONS = 8
RECALL = 0.9  #: that no run should fall below
TARGET = 0.95  #: share of the sample's true neighbours whose lists are to be scanned, more for few queries, by whose chance
CALIBRATION = 512  #: queries of the calibration
BLOCK = 16  #: columns of a block
CONFIDENCE = 1.5  #: of the test; a larger one abandons less
SEGMENT = 1 << 15  #: vectors of a list that a task holds at most, about; a list far above the mean is divided before
TURN = 1 << 20  #: queries of a list that meet in one task, about
TILE = 1 << 20  #: pairs of a query and a vector that are tested together
DENSE = 0.5  #: share of pairs still open above which a block is computed for all


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _means(x: np.ndarray, owner: np.ndarray, old: np.ndarray) -> np.ndarray:
    sums = np.zeros_like(old)
    np.add.at(sums, owner, x)
    counts = np.bincount(owner, minlength=len(old))[:, None]
    return np.where(counts > 0, sums / np.maximum(counts, 1), old)


@dataclass
class Index:
    centroids: np.ndarray
    fine: np.ndarray  #: residuals common to all lists, by which they are divided
    rotation: np.ndarray
    probes: int = 1

    @property
    def cells(self) -> int:
        return len(self.centroids) * len(self.fine)

    def lists(self, units: np.ndarray) -> np.ndarray:
        coarse = (units @ self.centroids.T).argmax(1)
        rest = units - self.centroids[coarse]
        return coarse * len(self.fine) + (rest @ self.fine.T - (self.fine**2).sum(1) / 2).argmax(1)

    def nearness(self, units: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """(queries, their nearness to all lists) in parts of bounded size."""
        cross = ((self.centroids[:, None] + self.fine[None]) ** 2).sum(2) / 2 if len(self.fine) > 1 else np.zeros((len(self.centroids), 1))
        step = max(1, (1 << 22) // self.cells)
        for low in range(0, len(units), step):
            part = units[low : low + step]
            yield slice(low, low + len(part)), ((part @ self.centroids.T)[:, :, None] + (part @ self.fine.T)[:, None] - cross).reshape(len(part), -1)


def fit_index(sample: np.ndarray, n: int, k: int, asking: int = 1 << 30) -> Index:
    """Centroids, rotation and number of probes from a sample of the n vectors for so many queries; the same sample gives the same index."""
    random = np.random.default_rng(11)
    units = _units(sample)
    wanted = max(1, round(math.sqrt(n)))
    n_lists = max(1, min(MAX_CENTROIDS, len(units) // 8, wanted))
    centroids = units[random.choice(len(units), n_lists, replace=False)]
    for _ in range(ITERATIONS):
        means = _means(units, (units @ centroids.T).argmax(1), centroids)
        length = np.linalg.norm(means, axis=1, keepdims=True)
        centroids = np.where(length > 0, means / np.maximum(length, 1e-300), centroids)
    parts = min(MAX_FINE, -(-wanted // n_lists), len(units))
    rest = units - centroids[(units @ centroids.T).argmax(1)]
    fine = np.zeros((1, units.shape[1])) if parts == 1 else rest[random.choice(len(units), parts, replace=False)]
    for _ in range(ITERATIONS if parts > 1 else 0):
        fine = _means(rest, (rest @ fine.T - (fine**2).sum(1) / 2).argmax(1), fine)
    rotation = np.linalg.qr(random.normal(size=(units.shape[1],) * 2))[0]
    index = Index(centroids, fine, rotation)
    owner, asked = index.lists(units), units[:CALIBRATION]
    near = asked @ units.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    best = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(units) - 1)]
    ranks = [int((row > row[o]).sum()) for part, scores in index.nearness(asked) for row, found in zip(scores, best[part]) for o in owner[found]]
    if ranks:
        goal = max(TARGET, RECALL + 4 * math.sqrt(TARGET * (1 - TARGET) / (k * asking)))
        index.probes = sorted(ranks)[min(len(ranks) - 1, math.ceil(goal * len(ranks)))] + 1
    return index


def scan(queries: np.ndarray, blocks: list[np.ndarray], limits: np.ndarray, k: int, own: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(query, row, values read): rows of the blocks that can be among the k nearest of the rotated queries.

    ``limits`` are squared distances that are known to hold k candidates, infinite where none is
    known; a row with the query's ``own`` id is no candidate.
    """
    dims, n = queries.shape[1], len(blocks[0])
    cuts = np.cumsum([b.shape[1] for b in blocks])
    parts = np.split(queries, cuts[:-1], axis=1)
    norms = [(b * b).sum(1) for b in blocks]
    found, read = [], 0
    for low in range(0, len(queries), max(1, TILE // max(n, 1))):
        mine = slice(low, low + max(1, TILE // max(n, 1)))
        limit, me = limits[mine].copy(), own[mine]
        lost = np.flatnonzero(np.isinf(limit))
        if len(lost) and n > k:  # the first rows' k-th best is one
            seeds = np.arange(min(n, max(64, 8 * k)))
            seen = sum(norms[b][seeds] - 2 * (part[mine][lost] @ blocks[b][seeds].T) + (part[mine][lost] ** 2).sum(1)[:, None] for b, part in enumerate(parts))
            seen[ids[seeds] == me[lost][:, None]] = np.inf
            read += seen.size * dims
            limit[lost] = np.partition(seen, k - 1, axis=1)[:, k - 1] if len(seeds) > k else np.inf
        q, row, total = None, None, None
        for b, (block, part, done) in enumerate(zip(blocks, parts, cuts)):
            part = part[mine]
            if q is None:
                whole = norms[b] - 2 * (part @ block.T) + (part * part).sum(1)[:, None]
                read += whole.size * block.shape[1]
                factor = 1.0 if done == dims else (1 + CONFIDENCE / math.sqrt(done)) ** 2 * done / dims
                q, row = np.nonzero(whole <= (limit * factor + 1e-9)[:, None])
                total = whole[q, row]
                kept = ids[row] != me[q]
                q, row, total = q[kept], row[kept], total[kept]
                continue
            rows = np.unique(row)
            if len(q) > DENSE * len(rows) * len(part):
                more = (norms[b][rows] - 2 * (part @ block[rows].T) + (part * part).sum(1)[:, None])[q, np.searchsorted(rows, row)]
                read += len(rows) * len(part) * block.shape[1]
            else:
                more = np.concatenate([((block[row[c : c + 65536]] - part[q[c : c + 65536]]) ** 2).sum(1) for c in range(0, len(q), 65536)]) if len(q) else np.zeros(0)
                read += len(q) * block.shape[1]
            total = total + more
            factor = 1.0 if done == dims else (1 + CONFIDENCE / math.sqrt(done)) ** 2 * done / dims
            kept = total <= (limit * factor + 1e-9)[q]
            q, row, total = q[kept], row[kept], total[kept]
        order = np.lexsort((total, q))
        q, row, total = q[order], row[order], total[order]
        starts = np.searchsorted(q, np.arange(len(limit)))
        counts = np.diff(np.append(starts, len(q)))
        worst = np.full(len(limit), np.inf)
        full = counts > k
        worst[full] = total[starts[full] + k - 1]
        kept = total <= worst[q] + 1e-9
        found.append((q[kept] + low, row[kept]))
    q, row = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    return q, row, read


def _is_vector(column: Column) -> Column:
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(column, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _needed(x: np.ndarray, ids: pa.Array, k: int) -> np.ndarray:
    """Rows without those that no query needs: of equal vectors the k + 1 smallest ids, one of which may be the query's own."""
    rank = np.zeros(len(ids), np.int64)
    rank[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
    same = np.unique(np.ascontiguousarray(x).view([("", x.dtype)] * x.shape[1]).ravel(), return_inverse=True)[1].ravel() if len(x) else rank
    order = np.lexsort((rank, same))
    new = np.diff(same[order], prepend=-1) != 0
    number = ids.dictionary_encode().indices.to_numpy()[order]
    fresh = new | (np.diff(number, prepend=-1) != 0)  # an id that is repeated with a vector counts once
    count = np.cumsum(fresh)
    turn = count - count[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else count
    return np.sort(order[fresh & (turn <= k)])


def search(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest of all other rows for each row where ``queries`` holds: ``query_id``, ``rank`` (from 1), ``id_col``, ``score``.

    Nearest first, ties to the smaller id; all candidates if they are fewer. Take no part: null ids;
    vectors that are null, all zero, hold a null or a component that isn't finite, or whose length
    isn't the most frequent one (the smaller of two). Rows that share an id are one item, whose
    nearest vector counts, and no candidate of their own query. An empty table gives no rows.
    Every row is indexed; only the centroids' sample is bounded, by MAX_SAMPLE.
    """
    spark = vectors.sparkSession
    clean = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & _is_vector(F.col("vector")))
    kind = clean.schema["id"].dataType.simpleString()
    out = f"query_id {kind}, rank int, {id_col} {kind}, score double"
    sizes = clean.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asking")).orderBy(F.desc("n"), "size").limit(1).collect()
    if not sizes or not sizes[0].asking:
        return spark.createDataFrame([], out)
    scratch = Scratch(spark, "neighbours")
    clean = clean.where(F.size("vector") == sizes[0]["size"])
    chosen = scratch.save(bounded_sample(clean.select("id"), "id", MAX_SAMPLE).distinct(), "sample")
    sample = clean.join(F.broadcast(chosen), "id", "left_semi").select("id", "vector").orderBy(F.xxhash64("id"), "id", "vector").limit(MAX_SAMPLE)
    index = spark.sparkContext.broadcast(fit_index(_matrix(sample.select("vector").toArrow().column(0).combine_chunks()), sizes[0].n, k, sizes[0].asking))
    item = f"list int, id {kind}, vector array<double>"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                kept = _needed(x, batch.column(0), k)
                lists = index.value.lists(_units(x[kept])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(lists), *(c.take(pa.array(kept)) for c in batch.columns)], ["list", "id", "vector"])

    placed = scratch.save(clean.select("id", "vector").mapInArrow(place, item), "placed")
    counts = {r.list: r.n for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most MAX_CENTROIDS x MAX_FINE rows
    lengths = np.array([counts.get(i, 0) for i in range(index.value.cells)])
    held = spark.sparkContext.broadcast(lengths)
    segment = min(SEGMENT, max(64, 2 * int(lengths.sum()) // max(1, int(np.count_nonzero(lengths)))))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, vector) to (list, id, vector, place), the lists to scan from the nearest, more of them where those hold too few candidates."""
        for batch in batches:
            for part, scores in index.value.nearness(_units(_matrix(batch.column(1)))) if batch.num_rows else ():
                order = np.argsort(-np.where(held.value > 0, scores, -np.inf), axis=1, kind="stable")
                enough = (np.cumsum(held.value[order], axis=1) <= k).sum(1) + 1
                most = np.minimum(np.maximum(index.value.probes, enough), np.count_nonzero(held.value))
                row = np.repeat(np.arange(len(order)), most)
                turn = np.arange(len(row)) - np.repeat(np.cumsum(most) - most, most)
                own = pa.array(row + part.start)
                yield pa.RecordBatch.from_arrays([pa.array(order[row, turn].astype(np.int32)), batch.column(0).take(own), batch.column(1).take(own), pa.array(turn.astype(np.int32))], ["list", "id", "vector", "place"])

    asked = clean.where("asks").select("id", "vector").mapInArrow(probe, f"{item}, place int")
    parts = spark.createDataFrame([(i, max(1, -(-int(c) // segment)), max(1, -(-int(c) * sizes[0].asking * index.value.probes // (sizes[0].n * TURN)))) for i, c in enumerate(lengths)], "list int, segments int, turns int")  # a row a list
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    rows = placed.join(F.broadcast(parts), "list").select("list", deal("segments").alias("segment"), every("turns").alias("turn"), F.lit(False).alias("asks"), "id", "vector", F.lit(0.0).alias("limit"))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by list, segment and turn, candidates before queries: the former are held, the latter stream by."""
        key, waiting, table = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)])
            cuts = np.flatnonzero((np.diff(marks) != 0).any(0)) + 1
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows]):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                if tuple(marks[:3, low]) != key:
                    key, waiting, table = tuple(marks[:3, low]), [], None
                if not marks[3, low]:
                    waiting.append((part.column(4), _matrix(part.column(5))))
                    continue
                if not waiting:
                    continue
                if table is None:
                    ids, x = pa.concat_arrays([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting])
                    kept = _needed(x, ids, k)
                    ids, x = ids.take(pa.array(kept)), x[kept]
                    turned = _units(x) @ index.value.rotation
                    table = ids, x, np.sqrt((x * x).sum(1)), [np.ascontiguousarray(b) for b in np.split(turned, range(BLOCK, turned.shape[1], BLOCK), axis=1)]
                    waiting = [()]
                ids, x, length, blocks = table
                asking, wanted = part.column(4), _matrix(part.column(5))
                numbers = pa.concat_arrays([ids, asking]).dictionary_encode().indices.to_numpy()
                q, row, _ = scan(_units(wanted) @ index.value.rotation, blocks, part.column(6).to_numpy(), k, numbers[len(ids) :], numbers[: len(ids)])
                score = (x[row] * wanted[q]).sum(1) / (length[row] * np.sqrt((wanted * wanted).sum(1))[q])
                yield pa.RecordBatch.from_arrays([asking.take(pa.array(q)), ids.take(pa.array(row)), pa.array(score)], ["query_id", "id", "score"])

    def scanned(which: DataFrame, name: str) -> DataFrame:
        which = which.join(F.broadcast(parts), "list").select("list", every("segments").alias("segment"), deal("turns").alias("turn"), F.lit(True).alias("asks"), "id", "vector", "limit")
        keys = ("list", "segment", "turn")
        dealt = rows.unionByName(which).repartition(*(F.col(c) for c in keys)).sortWithinPartitions(*keys, "asks")
        found = dealt.mapInArrow(nearest, f"query_id {kind}, id {kind}, score double")
        return scratch.save(found.groupBy("query_id", "id").agg(F.max("score").alias("score")), name)

    unlimited = F.lit(float("inf"))
    first = scanned(asked.where("place = 0").withColumn("limit", unlimited), "first")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    worst = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).groupBy("query_id").agg(F.min("score").alias("worst"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
    carried = asked.where("place > 0").join(worst.withColumnRenamed("query_id", "id"), "id", "left").withColumn("limit", F.coalesce(2 - 2 * F.col("worst") + 1e-9, unlimited))
    found = first.unionByName(scanned(carried.select("list", "id", "vector", "limit"), "others"))
    best = found.groupBy("query_id", "id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order))
    return best.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
