"""Approximate nearest neighbours: a forest of random-projection trees, searched through one shared priority queue.

The trees are fitted on a bounded sample (at most SAMPLE distinct vectors): each inner node holds a random direction and
the sample's median along it. Every row is indexed: each tree sends it to one leaf. A query walks all trees at once,
always opening the branch with the smallest margin over all trees, until the leaves it has opened hold SEARCH times as
many vectors as there are, counted once for each tree. Leaf and queries meet in one task, where inner products with
all candidates of the leaf are taken; the best of all leaves are ranked again on the original vectors.

Equal vectors are indexed once, with their k + 1 smallest ids, as more can never be among a query's k nearest; and equal
queries are searched once. So a vector that a third of the rows share is one entry. Nearness is the inner product in double
precision, ties go to the smaller id. Vectors that are null or zero, hold null, NaN or infinity, or differ in length from
most others take no part, neither do rows without an id. An id that repeats is a candidate with each of its vectors, once with
the best, and no candidate of its own query.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.llm import cells as C
from talentgrid.llm import words as W
from talentgrid.llm.staging import staged

SAMPLE = 16_384
TREES = 12
LEAF_ROWS = 48
MAX_DEPTH = 9
SEARCH = 1.3
SEED = 29


class Forest:
    """Complete trees of one depth: node i has the children 2i + 1 and 2i + 2; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int):
        rng = np.random.Generator(np.random.PCG64(SEED))
        inner = (1 << depth) - 1
        self.depth, self.trees = depth, trees
        self.direction = rng.standard_normal((trees, inner, sample.shape[1])) if sample.size else np.zeros((trees, inner, sample.shape[1]))
        self.direction /= np.maximum(np.linalg.norm(self.direction, axis=2, keepdims=True), 1e-12)
        self.cut = np.zeros((trees, inner))
        for t in range(trees):
            node = np.zeros(len(sample), np.int64)
            for _ in range(depth):
                for n in np.unique(node).tolist():
                    own = node == n
                    self.cut[t, n] = np.median(sample[own] @ self.direction[t, n])
                node = self._step(t, sample, node)

    def _step(self, t: int, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        out = np.empty_like(node)
        for n in np.unique(node).tolist():
            own = node == n
            out[own] = 2 * n + 1 + (x[own] @ self.direction[t, n] >= self.cut[t, n])
        return out

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.zeros((len(x), self.trees), np.int64)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = self._step(t, x, node)
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Signed distances of vectors to the cut of each node of each tree."""
        return np.einsum("qd,tnd->qtn", x, self.direction, optimize=True) - self.cut

    def search(self, margins: np.ndarray, sizes: np.ndarray, enough: float, least: int) -> list[int]:
        """Leaves (tree * leaves + leaf) of one query, nearest first, until they hold enough vectors.

        Leaves of one tree have no vector in common, so that one tree with `least` vectors tells as many different ones.
        """
        inner, held, out, queue = (1 << self.depth) - 1, 0, [], [(0.0, t, 0) for t in range(self.trees)]
        rows, different = margins.tolist(), [0] * self.trees
        while queue and (held < enough or max(different) < least):
            margin, t, n = heapq.heappop(queue)
            row = rows[t]
            while n < inner:
                side = row[n] >= 0
                heapq.heappush(queue, (max(margin, abs(row[n])), t, 2 * n + 2 - side))
                n = 2 * n + 1 + side
            slot = t * (inner + 1) + n - inner
            out.append(slot)
            held += int(sizes[slot])
            different[t] += int(sizes[slot])
        return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null").where(sound)
    size = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("v") == (size.n if size else 0))


def nearest(rows: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows found of each row where `is_query` (on column id) holds."""
    spark = rows.sparkSession
    good = usable(rows, vec_id, vector)
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    groups = good.distinct().withColumn("turn", first).where(f"turn <= {k + 1}").groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    groups = staged(groups.select(F.col("ids")[0].alias("vid"), "ids", "v"), "vectors")
    asked = good.where(is_query).select("id", "v").distinct()
    queries = staged(asked.groupBy("v").agg(F.min("id").alias("qid")), "queries")
    total = groups.count()
    sample = groups.select("vid", "v").orderBy(F.xxhash64("vid"), "vid").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    width = len(sample[0]) if len(sample) else 1
    depth = min(MAX_DEPTH, max(1, round(math.log2(max(2, total / LEAF_ROWS)))))
    forest = Forest(_matrix(sample, width).astype(np.float64), TREES, depth)
    told = spark.sparkContext.broadcast(forest)
    leaves, buckets = 1 << depth, C.bucket_count(spark)
    cells = "slot int, kind int, n long, cell binary"

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"slot": pa.int32(), "kind": pa.int32(), "n": pa.int64(), "cell": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                vectors, ids = _matrix(x.column(1), width), x.column(0).to_numpy()
                slot = told.value.leaves(vectors.astype(np.float64)) + np.arange(TREES) * leaves
                for t in range(TREES):
                    order = np.argsort(slot[:, t], kind="stable")
                    start, length = C.runs(slot[order, t])
                    parts = [(int(slot[order[i], t]), order[i : i + n]) for i, n in zip(start.tolist(), length.tolist(), strict=True)]
                    yield batch([(s, 1, len(p), C.pack(ids[p], vectors[p].reshape(-1))) for s, p in parts])

    index = staged(groups.select("vid", "v").mapInArrow(indexed, cells), "leaves")
    sizes = np.zeros(TREES * leaves, np.int64)
    for r in index.groupBy("slot").agg(F.sum("n").alias("n")).collect():  # at most one row for each leaf of each tree
        sizes[r.slot] = r.n

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i in range(0, x.num_rows, 512):
                part = x.slice(i, 512)
                vectors, ids = _matrix(part.column(1), width), part.column(0).to_numpy()
                margins = told.value.margins(vectors.astype(np.float64))
                found = [told.value.search(m, sizes, SEARCH * total, min(total, k + 1)) for m in margins]
                slot = np.array([s for f in found for s in f], np.int64)
                own = np.repeat(np.arange(len(ids)), [len(f) for f in found])
                order = np.argsort(slot, kind="stable")
                start, length = C.runs(slot[order])
                parts = [(int(slot[order[i]]), own[order[i : i + n]]) for i, n in zip(start.tolist(), length.tolist(), strict=True)]
                yield batch([(s, 0, len(p), C.pack(ids[p], vectors[p].reshape(-1))) for s, p in parts])

    def best(q: np.ndarray, v: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k + 1 best different candidates of each query."""
        order = np.lexsort((v, q))
        order = order[np.concatenate([[True], (np.diff(q[order]) != 0) | (np.diff(v[order]) != 0)])] if len(order) else order
        order = order[np.lexsort((v[order], -score[order], q[order]))]
        start, length = C.runs(q[order])
        order = order[np.arange(len(order)) - np.repeat(start, length) <= k]
        return q[order], v[order], score[order]

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size, limit, known, least = 0, 200_000, np.zeros(0, np.int64), np.zeros(0)  # queries with k + 1 candidates, and their last score
        rows = (r for x in batches for r in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), x.column(3).to_pylist(), strict=True))
        for _, group in groupby(rows, key=lambda r: r[0]):
            asked: list[tuple[np.ndarray, np.ndarray]] = []
            for _, kind, cell in group:  # queries come first
                ids, flat = C.unpack(cell)
                matrix = flat.reshape(len(ids), width).astype(np.float64)
                if not kind:
                    asked.append((ids, matrix))
                    continue
                for qids, vectors in asked:
                    score = vectors @ matrix.T
                    floor = np.full(len(qids), -np.inf)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, qids), len(known) - 1)
                        floor[known[at] == qids] = least[at][known[at] == qids]
                    if score.shape[1] > k + 1:
                        new = np.isneginf(floor)
                        floor[new] = np.partition(score[new], -(k + 1), axis=1)[:, -(k + 1)]
                    q, v = np.nonzero(score >= floor[:, None])
                    held.append((qids[q], ids[v], score[q, v]))
                    size += len(q)
                    if size > limit:
                        held = [best(*(np.concatenate(p) for p in zip(*held, strict=True)))]
                        start, length = C.runs(held[0][0])
                        full = start[length == k + 1]
                        size, known, least = len(held[0][0]), held[0][0][full], held[0][2][full + k] - 1e-9
                        limit = 2 * size + 200_000
        if not held:
            return
        q, v, score = best(*(np.concatenate(p) for p in zip(*held, strict=True)))
        home = W.mix(q.view(np.uint64))
        order = np.argsort(home)
        rows = [(b, C.pack(q[o], v[o], score[o])) for b, i, j in C.ranges(home[order], buckets) for o in [order[i:j]]]
        if rows:
            yield C.batch(rows)

    def merged(bucket: int, packed: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        q, v, _ = best(*(np.concatenate(x) for x in zip(*map(C.unpack, packed), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v)], names=["qid", "vid"])

    met = index.union(queries.select("qid", "v").mapInArrow(searched, cells))
    met = met.repartitionById(buckets, F.col("slot") % buckets).sortWithinPartitions("slot", "kind")
    found = C.by_bucket(met.mapInArrow(ranked, C.CELL), buckets, merged, "qid long, vid long")
    product = F.aggregate(F.zip_with("qv", "v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, b: a + b)
    scored = found.join(groups, "vid").join(queries.withColumnRenamed("v", "qv"), "qid").select("qid", "ids", product.alias("score"))
    each = scored.select("qid", (-F.col("score")).alias("far"), F.explode("ids").alias("id")).groupBy("qid", "id").agg(F.min("far").alias("far"))
    lists = each.groupBy("qid").agg(F.slice(F.sort_array(F.collect_list(F.struct("far", "id"))), 1, k + 1).alias("near"))
    known = staged(lists.join(queries, "qid").select("v", "near"), "near")
    other = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    out = asked.join(known, "v").select(F.col("id").alias("query_id"), F.posexplode(other).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.far")).alias("score"))
