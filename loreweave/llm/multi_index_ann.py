"""Approximate nearest neighbours by inner product through an inverted multi-index.

The two halves of a vector are quantised separately; a pair of centroids is a cell. For a query, cells are
taken in order of the summed distance of its halves (the negative inner products with the centroids), with a
heap over centroid pairs, until they hold the wanted share of all vectors; the entries of these cells are then
ranked exactly on the original vectors.

The centroids are fitted, and the share that reaches the wanted recall is measured by brute force, on a bounded
sample (``IndexLimits``); every vector is indexed. There are as many centroids a half as the square root of the
vectors, within bounds, so that cells stay small as the table grows. Equal vectors are one entry with its smallest
ids, more than a query can return, so that a vector with any number of copies is searched once. Entries are grouped
by their first centroid, a large group in blocks. A query goes to the groups it wants; a task holds the entries of one
block, and the queries of that block stream past it. Entries within rounding of the last place all stay until they are
ranked exactly.

Defined results: vectors that are null, zero or hold a null or non-finite component, those of another length
than most, and rows without an id take no part; of rows that share an id the smallest vector counts; ties go to
the smaller id; with fewer candidates than wanted all are returned; an empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.llm import shared


@dataclass(frozen=True)
class IndexLimits:
    """Bounds of the fit and of one block, and the recall to reach on the sample."""

    sample_rows: int = 20000
    sample_queries: int = 200
    least_centroids: int = 16
    most_centroids: int = 192
    rounds: int = 8
    recall: float = 0.94
    block_rows: int = 32768

    def centroids(self, vectors: int) -> int:
        return max(self.least_centroids, min(self.most_centroids, round(vectors**0.5)))


@dataclass
class MultiIndex:
    """Centroids of both halves, and the share of the vectors that a query reads."""

    first: np.ndarray
    second: np.ndarray
    share: float

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        half = self.first.shape[1]
        return _nearest(vectors[:, :half], self.first) * len(self.second) + _nearest(vectors[:, half:], self.second)

    def wanted(self, vector: np.ndarray, counts: np.ndarray, target: float) -> list[int]:
        """Cells by summed distance until they hold ``target`` vectors; pairs are visited with a heap."""
        half, k = self.first.shape[1], len(self.second)
        a, b = -(self.first @ vector[:half]), -(self.second @ vector[half:])
        rows, columns = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b = a[rows].tolist(), b[columns].tolist()
        rows, columns = rows.tolist(), columns.tolist()
        heap, out, held = [(a[0] + b[0], 0, 0)], [], 0
        while heap and held < target:
            _, i, j = heapq.heappop(heap)
            cell = rows[i] * k + columns[j]
            if counts[cell]:
                out.append(cell)
                held += counts[cell]
            if j + 1 < k:
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(rows):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
        return out


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(axis=1) - 2 * points @ centroids.T, axis=1)


def _centroids(points: np.ndarray, wanted: int, limits: IndexLimits) -> np.ndarray:
    """k-means with a fixed seed."""
    distinct = np.unique(points, axis=0)
    k = min(wanted, len(distinct))
    c = distinct[np.random.default_rng(0).choice(len(distinct), k, replace=False)]
    for _ in range(limits.rounds):
        own = _nearest(points, c)
        sums = np.zeros_like(c)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=k)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _share(index: MultiIndex, sample: np.ndarray, k: int, limits: IndexLimits) -> float:
    """The smallest share of the vectors, in steps of 1 in 50, that reaches the recall on the sample."""
    cells = index.cells(sample)
    counts = np.bincount(cells, minlength=len(index.first) * len(index.second)).tolist()
    needed = []
    for q in range(0, len(sample), max(1, len(sample) // limits.sample_queries)):
        scores = sample @ sample[q]
        scores[q] = -np.inf
        best = np.argsort(-scores, kind="stable")[: min(k, len(sample) - 1)]
        order = index.wanted(sample[q], counts, np.inf)
        read = dict(zip(order, np.cumsum([counts[c] for c in order]), strict=True))
        needed.extend(read[c] / len(sample) for c in cells[best].tolist())
    return min(1.0, float(np.ceil(np.quantile(needed, limits.recall) * 50) / 50)) if needed else 1.0


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _valid(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``embedding`` (doubles): one row an id, of those that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    width = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("embedding") == (width["n"] if width else 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _product(a: str, b: str) -> Column:
    """The inner product in double precision, summed from the first component on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _best(points: np.ndarray, keys: np.ndarray, cells: dict[int, np.ndarray], asked: np.ndarray, wants: list[list[int]], keep: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
    """Per query (its row): the best entries among the cells it wants, their scores, and how far rounding may be off.

    Queries that want the same cell are multiplied with it together; a query's scores are put side by side afterwards.
    """
    by_cell: dict[int, list[int]] = {}
    for q, own in enumerate(wants):
        for cell in own:
            if cell in cells:
                by_cell.setdefault(cell, []).append(q)
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in wants]
    for cell, who in by_cell.items():
        scores = asked[who] @ points[cells[cell]].T
        for q, row in zip(who, scores, strict=True):
            found[q].append((keys[cells[cell]], row))
    reach = float(np.sqrt((points**2).sum(axis=1).max())) * points.shape[1] * 1e-14
    for q, parts in enumerate(found):
        if parts:
            names, values = np.concatenate([n for n, _ in parts]), np.concatenate([v for _, v in parts])
            slack = reach * float(np.linalg.norm(asked[q]))
            if len(values) > keep:
                at = np.flatnonzero(values >= np.partition(values, -keep)[-keep] - slack)
                names, values = names[at], values[at]
            yield q, names, values, slack


def _search(width: int, columns: int, keep: int):
    """Rows (first, block, kind, name, cell, seconds, embedding) in order: the entries of a block, then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, held = None, [], None
        for batch in shared.table_of(batches):
            first, block, kind, name, cell = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            cuts = np.flatnonzero((np.diff(first) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(first)], strict=True):
                if (first[a], block[a]) != group:
                    group, parts, held = (first[a], block[a]), [], None
                vectors = _matrix(batch.column(6).slice(a, b - a), width)
                if kind[a] == 0:
                    parts.append((vectors, name[a:b], cell[a:b] % columns))
                    continue
                if held is None and parts:
                    points, keys, second = (np.concatenate(x) for x in zip(*parts, strict=True))
                    order = np.argsort(second, kind="stable")
                    ends = np.flatnonzero(np.diff(second[order])) + 1
                    held, parts = (points, keys, {int(second[o[0]]): o for o in np.split(order, ends)}), []
                if held is not None:
                    rows = [(name[a + q], n, v, slack) for q, n, v, slack in _best(*held, vectors, batch.column(5).slice(a, b - a).to_pylist(), keep)]
                    if rows:
                        counts = [len(n) for _, n, _, _ in rows]
                        columns_ = [np.repeat([r[0] for r in rows], counts), np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows]), np.repeat([r[3] for r in rows], counts)]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns_], ["query", "entry", "near", "slack"])

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 20, limits: IndexLimits = IndexLimits()) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each vector where ``is_query`` holds, its k nearest others."""
    spark = vectors.sparkSession
    shared.small_batches(spark)
    rows = shared.written(_valid(vectors), "vectors")
    # the k + 1 smallest ids of equal vectors; the limit is taken before the shuffle as well
    order = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= k + 1)
    entries = few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = shared.written(entries.select(F.element_at("ids", 1).alias("entry"), "embedding", "ids"), "entries")  # an entry is named by its smallest id

    sample = entries.orderBy(F.xxhash64("entry"), "entry").limit(limits.sample_rows).select("embedding").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = len(sample.column(0)[0].as_py())
    points = _matrix(sample.column("embedding"), width)
    half = max(1, width // 2)
    n = limits.centroids(entries.count())
    index = MultiIndex(_centroids(points[:, :half], n, limits), _centroids(points[:, half:], n, limits) if width > half else np.zeros((1, 0)), 1.0)
    index.share = _share(index, points, k, limits)

    @F.arrow_udf("int")
    def cell(embedding: pa.Array) -> pa.Array:
        return pa.array(index.cells(_matrix(embedding, width)), pa.int32())

    placed = shared.written(entries.select("entry", "embedding", cell(F.col("embedding")).alias("cell")), "placed")
    counts = np.zeros(len(index.first) * len(index.second), dtype=np.int64)
    for r in placed.groupBy("cell").count().collect():  # one row a cell
        counts[r["cell"]] = r["count"]
    total, cells = int(counts.sum()), counts.tolist()
    columns = len(index.second)
    blocks = np.maximum(1, -(-counts.reshape(-1, columns).sum(axis=1) // limits.block_rows)).tolist()

    asked = rows.where(is_query).join(entries.select("entry", "embedding"), "embedding").select("vec_id", "entry")
    asked = shared.written(asked, "asked")
    distinct = asked.select("entry").distinct().join(entries.select("entry", "embedding"), "entry")

    @F.arrow_udf("array<struct<first: int, seconds: array<int>>>")
    def wanted(embedding: pa.Array) -> pa.Array:
        out = []
        for vector in _matrix(embedding, width):
            by_first: dict[int, list[int]] = {}
            for c in index.wanted(vector, cells, index.share * total):
                by_first.setdefault(c // columns, []).append(c % columns)
            out.append([{"first": a, "seconds": b} for a, b in by_first.items()])
        return pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("seconds", pa.list_(pa.int32()))])))

    block_count = F.element_at(F.array(*[F.lit(b) for b in blocks]), F.col("first") + 1)
    left = placed.withColumn("first", (F.col("cell") / columns).cast("int")).withColumn("block", F.pmod(F.xxhash64("entry"), block_count).cast("int"))
    left = left.select("first", "block", F.lit(0).alias("kind"), F.col("entry").alias("name"), "cell", F.lit(None).cast("array<int>").alias("seconds"), "embedding")
    right = distinct.select(F.col("entry").alias("query"), "embedding", F.explode(wanted(F.col("embedding"))).alias("want")).select("query", "embedding", "want.*")
    right = right.select("first", F.explode(F.sequence(F.lit(0), block_count - 1)).alias("block"), F.lit(1).alias("kind"), F.col("query").alias("name"), F.lit(0).alias("cell"), "seconds", "embedding")
    both = left.unionByName(right).repartition("first", "block").sortWithinPartitions("first", "block", "kind", "name")
    near = shared.written(both.mapInArrow(_search(width, columns, k + 1), "query long, entry long, near double, slack double"), "near")

    best = Window.partitionBy("query")
    near = near.withColumn("turn", F.row_number().over(best.orderBy(F.desc("near"), "entry")))
    near = near.withColumn("least", F.min(F.when(F.col("turn") <= k + 1, F.col("near"))).over(best) - F.max("slack").over(best))
    near = near.where("near >= least").select("query", "entry")
    vector = entries.select(F.col("entry").alias("query"), F.col("embedding").alias("query_vector"))
    scored = near.join(entries, "entry").join(vector, "query").select("query", "ids", _product("query_vector", "embedding").alias("score"))
    scored = scored.select("query", "score", F.explode("ids").alias("vec_id"))
    nearest = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    scored = scored.withColumn("turn", F.row_number().over(nearest)).where(F.col("turn") <= k + 1).drop("turn")
    pairs = asked.select(F.col("vec_id").alias("query_id"), F.col("entry").alias("query")).join(scored, "query").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
