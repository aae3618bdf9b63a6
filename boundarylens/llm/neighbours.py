"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in halves, and each half is quantised by a codebook of its own; a cell is a pair of
centroids. A query walks the pairs in ascending order of its summed squared distances to both centroids, with a
heap, until the cells it has met hold enough entries. How many are enough is measured, not set: for a bounded
sample of queries the true neighbours are found by one pass over all vectors, and the walk must reach the cells of
a given share of them. All entries of the cells met are then ranked by their exact distance.

Equal vectors are one entry with its smallest ids, which is all that a result can hold of them, and equal queries are
searched once. Cells lie in shards of bounded size, each one row; cells of more entries are cut into several shards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boundarylens.llm.common import durable, python_ready

#: Vectors the codebooks are fitted on, centroids of a codebook, queries that measure the walk: at most so many.
FIT_ROWS, MOST_CENTROIDS, MEASURE_QUERIES = 16_384, 1024, 128
SHARD_ROWS, GROUP_QUERIES, LANE_GROUPS = 2048, 64, 64
_FOUND = "query long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """The vector in double precision; null if it is null, zero or holds null or non-finite components."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    zero = ~F.exists(doubles, lambda x: x != 0)
    return F.when(vector.isNotNull() & ~F.coalesce(bad | zero, F.lit(True)), doubles)


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Vectors as rows; missing components are 0."""
    column = pa.chunked_array(column).combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(int)
    out = np.zeros((len(column), size))
    out[np.arange(size) < lengths[:, None]] = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return out


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, summed component by component as a plain loop does."""
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        step = a[:, d, None] - b[None, :, d]
        out += step * step
    return out


def closest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroid of each row, by the expanded square, which is quick; its last digits may differ between calls."""
    return ((centroids**2).sum(1) - 2 * rows @ centroids.T).argmin(1)


def codebook(rows: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """Centroids by Lloyd's rounds, from evenly spaced rows of the sample; a centroid without rows stays where it was."""
    out = rows[np.linspace(0, len(rows) - 1, size).astype(int)]
    for _ in range(rounds):
        nearest = closest(rows, out)
        held = np.bincount(nearest, minlength=size)
        sums = np.stack([np.bincount(nearest, rows[:, d], size) for d in range(rows.shape[1])], 1) if rows.shape[1] else np.zeros((size, 0))
        out = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], out)
    return out


def walk(first: np.ndarray, second: np.ndarray, held: np.ndarray, enough: int) -> tuple[list[int], float]:
    """Cells with entries in ascending order of first[i] + second[j] until they hold enough entries, and all others of the last sum."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    cells, got, last = [], 0, np.inf
    reach = [0] * len(x)  # pairs of a row come in turn, so a row's next pair enters the heap when the one before leaves it
    heap = [(x[0] + y[0], 0, 0)] if x and y else []
    while heap:
        total, i, j = heapq.heappop(heap)
        if got >= enough and total > last:
            return cells, last
        if j + 1 < len(y):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if not reach[i]:
            reach[i] = 1
            if i + 1 < len(x):
                heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
        cell = int(a[i]) * len(y) + int(b[j])
        if held[cell]:
            cells.append(cell)
            got += int(held[cell])
            last = total if got >= enough else np.inf
    return cells, np.inf


def nearest_in(queries: np.ndarray, vectors: np.ndarray, lists: list[np.ndarray], allowed: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """(place of the query, id, distance) of each query's k nearest ids among the allowed vectors, ties to smaller ids."""
    scores = np.where(allowed, np.sqrt(squared(queries, vectors)), np.inf)
    for q, row in enumerate(scores):
        some = np.flatnonzero(allowed[q])
        if len(some) > k:
            some = some[row[some] <= np.partition(row[some], k - 1)[k - 1]]
        pairs = sorted((float(row[v]), int(i)) for v in some for i in lists[v][:k])
        for score, i in pairs[:k]:
            yield q, i, score


def nearest_neighbours(
    vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 100, k: int = 10, recall: float = 0.95,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every vector whose id is divisible by `every` its k nearest found, by Euclidean distance.

    Vectors null, zero or holding null or non-finite components, and rows of null id, take no part; of vectors of unequal length the missing
    components count as 0. Ties go to the smaller id. A row is a candidate of every query but itself, and repeated rows are rows
    each, as queries and as candidates. Fewer candidates than k give all of them. An empty table gives an
    empty result. `recall` is the share of true neighbours that the walk must reach, on average over at most MEASURE_QUERIES queries.
    The codebooks are fitted on at most FIT_ROWS different vectors, those of smallest hash; every vector is indexed. Other columns are not read.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    kept = vectors.select(F.col(vec_id).cast("long").alias("id"), usable(F.col(embedding)).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    kept = durable(kept, "neighbours-vectors")
    asked = kept.where(F.col("id") % every == 0)
    smallest = kept.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("place") <= k + 1)
    entries = durable(smallest.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "neighbours-entries")
    n, size = entries.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], schema)
    half = size // 2
    hashed = lambda column: F.xxhash64(F.lit(7), column)
    sample = matrix(entries.select("v").orderBy(hashed("v"), "v").limit(FIT_ROWS).toArrow().column(0), size)
    width = max(1, min(MOST_CENTROIDS, int(n**0.5 / 2), len(sample)))
    books = spark.sparkContext.broadcast((codebook(sample[:, :half], width), codebook(sample[:, half:], width)))
    python_ready(spark)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = books.value
        for batch in batches:
            rows = matrix(batch.column(0), size)
            cell = closest(rows[:, :half], first) * width + closest(rows[:, half:], second)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *batch.columns], names=["cell", "v", "ids"])

    entries = durable(entries.mapInArrow(assign, "cell int, v array<double>, ids array<long>"), "neighbours-cells")
    # At most width * width rows, a million at the most.
    counts = entries.groupBy("cell").count().toPandas()
    held = np.zeros(width * width, np.int64)
    held[counts["cell"].to_numpy(np.int64)] = counts["count"].to_numpy(np.int64)
    # Cells in order share shards until one is full; a cell of more entries has as many shards as it needs.
    pieces = np.maximum(1, -(-held // SHARD_ROWS))
    shard, filled, shard_of = 0, 0, np.zeros(width * width, np.int32)
    for cell in np.flatnonzero(held):
        if filled and filled + held[cell] > SHARD_ROWS:
            shard, filled = shard + 1, 0
        shard_of[cell] = shard
        filled += held[cell]
        if pieces[cell] > 1:
            shard, filled = shard + int(pieces[cell]), 0
    layout = spark.sparkContext.broadcast((held, shard_of, pieces))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, shard_of, pieces = layout.value
        for batch in batches:
            cell, spread = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array((shard_of[cell] + spread % pieces[cell]).astype(np.int32)), *batch.columns[:3]], names=["shard", "cell", "v", "ids"])

    def pack(group: pa.Table) -> pa.Table:
        ids = group.column("ids").combine_chunks()
        return pa.table({
            "shard": group.column("shard")[:1], "cells": [group.column("cell").to_numpy().tobytes()], "vectors": [matrix(group.column("v"), size).tobytes()],
            "sizes": [pc.list_value_length(ids).to_numpy().tobytes()], "ids": [pc.list_flatten(ids).to_numpy().tobytes()],
        })

    spread = entries.withColumn("spread", F.pmod(F.xxhash64("v"), F.lit(2**31))).mapInArrow(place, "shard int, cell int, v array<double>, ids array<long>")
    shards = durable(spread.groupBy("shard").applyInArrow(pack, "shard int, cells binary, vectors binary, sizes binary, ids binary"), "neighbours-shards")

    def opened(row: dict) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        cells = np.frombuffer(row["cells"], np.int32)
        ends = np.cumsum(np.frombuffer(row["sizes"], np.int32))
        return cells, np.frombuffer(row["vectors"]).reshape(len(cells), size), np.split(np.frombuffer(row["ids"], np.int64), ends[:-1])

    # Measure the walk: true neighbours of a bounded set of query vectors, and how many entries stand in cells up to theirs.
    questions = asked.select("v").distinct()
    measured = matrix(questions.orderBy(hashed("v"), "v").limit(MEASURE_QUERIES).toArrow().column(0), size)
    if not len(measured):
        return spark.createDataFrame([], schema)
    tests = spark.sparkContext.broadcast(measured)

    def true_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cells, rows, _ = opened(row)
                yield _arrays(nearest_in(tests.value, rows, [cells[i : i + 1] for i in range(len(cells))], np.ones((len(tests.value), len(cells)), bool), k + 1))

    by_query = Window.partitionBy("query").orderBy("score", "vec_id")
    true = shards.mapInArrow(true_cells, _FOUND).withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k + 1).where("score > 0").toPandas()
    need: list[int] = []
    for q, cells in true.groupby("query")["vec_id"]:
        sums = (squared(measured[q : q + 1, :half], books.value[0]).T + squared(measured[q : q + 1, half:], books.value[1])).ravel()
        order = np.argsort(sums, kind="stable")
        need += np.cumsum(held[order])[np.searchsorted(sums[order], sums[cells], "right") - 1].tolist()
    enough = max(k + 1, int(np.ceil(np.quantile(need, recall, method="higher")))) if need else n

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = books.value
        held, shard_of, pieces = layout.value
        for batch in batches:
            rows = matrix(batch.column(1), size)
            a, b = squared(rows[:, :half], first), squared(rows[:, half:], second)
            reach, to = [], []
            for i in range(len(rows)):
                cells, last = walk(a[i], b[i], held, enough)
                reach.append(last)
                to.append(sorted({int(shard_of[c]) + p for c in cells for p in range(pieces[c])}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(reach, pa.float64()), pa.array(to, pa.list_(pa.int32()))], names=["query", "v", "reach", "shards"])

    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbered = durable(questions.select(F.monotonically_increasing_id().alias("query"), "v"), "neighbours-questions")
    walked = durable(numbered.repartition(parts, "query").mapInArrow(ask, "query long, v array<double>, reach double, shards array<int>"), "neighbours-walks")
    # Groups of queries go past a shard in its task; beyond LANE_GROUPS groups it stands in several lanes, each a task's work.
    groups = max(1, -(-numbered.count() // GROUP_QUERIES))
    lanes = -(-groups // LANE_GROUPS)
    sent = walked.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int")).select("query", "v", "reach", "part", F.explode("shards").alias("shard"))
    sent = sent.groupBy("shard", "part").agg(F.collect_list(F.struct("query", "v", "reach")).alias("queries")).withColumn("lane", F.col("part") % F.lit(lanes))
    held_ready = shards.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).repartition(parts, "shard", "lane")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = books.value
        for batch in batches:
            for row in batch.to_pylist():
                cells, rows, lists = opened(row)
                queries = matrix(pa.array([x["v"] for x in row["queries"]], pa.list_(pa.float64())), size)
                numbers = [x["query"] for x in row["queries"]]
                sums = squared(queries[:, :half], first)[:, cells // width] + squared(queries[:, half:], second)[:, cells % width]
                allowed = sums <= np.array([x["reach"] for x in row["queries"]])[:, None]
                yield _arrays((numbers[q], i, s) for q, i, s in nearest_in(queries, rows, lists, allowed, k + 1))

    work = sent.repartition(parts, "shard", "lane").join(held_ready.hint("shuffle_hash"), ["shard", "lane"])
    found = work.select("queries", "cells", "vectors", "sizes", "ids").mapInArrow(search, _FOUND)
    best = found.withColumn("place", F.row_number().over(by_query)).where(F.col("place") <= k + 1)
    lists = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    answers = numbered.join(lists, "query").select("v", "near")
    own = F.array_position(F.transform("near", lambda x: (x["vec_id"] == F.col("query_id")) & (x["score"] == 0)), True)  # the row itself, one of its twins if there are some
    others = F.filter("near", lambda x, i: i + 1 != own)
    ranked = asked.select(F.col("id").alias("query_id"), "v").join(answers, "v").select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _arrays(rows: Iterator[tuple[int, int, float]]) -> pa.RecordBatch:
    query, ids, score = zip(*rows, strict=True) if (rows := list(rows)) else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64())], names=["query", "vec_id", "score"])
