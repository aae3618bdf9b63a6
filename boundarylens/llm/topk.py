"""Exact inner-product top-k on a bit-sliced index.

Vectors are cut into blocks. A block's index holds, for every dimension and every bit of its quantised
value (less the block's smallest, so never negative), a bitmap over the block's rows. A query's scores
are summed as bitmaps too: for each set bit of a query component the dimension's slices enter one place
higher, and carry-save adders bring all slices of one place down to one. From the top place downward the
rows that can still be among the best k are intersected, and rows that tie at the boundary are resolved
by the smaller id. Every block gives its k best for every query; those are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boundarylens.llm.common import durable, python_ready

BLOCK_ROWS, BLOCK_QUERIES = 8192, 128
AT_ONCE = 4  # queries whose slices are added in one go
MOST_SIDE = 32  # query groups that a task holds, and blocks that pass by them
MOST_PARTS = 2048  # partitions of the search, or four for each core if that is more


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as double; null for vectors null or with null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def bit_slices(values: np.ndarray) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """Smallest value of each dimension, and the bitmaps of its bits, lowest first."""
    low = values.min(axis=0)
    above = values - low
    width = -(-len(values) // 64) * 64
    out = []
    for d in range(values.shape[1]):
        bits = []
        for b in range(int(above[:, d].max()).bit_length()):
            padded = np.zeros(width, np.uint8)
            padded[: len(values)] = (above[:, d] >> b) & 1
            bits.append(np.packbits(padded, bitorder="little").view(np.uint64))
        out.append(bits)
    return low, out


class Slices:
    """A block's bitmaps in one table, then their complements and a row of zeros, and for each place which bits of a query bring which of them there."""

    def __init__(self, low: np.ndarray, widths: np.ndarray, bitmaps: np.ndarray, full: np.ndarray):
        self.low, self.widths, self.full, self.count = low.tolist(), widths, full, len(bitmaps)
        self.rows = np.concatenate([bitmaps, bitmaps ^ full, np.zeros_like(full)[None]])
        self.starts = np.concatenate([[0], np.cumsum(widths)]).astype(np.int64)
        self.dimension = np.repeat(np.arange(len(widths)), widths)
        self.place = np.arange(self.count) - self.starts[self.dimension]

    def values(self, row: int) -> list[int]:
        """A row's quantised vector, read back from the bitmaps."""
        bits = (self.rows[: self.count, row // 64] >> np.uint64(row % 64) & np.uint64(1)).tolist()
        ends = self.starts.tolist()
        return [least + sum(b << i for i, b in enumerate(bits[x:y])) for least, x, y in zip(self.low, ends, ends[1:], strict=False)]


def score_slices(queries: np.ndarray, index: Slices) -> tuple[list[np.ndarray], list[int]]:
    """Bitmaps of score less offset, lowest place first, a row for each query, and the offsets. Components below zero use complements, so that all is added.

    Queries have unlike numbers of slices at a place; they are filled up with zeros to be added at once.
    """
    size, below = np.abs(queries).astype(np.uint64), queries < 0
    ends = [(1 << w) - 1 for w in index.widths.tolist()]
    offsets = [sum(q * least + (q * end if q < 0 else 0) for q, least, end in zip(query, index.low, ends, strict=True)) for query in queries.tolist()]
    places: dict[int, list[np.ndarray]] = {}
    at = np.arange(index.count) + index.count * below[:, index.dimension]
    for i in range(int(size.max(initial=0)).bit_length()):
        taken = np.where((size >> np.uint64(i) & np.uint64(1)).astype(bool)[:, index.dimension], at, 2 * index.count)
        for k in range(int(index.widths.max(initial=0))):
            here = taken[:, index.place == k]
            most = int((here < 2 * index.count).sum(axis=1).max(initial=0))
            if most:
                places.setdefault(i + k, []).append(np.sort(here, axis=1)[:, :most].T)  # zeros last
    out, place, carried = [], 0, {}
    while places and place <= max(places) or carried:
        stack = index.rows[np.concatenate(places[place])] if place in places else np.zeros((0, len(queries), len(index.full)), np.uint64)
        stack = np.concatenate([stack, *carried.pop(place, [])])
        while len(stack) > 1:
            thirds = len(stack) // 3
            if thirds:
                a, b, c = (stack[i * thirds : (i + 1) * thirds] for i in range(3))
                half = a ^ b
                total, carry = half ^ c, (a & b) | (c & half)
                stack = np.concatenate([total, stack[3 * thirds :]])
            else:
                total, carry = stack[:1] ^ stack[1:], stack[:1] & stack[1:]
                stack = total
            carried.setdefault(place + 1, []).append(carry)
        out.append(stack[0] if len(stack) else np.zeros((len(queries), len(index.full)), np.uint64))
        place += 1
    return out, offsets


def top_rows(slices: list[np.ndarray], among: np.ndarray, k: int) -> np.ndarray:
    """Rows with the k highest scores among those allowed, from the top slice down; ties at the boundary to the first rows."""
    sure, tied = np.zeros_like(among), among
    need = min(k, int(np.bitwise_count(among).sum()))
    for bits in reversed(slices):
        high = tied & bits
        n = int(np.bitwise_count(high).sum())
        if n <= need:
            sure, need, tied = sure | high, need - n, tied & ~bits
        else:
            tied = high
    rows = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
    return np.concatenate([rows(sure), rows(tied)[:need]])


def _index(vectors: DataFrame, blocks: int) -> DataFrame:
    """One row per block: ids in ascending order and quantised values, the source of its slices."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        size = max(map(len, group["q"]), default=0)
        values = np.zeros((len(group), size), np.int64)
        for i, v in enumerate(group["q"]):
            values[i, : len(v)] = v
        low, slices = bit_slices(values) if size else (np.empty(0, np.int64), [])
        packed = b"".join(b.tobytes() for bits in slices for b in bits)
        return pd.DataFrame({"block": [int(group["block"].iloc[0])], "ids": [group["id"].to_numpy(np.int64).tobytes()], "low": [low.tobytes()], "widths": [np.array([len(b) for b in slices], np.int64).tobytes()], "slices": [packed]})

    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("id", "q"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInPandas(build, "block int, ids binary, low binary, widths binary, slices binary")


def _meet(held: list[list], ids: np.ndarray, low: np.ndarray, widths: np.ndarray, packed: bytes, k: int) -> None:
    """The best of a block's rows join the best of each query."""
    words = -(-len(ids) // 64)
    full = np.packbits(np.arange(words * 64) < len(ids), bitorder="little").view(np.uint64)
    index = Slices(low, widths, np.frombuffer(packed, np.uint64).reshape(-1, words), full)
    for at in range(0, len(held), AT_ONCE):
        some = held[at : at + AT_ONCE]
        wanted = np.zeros((len(some), len(low)), np.int64)
        for query, (_, _, _, vector, _) in zip(wanted, some, strict=True):
            query[: len(vector)] = vector[: len(low)]
        scores, offsets = score_slices(wanted, index)
        for n, (one, offset) in enumerate(zip(some, offsets, strict=True)):
            among, vector = full.copy(), one[3].tolist()
            for r in range(np.searchsorted(ids, one[2]), np.searchsorted(ids, one[2], "right")):
                if index.values(r) == [*vector, *[0] * (len(low) - len(vector))]:  # the row itself, or a twin in its place
                    among[r // 64] &= ~(np.uint64(1) << np.uint64(r % 64))
                    break
            mine = [s[n] for s in scores]
            rows = top_rows(mine, among, k)
            bits = [(s[rows // 64] >> (rows % 64).astype(np.uint64) & np.uint64(1)).tolist() for s in mine]
            for j, r in enumerate(rows.tolist()):
                one[4].append((-offset - sum(b[j] << i for i, b in enumerate(bits)), int(ids[r])))
            one[4] = sorted(one[4])[:k]


def top_k(
    vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 50, k: int = 5, scale: int = 256,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every vector whose id is divisible by `every` its k best others.

    Vectors null or holding null or non-finite components, and rows with a null id, take no part; of
    vectors of unequal length the missing components count as 0, an empty one scores 0. Repeated rows are rows each: every one of them asks, and
    is a candidate of all others, so that a row's twin, or another vector under its id, can be among its best. An empty table
    gives an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    kept = durable(
        vectors.select(F.col(vec_id).cast("long").alias("id"), quantised(F.col(embedding), scale).alias("q")).where("id IS NOT NULL AND q IS NOT NULL"), "topk-vectors"
    )
    blocks = max(1, -(-kept.count() // BLOCK_ROWS))
    python_ready(spark, 10_000)
    index = durable(_index(kept, blocks), "topk-index")
    asked = kept.where(F.col("id") % every == 0).groupBy("id", "q").agg(F.count("*").alias("copies"))
    asked = durable(asked.withColumn("ask", F.monotonically_increasing_id()), "topk-asked")
    groups = max(1, -(-asked.count() // BLOCK_QUERIES))
    # A task meets a square of query groups and blocks: its queries come first and stay, blocks pass by one at a time. So either side is copied
    # once for each square along the other, and neither is joined: a join would take the copies to be as small as what they are made of, and broadcast them.
    side = min(MOST_SIDE, max(1, math.isqrt(blocks * groups // (8 * spark.sparkContext.defaultParallelism))))
    down, across = -(-blocks // side), -(-groups // side)
    copied = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of_query = F.floor(F.pmod(F.xxhash64("id", "q"), F.lit(groups)) / side)
    queries = asked.select("ask", "copies", "id", "q", of_query.alias("x"), copied(down).alias("y"), F.lit(-1).alias("block"))
    passing = index.select("block", "ids", "low", "widths", "slices", F.floor(F.col("block") / side).alias("y"), copied(across).alias("x"))
    both = queries.unionByName(passing, allowMissingColumns=True).withColumn("tile", F.col("y") * F.lit(across) + F.col("x")).drop("x", "y")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []  # of each query: ask, copies, id, vector, its best as (-score, id)

        def found() -> Iterator[pa.RecordBatch]:
            rows = [(ask, copies, query_id, vec_id, -less) for ask, copies, query_id, _, best in held for less, vec_id in best]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["ask", "copies", "query_id", "vec_id", "score"])

        for batch in batches:
            ask, copies, query_id, vector, block, ids, low, widths, packed, of = (batch.column(batch.schema.names.index(n)) for n in ("ask", "copies", "id", "q", "block", "ids", "low", "widths", "slices", "tile"))
            for row in range(batch.num_rows):
                if of[row].as_py() != tile:
                    yield from found()
                    tile, held = of[row].as_py(), []
                if block[row].as_py() < 0:
                    held.append([ask[row].as_py(), copies[row].as_py(), query_id[row].as_py(), vector[row].values.to_numpy().copy(), []])
                else:
                    _meet(held, *(np.frombuffer(x[row].as_py(), np.int64) for x in (ids, low, widths)), packed[row].as_py(), k)
        yield from found()

    # Squares are work of equal size, so they are dealt by number: by size they look small and would lie together.
    parts = min(down * across, max(MOST_PARTS, 4 * spark.sparkContext.defaultParallelism))
    dealt = both.repartitionById(parts, F.pmod(F.col("tile"), F.lit(parts)).cast("int")).sortWithinPartitions("tile", "block")
    matched = dealt.mapInArrow(search, "ask long, copies long, query_id long, vec_id long, score long")
    best = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    ranked = matched.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("query_id", "rank", "vec_id", "score")
