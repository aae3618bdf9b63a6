"""Best-fit packing by patterns.

Documents become token ids once; only the histogram of piece lengths (at most as many rows as a
sequence has tokens) comes to the driver. There, patterns of few pieces that fill a sequence are
enumerated on a coarse grid of lengths, their repeat counts are fitted to the histogram by
non-negative least squares and rounded down, and what is left is placed by best fit, longest first,
also into the gaps of the patterns. The plan says which ranks of each length go where; pieces get
their rank by distributed counts, so a length that a third of all rows share is dealt to many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boundarylens.llm.common import blobs, durable, map_batches, python_ready

RANK_ROWS = 8000
CACHED_WORDS, CACHED_LENGTH = 300_000, 24

_words: dict[tuple[str, int], tuple[dict[bytes, bytes], dict[bytes, bytes]]] = {}
_tokenizers: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def _word_ids(path: str, texts: list[bytes]) -> Iterator[bytes]:
    """Token ids (little-endian, 4 bytes each) of every text.

    For tokenizers that drop white space and look no further than a word: a text's ids are those of
    its words one after the other, so that a word is encoded once and looked up from then on. When
    the cache is full, the words that are met again move on to a new one and the rest go with the one
    after it.
    """
    known, older = _words.get((path, 4), ({}, {}))
    if len(known) > CACHED_WORDS:
        known, older = {}, known
    _words[path, 4] = known, older
    split = [t.split() for t in texts]
    new = set(chain.from_iterable(split)) - known.keys()
    again = new & older.keys()
    known.update((w, older[w]) for w in again)
    new = list(new - again)
    here = known
    if new:
        ids = [pack_ids(f"<{len(e.ids)}I", *e.ids) for e in _tokenizer(path).encode_batch_fast([w.decode() for w in new], add_special_tokens=False)]
        here = {w: i for w, i in zip(new, ids, strict=True) if len(w) > CACHED_LENGTH}
        known.update((w, i) for w, i in zip(new, ids, strict=True) if len(w) <= CACHED_LENGTH)
    for words in split:
        try:
            yield b"".join(map(known.__getitem__, words))
        except KeyError:
            yield b"".join([known[w] if w in known else here[w] for w in words])


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int, separator: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every document's ids with a closing separator, cut at the capacity; the last piece may be shorter."""

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        end = np.array([separator], "<u4").tobytes()
        for key, ids in zip(batch.column(0).to_pylist(), _word_ids(tokenizer, blobs(batch.column(1))), strict=True):
            ids += end
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                rows.append((key, k, at // 4, len(part) // 4, zlib.crc32(part)))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")), pieces, PIECES)


def patterns(units: int, depth: int = 3) -> list[tuple[int, ...]]:
    """All ways to fill a sequence of so many units with at most `depth` pieces, longest first."""
    out: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], rest: int) -> None:
        if rest == 0:
            out.append(head)
        elif len(head) < depth:
            for u in range(min(rest, head[-1] if head else rest), 0, -1):
                if u * (depth - len(head)) >= rest:
                    extend((*head, u), rest - u)

    extend((), units)
    return out


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int) -> np.ndarray:
    """min |ax - b| with x >= 0, by active sets."""
    gram, proj = a.T @ a, a.T @ b
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    scale = 1e-9 * max(1.0, np.abs(proj).max(initial=0))
    for _ in range(rounds):
        slope = proj - gram @ x
        slope[free] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= scale:
            break
        free[best] = True
        while True:
            held = np.flatnonzero(free)
            z = np.linalg.lstsq(gram[np.ix_(held, held)], proj[held], rcond=1e-10)[0]
            if (z > 1e-9).all():
                x[:] = 0
                x[held] = z
                break
            down = z <= 1e-9
            step = np.min(x[held][down] / np.maximum(x[held][down] - z[down], 1e-12))
            x[held] += step * (z - x[held])
            x[held[down & (x[held] <= 1e-9)]] = 0
            gone = held[x[held] <= 1e-9]
            if not len(gone):
                gone = held[down]
            free[gone] = False
            x[gone] = 0
    return x


def plan(histogram: dict[int, int], capacity: int, grain: int = 16, depth: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """Sequences to make: (lengths of their pieces, how many such sequences)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    made: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        made.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    units = -(-capacity // grain)
    of = -(-np.arange(capacity + 1) // grain)
    shapes = [p for p in patterns(units, depth) if len(p) > 1]
    wanted = np.bincount(of, left, units + 1)
    shapes = [p for p in shapes if all(wanted[u] for u in p)]
    if shapes:
        fit = np.zeros((units + 1, len(shapes)))
        for k, p in enumerate(shapes):
            np.add.at(fit[:, k], list(p), 1)
        repeats = np.floor(non_negative_least_squares(fit, wanted, 3 * units) + 1e-6).astype(np.int64)
        for k in np.argsort(-repeats, kind="stable"):
            if repeats[k]:
                made += _filled(shapes[k], int(repeats[k]), left, grain)
    return _best_fit(made, left, capacity)


def _filled(shape: tuple[int, ...], times: int, left: np.ndarray, grain: int) -> list[tuple[tuple[int, ...], int]]:
    """Pieces of exact lengths for a pattern, as runs of equal sequences; taken from `left`.

    Lengths are rounded up to the grid, so a pattern leaves room; its last piece is the longest that
    fits it, if that is no shorter than the pattern asks for.
    """
    out = []
    while times:
        took: list[int] = []
        for k, u in enumerate(shape):
            top = min(u * grain, len(left) - 1) if k < len(shape) - 1 else len(left) - 1 - sum(took)
            found = next((n for n in range(top, (u - 1) * grain, -1) if left[n] > took.count(n)), None)
            if found is None:
                return out
            took.append(found)
        n = min(times, *(int(left[x]) // took.count(x) for x in took))
        for x in took:
            left[x] -= n
        out.append((tuple(took), n))
        times -= n
    return out


def _best_fit(made: list[tuple[tuple[int, ...], int]], left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Place what is left, longest first, each where the least room remains; open a sequence if there is none."""
    open_: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    for held, n in made:
        open_[capacity - sum(held)].append((held, n))
    for length in range(capacity, 0, -1):
        todo = int(left[length])
        room = length
        while todo:
            while room <= capacity and not open_[room]:
                room += 1
            if room > capacity:
                each = capacity // length
                full, rest = divmod(todo, each)
                for k, n in ((each, full), (rest, 1)):
                    if k and n:
                        open_[capacity - k * length].append(((length,) * k, n))
                break
            held, n = open_[room].pop()
            k = min(n, todo)
            if n > k:
                open_[room].append((held, n - k))
            open_[room - length].append(((*held, length), k))
            todo -= k
            room = length
    return [x for group in open_ for x in group]


def slots(made: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset), sorted by length and rank."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for held, n in made:
        offset = 0
        for length in held:
            rows.append((length, rank.get(length, 0), sequence, offset))
            rank[length] = rank.get(length, 0) + n
            offset += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(
    docs: DataFrame, *, tokenizer: str, capacity: int = 2048, separator: int = 0,
    text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """Where every piece of every document goes.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is
    the separator alone. Repeated rows are packed each on its own, null ids stay null; an empty table
    gives an empty result. Only documents longer than the capacity are cut. Other columns are not read.
    The tokenizer must drop white space and treat words apart from each other.
    """
    pieces = durable(tokenized_pieces(docs, tokenizer, capacity, separator, text, doc_id), "pack-pieces")
    counts = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    table = slots(plan({r["length"]: r["count"] for r in counts}, capacity))
    buckets = max(1, sum(r["count"] for r in counts) // RANK_ROWS)
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("length", "bucket").count().select(
        F.col("length"), F.col("bucket"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead")
    )
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        keyed.withColumn("rank", F.row_number().over(own) - 1)
        .join(starts, ["length", "bucket"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("ahead") + F.col("rank")).alias("rank"))
    )
    lookup = table[:, 0] * 2**40 + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy().astype(np.int64), batch.column(5).to_numpy()
            row = table[np.searchsorted(lookup, length * 2**40 + rank, "right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(length), batch.column(4), pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    python_ready(docs.sparkSession)
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
