"""Removal of byte strings that occur earlier, by distributed prefix doubling on sampled positions.

Prefix doubling gives every position the rank of the string that starts there, doubles the string's
length round by round and drops positions once they are unique. Three things make it fit a corpus:

* Ranks are only asked for equality, so a fingerprint serves as rank.
* A position is sampled if it has the smallest fingerprint of GRAM bytes in some window of LENGTH bytes
  (a minimizer). Equal windows sample the same position, so a repeated window has a repeated sample;
  most samples are unique after the first round and their windows drop out.
* The second round ranks, for every sample, the whole stretch of windows it stands for. Stretches equal
  to an earlier one are repeats as a whole. Only first stretches that share their sample with a
  different stretch go into the last round, which ranks their windows of LENGTH bytes one by one.

Repeats within a task are settled there, so that a string that a third of all documents hold reaches a
bucket once for each task. Texts are shuffled once, compressed, to meet what was
found about them, and then lie in buckets by row, so that the last round's finds join without
another shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boundarylens.llm.common import blobs, bucketed, map_batches, python_ready

GRAM = 32
CHUNK = 2**20
FLUSH = 500_000
#: Entries in a bucket, and bytes of text for a sampled position.
BUCKET_ROWS, BYTES_A_SAMPLE = 400_000, 34
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93)
_tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _table(which: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte, powers of an odd base and of its inverse, mod 2 ** 64."""
    grown = 1 << max(16, (size + 1).bit_length())
    if (which, grown) not in _tables:
        base = _BASES[which]
        inverse = pow(base, -1, 2**64)
        powers = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(grown - 1, b, np.uint64)]), dtype=np.uint64) for b in (base, inverse)]
        values = np.random.default_rng(12345 + which).integers(1, 2**64, 256, dtype=np.uint64)
        _tables[which, grown] = (values, *powers)
    return _tables[which, grown]


class Fingerprints:
    """Of any stretch of a text, from prefix sums."""

    def __init__(self, text: np.ndarray, which: int):
        values, powers, self.inverse = _table(which, len(text))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(values[text] * powers[: len(text)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.inverse[start]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        x = (self.sums[length:] - self.sums[:n]) * self.inverse[:n]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def stretches(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per sampled position: fingerprint of its GRAM bytes, of its whole stretch, first window, number of windows less one."""
    out = []
    for at in range(0, max(0, len(text) - length + 1), CHUNK):
        part = text[at : at + CHUNK + length - 1]
        prints = Fingerprints(part, 0)
        gram = prints.all(GRAM)
        best = (gram & ~np.uint64(2 * CHUNK - 1)) | np.arange(len(gram), dtype=np.uint64)
        width, have = length - GRAM + 1, 1
        while 2 * have <= width:
            best = np.minimum(best[:-have], best[have:])
            have *= 2
        if have < width:
            best = np.minimum(best[: len(best) - (width - have)], best[width - have :])
        sample = (best & np.uint64(2 * CHUNK - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(sample, prepend=-1))
        last = np.append(first[1:], len(sample)) - 1
        whole = prints.of(first, last + length) + (last - first).astype(np.uint64)
        out.append((gram[sample[first]], whole, first + at, last - first))
    if not out:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_ORDER = np.iinfo(np.int64).max


def _first_of(keys: tuple[np.ndarray, ...], doc: np.ndarray, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys, document, row and start; and which entries in that order are the first of their keys.

    Of entries with the same keys and place, as equal rows give, one is left: what is found holds for all of them.
    """

    def changes(columns: tuple[np.ndarray, ...]) -> np.ndarray:
        out = np.zeros(len(order), bool)
        out[:1] = True
        for c in columns:
            out[1:] |= c[order][1:] != c[order][:-1]
        return out

    order = np.lexsort((start, row, doc, *keys[::-1]))
    new = changes(keys)
    place = new | changes((doc, row, start))
    return order[place], new[place]


def _by_row(row: np.ndarray, start: np.ndarray, span: np.ndarray, code: np.ndarray) -> pd.DataFrame:
    order = np.lexsort((start, row))
    row, found = row[order], np.stack([start, span, code], 1).astype(np.int32)[order]
    cuts = np.flatnonzero(row[1:] != row[:-1]) + 1
    heads = row[np.concatenate([[0], cuts])] if len(row) else row
    return pd.DataFrame({"row": heads, "found": [x.tobytes() for x in np.split(found, cuts)] if len(row) else []})


_FOUND = "row long, found binary"
REPEAT, CONTESTED = 1, 2


def _dealt(df: DataFrame, entries: Callable, buckets: int) -> DataFrame:
    """Entries (a, b, doc, row, start, span) of the rows of df, dealt by a; what repeats (a, b) within a task is settled: such rows pass through with what was found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            a, b, doc, row, start, span = (np.concatenate(x) for x in zip(*held, strict=True))
            b = b.astype(np.uint32)
            press = zstandard.ZstdCompressor(level=1).compress
            held.clear()
            order, new = _first_of((a, b), doc, row, start)
            again, rows = order[~new], np.sort(order[new])
            out = []
            if len(again):
                for x in _by_row(row[again], start[again], span[again], np.full(len(again), REPEAT)).itertuples(index=False):
                    out.append((x.row % buckets, x.row, x.found, b"", b"", b"", b"", b""))
            to = ((a[rows] >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(to, kind="stable")
            rows, to = rows[by], to[by]
            for part in np.split(np.arange(len(to)), np.flatnonzero(np.diff(to)) + 1) if len(to) else ():
                r = rows[part]
                out.append((int(to[part[0]]), 0, a[r].tobytes(), b[r].tobytes(), press(doc[r].tobytes()), press(row[r].tobytes()), press(start[r].astype(np.int32).tobytes()), press(span[r].astype(np.uint16).tobytes())))
            kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 6)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["bucket", "row", "a", "b", "docs", "rows", "starts", "spans"])

        n = 0
        for batch in batches:
            for x in entries(batch):
                if len(x[0]):
                    held.append(x)
                    n += len(x[0])
                if n > FLUSH:
                    yield from flush()
                    n = 0
        if held:
            yield from flush()

    python_ready(df.sparkSession)
    return df.mapInArrow(run, "bucket int, row long, a binary, b binary, docs binary, rows binary, starts binary, spans binary")


def _ranked(dealt: DataFrame, contest: bool, buckets: int) -> DataFrame:
    """(row, found): what is found about each row, windows that repeat and first stretches whose sample others share. One row per row of the table.

    A bucket deals its finds by row over as many buckets again, in one blob for each; those are then put
    together row by row.
    """

    def rank(group: pd.DataFrame) -> pd.DataFrame:
        settled = group["docs"].map(len) == 0
        passed, group = group[settled], group[~settled]
        known = np.frombuffer(b"".join(passed["a"]), np.int32).reshape(-1, 3)
        of = np.repeat(passed["row"].to_numpy(np.int64), passed["a"].map(len).to_numpy(np.int64) // 12)
        a, b = np.frombuffer(b"".join(group["a"]), np.uint64), np.frombuffer(b"".join(group["b"]), np.uint32)
        doc, row, start, span = (
            np.frombuffer(b"".join(map(zstandard.decompress, group[c])), k) for c, k in (("docs", np.int64), ("rows", np.int64), ("starts", np.int32), ("spans", np.uint16))
        )
        order, new = _first_of((a, b), doc, row, start)
        code = np.where(new, 0, REPEAT)
        if contest and len(order):
            sample = np.cumsum(np.concatenate([[True], a[order][1:] != a[order][:-1]])) - 1
            different = np.bincount(sample, new)
            code[new & (different[sample] > 1)] = CONTESTED
        keep = code > 0
        rows = order[keep]
        row = np.concatenate([of, row[rows]])
        found = np.concatenate([known, np.stack([start[rows], span[rows], code[keep]], 1).astype(np.int32)])
        to = (row.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
        by = np.argsort(to, kind="stable")
        parts = np.split(by, np.flatnonzero(np.diff(to[by])) + 1) if len(by) else []
        press = zstandard.ZstdCompressor(level=1).compress
        return pd.DataFrame({"bucket": [int(to[p[0]]) for p in parts], "rows": [press(row[p].tobytes()) for p in parts], "found": [press(found[p].tobytes()) for p in parts]})

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        row = np.frombuffer(b"".join(map(zstandard.decompress, group["rows"])), np.int64)
        found = np.frombuffer(b"".join(map(zstandard.decompress, group["found"])), np.int32).reshape(-1, 3)
        return _by_row(row, *found.T)

    finds = dealt.groupBy("bucket").applyInPandas(rank, "bucket int, rows binary, found binary")
    return finds.groupBy("bucket").applyInPandas(gather, _FOUND)


def _result(text: bytes, covered: list[tuple[np.ndarray, np.ndarray]]) -> tuple[int, int, int, str]:
    """n_bytes, n_removed, n_spans and the digest of what is kept."""
    n = len(text)
    change = np.zeros(n + 1, np.int64)
    for start, end in covered:
        np.add.at(change, start, 1)
        np.subtract.at(change, end, 1)
    gone = np.cumsum(change[:n]) > 0
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return n, int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()


def _intervals(found: bytes | None, code: int, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    if not found:
        return []
    x = np.frombuffer(found, np.int32).reshape(-1, 3).astype(np.int64)
    x = x[x[:, 2] == code]
    return [(x[:, 0], x[:, 0] + x[:, 1] + length)]


def remove_repeats(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per row of docs.

    A byte goes if a string of `length` bytes that covers it also starts earlier, in a document of
    smaller id or in the same one. Strings are judged on the input and never cross rows. A null
    text is empty; texts shorter than `length` stay whole. Rows that share an id but not the text come
    one after the other, by a hash of the text; rows equal in both are the same document, so that
    neither repeats the other. Rows of null id come last, each a document of its own, also by hash: of
    those with the same text one counts as the earlier. An empty table gives an empty result. Other
    columns are not read.
    """
    given = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_ORDER)).alias("doc"),
        F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string")).alias("row"), F.col(text).cast("string").alias("text"),
    )
    n_bytes = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, n_bytes // BYTES_A_SAMPLE // BUCKET_ROWS)

    def sampled(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        for doc, row, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), blobs(batch.column(2)), strict=True):
            gram, whole, start, span = stretches(np.frombuffer(t, np.uint8), length)
            yield gram, whole, np.full(len(gram), doc, np.int64), np.full(len(gram), row, np.int64), start, span

    found = _ranked(_dealt(given.select("doc", "row", "text"), sampled, buckets), True, buckets)

    def settle(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t, found in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            body = zstandard.decompress(t)
            open_ = _intervals(found, CONTESTED, 0)
            if open_ and len(open_[0][0]):
                rows.append((len(body), None, None, None, t, found, int((open_[0][1] - open_[0][0] + 1).sum())))
            else:
                rows.append((*_result(body, _intervals(found, REPEAT, length)), None, None, 0))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=["doc_id", "doc", "row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "found", "n_open"])

    def squeeze(batch: pa.RecordBatch) -> pa.RecordBatch:
        press = zstandard.ZstdCompressor(level=3)
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([press.compress(t) for t in blobs(batch.column(3))], pa.binary())], names=["doc_id", "doc", "row", "text"])

    pressed = map_batches(given, squeeze, "doc_id long, doc long, row long, text binary")
    joined = pressed.join(found.hint("shuffle_hash"), "row", "left").select("doc_id", "doc", "row", "text", "found")
    settled = bucketed(map_batches(joined, settle, "doc_id long, doc long, row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text binary, found binary, n_open long"), "row", "repeats_settled")
    open_docs = settled.where("text IS NOT NULL")
    n_open = settled.agg(F.sum("n_open")).first()[0] or 0

    def windows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        for doc, row, t, found in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            body = np.frombuffer(zstandard.decompress(t), np.uint8)
            x = np.frombuffer(found, np.int32).reshape(-1, 3).astype(np.int64)
            x = x[x[:, 2] == CONTESTED]
            start = np.unique(np.repeat(x[:, 0], x[:, 1] + 1) + np.arange((x[:, 1] + 1).sum()) - np.repeat(np.cumsum(x[:, 1] + 1) - x[:, 1] - 1, x[:, 1] + 1))
            yield *(_windows(body, start, which, length) for which in (0, 1)), np.full(len(start), doc, np.int64), np.full(len(start), row, np.int64), start, np.zeros(len(start), np.int64)

    last = max(8, n_open // BUCKET_ROWS)
    again = _ranked(_dealt(open_docs.select("doc", "row", "text", "found"), windows, last), False, last).withColumnRenamed("found", "again")

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t, found, more in zip(*(batch.column(i).to_pylist() for i in range(2, 5)), strict=True):
            rows.append(_result(zstandard.decompress(t), _intervals(found, REPEAT, length) + _intervals(more, REPEAT, length)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=["doc_id", "row", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = "doc_id long, row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    late = map_batches(open_docs.join(again.hint("shuffle_hash"), "row", "left").select("doc_id", "row", "text", "found", "again"), finish, out)
    done = settled.where("text IS NULL").select("doc_id", "row", "n_bytes", "n_removed", "n_spans", "kept_sha256").unionByName(late)
    # Of rows of null id with the same text all but one go whole.
    copy = F.row_number().over(Window.partitionBy("row").orderBy("doc_id")) > 1
    gone = F.col("doc_id").isNull() & (F.col("n_bytes") >= length) & F.col("copy")
    whole = {"n_removed": F.col("n_bytes"), "n_spans": F.lit(1).cast("long"), "kept_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return done.withColumn("copy", copy).select("doc_id", "n_bytes", *[F.when(gone, v).otherwise(F.col(c)).alias(c) for c, v in whole.items()])


def _windows(body: np.ndarray, start: np.ndarray, which: int, length: int) -> np.ndarray:
    """Fingerprints of the windows at the given places, in chunks so that tables stay small."""
    out = np.empty(len(start), np.uint64)
    for at in range(0, len(body), CHUNK):
        here = (start >= at) & (start < at + CHUNK)
        if here.any():
            s = start[here] - at
            out[here] = Fingerprints(body[at : at + CHUNK + length], which).of(s, s + length)
    return out
