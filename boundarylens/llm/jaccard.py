"""N-gram Jaccard join over word shingles with a token-group matrix; exact.

Documents with equal shingle sets form a class and one of them stands for it. Two sets of Jaccard
similarity t share a token among the first n - ceil(tn) + 1 of either, in any common order of tokens;
the order here puts tokens that many documents hold last (found from a hash sample of documents: any
order gives the same result, a good one gives few candidates), the rest by hash.

Documents that share a token of few holders are compared at once. For tokens with more (known to be frequent
from the sample, or found to have over MOST_PAIRED holders where they meet), similar documents are first
gathered in groups: all holders of a token are compared with the one that has the fewest other tokens,
and what is linked becomes a group. The matrix then has for every token and group the most tokens that
any member can still share and the range of member sizes. A document is bound against each group of its
tokens, and only groups that may hold a partner are opened. So a group of copies costs as many
comparisons as it has members, not their square. Tokens with so many holders that one would weigh on a task
are dealt over several; there can only be few of them, so they are known everywhere by a broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundarylens.llm.common import WORD, blobs, durable, map_batches, python_ready, small_side, word_hashes

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SAMPLE, FREQUENT, MOST_FREQUENT = 8, 3, 2**17
BUCKET_TOKENS, FLUSH, GROUPS = 600_000, 400_000, 256
MOST_PAIRED = 64
#: A token is heavy from this many holders on, and from this share of all holdings; so there are at most HEAVY_SHARE of them.
HEAVY, HEAVY_SHARE = 1000, 100_000
#: Rows without an id stand under numbers from here on.
NAMELESS = 2**62


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; the whole sequence is one if it is shorter."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    width = min(width, len(h))
    out = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        out = ((out ^ (out >> np.uint64(29))) * _P) + h[k : len(h) - width + 1 + k] * _Q
    out ^= out >> np.uint64(31)
    out *= _P
    return np.unique(out ^ (out >> np.uint64(32)))


def _marked(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(tokens), bool)
    return frequent[np.searchsorted(frequent, tokens).clip(max=len(frequent) - 1)] == tokens


def _dealt(arrays: list[np.ndarray], buckets: int, whole: bool) -> Iterator[tuple]:
    """Rows (bucket, bytes of each array) with the tokens of arrays[0] dealt by value."""
    to = (arrays[0] >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(to, kind="stable")
    to = to[order]
    cuts = np.flatnonzero(np.diff(to)) + 1
    press = zstandard.ZstdCompressor(level=1)
    for part in np.split(np.arange(len(to)), cuts) if len(to) else ():
        rows = order[part]
        # In a bucket half a token tells as much as is needed to find candidates, or nearly.
        yield (int(to[part[0]]), arrays[0][rows].tobytes() if whole else arrays[0][rows].astype(np.uint32).tobytes(), *[press.compress(a[rows].tobytes()) for a in arrays[1:]])


def _unpressed(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(map(zstandard.decompress, column)), kind)


def frequent_tokens(docs: DataFrame, width: int) -> np.ndarray:
    """Tokens that many documents hold, counted on a hash sample of documents; at most MOST_FREQUENT, the most frequent."""
    spark = docs.sparkSession
    buckets = 2 * max(8, docs.rdd.getNumPartitions())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            rows = list(_dealt([tokens, n.astype(np.int32)], buckets, True))
            if rows:
                b, t, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(t, pa.binary()), pa.array(c, pa.binary())], names=["bucket", "tokens", "counts"])

        for batch in batches:
            held += [shingle_set(t, width) for t in blobs(batch.column(0))]
            if sum(map(len, held)) > FLUSH:
                yield from flush()
        if held:
            yield from flush()

    def total(group: pd.DataFrame) -> pd.DataFrame:
        tokens = np.frombuffer(b"".join(group["tokens"]), np.uint64)
        counts = _unpressed(group["counts"], np.int32)
        order = np.argsort(tokens, kind="stable")
        tokens, starts = np.unique(tokens[order], return_index=True)
        n = np.add.reduceat(counts[order].astype(np.int64), starts) if len(starts) else np.empty(0, np.int64)
        return pd.DataFrame({"token": tokens[n >= FREQUENT].view(np.int64), "n": n[n >= FREQUENT]})

    python_ready(spark)
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    counted = sample.mapInArrow(count, "bucket int, tokens binary, counts binary").groupBy("bucket").applyInPandas(total, "token long, n long")
    rows = counted.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).collect()
    return np.sort(np.array([r["token"] for r in rows], np.int64).view(np.uint64))


def signatures(docs: DataFrame, frequent: np.ndarray, width: int, num: int, den: int) -> DataFrame:
    """doc_id, n, a digest of the set, and the tokens of its prefix: seldom ones as bytes, frequent ones as an array."""
    spread = docs.sparkSession.sparkContext.broadcast(frequent)

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        ns, d1, d2, cold, hot = [], [], [], [], []
        for t in blobs(batch.column(1)):
            s = shingle_set(t, width)
            n = len(s)
            ns.append(n)
            with np.errstate(over="ignore"):
                d1.append(int((s * _Q).sum(dtype=np.uint64).view(np.int64)))
                d2.append(int(((s ^ (s >> np.uint64(17))) * _P).sum(dtype=np.uint64).view(np.int64)))
            size = n + (-num * n // den) + 1 if n else 0
            often = _marked(s, spread.value)
            seldom = s[~often][:size]
            cold.append(seldom.tobytes())
            hot.append(s[often][: size - len(seldom)].view(np.int64))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in hot])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(hot)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(cold, pa.binary()), lists], names=["doc_id", "n", "d1", "d2", "cold", "hot"])

    return map_batches(docs, sign, "doc_id long, n int, d1 long, d2 long, cold binary, hot array<long>")


def _seldom_pairs(nodes: DataFrame, buckets: int, num: int, den: int) -> DataFrame:
    """Pairs x < y that share a prefix token of few holders and may reach the threshold by their sizes and the token's places.

    Tokens of more holders give rows (x = y, token, n, rest) instead, one per holder.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(_dealt([np.concatenate(x) for x in zip(*held, strict=True)], buckets, False))
            held.clear()
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=["bucket", "tokens", "docs", "ns", "places"])

        n = 0
        for batch in batches:
            for doc, size, cold in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                t = np.frombuffer(cold, np.uint64)
                held.append((t, np.full(len(t), doc, np.int64), np.full(len(t), size, np.int32), np.arange(len(t), dtype=np.int32)))
                n += len(t)
            if n > FLUSH:
                yield from flush()
                n = 0
        if held:
            yield from flush()

    def pair(group: pd.DataFrame) -> pd.DataFrame:
        tokens = np.frombuffer(b"".join(group["tokens"]), np.uint32)
        docs, ns, places = (_unpressed(group[c], k) for c, k in (("docs", np.int64), ("ns", np.int32), ("places", np.int32)))
        order = np.lexsort((docs, tokens))
        # A repeated row of a document is passed over.
        order = order[np.append(True, (np.diff(tokens[order]) != 0) | (np.diff(docs[order]) != 0))] if len(order) else order
        tokens, docs, ns, places = tokens[order], docs[order], ns[order].astype(np.int64), places[order]
        ends = np.append(np.flatnonzero(np.diff(tokens)) + 1, len(tokens))
        starts = np.append(0, ends[:-1])
        found, many = [], np.zeros(len(tokens), bool)
        for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
            if b - a > MOST_PAIRED:
                many[a:b] = True
                continue
            x, y = np.triu_indices(b - a, 1)
            x, y = x + a, y + a
            rest = np.minimum(ns[x] - places[x], ns[y] - places[y])
            ok = (rest * (num + den) >= num * (ns[x] + ns[y])) & (den * np.minimum(ns[x], ns[y]) >= num * np.maximum(ns[x], ns[y])) & (docs[x] != docs[y])
            if ok.any():
                x, y = docs[x[ok]], docs[y[ok]]
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        one = pd.DataFrame({"x": pairs[:, 0], "y": pairs[:, 1], "token": 0, "n": 0, "rest": 0})
        token = (np.int64(group["bucket"].iloc[0]) << 32) | tokens[many].astype(np.int64) if many.any() else np.empty(0, np.int64)
        two = pd.DataFrame({"x": docs[many], "y": docs[many], "token": token, "n": ns[many], "rest": ns[many] - places[many]})
        return pd.concat([one, two], ignore_index=True)

    python_ready(nodes.sparkSession)
    dealt = nodes.where(F.length("cold") > 0).select("doc_id", "n", "cold").mapInArrow(deal, "bucket int, tokens binary, docs binary, ns binary, places binary")
    return dealt.groupBy("bucket").applyInPandas(pair, "x long, y long, token long, n int, rest int")


def _may_link(nx, ny, rest, num: int, den: int):
    """Sizes and the most that can be shared leave the threshold in reach."""
    return (rest * (num + den) >= num * (nx + ny)) & (den * F.least(nx, ny) >= num * F.greatest(nx, ny))


def _verified(pairs: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs whose Jaccard similarity is at least num / den.

    Tokens fall into GROUPS groups by their hash; what two documents share is at most the sum of the
    smaller counts. Only documents of pairs that this bound leaves over get their whole sets, made
    from their texts once more: reading costs less than to keep and shuffle every set.
    """

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            if len(x) > len(y):
                x, y = y, x
            both = int((y[np.searchsorted(y, x).clip(max=len(y) - 1)] == x).sum()) if len(x) else 0
            ok.append(den * both >= num * (len(x) + len(y) - both))
        return pa.RecordBatch.from_arrays(batch.columns[:2], names=["x", "y"]).filter(pa.array(ok))

    def bound(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
            most = int(np.minimum(x, y).sum())
            ok.append(den * most >= num * (int(x.sum()) + int(y.sum()) - most))
        return pa.RecordBatch.from_arrays(batch.columns[:2], names=["x", "y"]).filter(pa.array(ok))

    def beside(some: DataFrame, what: str, of: Callable[[np.ndarray], bytes]) -> DataFrame:
        ids = durable(some.select(F.col("x").alias("doc_id")).union(some.select("y")).distinct(), f"jaccard-{what}-ids")
        made = durable(_of_sets(docs.join(small_side(ids), "doc_id", "left_semi"), width, of), f"jaccard-{what}")
        left, right = (made.select(F.col("doc_id").alias(c), F.col("made").alias(f"of {c}")) for c in ("x", "y"))
        return some.join(left, "x").join(right, "y").select("x", "y", "of x", "of y")

    likely = durable(map_batches(beside(pairs, "counts", _group_counts), bound, "x long, y long").distinct(), "jaccard-likely")
    return map_batches(beside(likely, "tokens", np.ndarray.tobytes), check, "x long, y long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, component): the smallest node reachable; by smallest neighbour labels and pointer jumping until nothing changes."""
    both = durable(edges.select("x", "y").union(edges.select("y", "x")).toDF("v", "u").distinct(), "links")
    labels = durable(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("component").alias("near"))
        better = labels.join(near, "v").select("v", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        jump = labels.select(F.col("v").alias("component"), F.col("component").alias("further"))
        moved = durable(
            better.join(jump, "component", "left").select("v", F.least("component", F.coalesce("further", "component")).alias("component"), "old"), "labels"
        )
        labels = moved.select("v", "component")
        if moved.where("component <> old").isEmpty():
            return labels


def jaccard_classes(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", width: int = 5, threshold: tuple[int, int] = (4, 5),
) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of docs.

    Words are separated by ASCII white space and compared with A-Z in lower case. A null or blank text
    has no shingles, links with nothing and is its own component, as is every document without a
    partner. Rows that share an id are one document: linked to whatever either of them links to. Rows
    with a null id take part like all others, those of equal text as one document; their id stays null,
    and so does the component of documents that reach no id. Ids may be any long. An empty table
    gives an empty result. Other columns are not read.
    """
    given, names = _nodes(docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")))
    found = _classes(given, width, threshold)
    for c in ("doc_id", "component_id"):
        if names is None:
            continue
        if isinstance(names, DataFrame):
            found = found.join(names.withColumnsRenamed({"node": c, "id": "real"}), c, "left").withColumn(c, F.col("real")).drop("real")
        else:
            found = found.withColumn(c, F.when(F.col(c) < names, F.col(c)))
    return found.select("doc_id", "n_shingles", "component_id")


def _nodes(rows: DataFrame) -> tuple[DataFrame, DataFrame | int | None]:
    """The rows (id, text, ...) with doc_id, the number they take part under, in the order of ids and after all of them for rows without.

    Numbers are the ids themselves if every row has one, or if the largest leaves room for those without; what these start from comes along. Otherwise ids
    are numbered in their order, and (node, id) comes along.
    """
    nameless = lambda: F.lit(NAMELESS) + F.pmod(F.xxhash64("text"), F.lit(NAMELESS))
    n, named, largest = rows.agg(F.count("*"), F.count("id"), F.max("id")).first()
    if n == named:
        return rows.withColumn("doc_id", F.col("id")), None
    if (largest or 0) < NAMELESS:
        return rows.withColumn("doc_id", F.coalesce("id", nameless())), NAMELESS
    order = durable(rows.select("id").where("id IS NOT NULL").distinct().repartitionByRange("id").sortWithinPartitions("id").select(F.monotonically_increasing_id().alias("node"), "id"), "jaccard-numbers")
    numbered = rows.join(order, "id", "left").withColumn("doc_id", F.coalesce("node", nameless())).drop("node")
    return numbered, order


def _heavy(holdings: int) -> int:
    return max(HEAVY, -(-holdings // HEAVY_SHARE))


def _classes(given: DataFrame, width: int, threshold: tuple[int, int]) -> DataFrame:
    """jaccard_classes of (doc_id, text), all with a number."""
    num, den = threshold
    given = given.select("doc_id", "text")
    frequent = frequent_tokens(given, width)
    signed = durable(signatures(given, frequent, width, num, den), "jaccard-signatures")
    classes = signed.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    classes = durable(classes, "jaccard-classes")
    stand = small_side(classes.select(F.col("rep").alias("doc_id")).where("doc_id IS NOT NULL"))
    nodes = signed.where("n > 0").join(stand, "doc_id", "left_semi")
    tokens = signed.agg(F.sum(F.length("cold"))).first()[0] or 0
    met = durable(_seldom_pairs(nodes, max(8, tokens // 8 // BUCKET_TOKENS), num, den), "jaccard-met")
    seldom = met.where("x <> y").select("x", "y").distinct()
    held = nodes.where(F.size("hot") > 0).select(
        "doc_id", "n", F.posexplode("hot").alias("k", "token"), (F.length("cold") / 8).cast("int").alias("ahead")
    ).select("doc_id", "n", "token", (F.col("n") - F.col("ahead") - F.col("k")).alias("rest"))
    held = held.union(met.where("x = y").select(F.col("x").alias("doc_id"), "n", "token", "rest"))
    held = durable(held.groupBy("doc_id", "n", "token").agg(F.max("rest").alias("rest")), "jaccard-frequent")
    best = held.groupBy("token").agg(F.max_by(F.struct("doc_id", "n", "rest"), F.struct("rest", F.bitwise_not("doc_id"))).alias("l"), F.count(F.lit(1)).alias("holders")).where("holders > 1")
    best = durable(best, "jaccard-stars")
    heavy = F.col("holders") >= _heavy(held.count())
    few = F.broadcast(best.where(heavy))
    starred = held.join(few, "token").unionByName(held.join(few.select("token"), "token", "left_anti").join(best.where(~heavy), "token"))
    star = starred.where(
        (F.col("doc_id") != F.col("l.doc_id")) & _may_link(F.col("n"), F.col("l.n"), F.least("rest", "l.rest"), num, den)
    ).select(F.least("doc_id", "l.doc_id").alias("x"), F.greatest("doc_id", "l.doc_id").alias("y")).distinct()
    first = durable(seldom.union(star).distinct(), "jaccard-first")
    links = durable(_verified(first, given, width, num, den), "jaccard-links")
    groups = components(links)
    second = durable(_opened(held, groups, num, den), "jaccard-opened")
    if not second.isEmpty():
        links = durable(links.union(_verified(second, given, width, num, den)), "jaccard-links")
        groups = components(links)
    of_class = classes.join(groups.withColumnRenamed("v", "rep"), "rep", "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    return signed.join(of_class, ["n", "d1", "d2"], "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def _group_counts(tokens: np.ndarray) -> bytes:
    return np.bincount((tokens >> np.uint64(24)).astype(np.int64) % GROUPS, minlength=GROUPS).astype(np.uint32).tobytes()


def _of_sets(docs: DataFrame, width: int, of: Callable[[np.ndarray], bytes]) -> DataFrame:
    """doc_id and what `of` makes of the shingle set, for documents that have one."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, width) for t in blobs(batch.column(1))]
        made = [of(s) if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["doc_id", "made"])

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, made binary").where("made IS NOT NULL")


def _opened(held: DataFrame, groups: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs x < y of different groups from the groups that the matrix can't rule out."""
    grouped = held.join(groups.withColumnRenamed("v", "doc_id"), "doc_id", "left").withColumn("group", F.coalesce("component", "doc_id")).drop("component")
    grouped = durable(grouped, "jaccard-grouped")
    matrix = grouped.groupBy("token", "group").agg(F.max("rest").alias("most"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.count(F.lit(1)).alias("members"))
    matrix = durable(matrix, "jaccard-matrix")
    # Tokens of one group alone open nothing. Heavy ones meet on a grid: queries and groups are cut in parts, and each part of one side stands with all of the other.
    tokens = matrix.groupBy("token").agg(F.count(F.lit(1)).alias("groups"), F.sum("members").alias("holders")).where("groups > 1")
    tokens = durable(tokens.select("token", "holders", F.ceil(F.col("groups") / HEAVY).cast("int").alias("across"), F.ceil(F.col("holders") / HEAVY).cast("int").alias("down")), "jaccard-open-tokens")
    heavy = F.col("holders") >= _heavy(grouped.count())
    few = F.broadcast(tokens.where(heavy).select("token", "across", "down"))
    light = tokens.where(~heavy).select("token")

    def dealt(side: DataFrame, own: str, count: str, other: str, others: str) -> DataFrame:
        """Rows of open tokens with the cell of the grid they stand in."""
        cut = side.join(few, "token").withColumn(own, F.pmod(F.xxhash64("doc_id" if own == "row" else "group"), F.col(count)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
        plain = side.join(few.select("token"), "token", "left_anti").join(light, "token", "left_semi")
        return cut.drop("across", "down").unionByName(plain.withColumn(own, F.lit(0)).withColumn(other, F.lit(0)))

    query = dealt(grouped, "row", "down", "column", "across")
    matrix = dealt(matrix, "column", "across", "row", "down").withColumnRenamed("group", "other")
    # The nearest size a member can have decides the bound: the query's own where the range holds it.
    near = F.greatest(F.least("n", "largest"), "smallest")
    needed = F.greatest("smallest", F.ceil(F.col("n") * num / den))
    qualifies = (F.col("other") < F.col("group")) & (den * F.least(F.col("n"), near) >= num * F.greatest(F.col("n"), near)) & (
        F.least("rest", "most") * (num + den) >= num * (F.col("n") + needed)
    )
    opened = query.join(matrix, ["token", "row", "column"]).where(qualifies).select(
        "token", "other", F.col("doc_id").alias("q"), F.col("n").alias("nq"), F.col("rest").alias("rq")
    )
    members = grouped.withColumnRenamed("group", "other")
    pairs = opened.join(members, ["token", "other"]).where(
        _may_link(F.col("n"), F.col("nq"), F.least("rest", "rq"), num, den)
    )
    return pairs.select(F.least("q", "doc_id").alias("x"), F.greatest("q", "doc_id").alias("y")).distinct()


def representatives(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", width: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """The documents that stay when of each component only the one with the smallest id does; all columns stay.

    Documents without shingles all stay. Of a component in which no document has an id, the rows of one text
    stay; of rows without id that have the same text, one does. An empty table gives an empty result.
    """
    own = {c: f"given {i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"), *[F.col(f"`{c}`").alias(a) for c, a in own.items()])
    rows, _ = _nodes(rows)
    found = _classes(rows, width, threshold)
    gone = durable(found.where("n_shingles > 0 AND component_id <> doc_id").select("doc_id").distinct(), "jaccard-gone")
    kept = rows.join(small_side(gone), "doc_id", "left_anti")
    single = F.col("id").isNotNull() | (F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)) == 0)
    return kept.where(single).unionByName(kept.where(~single).dropDuplicates(["doc_id"])).select(*[F.col(f"`{a}`").alias(c) for c, a in own.items()])
