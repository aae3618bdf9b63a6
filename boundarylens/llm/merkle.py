"""A Merkle manifest of a table: one tree per key, and one over the keys' roots.

Leaves are digests of rows, computed by Spark and stored; only those are sorted, each getting its place
within its key. Places are cut into aligned buckets of 4,096 leaves, four levels of eight. A bucket travels as one
Arrow table, and an in-process DuckDB in the task runs the level queries on it: an ordered string_agg of
every eight nodes, and its sha256. The roots of buckets are few, and Spark combines them level by level. Going
down again, every bucket gets the siblings above it (the outer proof); joined to the buckets, these let the block engine
give each leaf its whole proof and the root folded from it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boundarylens.llm.common import durable, python_ready

FAN, BLOCK_LEVELS = 8, 4
BLOCK = FAN**BLOCK_LEVELS
_ROWS = "doc_id long, key string, leaf string, altered string"


def encoded(column: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, columns)), 256)


def height(n: int) -> int:
    """Levels above n leaves until one node is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def placed(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows with pos, their place (from 0) within their key by the order, and n, the number of rows of the key.

    A sort in ranges, so that a key with most of the rows is dealt over many tasks; a row's place is its place in
    its range plus what ranges before hold of the key.
    """
    ranged = df.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    ranged = durable(ranged.withColumn("at", F.monotonically_increasing_id()), "merkle-placed")
    ranged = ranged.withColumn("part", F.shiftright("at", 33))
    starts = ranged.groupBy("key", "part").agg(F.count("*").alias("held"), F.min("at").alias("least"))
    by_key = Window.partitionBy("key")
    starts = starts.select(
        "key", "part", "least", F.sum("held").over(by_key).alias("n"),
        (F.sum("held").over(by_key.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")).alias("before"),
    )
    return ranged.join(starts, ["key", "part"]).withColumn("pos", F.col("at") - F.col("least") + F.col("before")).drop("at", "part", "least", "before")


def _levels(count: int) -> tuple[str, int]:
    """SQL of the node tables n0, n1, ... of a bucket, and how many levels it has above the leaves."""
    top = min(BLOCK_LEVELS, height(count))
    steps = ["n0 AS MATERIALIZED (SELECT pos, leaf AS node FROM leaves)"]
    steps += [f"n{i + 1} AS MATERIALIZED (SELECT pos // {FAN} AS pos, sha256(string_agg(node, '' ORDER BY pos)) AS node FROM n{i} GROUP BY pos // {FAN})" for i in range(top)]
    return ", ".join(steps), top


def _engine():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})


def _bucket(key: tuple, rows: pa.Table) -> pa.Table:
    """A bucket's root, and its rows as one Arrow table."""
    count = rows.column("n")[0].as_py()
    leaves = rows.select(["pos", "doc_id", "leaf", "altered"]).sort_by("pos").combine_chunks()
    steps, top = _levels(count)
    with _engine() as engine:
        engine.register("leaves", leaves)
        nodes = engine.execute(f"WITH {steps} SELECT node FROM n{top}").fetchall()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, leaves.schema) as writer:
        writer.write_table(leaves)
    return pa.table({"key": rows.column("key")[:1], "block": rows.column("block")[:1], "n": [count], "node": [nodes[0][0]], "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _combined(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(key, node) with the root of each key, from (key, pos, m, node) with m nodes a key; and the runs of eight of each level below it."""
    levels = []
    for _ in range(height(nodes.agg(F.max("m")).first()[0] or 0)):
        up = F.floor(F.col("pos") / FAN).alias("up")
        run = nodes.groupBy("key", "m", up).agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("run"))
        digest = F.sha2(F.array_join("run.node", ""), 256)
        levels.append(durable(run.withColumn("node", F.when(F.col("m") > 1, digest).otherwise(F.col("run")[0]["node"])), "merkle-level"))
        nodes = levels[-1].select("key", F.col("up").alias("pos"), F.ceil(F.col("m") / FAN).alias("m"), "node")
    return nodes.select("key", "node"), levels


def _outer(top: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(key, pos, lefts, rights) of the lowest nodes: what stands left and right of them and their ancestors, level by level upward.

    top has (key, lefts, rights) of the keys' roots.
    """
    found = top.select("key", F.lit(0).cast("long").alias("up"), "lefts", "rights")
    for level in reversed(levels):
        beside = lambda x, side: F.array_join(F.transform(F.filter("run", side(x)), lambda y: y["node"]), "")
        child = level.select(
            "key", "up", "m",
            F.explode(F.transform("run", lambda x: F.struct(x["pos"].alias("pos"), beside(x, lambda x: lambda y: y["pos"] < x["pos"]).alias("left"), beside(x, lambda x: lambda y: y["pos"] > x["pos"]).alias("right")))).alias("x"),
        )
        grown = lambda side: F.when(F.col("m") > 1, F.concat(F.array(f"x.{side}"), f"{side}s")).otherwise(F.col(f"{side}s")).alias(f"{side}s")
        found = child.join(found, ["key", "up"]).select("key", F.col("x.pos").alias("up"), grown("left"), grown("right"))
    return found.withColumnRenamed("up", "pos")


@dataclass
class Manifest:
    """roots: key (null for null), leaves, subroot, root. buckets: the rows of each bucket and the nodes beside the way from it to the root."""

    roots: DataFrame
    buckets: DataFrame


def build_manifest(rows: DataFrame, columns: list[str], *, key: str = "lang", order: str = "doc_id", altered: list[Column] | None = None) -> Manifest:
    """The manifest of a table, for each value of `key` a tree over its rows by ascending `order` (an integer; null first, ties by digest).

    A leaf is the sha256 of its `columns`, each null or with its length; a node that of up to eight below. `altered` gives the columns of another
    version of each row, null where there is none, whose leaves are folded into proofs instead. Rows equal in everything are a leaf
    each. Null, empty and very long values are values; an empty table gives an empty manifest. Only digests, not values, are
    shuffled.
    """
    spark = rows.sparkSession
    columns_now = [F.col(c) for c in columns]
    leaf = leaf_digest(columns_now)
    other = F.lit(None).cast("string") if altered is None else F.when(altered[0], leaf_digest(altered[1:]))
    named = F.coalesce(F.concat(F.lit("+"), F.col(key).cast("string")), F.lit(""))  # a null key is the empty string and comes first
    leaves = durable(rows.select(F.col(order).cast("long").alias("doc_id"), named.alias("key"), leaf.alias("leaf"), other.alias("altered")), "merkle-leaves")
    python_ready(spark)
    dealt = placed(leaves, ["doc_id", "leaf"]).withColumn("block", F.floor(F.col("pos") / BLOCK)).withColumn("pos", F.col("pos") % BLOCK)
    buckets = durable(dealt.groupBy("key", "block").applyInArrow(_bucket, "key string, block long, n long, node string, rows binary"), "merkle-buckets")
    nodes = buckets.select("key", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("m"), "node")
    subroots, levels = _combined(nodes)
    ranked = durable(placed(subroots.select(F.lit("").alias("key"), F.col("key").alias("name"), "node"), ["name"]), "merkle-subroots")
    root, upper = _combined(ranked.select("key", "pos", F.col("n").alias("m"), "node"))
    none = F.array().cast("array<string>")
    beside = _outer(root.select("key", none.alias("lefts"), none.alias("rights")), upper) if upper else ranked.select("pos", none.alias("lefts"), none.alias("rights"))
    tops = ranked.withColumnRenamed("node", "subroot").join(F.broadcast(root.withColumnRenamed("node", "root")), "key").drop("key")
    tops = durable(tops.join(beside.drop("key"), "pos").withColumnRenamed("name", "key"), "merkle-tops")
    outer = durable(_outer(tops, levels), "merkle-outer") if levels else tops.select("key", F.lit(0).cast("long").alias("pos"), "lefts", "rights")
    counted = buckets.where("block = 0").select("key", F.col("n").alias("leaves"))
    roots = tops.join(counted, "key").select(F.when(F.col("key") != "", F.substring("key", 2, 2**31 - 1)).alias(key), "leaves", "subroot", "root")
    joined = buckets.join(outer.withColumnRenamed("pos", "block"), ["key", "block"]).join(tops.select("key", "subroot", "root"), "key")
    return Manifest(roots, joined.select("n", "rows", "lefts", "rights", "subroot", "root"))


def proofs(manifest: Manifest, *, digests: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof, folded_root, verified: one row per leaf.

    proof holds the siblings of the leaf and of its ancestors, level by level and left to right, in hexadecimal; with `digests` its sha256.
    folded_root is computed from the leaf, or the altered one, and the siblings; verified says whether it is the root.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _engine() as engine:
            for batch in batches:
                for row in batch.to_pylist():
                    engine.register("leaves", pa.ipc.open_stream(row["rows"]).read_all())
                    steps, top = _levels(row["n"])
                    for i in range(top):
                        steps += (
                            f", s{i} AS (SELECT a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,"
                            f" coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r FROM n{i} a JOIN n{i} b ON a.pos // {FAN} = b.pos // {FAN} GROUP BY a.pos)"
                        )
                    folded, proof, joins = "coalesce(altered, leaf)", ["''"], ""
                    for i in range(top):
                        folded = f"sha256(s{i}.l || {folded} || s{i}.r)"
                        proof += [f"s{i}.l", f"s{i}.r"]
                        joins += f" JOIN s{i} ON s{i}.pos = leaves.pos // {FAN**i}"
                    for _ in row["lefts"]:
                        folded = f"sha256(? || {folded} || ?)"
                    sides = list(zip(row["lefts"], row["rights"], strict=True))
                    whole = f"{' || '.join(proof)} || ?"
                    sql = f"WITH {steps} SELECT doc_id, leaf, ? AS subroot, ? AS root, {f'sha256({whole})' if digests else whole} AS proof, {folded} AS folded_root FROM leaves{joins}"
                    values = [row["subroot"], row["root"], "".join(a + b for a, b in sides), *[a for a, _ in reversed(sides)], *[b for _, b in sides]]
                    yield from engine.sql(sql, params=values).to_arrow_table().cast(kinds).to_batches()
                    engine.unregister("leaves")

    kinds = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof", "folded_root")]])
    python_ready(manifest.buckets.sparkSession)
    out = manifest.buckets.mapInArrow(each, "doc_id long, leaf string, subroot string, root string, proof string, folded_root string")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def tampered_proofs(docs: DataFrame) -> DataFrame:
    """Proofs of all documents, with the texts of a third of them in lower case A-Z: those whose id's crc32 3 divides. Rows of null id are not tampered with."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    changed = [F.translate(F.col(c).cast("string"), upper, lower) if c == "text" else F.col(c) for c in FIELDS]
    return proofs(build_manifest(docs.select(*FIELDS), FIELDS, altered=[hit, *changed]), digests=True).withColumnRenamed("proof", "proof_sha256")
