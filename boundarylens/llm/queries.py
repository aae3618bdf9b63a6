"""One query per operator over its whole table, with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from boundarylens.llm import html, jaccard, merkle, mixing, neighbours, packing, quality, resampling, runs, secrets, suffix, toolcalls, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(_table(spark, sf_dir, "documents")))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op4_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op5_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(_table(spark, sf_dir, "documents"))


def op6_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolcalls.conversation_calls(_table(spark, sf_dir, "conversations"))
    return toolcalls.link_tool_calls(calls, results, toolcalls.REPLY)


def op7_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(_table(spark, sf_dir, "pages"))


def op8_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_table(spark, sf_dir, "documents"))


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), share=0.99)


def op10_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("word_bpe_49k.json"))


def op11_kolpakov_kucherov_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.periodic_runs(_table(spark, sf_dir, "documents"), alter=True))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_proofs(_table(spark, sf_dir, "documents"))


def op13_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_randomness_battery, op2_mix_sources, op3_divergence_rules, op4_bit_sliced_top_k,
        op5_token_group_join, op6_tool_call_linking, op7_wrapper_induction, op8_prefix_doubling, op9_importance_resampling, op10_pattern_packing,
        op11_kolpakov_kucherov_runs, op12_merkle_manifest, op13_inverted_multi_index,
    )
}

OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
keyed AS (
  SELECT *, md5('7/' || coalesce(doc_id::VARCHAR, '') || '/' || size::VARCHAR) AS key FROM sized),
sums AS (
  SELECT src, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY src) - 1 AS place FROM keyed GROUP BY src),
weighed AS (SELECT *, [5, 2, 1][(place % 3 + 1)::INT] AS weight FROM sums),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed
  WINDOW w AS (ORDER BY 3.0::DOUBLE * source_size / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT src, source_size, least(3.0::DOUBLE * source_size, max(level) OVER () * weight) AS target FROM levels),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs,
         floor(target + 0.5)::BIGINT AS budget FROM targets),
placed AS (
  SELECT k.*, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
         sum(size) OVER (PARTITION BY k.src ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         count(*) OVER (PARTITION BY k.src, key) AS n
  FROM keyed k JOIN budgets b ON k.src = b.src)
SELECT doc_id, size, source_size, target,
       (epochs * size + CASE WHEN upto <= rest THEN size
                             WHEN upto - n * size > rest THEN 0
                             ELSE (rest - (upto - n * size)) // n END)::BIGINT AS taken
FROM placed
"""

OP4_SQL = """
WITH kept AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.row, a.vec_id AS query_id, b.vec_id AS vec_id,
         list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM kept a JOIN kept b ON a.vec_id % 50 = 0 AND a.row <> b.row)
SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) <= 5
"""

OP6_SQL = """
WITH RECURSIVE asked AS (
  SELECT conv_id AS conv, turn, min(CASE role WHEN 'user' THEN 'reply' ELSE 'instruct' END) AS name, count(*) AS n_calls, count(DISTINCT [role, text]) > 1 AS several
  FROM conversations WHERE role IN ('user', 'system') AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
calls AS (
  SELECT a.*, (SELECT min(text) FROM conversations c WHERE c.conv_id = a.conv AND c.turn = a.turn AND c.role = CASE a.name WHEN 'reply' THEN 'user' ELSE 'system' END) AS text,
         CASE WHEN EXISTS (SELECT 1 FROM asked p WHERE p.conv = a.conv AND p.turn = a.turn - 1) THEN a.turn - 1 ELSE a.turn - 2 END AS up
  FROM asked a),
answers AS (
  SELECT conv_id AS conv, turn - 1 AS turn, text AS content, count(*) AS n_results
  FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn, text),
placed AS (
  SELECT c.conv, c.turn, 0::BIGINT AS depth FROM calls c
  WHERE NOT EXISTS (SELECT 1 FROM asked p WHERE p.conv = c.conv AND p.turn = c.up)
  UNION ALL
  SELECT c.conv, c.turn, p.depth + 1 FROM placed p JOIN calls c ON c.conv = p.conv AND c.up = p.turn),
checked AS (
  SELECT c.*, depth, concat_ws(';', CASE WHEN text IS NULL THEN CASE name WHEN 'reply' THEN 'prompt: missing' ELSE 'required: text' END END,
                               CASE WHEN name = 'instruct' AND turn < 0 THEN '/turn minimum' END, CASE WHEN several THEN 'several calls' END) AS errors
  FROM calls c JOIN placed p USING (conv, turn))
SELECT c.conv, 't' || c.turn AS id, name, depth AS call_order, errors = '' AS valid, errors, n_calls, coalesce(n_results, 0) AS n_results,
       to_json({'arguments': CASE WHEN text IS NULL THEN to_json({'turn': c.turn}) WHEN name = 'reply' THEN to_json({'prompt': text, 'turn': c.turn}) ELSE to_json({'text': text, 'turn': c.turn}) END,
                'id': 't' || c.turn, 'name': name, 'order': depth, 'result': content, 'valid': errors = ''})::VARCHAR AS json
FROM checked c LEFT JOIN answers a ON a.conv = c.conv AND a.turn = c.turn
"""

def _crc32(text: str) -> str:
    """The unsigned crc32 of an ASCII text, bit by bit."""
    byte = "list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), xor(state, byte))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT), lambda state, byte: {byte}, 4294967295::BIGINT), 4294967295)"


def _leaf(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({x})::VARCHAR || ':' || {x}, '-')" for x in fields) + ")"


def _tree(nodes: str, leaves: str, beside: str) -> str:
    """All nodes over some leaves (key, pos, node, n), and what stands left and right of each under its parent."""
    return f"""
{nodes} AS (
  SELECT key, 0 AS level, pos, node, n FROM {leaves}
  UNION ALL
  SELECT key, level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (n + 7) // 8 FROM {nodes} WHERE n > 1 GROUP BY key, level, pos // 8, n),
{beside} AS (
  SELECT a.key, a.level, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM {nodes} a JOIN {nodes} b ON a.key = b.key AND a.level = b.level AND a.pos // 8 = b.pos // 8 AND a.n > 1 GROUP BY a.key, a.level, a.pos)"""


OP12_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('+' || lang, '') AS key, {_leaf("text")} AS node,
         CASE WHEN {_crc32("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS altered
  FROM documents),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, node) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM leaves),
{_tree("low", "numbered", "low_beside")},
subroots AS (
  SELECT key AS name, level AS height, node, '' AS key, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
{_tree("high", "subroots", "high_beside")},
up AS (
  SELECT doc_id, key, pos AS leaf_pos, node AS leaf, 0 AS level, pos, coalesce(altered, node) AS folded, '' AS proof FROM numbered
  UNION ALL
  SELECT doc_id, key, leaf_pos, leaf, level + 1, pos // 8, sha256(l || folded || r), proof || l || r FROM up JOIN low_beside USING (key, level, pos)),
over AS (
  SELECT u.doc_id, u.leaf, s.node AS subroot, 0 AS level, s.pos, u.folded, u.proof, s.name, u.leaf_pos
  FROM up u JOIN subroots s ON u.key = s.name AND u.level = s.height
  UNION ALL
  SELECT doc_id, leaf, subroot, o.level + 1, o.pos // 8, sha256(l || folded || r), proof || l || r, name, leaf_pos FROM over o JOIN high_beside b ON o.level = b.level AND o.pos = b.pos)
SELECT doc_id, leaf, subroot, root.node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root.node AS verified
FROM over JOIN high root ON root.n = 1 AND over.level = root.level
"""

ORACLE_SQL: dict[str, str] = {"op12_merkle_manifest": OP12_SQL, "op2_mix_sources": OP2_SQL, "op4_bit_sliced_top_k": OP4_SQL, "op6_tool_call_linking": OP6_SQL}
