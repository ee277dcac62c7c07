"""The queries over the given tables that apply this subpackage's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fingerprints, kneser_ney, language, lengths, merkle, mixing, packing, preferences, repair, round_sql, simhash, topk, toxicity
from .common import table


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.suffix_sums(lengths.histogram(table(spark, sf_dir, "documents")))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.format_arrays(preferences.exchange_tails(table(spark, sf_dir, "conversations")))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_document_fingerprints, op2_mixing_sources, op3_toxicity, op4_exact_top_k, op5_quality_classifier,
    op6_language_id, op7_token_counts, op8_chat_formatting, op9_simhash_near_dedup, op10_packing,
    op11_conversation_repair, op12_benchmark_decontamination, op13_merkle_manifest)}

ORACLES = {
    "op11_conversation_repair": round_sql.REPAIR,
    "op12_benchmark_decontamination": round_sql.DECONTAMINATION,
    "op13_merkle_manifest": round_sql.MERKLE,
    "op4_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op8_chat_formatting": """
        WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
                   FROM conversations WHERE conv_id IS NOT NULL),
        n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
        p AS (SELECT conv_id, n, ((conv_id % n) + n) % n AS keep,
                     coalesce(lead(conv_id) OVER (ORDER BY conv_id), min(conv_id) OVER ()) AS next_id FROM n),
        r AS (SELECT t.conv_id, i, role, text FROM t JOIN p USING (conv_id) WHERE i < keep
              UNION ALL SELECT p.conv_id, i, role, text FROM p JOIN t ON t.conv_id = p.next_id WHERE i >= keep),
        m AS (SELECT p.conv_id, n, (SELECT count(*) FROM r WHERE r.conv_id = p.conv_id) AS n2 FROM p),
        d AS (SELECT a.conv_id, min(a.i) AS i FROM t a JOIN r b ON a.conv_id = b.conv_id AND a.i = b.i AND (a.role <> b.role OR a.text <> b.text) GROUP BY a.conv_id),
        f AS (SELECT m.conv_id, coalesce(d.i, least(n, n2)) AS first FROM m LEFT JOIN d ON d.conv_id = m.conv_id),
        s AS (SELECT 0 AS side, conv_id, role, text, i FROM t UNION ALL SELECT 1, conv_id, role, text, i FROM r),
        u AS (SELECT side, s.conv_id, i, i < first AS early, role, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS own FROM s JOIN f ON f.conv_id = s.conv_id),
        w AS (SELECT *, sum(length(own)) OVER (PARTITION BY side, conv_id, early ORDER BY i) AS till FROM u),
        g AS (SELECT conv_id, string_agg(own, '' ORDER BY i) FILTER (WHERE side = 0 AND early) AS prompt,
                     string_agg(own, '' ORDER BY i) FILTER (WHERE side = 0 AND NOT early) AS chosen,
                     string_agg(own, '' ORDER BY i) FILTER (WHERE side = 1 AND NOT early) AS rejected,
                     string_agg((till - length(own) + length(role) + 5) || '-' || till, ',' ORDER BY i) FILTER (WHERE side = 0 AND NOT early AND role = 'assistant') AS m0,
                     string_agg((till - length(own) + length(role) + 5) || '-' || till, ',' ORDER BY i) FILTER (WHERE side = 1 AND NOT early AND role = 'assistant') AS m1
              FROM w GROUP BY conv_id)
        SELECT f.conv_id AS pair_id, CAST(first AS BIGINT) AS n_prompt_turns, coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen,
               coalesce(rejected, '') AS rejected, coalesce(m0, '') AS chosen_mask, coalesce(m1, '') AS rejected_mask
        FROM f JOIN g ON g.conv_id = f.conv_id""",
}
