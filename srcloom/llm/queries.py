"""The queries opN_<name> over the tables of a folder, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import html_extract, ngram_rules, passages, pieces, pii, ppm, qda, simhash, tiling, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_mss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qda.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_ngram_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_rules.judged(table(spark, sf_dir, "documents")).drop("log_ppl")


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scores(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op10_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents"))


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.lookup(warc.write(pages), warc.keys_of(pages)).drop("key")


def op8_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict:
    return {
        "op2_warc_index": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
            q AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS lead FROM p)
            SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
                list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                    ((('0x' || substr(h, (1 + 10 * (i // 8))::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
                CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
                CASE WHEN page_id = lead THEN NULL ELSE lead END AS refers_to
            FROM q
        """,
    }
