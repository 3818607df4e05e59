"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webwarden.llm import lookalikes, nearcopies, packing, residue, spam, tokens
from webwarden.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def all_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical = lookalikes.host_values(table(spark, sf_dir, "lexical_features"), "lexical_features.raw_domain", "feature_id", "raw_domain")
    ct = lookalikes.host_values(table(spark, sf_dir, "ct_events"), "ct_events.domain", "delivery_id", "domain")
    stream = lookalikes.host_values(table(spark, sf_dir, "certstream_events"), "certstream_events.san_list", "event_id", "san_list")
    return lexical.unionAll(ct).unionAll(stream)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.consistent_hosts(all_hosts(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = residue.residual_pages(table(spark, sf_dir, "page_captures")).filter("is_residue").select(F.lit("page_captures.dom_html").alias("field_name"), "row_id")
    types = residue.residual_types(table(spark, sf_dir, "cloaking_results")).select(F.lit("cloaking_results.interstitial_type").alias("field_name"), "row_id")
    return pages.unionAll(types)


def p3_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residual_pages(table(spark, sf_dir, "page_captures"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nearcopies.NearCopies(table(spark, sf_dir, "page_captures"), "capture_id", "dom_html")
    return near.pairs().select(F.col("id_a").alias("capture_id_a"), F.col("id_b").alias("capture_id_b"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.NearCopies(table(spark, sf_dir, "page_captures"), "capture_id", "dom_html").groups().withColumnRenamed("id", "capture_id")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_texts(table(spark, sf_dir, "documents"), "byte_bpe_50k")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_specs"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.container_fill(p8_containers(spark, sf_dir), table(spark, sf_dir, "container_specs"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_verdicts(table(spark, sf_dir, "documents")).filter("is_spam").select("doc_id")


def p9_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_verdicts(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_measures, p5_found, p5_groups, p7_ids, p8_containers, p8_fill, p9_found, p9_measures)}
_PAIRS = r"""
WITH w AS (SELECT capture_id, list_transform(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(dom_html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g'), '<[^>]*>', ' ', 'g'), '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM page_captures),
s AS (SELECT capture_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM w WHERE len(w) >= 60),
n AS (SELECT capture_id, count(*) AS n FROM s GROUP BY capture_id),
o AS (SELECT a.capture_id AS capture_id_a, b.capture_id AS capture_id_b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.capture_id < b.capture_id GROUP BY ALL)
SELECT capture_id_a, capture_id_b FROM o JOIN n x ON capture_id_a = x.capture_id JOIN n y ON capture_id_b = y.capture_id WHERE o / (x.n + y.n - o) >= 0.6
"""
SQL = {"p5_found": _PAIRS}
