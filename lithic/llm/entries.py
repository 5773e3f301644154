"""The thin queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_gru, chroma, config_packing, fair_mix, graph_ann, group_join, host_reputation, html_layout, toxicity, trigram_secrets


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.round("severity", 6).alias("severity"), "grade", (F.col("severity") >= model.cutoff()).alias("toxic"))


def op2_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.extract(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "text")


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).cast("int").alias("bad"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return host_reputation.judge(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def op4_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_join.similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=90)


def op5_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio: each embedding is rendered as a recording (see chroma.melody)."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return chroma.catalogue(chroma.fingerprints(rows, "v", decode=chroma.melody))


def op6_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trigram_secrets.digest(trigram_secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op8_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op9_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = byte_gru.fit(docs.where("NOT held_out"))
    return byte_gru.label(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def op10_config_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config_packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_html_layout, op3_host_reputation, op4_group_join, op5_chroma, op6_trigram_secrets, op7_graph_ann, op8_fair_mix, op9_byte_gru, op10_config_packing)
}
ORACLES: dict[str, str] = {
    "op3_host_reputation": host_reputation.oracle_sql(),
    "op6_trigram_secrets": trigram_secrets.oracle_sql(),
    "op8_fair_mix": fair_mix.ORACLE_SQL,
}
