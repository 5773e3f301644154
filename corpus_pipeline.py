"""A training corpus from documents: five stages, each one operator of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the shared folder and
rereads it as the next one's docs. All but the last return the columns of documents. Copies that the mix takes more
than once are rows of their own, as often as they are taken.

Defined results, of all stages: rows with a null text, an empty one or one without words, and rows with a null id, go
through to the end (the end id alone is one piece). Repeated rows are one document from the second stage on, unless
their id is null. Ties go to the smallest id. Empty tables give empty tables with the same columns. Extra columns pass
through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.llm import config_packing, fair_mix, group_join, shared, toxicity, trigram_secrets


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below the cutoff."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = tuple(shared.free(n, docs.columns) for n in toxicity.OUT)
    return toxicity.score(docs, model, out=out).where(F.col(out[0]) < model.cutoff()).select(*[f"`{c}`" for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return group_join.keep_one(docs, width=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced; n_chars follows the text."""
    clean = trigram_secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*[f"`{c}`" for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents without words stay once."""
    return fair_mix.repeated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place."""
    return config_packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
    ("packing", pack_sequences),
]
#: The model, the tokenizer and the linear program have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = shared.cut(stage(spark, docs, sf_dir))
    return docs
