"""Every operator and stage over a table that has columns with all names they use themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lithic.llm import byte_gru, chroma, config_packing, fair_mix, graph_ann, group_join, host_reputation, html_layout, toxicity, trigram_secrets

NAMES = (
    "_id _words _most _extra _rows _copy _nth _d _digest _h _x _src _part _k _r _n _b _sxid _sxmask _sxsalt _sxlow _sxtext secrets severity grade severity_probs "
    "lang_pred score fingerprint size taken target finish id d n sig g comp component_id n_shingles piece start length offset sequence_id spans out"
).split()
TEXT = "plain words of a text password=abcdef123 that goes on and on for a while"


@pytest.fixture
def docs(spark):
    rows = [(1, TEXT, "en", "a", 0), (2, TEXT, "en", "b", 0), (3, "quite another text about nothing", "de", None, 0), (None, "no id here at all, password=zzzzzz99", "de", "a", 0), (4, None, None, "b", None), (5, "", "en", "b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(f"keep {n}").alias(n) for n in NAMES])


def kept(df):
    """All extra columns are as they were."""
    return all(r[n] == f"keep {n}" for r in df.collect() for n in NAMES)


def test_toxicity(docs):
    model = toxicity.OrdinalModel({}, np.zeros(0), np.array([1.0, 2.0, 3.0]))
    out = ("s1", "s2", "s3")
    scored = toxicity.score(docs, model, out=out)
    assert scored.columns == [*docs.columns, *out] and kept(scored)
    replaced = toxicity.score(docs, model)
    assert replaced.columns.count("severity") == 1 and dict(replaced.dtypes)["severity"] == "double" and replaced.count() == 6


def test_group_join(docs):
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in group_join.similar_documents(docs).collect()) == [(0, 0), (1, 1), (2, 1), (3, 3), (4, 4), (5, 5)]
    left = group_join.keep_one(docs)
    assert left.columns == docs.columns and kept(left) and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 3, 4, 5]


def test_secrets(docs):
    found = trigram_secrets.digest(trigram_secrets.scan(docs))
    assert sorted((r.doc_id or 0, r.n_assign) for r in found.collect()) == [(0, 1), (1, 1), (2, 1), (3, 0), (4, 0), (5, 0)]
    clean = trigram_secrets.redact(docs)
    assert clean.columns == docs.columns and kept(clean) and not clean.where("text LIKE '%password=%'").count()


def test_secrets_beyond_the_broadcast(docs, monkeypatch):
    near = sorted(map(str, trigram_secrets.digest(trigram_secrets.scan(docs)).collect()))
    monkeypatch.setattr(trigram_secrets, "FEW", -1)
    assert sorted(map(str, trigram_secrets.digest(trigram_secrets.scan(docs)).collect())) == near


def test_mix(docs):
    out = fair_mix.repeated(docs)
    assert out.columns == docs.columns and kept(out) and out.where("doc_id IN (4, 5)").count() == 2


def test_language(docs):
    model = byte_gru.train(["some words here", "andere worte da"], ["en", "de"], steps=3)
    for m in (model, None):
        out = byte_gru.label(docs, m)
        assert out.columns.count("score") == 1 and out.count() == 6 and {r.lang_pred for r in out.collect()} <= {"en", "de", "und"}
        assert byte_gru.label(docs.limit(0), m).collect() == []


def test_pages_and_media(docs, spark):
    pages = docs.withColumnRenamed("text", "html").withColumn("text", F.lit("old")).withColumn("url", F.lit("https://a.com/x")).withColumn("page_id", F.col("doc_id"))
    out = html_layout.extract(pages)
    assert out.columns.count("text") == 1 and not out.where("text = 'old'").count()
    marks = docs.select(F.col("doc_id").alias("page_id"), F.lit(1).alias("bad"), *NAMES)
    assert host_reputation.judge(pages, marks).count() == 6
    heard = chroma.fingerprints(docs.withColumn("v", F.lit(None).cast("binary")), "v")
    assert heard.columns.count("fingerprint") == 1 and dict(heard.dtypes)["fingerprint"] == "array<int>"


def test_vectors_and_packing(docs):
    vectors = docs.withColumn("vec_id", F.coalesce("doc_id", F.lit(0)) * 100).withColumn("embedding", F.array(F.lit(1.0), F.col("vec_id").cast("double")))
    assert graph_ann.nearest(vectors).count() == 6 * 5
    assert config_packing.pack_documents(docs).where("piece = 0").count() == 6


def test_stages(docs, spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert kept(docs), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).where("piece = 0").count() >= 5
