import itertools
import random

import corpus_pipeline
from tests.llm.test_group_join import shingles


def corpus(spark, folder):
    r = random.Random(9)
    vocab = ["".join(r.choices("abcdefghijkl", k=r.randrange(2, 9))) for _ in range(500)]
    rows = []
    for i in range(120):
        words = r.choices(vocab, k=r.choice([5, 40, 120]))
        if i % 8 == 0:
            words += ["zzmoron", "zzidiot", "zzmoron"]
        if i % 11 == 0:
            words += ["token=abcdefgh123"]
        rows.append((i, " ".join(words), "en", f"src{i % 4}", 0))
    rows += [(200 + k, rows[k][1] + " tail", "en", "src9", 0) for k in (1, 2, 3)] + [(300, rows[5][1], "fr", None, 0), (301, None, None, "src1", None), (302, "", "de", "src1", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i % 8 == 0)) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        docs.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        out[name] = docs
        if name != names[-1]:
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
    clean = {i for i, t, *_ in rows if "zzmoron" not in (t or "")}
    first = {r.doc_id: r.text for r in out["toxicity"].collect()}
    assert set(first) == clean
    sets = {i: shingles(t, 5) for i, t in first.items()}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            up[max(find(a), find(b))] = min(find(a), find(b))
    second = {r.doc_id for r in out["near copies"].collect()}
    assert second == {find(i) for i in sets}
    third = {r.doc_id: r for r in out["secrets"].collect()}
    assert set(third) == second
    for i, r in third.items():
        assert (r.text is None) == (first[i] is None) and "token=abcdefgh123" not in (r.text or "")
        assert r.n_chars == (None if r.text is None else len(r.text))
    mixed = [r.doc_id for r in out["mix"].collect()]
    assert set(mixed) <= second and max(map(mixed.count, set(mixed))) <= 3 and {301, 302} <= set(mixed)
    assert out["packing"].where("piece = 0").count() == len(mixed)


def test_empty_documents(spark, tmp_path):
    corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.collect() == []
