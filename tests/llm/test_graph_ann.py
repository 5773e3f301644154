import numpy as np

from lithic.llm import graph_ann

SCHEMA = "vec_id long, embedding array<float>, query_id string"


def test_recall_and_exact_scores(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 16)).astype(np.float32)
    x[700:900] = x[5]  # one very common vector
    rows = [(i, [float(v) for v in x[i]], "x") for i in range(len(x))]
    df = spark.createDataFrame(rows, SCHEMA)
    items = df.select(graph_ann.F.col("vec_id").alias("id"), graph_ann.F.col("embedding").cast("array<double>").alias("v"))
    got = graph_ann.search(items, items.where("id % 100 = 0"), shard=400).collect()
    y = x.astype(float)
    hit = total = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(len(y)), d)) if i != q][:10]
        own = sorted((g["rank"], g.vec_id, g.score) for g in got if g.query_id == q)
        assert [k for k, *_ in own] == list(range(1, 11))
        assert all(abs(s - d[v]) < 1e-9 for _, v, s in own)
        hit += len({v for _, v, _ in own} & set(order))
        total += 10
    assert hit / total >= 0.9


def test_odd_vectors_and_few_rows(spark):
    rows = [(0, [1.0, 0.0], "a"), (100, [1.0, 0.0], "a"), (1, None, "a"), (2, [], "a"), (3, [0.0, 0.0], "a"), (4, [1.0, None], "a"), (5, [float("nan"), 1.0], "a"), (6, [2.0, 0.0], "a"), (6, [2.0, 0.0], "a"), (7, [1.0, 2.0, 3.0], "a"), (None, [1.0, 1.0], "a")]
    got = sorted(tuple(r) for r in graph_ann.nearest(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 1, 100, 0.0), (0, 2, 6, 1.0), (100, 1, 0, 0.0), (100, 2, 6, 1.0)]
    assert graph_ann.nearest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_recall_of_production_shards_and_blocks(spark, monkeypatch):
    """Several shards of the production size, and queries in several blocks."""
    monkeypatch.setattr(graph_ann, "QUERY_BLOCK", 40)
    r = np.random.default_rng(2)
    n = 2 * graph_ann.SHARD + 500
    centres = r.normal(size=(40, 32)) * 2
    x = (centres[r.integers(0, 40, n)] + r.normal(size=(n, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], "x") for i in range(n)], SCHEMA)
    got = graph_ann.nearest(df).collect()
    y, hit = x.astype(float), 0
    queries = range(0, n, 100)
    for q in queries:
        d = ((y - y[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += len({g.vec_id for g in got if g.query_id == q} & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert len(got) == 10 * len(queries) and hit >= 0.9 * len(got)
