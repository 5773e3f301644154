import itertools
import random
import tracemalloc

import pytest

from lithic.llm import group_join


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words)} if len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows]
    up = {k: k for k in range(len(sets))}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, (_, x)), (b, (_, y)) in itertools.combinations(enumerate(sets), 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


def corpus(seed, n):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    passage = [r.choice(vocab) + "p" for _ in range(40)]
    rows, bases = [], [[r.choice(vocab) for _ in range(r.choice([1, 2, 5, 12, 30, 80, 200]))] for _ in range(12)]
    for i in range(n):
        words = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 8])):
            words[r.randrange(len(words))] = r.choice(vocab)
        if r.random() < 0.3:
            words += passage
        rows.append((i, " ".join(words)))
    return [*rows, (n, ""), (n + 1, None), (n + 2, " \t\n"), (n + 3, "A b"), (n + 4, "a B"), (n + 5, rows[3][1]), (n + 5, rows[3][1])]


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, width, percent):
    rows = corpus(width, 220)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in group_join.similar_documents(df, width, percent).collect())
    assert got == brute(rows, width, percent)


def test_empty_and_blank_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert group_join.similar_documents(df).collect() == []
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, group_join.similar_documents(df).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_keep_one(spark):
    rows = [(1, "a b c d e f g h", "x"), (2, "a b c d e f g h", "y"), (3, "other words that stand alone here", "x"), (3, "other words that stand alone here", "x"), (4, None, None), (5, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    got = group_join.keep_one(df.withColumnRenamed("_id", "d"))
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 4, 5]
    assert got.columns == ["doc_id", "text", "d"]


def test_keep_one_tells_texts_of_one_id_apart(spark):
    copied, alone = "a b c d e f g h", "other words that stand alone here"
    df = spark.createDataFrame([(1, copied), (2, copied), (2, alone), (3, alone)], "doc_id long, text string")
    assert sorted(map(tuple, group_join.keep_one(df).collect())) == [(1, copied), (2, alone)]


def prefixes_meet(a, b, percent):
    found = []
    for x in (a, b):
        sig, cls, spare = group_join.signatures(x, percent)
        rows = sorted(zip(cls.tolist(), sig.tolist(), spare.tolist(), strict=True))
        kept = set()
        for c in set(cls.tolist()):
            own = [r for r in rows if r[0] == c]
            kept |= {r[1] for r in own[own[0][2] :]}  # any one order of all blocks serves
        found.append(kept)
    return found[0] & found[1]


def test_pigeonhole_never_misses():
    r = random.Random(5)
    for percent in (80, 90):
        for _ in range(150):
            n = r.randrange(1, 120)
            x = [f"{r.random()}" for _ in range(n)]
            a = group_join.np.unique(group_join.np.array([hash(v) & (2**64 - 1) for v in x], group_join.U))
            most = (100 - percent) * len(a) // percent
            extra = group_join.np.array([r.getrandbits(64) for _ in range(r.randrange(0, most + 1))], group_join.U)
            b = group_join.np.unique(group_join.np.concatenate([a, extra]))
            if 100 * len(a) >= percent * len(b):
                assert prefixes_meet(a, b, percent)


def test_bitmap_is_whole_and_small_on_the_driver(spark):
    np, bits = group_join.np, 23
    values = group_join.mix(np.arange(200_000, dtype=group_join.U)).view(np.int64)
    df = spark.createDataFrame([(int(v),) for v in values], "v long")
    low = values.view(group_join.U) & group_join.U((1 << bits) - 1)
    wanted = np.zeros(1 << (bits - 6), group_join.U)
    np.bitwise_or.at(wanted, (low >> group_join.U(6)).astype(np.int64), group_join.U(1) << (low & group_join.U(63)))
    tracemalloc.start()
    got = group_join.bitmap(df, "v", bits)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == wanted).all() and peak < 8 * got.nbytes
    assert not group_join.bitmap(df.limit(0), "v", bits).any()


def test_many_pairs_are_not_broadcast(spark, monkeypatch):
    """Above the bound, pairs and tokens are shuffled; the same links come of it."""
    asked, matched = [], group_join.matched
    monkeypatch.setattr(group_join, "matched", lambda left, key, right: asked.append(key) or matched(left, key, right))
    pairs = group_join.cut(spark.range(300_000).selectExpr("id AS a", "id + 300000 AS b"))
    tokens = group_join.cut(spark.range(600_000).selectExpr("id AS d", "array(id % 300000, if(id % 3 = 0, id, 0)) AS tokens"))
    found = group_join.verified(pairs, tokens, 90)
    assert asked == ["a", "b"]
    assert found.count() == found.where("b = a + 300000 AND a % 3 <> 0").count() == 200_000
