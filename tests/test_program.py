import pytest

from lithic.operators import graphs, program
from lithic.functions import names as N

OPS = "array<struct<ty:string,val_i:bigint,val_f:double>>"
CODE = f"bundle_id string, function_id long, offset long, name string, operands {OPS}"


def r(ty, v):
    return (ty, v, None)


def test_call_edges_through_copies_and_redefinitions(spark):
    rows = [
        ("b", 0, 0, "CreateClosure", [r("Reg8", 1), r("Reg8", 0), r("UInt16", 7)]),
        ("b", 0, 5, "Mov", [r("Reg8", 2), r("Reg8", 1)]),
        ("b", 0, 8, "Call1", [r("Reg8", 3), r("Reg8", 2)]),
        ("b", 0, 12, "CreateClosure", [r("Reg8", 2), r("Reg8", 0), r("UInt16", 8)]),
        ("b", 0, 17, "Call1", [r("Reg8", 3), r("Reg8", 2)]),
        ("b", 0, 21, "Call1", [r("Reg8", 3), r("Reg8", 2)]),
        ("b", 0, 25, "LoadConstInt", [r("Reg8", 2), r("Imm32", 5)]),
        ("b", 0, 30, "Call1", [r("Reg8", 3), r("Reg8", 2)]),
        ("b", 1, 0, "Call1", [r("Reg8", 3), r("Reg8", 2)]),
        ("c", 0, 4, "Call1", [r("Reg8", 3), r("Reg8", 1)]),
    ]
    got = sorted(map(tuple, program.call_edges(spark.createDataFrame(rows, CODE)).collect()))
    assert got == [("b", 0, 8, 7), ("b", 0, 17, 8), ("b", 0, 21, 8)]
    assert program.call_edges(spark.createDataFrame([], CODE)).collect() == []


def test_module_registry(spark):
    def define(at, function, module, name):
        return [
            ("b", 0, at, "TryGetById", [r("Reg8", 4), r("Reg8", 0), r("UInt8", 1), r("UInt16S", name)]),
            ("b", 0, at + 6, "CreateClosure", [r("Reg8", 5), r("Reg8", 0), r("UInt16", function)]),
            ("b", 0, at + 11, "LoadConstInt", [r("Reg8", 6), r("Imm32", module)]),
            ("b", 0, at + 17, "Call3", [r("Reg8", 1), r("Reg8", 4), r("Reg8", 0), r("Reg8", 5), r("Reg8", 6)]),
        ]

    rows = define(0, 3, 100, 0) + define(30, 4, 101, 0) + define(60, 9, 100, 0) + define(90, 5, 102, 1)
    strings = spark.createDataFrame([("b", 0, "__d"), ("b", 1, "other")], "bundle_id string, string_id long, value string")
    got = sorted(map(tuple, program.module_registry(spark.createDataFrame(rows, CODE), strings).collect()))
    assert got == [("b", 100, 3), ("b", 101, 4)]


def test_wide_ids(spark):
    rows = [("b", 530, 1), ("b", 4739766416, 2), ("b", 15714428054, 3), ("b", 4739766416, 4), ("b", 0xF0000001, 5)]
    got = {x.id: x.dense_id for x in program.interned(spark.createDataFrame(rows, "bundle string, id long, at int"), "bundle", "id", ["at"]).collect()}
    assert got == {530: 530, 4739766416: 0xF0000000, 15714428054: 0xF0000001, 0xF0000001: 0xF0000002}


def test_selection_and_tree(spark):
    functions = spark.createDataFrame([("b", 1), ("b", 2)], "bundle_id string, function_id long")
    assert program.selected_functions(functions, [2], None, None).count() == 1
    with pytest.raises(ValueError, match="no function 9"):
        program.selected_functions(functions, [2, 9], None, None)
    tree = spark.createDataFrame([("b", 0, 0, 5), ("b", 1, 1, 6), ("b", 2, 2, 7), ("b", 3, 1, 7)], "key string, ordinal long, depth long, node long")
    assert program.rendered_tree(tree, "key", tree["node"].cast("string")).first().text == "5\n  6\n    7\n  7"


def brute_names(names, links, rounds=20, most=8):
    names = dict(names)
    for _ in range(rounds):
        queued = {}
        for s, d in links:
            if names.get(s) is not None and names.get(d, 0) is None:
                queued[d] = min(queued.get(d, names[s]), names[s])
        fans = {}
        for n in queued.values():
            fans[n] = fans.get(n, 0) + 1
        applied = {d: n for d, n in queued.items() if fans[n] <= most}
        if not applied:
            break
        names |= applied
    return names


def test_names_spread_to_a_fixpoint(spark):
    names = [(k, "login" if k == 0 else "basket" if k == 20 else None) for k in range(40)]
    links = [(k, k + 1) for k in range(12)] + [(20, 21 + k) for k in range(9)] + [(3, 39), (39, 3)]
    got = {x.node: x.name for x in graphs.copy_names(spark.createDataFrame(names, "node long, name string"), spark.createDataFrame(links, "src long, dst long"), N.is_generic_param).collect()}
    assert got == brute_names(names, links)
    assert got[12] == "login" and got[25] is None and got[39] == "login"


def brute_dominators(links, root):
    def reached(without):
        seen, todo = set(), [] if without == root else [root]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += [d for s, d in links if s == n and d != without]
        return seen

    every = reached(None)
    strict = {n: {d for d in every if d != n and n not in reached(d)} for n in every}
    return {n: max(strict[n], key=lambda d: len(strict[d])) if strict[n] else n for n in every}


def test_flow_of_random_graphs_equals_brute_force(spark):
    import random

    r = random.Random(4)
    links = {f"g{g}": sorted({(r.randrange(9), r.randrange(9)) for _ in range(14)} | {(0, 1)}) for g in range(6)}
    rows = [(g, s, d, d) for g, v in links.items() for s, d in v]
    edges = spark.createDataFrame(rows, "bundle string, src long, dst long, ordinal long")
    got = {(x.bundle, x.node): x.dominator for x in graphs.dominator_tree(edges, "bundle", 0).collect()}
    assert got == {(g, n): d for g, v in links.items() for n, d in brute_dominators(v, 0).items()}
    back = {(x.bundle, x.header, x.latch) for x in graphs.loops(edges, "bundle", 0).collect()}
    over = {g: brute_dominators(v, 0) for g, v in links.items()}

    def above(up, n):
        return {n} if up[n] == n else {n} | above(up, up[n])

    assert back == {(g, d, s) for g, v in links.items() for s, d in v if s in over[g] and d in above(over[g], s)}

    blocks = spark.createDataFrame([(g, n, [f"v{n % 3}"] if n % 2 else []) for g in links for n in range(9)], "bundle string, block long, defs array<string>")
    flow = graphs.dataflow(blocks, edges.drop("ordinal"), "bundle", lambda row, seen: {x for x in seen if x.split("@")[0] not in set(row["defs"])} | {f"{d}@{row['block']}" for d in row["defs"]}, most=50)
    found = {(x.bundle, x.block, *v.split("@")) for x in flow.collect() for v in x.before}
    same = {(x.bundle, x.block, x.variable, str(x.defined_in)) for x in graphs.reaching_definitions(blocks, edges.drop("ordinal"), "bundle").collect()}
    assert found == same


def test_numbers_of_a_hot_key(spark):
    from lithic.operators import rows

    df = spark.createDataFrame([("" if k % 3 else "x", k * 7) for k in range(900)], "name string, id long")
    got = {(x.name, x.id): x.k for x in rows.numbered(df, ["name"], "id", "k").collect()}
    for name in ("", "x"):
        assert [got[name, i] for i in sorted(i for n, i in got if n == name)] == list(range(1, sum(n == name for n, _ in got) + 1))
    assert rows.numbered(df.limit(0), ["name"], "id", "k").collect() == []


def test_cache_answer_meets_facts_once_in_parts_that_follow_the_rows(spark, monkeypatch):
    """Two parents on a level, a slot hidden by an own one, a repeated slot, unknown and null ids; one shuffle by function after the lineage."""
    parents = spark.createDataFrame([("b", 3, 2), ("b", 3, 9), ("b", 2, 1), ("c", 3, 1), ("b", 7, None)], "bundle_id string, child long, parent long")
    slots = spark.createDataFrame([("b", 1, 0, 5, "v", "x"), ("b", 2, 0, 5, "v", "y"), ("b", 2, 0, 5, "v", "z"), ("b", 3, 1, 5, "v", "own"), ("b", 9, 0, 6, "v", "w"), ("b", 2, 0, None, "v", "n"), ("b", None, 0, 1, "v", "n")], "bundle_id string, function_id long, level int, slot long, kind string, value string")
    ids = spark.createDataFrame([("b", 3), ("b", 3), ("b", 2), ("b", 8), ("c", 3), ("b", None), ("b", 7)], "bundle_id string, function_id long")
    monkeypatch.setattr(program, "ROWS_A_PART", 1)
    found = program.cache_answer(ids, parents, slots)
    want = [("b", 3, "2,9,1", 1, 4), ("b", 2, "1", 3, 3), ("b", 8, "", 0, 0), ("c", 3, "1", 0, 0), ("b", None, "", 0, 0), ("b", 7, "", 0, 0)]
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, want))
    assert found.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
