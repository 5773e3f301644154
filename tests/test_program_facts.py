import pytest
from pyspark.sql import functions as F

from lithic.operators import closures, code, dumps

OPS = "operands array<struct<ty:string,val_i:bigint,val_f:double>>"


@pytest.fixture(scope="module")
def program(spark):
    r = lambda ty, v: (ty, v, None)
    rows = [
        ("b", 0, 0, 1, "LoadConstString", 4, [r("Reg8", 0), r("UInt16S", 1)]),
        ("b", 0, 4, 2, "JmpTrue", 3, [r("Addr8", 6), r("Reg8", 0)]),
        ("b", 0, 7, 3, "Ret", 2, [r("Reg8", 0)]),
        ("b", 0, 9, 4, "Nop", 1, []),
        ("b", 0, 10, 5, "CreateRegExp", 14, [r("Reg8", 1), r("UInt32S", 2), r("UInt32S", 3), r("UInt32", 0)]),
        ("b", 0, 24, 3, "Ret", 2, [r("Reg8", 1)]),
    ]
    instructions = spark.createDataFrame(rows, f"bundle_id string, function_id long, offset long, opcode int, name string, length int, {OPS}")
    strings = spark.createDataFrame([("b", k, v, False, True) for k, v in enumerate(["main", 'say "hi"', "a+", "gi"])], "bundle_id string, string_id long, value string, is_utf16 boolean, is_identifier boolean")
    functions = spark.createDataFrame([("b", 0, 0, 2, 3, 26, 100, 4, True, False, False), ("b", 1, 9, 1, 4294967295, 5, 126, 1, False, False, True)], "bundle_id string, function_id long, name_id long, param_count long, frame_size long, size long, offset long, flags int, is_strict boolean, overflowed boolean, prohibit_construct boolean")
    handlers = spark.createDataFrame([("b", 0, 0, 0, 7, 9)], "bundle_id string, function_id long, ordinal int, start long, `end` long, target long")
    return instructions, strings, functions, handlers


def test_dumps(program, spark):
    instructions, strings, functions, handlers = program
    assert dumps.table_kind("CJS_Modules") == "cjs-modules" and dumps.table_kind("regex") == "regexps"
    with pytest.raises(ValueError):
        dumps.table_kind("nothing")
    assert [r.name for r in dumps.dump_functions(functions, strings).orderBy("function_id").collect()] == ["main", "f1"]
    info = [r.info for r in dumps.banner(functions, strings, handlers).orderBy("function_id").collect()]
    assert info[0] == "main params=2 frame=3 regs=5 size=26 offset=100 flags=strict handlers=1" and "regs=4294967295" in info[1] and info[1].startswith("<anonymous>")
    text = dumps.disassembly(instructions, strings).first().text
    assert text.split("\n") == ["  LoadConstString r0, \"say \\\"hi\\\"\"", "  JmpTrue 6, r0", "L7:", "  Ret r0", "L9:", "  Nop", "L10:", "  CreateRegExp r1, \"a+\", \"gi\", 0", "  Ret r1"]
    tables = spark.createDataFrame([("b", "reg_exp", 0, 0, 8), ("b", "reg_exp", 1, 8, 9)], "bundle_id string, table string, ordinal long, first long, second long")
    assert {(r.regexp_id, r.pattern, r.flags) for r in dumps.regexp_sources(tables, instructions, strings).collect()} == {(0, "a+", "gi"), (1, None, None)}
    spots = spark.createDataFrame([("b", 100), ("b", 125), ("b", 126), ("b", 999)], "bundle_id string, at long")
    assert {(r["at"], r.function_id, r.body_offset) for r in dumps.at_file_offset(functions, spots).collect()} == {(100, 0, 0), (125, 0, 25), (126, 1, 0)}
    cut = spark.createDataFrame([(bytearray(b"abc"), 1, 9), (bytearray(b"abc"), 7, 9)], "b binary, s int, e int").select(dumps.slice_of(F.col("b"), F.col("s"), F.col("e")).alias("x")).collect()
    assert [bytes(r.x) for r in cut] == [b"bc", b""]


def test_control_flow(program):
    instructions, _, _, handlers = program
    cfg = code.blocks(instructions, handlers)
    assert [(r.block_id, r.start, r.end) for r in cfg.orderBy("block_id").collect()] == [(0, 0, 7), (1, 7, 9), (2, 9, 10), (3, 10, 26)]
    assert {(r.src, r.dst, r.kind) for r in code.edges(instructions, cfg, handlers).collect()} == {(0, 3, "jump"), (0, 1, "fall"), (2, 3, "fall"), (0, 2, "exception")}


def test_values(spark):
    assert code.fold("<<", 1, 31) == -2147483648.0 and code.fold(">>>", -1, 0) == 4294967295.0 and code.fold("|", 4294967296.0 + 5, 0) == 5.0
    assert code.fold("/", 1, -0.0) == float("-inf") and str(code.fold("%", 5, 0)) == "nan" and code.fold("%", -5, 3) == -2.0 and code.fold("<", 1, 2) is True
    rows = [("b", 0, 0, "a", None, None, None, 2.0), ("b", 0, 1, "c", "mov", "a", None, None), ("b", 0, 2, "d", "+", "a", "c", None), ("b", 0, 3, "e", "*", "d", "x", None), ("b", 0, 4, "t", None, None, None, 1.0), ("b", 0, 5, "t", None, None, None, 2.0)]
    assigns = spark.createDataFrame(rows, "bundle_id string, function_id long, ordinal long, dst string, op string, left string, right string, number double")
    assert {(r.dst, r.value) for r in code.propagate_constants(assigns).collect()} == {("a", 2.0), ("c", 2.0), ("d", 4.0)}
    reads = spark.createDataFrame([("b", 0, "a"), ("b", 0, "a"), ("b", 0, "d")], "bundle_id string, function_id long, name string")
    kept = spark.createDataFrame([("b", 0, "e")], "bundle_id string, function_id long, name string")
    assert {r.dst for r in code.dead_stores(assigns, reads, kept).collect()} == {"c", "t"}
    assert {r.dst for r in code.single_use(assigns, reads).collect()} == {"d"}
    d = spark.createDataFrame([("b", 0, 1, k) for k in (0, 4, 9)], "bundle_id string, function_id long, register long, definition long")
    r = spark.createDataFrame([("b", 0, 1, [0, 4]), ("b", 0, 1, [9])], "bundle_id string, function_id long, register long, seen array<long>")
    assert {(x.definition, x.range) for x in code.live_ranges(d, r).collect()} == {(0, 0), (4, 0), (9, 1)}


def test_closures(spark):
    parents = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("b", 9, 8), ("b", 8, 9)], "bundle_id string, child long, parent long")
    functions = spark.createDataFrame([("b", k) for k in (1, 2, 3, 4, 8, 9)], "bundle_id string, function_id long")
    modules = spark.createDataFrame([("b", 100, 1, "app"), ("b", 101, 4, None)], "bundle_id string, module_id long, function_id long, name string")
    assert {r.function_id: r.module_id for r in closures.module_of(functions, modules, parents).collect()} == {1: 100, 2: 100, 3: 100, 4: 101, 8: None, 9: None}
    slots = spark.createDataFrame([("b", 1, 0, 0, "function", "login", None), ("b", 2, 0, 0, "constant", "x", None)], "bundle_id string, function_id long, level int, slot int, kind string, value string, ref_function long")
    view = closures.slot_view(slots, parents)
    assert {(r.function_id, r.level, r.value) for r in view.collect()} == {(1, 0, "login"), (2, 0, "x"), (2, 1, "login"), (3, 1, "x"), (3, 2, "login")}
    reads = spark.createDataFrame([("b", 3, "closure_2_0"), ("b", 3, "closure_0_0"), ("b", 3, "plain")], "bundle_id string, function_id long, name string")
    assert {r.name: r.resolved for r in closures.resolve_placeholders(reads, view).collect()} == {"closure_2_0": "login", "closure_0_0": "closure_0_0", "plain": "plain"}
    assert {r.function_id: r.names for r in closures.captured(spark.createDataFrame([("b", 3, "q"), ("b", 2, "p")], "bundle_id string, function_id long, name string"), parents).collect()} == {1: "p,q", 2: "q"}
    creators = spark.createDataFrame([("b", 2, 1), ("b", 2, 1), ("b", 3, 2), ("b", 4, 1), ("b", 4, 2), ("b", 5, 4), ("b", 7, 8), ("b", 8, 7)], "bundle_id string, scope long, creator long")
    got = {r.scope: (r.root, r.status) for r in closures.scope_of(creators, 8).collect()}
    assert got == {2: (1, "resolved"), 3: (1, "resolved"), 4: (None, "conflict"), 5: (None, "through conflict"), 7: (None, "cycle"), 8: (None, "cycle")}


def test_modules(spark):
    modules = spark.createDataFrame([("b", 0, 1, "app"), ("b", 1, 2, "utils"), ("b", 2, 3, "core"), ("b", 15714428054, 4, "wide")], "bundle_id string, module_id long, function_id long, name string")
    deps = spark.createDataFrame([("b", 0, 0, 1), ("b", 0, 1, 2), ("b", 1, 0, 2)], "bundle_id string, module_id long, ordinal int, dep_id long")
    exports = spark.createDataFrame([("b", 0, "default", 1), ("b", 1, "format", 11), ("b", 1, "getX", 12), ("b", 2, "Core", 3), ("b", 2, "Other", 3)], "bundle_id string, module_id long, export_name string, function_id long")
    got = closures.list_modules(modules, deps, exports, 2).orderBy("module_id").collect()
    assert [(r.name, r.dependencies, r.n_exports) for r in got] == [("app", "1,2", 1), ("utils", "2", 2)]
    assert [r.module_id for r in closures.topological(deps, modules).orderBy("position").collect()] == [2, 1, 0, 15714428054]
    assert {r.module_id: r.level for r in closures.levels(deps, modules).collect()} == {0: 2, 1: 1, 2: 0, 15714428054: 0}
    assert {(r.module_id, r.name) for r in closures.name_from_single_export(exports).collect()} == {(1, "format")}
    roles = [r[0] for r in spark.createDataFrame([(k,) for k in (3, 4, 5, 6, 7)], "n int").select(closures.factory_roles(F.col("n"))).collect()]
    assert roles[0] is None and roles[1].exports == 2 and roles[2].global_ == 0 and roles[3].dependency_map == 5 and roles[4].import_all == 3
    reads = spark.createDataFrame([("b", 0, 1), ("b", 0, 7)], "bundle_id string, module_id long, index int")
    assert {(r["index"], r.dep_id) for r in closures.resolve_dependency(reads, deps).collect()} == {(1, 2), (7, None)}


def test_proposals(spark):
    functions = spark.createDataFrame([("b", 1, None), ("b", 2, "f"), ("b", 3, "arg1"), ("b", 4, "tmp"), ("b", 5, None)], "bundle_id string, function_id long, name string")
    statements = spark.createDataFrame([("b", 2, 0, "return_param", None), ("b", 3, 0, "return_constant", None), ("b", 4, 0, "string", "s1"), ("b", 4, 1, "call_decode", None), ("b", 5, 0, "other", None)], "bundle_id string, function_id long, ordinal int, kind string, value string")
    got = {r.function_id: (r.role, r.sample) for r in closures.candidates(statements, functions).collect()}
    assert got == {1: ("noop", []), 3: ("constant_returner", []), 4: ("string_decoder", ["s1"])}
    verdicts = spark.createDataFrame([(1, "noop", "confirmed"), (2, "g", "role")], "function_id long, name string, verdict string")
    assert {r.function_id: (r.name, r.changed) for r in closures.apply_names(functions, verdicts).collect()}[1] == ("noop", True)
