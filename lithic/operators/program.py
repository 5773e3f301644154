"""Facts derived from instructions: which register holds what, call edges, module registry, hints, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names as N
from ..functions import text as T
from .closures import lineage

KEY = ["bundle_id", "function_id"]
#: Instructions whose first operand is read, not written.
READERS = ("Ret", "Throw", "StoreToEnvironment", "PutById", "PutByVal", "PutNewOwnById", "PutOwnByIndex")
#: Rows of parents and slots, about, for which cache_answer makes a part.
ROWS_A_PART = 250_000


def operand(k: int) -> Column:
    return F.try_element_at("operands", F.lit(k + 1))["val_i"]


def definitions(instructions: DataFrame) -> DataFrame:
    """bundle_id, function_id, register, offset, name, operands of each instruction that writes its first operand."""
    writes = F.try_element_at("operands", F.lit(1))["ty"].startswith("Reg") & ~F.col("name").isin(*READERS) & ~F.col("name").startswith("J")
    return instructions.where(writes).select(*KEY, operand(0).alias("register"), "offset", "name", "operands")


def held_at(reads: DataFrame, defs: DataFrame) -> DataFrame:
    """reads(bundle_id, function_id, register, at, …) with def: the last definition of the register before at, or null.

    Both sides are laid in one order per register and the last definition is carried forward: one shuffle, no range join.
    """
    rest = [c for c in reads.columns if c not in (*KEY, "register", "at")]
    d = defs.select(*KEY, "register", F.col("offset").alias("at"), F.struct("offset", "name", "operands").alias("_def"), F.lit(1).alias("_o"))
    r = reads.select(*KEY, "register", "at", F.struct(F.lit(True).alias("_is"), *rest).alias("_row"), F.lit(0).alias("_o"))  # a read comes before a write at one place
    both = d.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*KEY, "register").orderBy("at", "_o").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("def", F.last("_def", ignorenulls=True).over(w)).where("_row IS NOT NULL")
    return carried.select(*KEY, "register", "at", *[F.col(f"_row.{c}").alias(c) for c in rest], "def")


def call_edges(instructions: DataFrame, closure: str = "CreateClosure", copy: str = "Mov", steps: int = 4) -> DataFrame:
    """bundle_id, caller, offset, callee of calls whose callee register holds a closure, through up to `steps` copies.

    Multi-edges are kept. CreateClosure writes (register, environment, function); calls are (register, callee, …).
    """
    defs = definitions(instructions)
    todo = instructions.where(F.col("name").startswith("Call")).select(*KEY, operand(1).alias("register"), F.col("offset").alias("at"), F.col("offset").alias("call"))
    found = None
    for _ in range(steps):
        seen = held_at(todo, defs)
        hit = seen.where(F.col("def.name").startswith(closure)).select("bundle_id", F.col("function_id").alias("caller"), F.col("call").alias("offset"), F.col("def.operands")[2]["val_i"].alias("callee"))
        found = hit if found is None else found.unionByName(hit)
        todo = seen.where(F.col("def.name").startswith(copy)).select(*KEY, F.col("def.operands")[1]["val_i"].alias("register"), F.col("def.offset").alias("at"), "call")
    return found


def builtin_calls(instructions: DataFrame, versions: DataFrame, builtins: DataFrame) -> DataFrame:
    """bundle_id, function_id, offset, builtin, name of calls of builtins; the table is the one of versions.table_version.

    An index that the table does not hold has a null name. versions is what sources.bundles.table_version gives.
    """
    calls = instructions.where(F.col("name").isin("CallBuiltin", "CallBuiltinLong", "GetBuiltinClosure")).select(*KEY, "offset", operand(1).alias("builtin"))
    names = builtins.select(F.col("version").alias("table_version"), F.col("builtin").cast("long").alias("builtin"), F.col("name"))
    return calls.join(versions.select("bundle_id", "table_version"), "bundle_id", "left").join(names, ["table_version", "builtin"], "left").select(*KEY, "offset", "builtin", "name")


def module_registry(instructions: DataFrame, strings: DataFrame, define: str = "__d") -> DataFrame:
    """bundle_id, module_id, function_id, array_offset: calls define(factory, id, …) whose function, factory and id are known.

    The called register comes from a property or global read named `define`; the factory from a closure, the id from a
    number. Of several definitions of one id the first in code order stands.
    """
    defs = definitions(instructions)
    calls = instructions.where(F.col("name").startswith("Call") & (F.size("operands") >= 5)).select(*KEY, F.col("offset").alias("call"), *[operand(k).alias(n) for k, n in ((1, "callee"), (3, "factory"), (4, "id"))])

    def value_of(column: str, out: str, wanted: Column, value: Column) -> DataFrame:
        seen = held_at(calls.select(*KEY, F.col(column).alias("register"), F.col("call").alias("at"), "call"), defs)
        return seen.where(wanted).select(*KEY, "call", value.alias(out))

    names = strings.where(F.col("value") == define).select("bundle_id", F.col("string_id").alias("_s"))
    last = F.element_at("def.operands", -1)["val_i"]
    called = value_of("callee", "_s", F.col("def.name").rlike("^(Try)?GetById"), last).join(names, ["bundle_id", "_s"])
    factory = value_of("factory", "factory_id", F.col("def.name").startswith("CreateClosure"), F.col("def.operands")[2]["val_i"])
    number = value_of("id", "module_id", F.col("def.name").startswith("LoadConst"), last)
    rows = called.drop("_s").join(factory, [*KEY, "call"]).join(number, [*KEY, "call"])
    first = rows.groupBy("bundle_id", "module_id").agg(F.min_by("factory_id", F.struct("function_id", "call")).alias("function_id"))
    return first.select("bundle_id", "module_id", "function_id")


def param_hints(hints: DataFrame) -> DataFrame:
    """bundle_id, function_id, param, name: the first semantic hint in order, else the first hint by type."""
    order = F.struct((F.col("kind") != "semantic").cast("int"), F.col("ordinal"))
    return hints.where("name IS NOT NULL").groupBy(*KEY, "param").agg(F.min_by("name", order).alias("name"))


def error_hints(throws: DataFrame) -> DataFrame:
    """bundle_id, function_id, param, words: the words of a thrown message, where one parameter alone is named beside it."""
    one = throws.where(F.size(F.array_distinct("params")) == 1)
    words = F.filter(F.split(F.lower("message"), "[^a-z0-9]+"), lambda w: w != "")
    return one.select(*KEY, F.col("params")[0].alias("param"), words.alias("words")).distinct()


def reaching_binding(bindings: DataFrame, key: list[str], name: str, definition: str) -> DataFrame:
    """key, name, definition: the one definition that reaches, or null where there are many."""
    seen = bindings.groupBy(*key, name).agg(F.min(definition).alias("_lo"), F.max(definition).alias("_hi"))
    return seen.select(*key, name, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias(definition), (F.col("_lo") != F.col("_hi")).alias("many"))


def last_definition(df: DataFrame, key: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """The last value assigned before each row, null before the first."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def interned(ids: DataFrame, key: str, id_: str, order: list[str], out: str = "dense_id") -> DataFrame:
    """key, id, dense: ids that do not fit 32 bits (or fall in the range of the dense ones) get dense ids by first sight.

    Fixed values: dense ids start at 0xF0000000.
    """
    base = 0xF0000000
    first = ids.groupBy(key, id_).agg(F.min(F.struct(*order)).alias("_first"))
    wide = first.where(F.col(id_) >= base).withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy("_first")) - 1 + F.lit(base))
    return wide.select(key, id_, out).unionByName(first.where(F.col(id_) < base).select(key, id_, F.col(id_).alias(out)))


def grouped_by_module(functions: DataFrame, module_of: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bundle_id, module_id, function_id) of the functions that no other contains, by module; (bundle_id, function_id) of orphans."""
    top = functions.join(parents.select("bundle_id", F.col("child").alias("function_id")), KEY, "left_anti")
    placed = top.select(*KEY).join(module_of, KEY, "left")
    return placed.where("module_id IS NOT NULL").select("bundle_id", "module_id", "function_id"), placed.where("module_id IS NULL").select(*KEY)


def module_rows(modules: DataFrame, query: str) -> DataFrame:
    """Modules whose label (the name, or module_<id>) holds the query in either case."""
    label = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.concat(F.lit("module_"), F.col("module_id").cast("string")))
    return modules.withColumn("label", label).where(T.contains_ignoring_case(F.col("label"), query))


def selected_functions(functions: DataFrame, ids: list[int] | None, module_of: DataFrame | None, chosen: DataFrame | None) -> DataFrame:
    """By id, each of which must exist, or those of the chosen modules (orphans have none); all if neither is given."""
    if ids is not None:
        found = functions.where(F.col("function_id").isin(*ids))
        have = {r[0] for r in found.select("function_id").distinct().collect()}  # at most the ids given
        if missing := sorted(set(ids) - have):
            raise ValueError(f"no function {missing[0]}")
        return found
    if module_of is None or chosen is None:
        return functions
    return functions.join(module_of.join(chosen.select("bundle_id", "module_id").distinct(), ["bundle_id", "module_id"], "left_semi").select(*KEY), KEY, "left_semi")


def cache_answer(ids: DataFrame, parents: DataFrame, slots: DataFrame, most: int = 12) -> DataFrame:
    """For ids(bundle_id, function_id): the chain of parents, how many slots are its own and how many it sees."""
    line = lineage(parents, most).select(*KEY, "ancestor", "level")
    held = slots.select("bundle_id", F.col("function_id").alias("ancestor"), F.col("level").alias("_l"), "slot")
    above = line.join(held, ["bundle_id", "ancestor"]).select(*KEY, N.slot_key(F.col("_l") + F.col("level"), F.col("slot")).alias("key"))

    def part(df: DataFrame, what: str, a: Column, b: Column) -> DataFrame:
        return df.select(*KEY, F.lit(what).alias("what"), a.cast("long").alias("a"), b.cast("long").alias("b"))

    none = F.lit(None)
    own = part(slots, "own", N.slot_key(F.col("level"), F.col("slot")), none)
    known = part(line, "chain", F.col("level"), F.col("ancestor")).unionByName(own).unionByName(part(above, "above", F.col("key"), none)).dropna(subset=KEY)
    facts = known.unionByName(part(ids, "asked", none, none))
    # A function's facts meet once, in as many parts as keep a part's rows near ROWS_A_PART at any size.
    parts = max(parents.sparkSession.sparkContext.defaultParallelism, (line.count() + slots.count()) // ROWS_A_PART + 1)
    met = facts.repartition(parts, *KEY)
    has = lambda *k: F.col("what").isin(*k)
    keys = F.size(F.collect_set(F.when(has("own", "above"), F.struct("a"))))
    chain = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(has("chain"), F.struct("a", "b")))), lambda x: x["b"].cast("string")), ",")
    found = met.groupBy(*KEY).agg(F.max(has("asked")).alias("_asked"), chain.alias("chain"), F.count_if(has("own")).alias("own"), keys.alias("seen"))
    return found.where("_asked").select(*KEY, "chain", "own", F.col("seen").cast("long").alias("seen"))


def rendered_tree(tree: DataFrame, key: str, name: Column) -> DataFrame:
    """key, text of tree(key, ordinal, depth, …): a line a node, two blanks a level."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int")), name)
    return tree.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def capped(df: DataFrame, order: list, most: int) -> DataFrame:
    """The first rows of a report."""
    return df.orderBy(*order).limit(most)


def samples(df: DataFrame, key: list[str], order: list[str], value: str, most: int = 8) -> DataFrame:
    """key, sample: the first values of a key in order; only those are gathered."""
    w = Window.partitionBy(*key).orderBy(*order)
    first = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    return first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", value))), lambda x: x[value]).alias("sample"))
