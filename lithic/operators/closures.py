"""Closures and modules: ancestors, slots, owners, exports, orders."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names as N
from .graphs import ancestors, graph_of, settle

KEY = ["bundle_id", "function_id"]


def lineage(parents: DataFrame, most: int = 12) -> DataFrame:
    """bundle_id, function_id, ancestor, level from closure_parents(bundle_id, child, parent)."""
    tag = lambda c: F.struct(F.col("bundle_id").alias("b"), F.col(c).alias("f"))
    found = ancestors(parents.select(tag("child").alias("c"), tag("parent").alias("p")), "c", "p", most)
    return found.select(F.col("node.b").alias("bundle_id"), F.col("node.f").alias("function_id"), F.col("ancestor.f").alias("ancestor"), "level")


def module_of(functions: DataFrame, modules: DataFrame, parents: DataFrame, most: int = 64) -> DataFrame:
    """Each function's module: its own if it is a factory, else that of its nearest ancestor that is one; null for orphans."""
    factory = modules.select("bundle_id", F.col("function_id").alias("_f"), "module_id")
    own = functions.select(*KEY, F.col("function_id").alias("ancestor"), F.lit(0).alias("level"))
    line = own.unionByName(lineage(parents, most).select(*KEY, "ancestor", "level"))
    hit = line.join(factory, (line["bundle_id"] == factory["bundle_id"]) & (F.col("ancestor") == F.col("_f"))).select(line["bundle_id"], "function_id", "level", "module_id")
    nearest = hit.groupBy(*KEY).agg(F.min_by("module_id", F.struct("level", "module_id")).alias("module_id"))
    return functions.select(*KEY).join(nearest, KEY, "left")


def slot_view(slots: DataFrame, parents: DataFrame, most: int = 12) -> DataFrame:
    """Slots that each function sees: its own at their level, an ancestor's one level higher for each step; key packs both."""
    own = slots.select("bundle_id", "function_id", "level", "slot", "kind", "value")
    seen = lineage(parents, most).join(slots.withColumnRenamed("function_id", "ancestor").withColumnRenamed("level", "_l"), ["bundle_id", "ancestor"])
    above = seen.select("bundle_id", "function_id", (F.col("_l") + F.col("level")).alias("level"), "slot", "kind", "value")
    every = own.unionByName(above).withColumn("key", N.slot_key(F.col("level"), F.col("slot")))
    nearest = Window.partitionBy(*KEY, "key").orderBy("level", F.coalesce("value", F.lit("")))
    return every.withColumn("_r", F.row_number().over(nearest)).where("_r = 1").drop("_r")


def resolve_placeholders(reads: DataFrame, view: DataFrame) -> DataFrame:
    """reads(…, name) with the slot value that a closure_L_S name stands for, else the name."""
    level, slot = N.placeholder_slot(F.col("name"))
    marked = reads.withColumn("key", N.slot_key(level, slot))
    return marked.join(view.select(*KEY, "key", F.col("value").alias("_v")), [*KEY, "key"], "left").withColumn("resolved", F.coalesce("_v", "name")).drop("_v", "key")


def captured(uses: DataFrame, parents: DataFrame, most: int = 64) -> DataFrame:
    """bundle_id, function_id, names used anywhere below it, sorted and comma-joined."""
    below = lineage(parents, most).join(uses, KEY).select("bundle_id", F.col("ancestor").alias("function_id"), "name").distinct()
    return below.groupBy(*KEY).agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("names"))


def scope_of(creators: DataFrame, rounds: int = 32) -> DataFrame:
    """bundle_id, scope, root, status of scopes with the set of scopes that create them (creators: bundle_id, scope, creator).

    A scope has a parent only if all its creators agree; chains are followed to their root, cycles end unresolved.
    """
    agreed = creators.groupBy("bundle_id", "scope").agg(F.min("creator").alias("parent"), F.countDistinct("creator").alias("n"))
    state = settle(agreed.select("bundle_id", "scope", F.when(F.col("n") == 1, F.col("parent")).alias("root"), F.when(F.col("n") > 1, "conflict").alias("status")))
    step = agreed.where("n = 1").select("bundle_id", F.col("scope").alias("_s"), F.col("parent").alias("_p"))
    bad = state.where("status = 'conflict'").select("bundle_id", F.col("scope").alias("_s"), F.lit(True).alias("_bad"))
    for _ in range(rounds):
        moved = state.join(step, (state["bundle_id"] == step["bundle_id"]) & (F.col("root") == F.col("_s")), "left").select(state["bundle_id"], "scope", F.coalesce("_p", "root").alias("root"), "status", F.col("_p").isNotNull().alias("_moved"))
        state = settle(moved)
        if not state.where("_moved").limit(1).count():
            break
    # What still moves after so many rounds goes round.
    cyclic = F.col("_moved")
    final = state.join(bad, (state["bundle_id"] == bad["bundle_id"]) & (F.col("root") == F.col("_s")), "left")
    status = F.when(F.col("status").isNotNull(), F.col("status")).when(cyclic, "cycle").when(F.col("_bad"), "through conflict").otherwise("resolved")
    return final.select(state["bundle_id"], "scope", F.when(status == "resolved", F.col("root")).alias("root"), status.alias("status"))


def factory_roles(param_count: Column) -> Column:
    """Positions of a module factory's parameters by their number (without this)."""
    at = lambda **k: F.struct(*[F.lit(k.get(n)).cast("int").alias(n) for n in ("global_", "require", "import_default", "import_all", "module", "exports", "dependency_map")])
    return (
        F.when(param_count >= 7, at(global_=0, require=1, import_default=2, import_all=3, module=4, exports=5, dependency_map=6))
        .when(param_count == 6, at(require=0, import_default=1, import_all=2, module=3, exports=4, dependency_map=5))
        .when(param_count == 5, at(global_=0, require=1, module=2, exports=3, dependency_map=4))
        .when(param_count == 4, at(require=0, module=1, exports=2, dependency_map=3))
    )


def list_modules(modules: DataFrame, deps: DataFrame, exports: DataFrame, limit: int) -> DataFrame:
    """The first modules by id, with dependencies in order and the number of exports."""
    k = ["bundle_id", "module_id"]
    first = modules.orderBy("bundle_id", "module_id").limit(limit)
    d = deps.groupBy(*k).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "dep_id"))), lambda x: x["dep_id"].cast("string")), ",").alias("dependencies"))
    e = exports.groupBy(*k).agg(F.count(F.lit(1)).alias("n_exports"))
    return first.join(d, k, "left").join(e, k, "left").select(*k, "name", F.coalesce("dependencies", F.lit("")).alias("dependencies"), F.coalesce("n_exports", F.lit(0)).alias("n_exports"))


def resolve_dependency(reads: DataFrame, deps: DataFrame) -> DataFrame:
    """reads(bundle_id, module_id, index) with the absolute id behind dependencyMap[index]."""
    return reads.join(deps.select("bundle_id", "module_id", F.col("ordinal").alias("index"), "dep_id"), ["bundle_id", "module_id", "index"], "left")


def topological(deps: DataFrame, modules: DataFrame) -> DataFrame:
    """bundle_id, module_id, position: dependencies before dependents, smallest id first; cycles in id order."""

    def run(key: tuple, m: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        ids = sorted({*map(int, m["module_id"])})
        graph = graph_of(d.rename(columns={"module_id": "src", "dep_id": "dst"}).sort_values("ordinal")) if len(d) else {}
        known, seen, out = set(ids), set(), []
        for root in ids:
            stack = [(root, iter(sorted(x for x in graph.get(root, ()) if x in known)))] if root not in seen else []
            seen.add(root)
            while stack:
                node, rest = stack[-1]
                nxt = next((x for x in rest if x not in seen), None)
                if nxt is None:
                    out.append(node)
                    stack.pop()
                else:
                    seen.add(nxt)
                    stack.append((nxt, iter(sorted(x for x in graph.get(nxt, ()) if x in known))))
        return pd.DataFrame({"bundle_id": key[0], "module_id": out, "position": range(len(out))})

    return modules.groupBy("bundle_id").cogroup(deps.groupBy("bundle_id")).applyInPandas(run, "bundle_id string, module_id long, position long")


def levels(deps: DataFrame, modules: DataFrame) -> DataFrame:
    """bundle_id, module_id, level: the longest chain of dependencies below; null within cycles. Kahn's algorithm per bundle."""

    def run(key: tuple, m: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        ids = sorted({*map(int, m["module_id"])})
        known = set(ids)
        needs = {i: set() for i in ids}
        users: dict = {i: set() for i in ids}
        for a, b in zip(d["module_id"], d["dep_id"], strict=True) if len(d) else ():
            if int(a) in known and int(b) in known:
                needs[int(a)].add(int(b))
                users[int(b)].add(int(a))
        level = {}
        ready = [(0, i) for i in ids if not needs[i]]
        heapq.heapify(ready)
        left = {i: len(needs[i]) for i in ids}
        while ready:
            n, i = heapq.heappop(ready)
            level[i] = n
            for u in users[i]:
                left[u] -= 1
                if not left[u]:
                    heapq.heappush(ready, (max(level[x] for x in needs[u]) + 1, u))
        return pd.DataFrame({"bundle_id": key[0], "module_id": ids, "level": pd.array([level.get(i) for i in ids], dtype="Int64")})

    return modules.groupBy("bundle_id").cogroup(deps.groupBy("bundle_id")).applyInPandas(run, "bundle_id string, module_id long, level long")


def name_from_single_export(exports: DataFrame) -> DataFrame:
    """Modules with exactly one export that says something name themselves by it."""
    says = exports.where(~F.col("export_name").isin("default", "__esModule") & ~N.is_generic_module(F.col("export_name")) & ~N.begins_with_verb(F.col("export_name")))
    one = says.groupBy("bundle_id", "module_id").agg(F.min("export_name").alias("name"), F.countDistinct("export_name").alias("_n"))
    return one.where("_n = 1").drop("_n")


def candidates(statements: DataFrame, functions: DataFrame) -> DataFrame:
    """Functions with a name that says nothing whose body is a known small shape: noop, identity, constant_returner, string_decoder.

    statements(…, ordinal, kind, value): kinds return_param, return_constant, call_decode, string, other.
    """
    count = lambda k: F.count_if(F.col("kind") == k)
    per = statements.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), *[count(k).alias(k) for k in ("return_param", "return_constant", "call_decode")], F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "string", F.struct("ordinal", "value")))), lambda x: x["value"]), 1, 8).alias("sample"))
    role = F.when(F.coalesce("n", F.lit(0)) == 0, "noop").when((F.col("n") == 1) & (F.col("return_param") == 1), "identity").when((F.col("n") == 1) & (F.col("return_constant") == 1), "constant_returner").when(F.col("call_decode") > 0, "string_decoder")
    unnamed = functions.where(F.col("name").isNull() | N.is_generic_param(F.col("name")))
    return unnamed.join(per, KEY, "left").withColumn("role", role).where("role IS NOT NULL").select(*KEY, "name", "role", F.coalesce("sample", F.array().cast("array<string>")).alias("sample"))


def apply_names(functions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """functions with confirmed names put in, and whether that changed anything."""
    sure = verdicts.where("verdict = 'confirmed'").select("function_id", F.col("name").alias("_new")).dropDuplicates(["function_id"])
    named = functions.join(sure, "function_id", "left")
    changed = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("name"))
    return named.withColumn("changed", changed).withColumn("name", F.coalesce("_new", "name")).drop("_new")
