"""Graph operators: fixpoints as iterated joins over tables cut from their lineage; orders and flow as grouped maps."""

from __future__ import annotations

import uuid
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where it is unset, one beside the session's warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-scratch"


def settle(df: DataFrame) -> DataFrame:
    """A written table in place of a growing plan."""
    path = f"{scratch(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reach(edges: DataFrame, roots: DataFrame, max_depth: int | None = None, key: tuple[str, ...] = ()) -> DataFrame:
    """node, depth of everything at most max_depth hops from a root, roots at 0; edges(src, dst), roots(node).

    A frontier at a time: each round joins the frontier only, and an anti join keeps what is new.
    """
    edges = settle(edges.select(*key, "src", "dst").distinct())
    seen = settle(roots.select(*key, "node").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.select(*key, F.col("node").alias("src")).join(edges, [*key, "src"]).select(*key, F.col("dst").alias("node")).distinct()
        frontier = settle(step.join(seen, [*key, "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen


def unreached(nodes: DataFrame, reached: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    return nodes.join(reached.select(*key, "node"), [*key, "node"], "left_anti")


def adjacency(edges: DataFrame, src: str, dst: str, out: str) -> DataFrame:
    return edges.groupBy(src).agg(F.array_join(F.transform(F.sort_array(F.collect_set(dst)), lambda x: x.cast("string")), ",").alias(out))


def ancestors(parents: DataFrame, child: str, parent: str, most: int = 12) -> DataFrame:
    """child, ancestor, level up to `most` levels; cycles end at the bound."""
    step = parents.select(F.col(child).alias("_c"), F.col(parent).alias("_p"))
    level = parents.where(F.col(parent).isNotNull()).select(F.col(child).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("level"))
    out = level
    for k in range(2, most + 1):
        level = settle(level.join(step, F.col("ancestor") == F.col("_c")).where(F.col("_p").isNotNull()).select("node", F.col("_p").alias("ancestor"), F.lit(k).alias("level")))
        if not level.limit(1).count():
            break
        out = out.unionByName(level)
    return out


def copy_names(names: DataFrame, links: DataFrame, generic, rounds: int = 20, most_fans: int = 8) -> DataFrame:
    """node, name after copying names along links(src, dst) to unnamed nodes until nothing changes.

    A name meant for more than most_fans empty nodes in one round is not applied; of several the smallest wins.
    """
    names = settle(names.select("node", "name"))
    for _ in range(rounds):
        given = names.where(F.col("name").isNotNull() & ~generic(F.col("name"))).select(F.col("node").alias("src"), F.col("name").alias("_new"))
        empty = names.where(F.col("name").isNull()).select(F.col("node").alias("dst"))
        queued = links.join(given, "src").join(empty, "dst").groupBy("dst").agg(F.min("_new").alias("_new"))
        fans = queued.groupBy("_new").agg(F.count(F.lit(1)).alias("_fans")).where(F.col("_fans") <= most_fans)
        applied = settle(queued.join(fans, "_new", "left_semi"))
        if not applied.limit(1).count():
            break
        names = settle(names.join(applied.withColumnRenamed("dst", "node"), "node", "left").select("node", F.coalesce("name", "_new").alias("name")))
    return names


def graph_of(rows: pd.DataFrame) -> dict[int, list[int]]:
    out: dict[int, list[int]] = defaultdict(list)
    for s, d in zip(rows["src"], rows["dst"], strict=True):
        out[int(s)].append(int(d))
    return out


def depth_first(graph: dict[int, list[int]], roots: list[int]) -> list[int]:
    """Post-order, roots and callees in the order given; cycles are cut where they close."""
    seen: set[int] = set()
    out: list[int] = []
    for root in roots:
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(graph.get(root, ())))]
        while stack:
            node, rest = stack[-1]
            for n in rest:
                if n not in seen:
                    seen.add(n)
                    stack.append((n, iter(graph.get(n, ()))))
                    break
            else:
                out.append(node)
                stack.pop()
    return out


def post_order(edges: DataFrame, key: str) -> DataFrame:
    """key, node, position: depth-first post-order of each key's graph, from the smallest ids. One group is one program."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["src", "ordinal"])
        order = depth_first(graph_of(rows), sorted({*map(int, rows["src"]), *map(int, rows["dst"])}))
        return pd.DataFrame({key: rows[key].iloc[0], "node": order, "position": range(len(order))})

    return edges.groupBy(key).applyInPandas(run, f"{key} {edges.schema[key].dataType.simpleString()}, node long, position long")


def dependency_tree(edges: DataFrame, key: str, root: int, max_depth: int) -> DataFrame:
    """key, ordinal, depth, node: first expansions in depth-first order; a node met again is a leaf."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        graph = graph_of(rows.sort_values(["src", "ordinal"]))
        out, seen, stack = [], set(), [(root, 0)]
        while stack:
            node, depth = stack.pop()
            out.append((rows[key].iloc[0], len(out), depth, node))
            if node in seen or depth >= max_depth:
                continue
            seen.add(node)
            stack += [(n, depth + 1) for n in reversed(graph.get(node, []))]
        return pd.DataFrame(out, columns=[key, "ordinal", "depth", "node"])

    return edges.groupBy(key).applyInPandas(run, f"{key} {edges.schema[key].dataType.simpleString()}, ordinal long, depth long, node long")


def immediate_dominators(graph: dict[int, list[int]], root: int) -> dict[int, int]:
    """node -> immediate dominator of everything that root reaches, root -> root; linear memory.

    The published iterative scheme: in reverse post-order, a node's dominator is where the chains of its processed
    predecessors meet, until nothing changes.
    """
    order = depth_first(graph, [root])
    rank = {n: k for k, n in enumerate(order)}
    before: dict[int, list[int]] = defaultdict(list)
    for s in order:
        for d in graph.get(s, ()):
            before[d].append(s)
    up = {root: root}
    changed = True
    while changed:
        changed = False
        for n in reversed(order[:-1]):
            meet = None
            for p in before[n]:
                if p not in up:
                    continue
                a, b = p, p if meet is None else meet
                while a != b:
                    if rank[a] < rank[b]:
                        a = up[a]
                    else:
                        b = up[b]
                meet = a
            if up.get(n) != meet:
                up[n], changed = meet, True
    return up


def dominates(up: dict[int, int], a: int, b: int) -> bool:
    while b in up and b != a and up[b] != b:
        b = up[b]
    return a == b


def dominator_tree(edges: DataFrame, key: str, root: int) -> DataFrame:
    """key, node, dominator: the immediate one of each node that root reaches (root's own is root)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        up = immediate_dominators(graph_of(rows), root)
        return pd.DataFrame({key: rows[key].iloc[0], "node": list(up), "dominator": list(up.values())})

    return edges.groupBy(key).applyInPandas(run, f"{key} {edges.schema[key].dataType.simpleString()}, node long, dominator long")


def dominators(edges: DataFrame, key: str, root: int) -> DataFrame:
    """key, node, dominator: all dominators of each node that root reaches, itself among them (see dominator_tree for one each)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        up, out = immediate_dominators(graph_of(rows), root), []
        for n in up:
            out.append((n, n))
            at = n
            while up[at] != at:
                at = up[at]
                out.append((n, at))
        return pd.DataFrame([(rows[key].iloc[0], *x) for x in out], columns=[key, "node", "dominator"])

    return edges.groupBy(key).applyInPandas(run, f"{key} {edges.schema[key].dataType.simpleString()}, node long, dominator long")


def loops(edges: DataFrame, key: str, root: int) -> DataFrame:
    """key, header, latch, node: the body of each back edge's natural loop."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        graph = graph_of(rows)
        up = immediate_dominators(graph, root)
        before: dict[int, set[int]] = defaultdict(set)
        for s, v in graph.items():
            for d in v:
                before[d].add(s)
        out = []
        for latch in sorted(n for n in graph if n in up):
            for header in sorted(set(graph[latch])):
                if dominates(up, header, latch):
                    body, todo = {header, latch}, [latch] if latch != header else []
                    while todo:
                        for p in before[todo.pop()]:
                            if p not in body and p in up:
                                body.add(p)
                                todo.append(p)
                    out += [(rows[key].iloc[0], header, latch, n) for n in sorted(body)]
        return pd.DataFrame(out, columns=[key, "header", "latch", "node"])

    return edges.groupBy(key).applyInPandas(run, f"{key} {edges.schema[key].dataType.simpleString()}, header long, latch long, node long")


def dataflow(facts: DataFrame, edges: DataFrame, key: str, transfer, forward: bool = True, most: int = 16) -> DataFrame:
    """key, block, before, after: sets that flow along edges to a fixpoint, joined by union; facts(key, block, …).

    transfer(row of facts, set that flows in) gives the set that flows out. Blocks that nothing reaches contribute the
    empty set. At most `most` rounds over a program's blocks, beyond which the sets found so far stand.
    """

    def run(k: tuple, b: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        feeds: dict[int, list[int]] = defaultdict(list)
        for s, d in zip(e["src"], e["dst"], strict=True):
            feeds[int(d if forward else s)].append(int(s if forward else d))
        rows = {int(r["block"]): r for r in b.to_dict("records")}
        into, out = {n: set() for n in rows}, {n: set() for n in rows}
        for _ in range(most):
            changed = False
            for n in sorted(rows, reverse=not forward):
                into[n] = set().union(*(out.get(p, set()) for p in feeds[n]))
                new = set(transfer(rows[n], into[n]))
                changed, out[n] = changed or new != out[n], new
            if not changed:
                break
        return pd.DataFrame({key: k[0], "block": list(rows), "before": [sorted(into[n]) for n in rows], "after": [sorted(out[n]) for n in rows]})

    kind = facts.schema[key].dataType.simpleString()
    return facts.groupBy(key).cogroup(edges.groupBy(key)).applyInPandas(run, f"{key} {kind}, block long, before array<string>, after array<string>")


def liveness(blocks: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """key, block, live_in, live_out; blocks(key, block, uses, defs): uses are those before any definition in the block."""

    def run(k: tuple, b: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        graph = graph_of(e)
        use = {int(n): set(u) for n, u in zip(b["block"], b["uses"], strict=True)}
        define = {int(n): set(u) for n, u in zip(b["block"], b["defs"], strict=True)}
        into: dict[int, set] = {n: set() for n in use}
        out: dict[int, set] = {n: set() for n in use}
        changed = True
        while changed:
            changed = False
            for n in sorted(use, reverse=True):
                after = set().union(*(into.get(s, set()) for s in graph.get(n, ())))
                new = use[n] | (after - define[n])
                if new != into[n] or after != out[n]:
                    into[n], out[n], changed = new, after, True
        return pd.DataFrame({key: k[0], "block": list(use), "live_in": [sorted(into[n]) for n in use], "live_out": [sorted(out[n]) for n in use]})

    kind = blocks.schema[key].dataType.simpleString()
    return blocks.groupBy(key).cogroup(edges.groupBy(key)).applyInPandas(run, f"{key} {kind}, block long, live_in array<string>, live_out array<string>")


def reaching_definitions(blocks: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """key, block, variable, defined_in: definitions that reach a block's entry; blocks(key, block, defs)."""

    def run(k: tuple, b: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        graph = graph_of(e)
        define = {int(n): set(d) for n, d in zip(b["block"], b["defs"], strict=True)}
        into: dict[int, set] = {n: set() for n in define}
        todo = sorted(define)
        while todo:
            n = todo.pop(0)
            out = {(v, w) for v, w in into[n] if v not in define[n]} | {(v, n) for v in define[n]}
            for s in graph.get(n, ()):
                if s in into and not out <= into[s]:
                    into[s] |= out
                    todo.append(s)
        rows = [(k[0], n, v, w) for n in sorted(into) for v, w in sorted(into[n])]
        return pd.DataFrame(rows, columns=[key, "block", "variable", "defined_in"])

    kind = blocks.schema[key].dataType.simpleString()
    return blocks.groupBy(key).cogroup(edges.groupBy(key)).applyInPandas(run, f"{key} {kind}, block long, variable string, defined_in long")
