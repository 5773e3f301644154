"""Aggregations over program facts: votes, guards, unique names, censuses, proposals, secrets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names as N


def vote_names(sites: DataFrame, fn: str, pos: str, name: str) -> DataFrame:
    """fn, pos, name: the most frequent name that says something, callback roles only for want of others.

    Ties go to the smaller name; a name chosen again at a later position gets a number.
    """
    counted = sites.where(F.col(name).isNotNull() & ~N.is_generic_param(F.col(name))).groupBy(fn, pos, name).agg(F.count(F.lit(1)).alias("_n"))
    best = Window.partitionBy(fn, pos).orderBy(N.is_callback_role(F.col(name)).cast("int"), F.desc("_n"), name)
    chosen = counted.withColumn("_r", F.row_number().over(best)).where("_r = 1")
    again = F.row_number().over(Window.partitionBy(fn, name).orderBy(pos))
    return chosen.select(fn, pos, F.when(again == 1, F.col(name)).otherwise(F.concat(F.col(name), again.cast("string"))).alias(name))


def fan_out_guard(queued: DataFrame, name: str, most: int = 8) -> DataFrame:
    """Rows whose name is queued at most so often."""
    counts = queued.groupBy(name).agg(F.count(F.lit(1)).alias("_fans")).where(F.col("_fans") <= most)
    return queued.join(counts, name, "left_semi")


def finalize_stems(modules: DataFrame, id_: str, name: str, truth: Column, most: int = 4) -> DataFrame:
    """id, name: generic names and names of actions are dropped, as are stems that more than `most` modules share;
    of the others that collide the best keeps the stem (ground truth first, then the smallest id), the rest lose it."""
    kept = F.when(N.is_generic_module(F.col(name)) | (N.begins_with_verb(F.col(name)) & ~truth), None).otherwise(F.col(name))
    every = modules.select(id_, kept.alias(name), truth.alias("_truth"))
    rows = every.where(F.col(name).isNotNull())  # the many without a name meet in no window
    w = Window.partitionBy(name)
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("_truth"), id_)))
    final = F.when(F.col("_n") <= 1, F.col(name)).when((F.col("_n") > most) & ~F.col("_truth"), None).when(F.col("_r") == 1, F.col(name))
    return rows.select(id_, final.alias(name)).unionByName(every.where(F.col(name).isNull()).select(id_, name))


def make_unique(df: DataFrame, scope: str, order: str, base: str, out: str = "unique_name") -> DataFrame:
    """Within scope, in order: the base if free, else the smallest free number from 2 on after it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        taken, given, found = set(), {}, []
        for b in rows[base]:
            name = b
            if name in taken:
                k = given.get(b, 2)
                while (name := f"{b}{k}") in taken:
                    k += 1
                given[b] = k + 1
            taken.add(name)
            found.append(name)
        return rows.assign(**{out: found})

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{out}` string"])
    return df.groupBy(scope).applyInPandas(run, schema)


def numbered(df: DataFrame, scope: str, order: str, base: str, out: str = "unique_name") -> DataFrame:
    """Like make_unique where no base ends in a digit: then a plain row number gives the same."""
    k = F.row_number().over(Window.partitionBy(scope, base).orderBy(order))
    return df.withColumn(out, F.when(k == 1, F.col(base)).otherwise(F.concat(F.col(base), k.cast("string"))))


def group_children(parents: DataFrame, child: str, parent: str, out: str = "children") -> DataFrame:
    return parents.groupBy(parent).agg(F.array_join(F.transform(F.sort_array(F.collect_list(child)), lambda x: x.cast("string")), ",").alias(out))


def fingerprint(strings: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, n, digest of the values in order: per-part digests first, so no group's texts meet in one place."""
    each = strings.select(key, F.col(order).alias("_o"), F.sha2(F.coalesce(F.col(value), F.lit("")), 256).alias("_h"))
    ordered = F.array_sort(F.collect_list(F.struct("_o", "_h")))
    return each.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(ordered, lambda s: s["_h"]), ","), 256).alias("digest"))


def rate(df: DataFrame, key: str, ok: Column) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("confirmed"), F.coalesce(F.round(F.count_if(ok) / F.nullif(F.count(F.lit(1)), F.lit(0)), 6), F.lit(0.0)).alias("rate"))


def slot_census(uses: DataFrame, owner: str, slot: str, name: str) -> DataFrame:
    """owner, slots, split: slots of an owner, and those that bear more than one name."""
    per = uses.groupBy(owner, slot).agg(F.countDistinct(name).alias("_names"))
    return per.groupBy(owner).agg(F.count(F.lit(1)).alias("slots"), F.count_if(F.col("_names") > 1).alias("split"))


def use_def_counts(df: DataFrame, key: list[str], is_def: Column) -> DataFrame:
    return df.groupBy(*key).agg(F.count_if(is_def).alias("defs"), F.count_if(~is_def).alias("uses"))


def verify_proposals(proposals: DataFrame, functions: DataFrame, bundle_ok: Column, version_ok: Column) -> DataFrame:
    """proposals(function_id, name, role) with the first reason against each, or confirmed.

    functions(function_id, roles): the roles that its body bears out.
    """
    known = proposals.join(functions.withColumn("_known", F.lit(True)), "function_id", "left")
    reason = (
        F.when(~version_ok, "version").when(~bundle_ok, "bundle").when(~N.is_valid_identifier(F.col("name")), "identifier").when(N.is_reserved(F.col("name")), "reserved")
        .when(F.col("_known").isNull(), "no such function").when(~F.array_contains("roles", F.col("role")), "role").otherwise("confirmed")
    )
    return known.select("function_id", "name", "role", reason.alias("verdict"))


#: (category, name, expression) of the reference-style scan; within what Java and RE2 read alike.
SECRET_PATTERNS = (
    ("cloud", "aws_access_key", "AKIA[0-9A-Z]{16}"),
    ("token", "json_web_token", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+"),
    ("token", "assigned_token", "(?i)(api_?key|secret|token|password)[\"' ]*[:=][\"' ]*[A-Za-z0-9+/_.-]{8,}"),
    ("key", "private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("url", "url", "https?://[A-Za-z0-9./?=_%:-]+"),
    ("mail", "mail", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"),
)


def scan_secrets(strings: DataFrame, id_: str, value: str, patterns: tuple = SECRET_PATTERNS) -> DataFrame:
    """One row for each string and pattern that hits: id, category, pattern_name, value, redacted.

    The patterns are one array of conditions in one pass over the strings: no join at all.
    """
    rows = [F.when(F.col(value).rlike(p), F.struct(F.lit(c).alias("category"), F.lit(n).alias("pattern_name"), F.regexp_extract(value, p, 0).alias("value"))) for c, n, p in patterns]
    hits = strings.select(F.col(id_), F.explode(F.array_compact(F.array(*rows))).alias("_h")).select(id_, "_h.*")
    return hits.withColumn("redacted", redacted(F.col("value")))


def redacted(c: Column) -> Column:
    return F.when(F.length(c) <= 8, "***").otherwise(F.concat(F.substring(c, 1, 4), F.lit("***"), F.right(c, F.lit(2))))


def quality_metrics(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Whole-word marker counts, lines and rows of each key."""
    count = lambda p: F.sum(F.regexp_count(text, F.lit(p))).cast("long")
    return texts.groupBy(key).agg(
        F.count(F.lit(1)).alias("texts"), count(r"\barg[0-9]+\b").alias("args"), count(r"\bclosure_[0-9]+\b").alias("closures"),
        count(r"\btmp[0-9]*\b").alias("temps"), count(r"\br[0-9]+\b").alias("registers"), F.sum(F.size(F.split(text, "\n"))).cast("long").alias("lines"),
    )


def resolve_filter(modules: DataFrame, id_: str, name: str, include_ranges, include_globs, subtree: DataFrame | None, exclude_ranges, exclude_globs) -> DataFrame:
    """Modules in any include (all, if there is none) and in no exclude."""
    from ..functions import text as T

    hit = lambda ranges, globs: T.in_ranges(F.col(id_), ranges) | _any(T.matches_glob(F.coalesce(F.col(name), F.lit("")), g) for g in globs)
    kept = modules
    if include_ranges or include_globs or subtree is not None:
        kept = modules.where(hit(include_ranges, include_globs))
        if subtree is not None:
            more = modules.join(subtree.select(F.col("node").alias(id_)), id_, "left_semi")
            kept = kept.unionByName(more).distinct()
    return kept.where(~hit(exclude_ranges, exclude_globs))


def _any(columns) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out
