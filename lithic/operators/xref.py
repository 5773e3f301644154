"""Cross references and name lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def xref_string(strings: DataFrame, uses: DataFrame, query: str, on: str = "value", key: tuple[str, ...] = ()) -> DataFrame:
    """uses rows (one each, however many operands match) of a string that holds query in either case.

    strings has one row per distinct value, uses refers to it by `on`; a semi join, whose side Spark picks by size.
    """
    hits = strings.where(F.lower(on).contains(query.lower())).select(*key, on).distinct()
    return uses.join(hits, [*key, on], "left_semi")


def xref_operand(uses: DataFrame, operands: str, types: tuple[str, ...], value: int) -> DataFrame:
    """Rows of which any operand of the given types equals value."""
    return uses.where(F.exists(operands, lambda o: o["ty"].isin(*types) & (o["val"] == value)))


def deep_search(names: DataFrame, hits: DataFrame, named: DataFrame, id_: str, name: str, query: str) -> DataFrame:
    """Names that hold the query, and names of what its cross references stand in; sorted, each once."""
    direct = names.where(F.lower(name).contains(query.lower())).select(name)
    found = named.join(hits.select(id_).distinct(), id_, "left_semi").select(name)
    return direct.union(found).distinct().orderBy(name)


def with_names(df: DataFrame, names: DataFrame, id_: str, name: str, fallback: Column) -> DataFrame:
    """Left join of names; a missing or empty one becomes fallback."""
    return df.join(names, id_, "left").withColumn(name, F.coalesce(F.when(F.col(name) != "", F.col(name)), fallback))


def unique_names(names: DataFrame, id_: str, name: str, key: tuple[str, ...] = ()) -> DataFrame:
    """Names that exactly one id bears, with it."""
    counted = names.groupBy(*key, name).agg(F.min(id_).alias(id_), F.countDistinct(id_).alias("_n"))
    return counted.where("_n = 1").drop("_n")


def name_index(names: DataFrame, id_: str, name: str) -> DataFrame:
    return names.groupBy(name).agg(F.sort_array(F.collect_set(id_)).alias("ids"))


def resolve(df: DataFrame, on: str, sources: list[tuple[DataFrame, str, str]], out: str) -> DataFrame:
    """The value of the first source, in order, that knows df's column `on`: (table, its key, its value)."""
    picks = []
    for k, (source, key, value) in enumerate(sources):
        df = df.join(source.select(F.col(key).alias(f"_k{k}"), F.col(value).alias(f"_v{k}")), F.col(on) == F.col(f"_k{k}"), "left")
        picks.append(F.col(f"_v{k}"))
    return df.withColumn(out, F.coalesce(*picks)).drop(*[f"_{c}{k}" for k in range(len(sources)) for c in "kv"])


def dependents(edges: DataFrame, src: str, dst: str, target: Column) -> DataFrame:
    return edges.where(F.col(dst) == target).select(src).distinct()


def division(have: DataFrame, required: DataFrame, owner: str, item: str, name: str, priority: str) -> DataFrame:
    """owner -> the first name, by priority, all of whose items the owner has."""
    need = required.groupBy(name, priority).agg(F.countDistinct(item).alias("_need"))
    got = have.select(owner, item).distinct().join(required, item).groupBy(owner, name, priority).agg(F.countDistinct(item).alias("_got"))
    full = got.join(need, [name, priority]).where("_got = _need")
    return full.groupBy(owner).agg(F.min_by(name, priority).alias(name))


def signature(have: DataFrame, signatures: DataFrame, owner: str, item: str, name: str, priority: str, least: str) -> DataFrame:
    """owner -> the first name, by priority, of whose items it has at least `least`."""
    got = have.select(owner, item).distinct().join(signatures, item).groupBy(owner, name, priority, least).agg(F.countDistinct(item).alias("_got"))
    return got.where(F.col("_got") >= F.col(least)).groupBy(owner).agg(F.min_by(name, priority).alias(name))
