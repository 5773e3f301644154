"""Questions to debug facts: names of registers, lists of names, listings, lines of instructions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import as_of


def variable_map(function_scopes: DataFrame, scopes: DataFrame) -> DataFrame:
    """bundle_id, function_id, register, name: the names of a function's own scope; a place without name has no row."""
    names = scopes.select("bundle_id", "scope_offset", F.posexplode("names").alias("register", "name")).where("name <> ''")
    return function_scopes.join(names, ["bundle_id", "scope_offset"]).select("bundle_id", "function_id", "register", "name")


def variable_names(scopes: DataFrame) -> DataFrame:
    """bundle_id, name, uses: each name of a bundle's scopes once."""
    return scopes.select("bundle_id", F.explode("names").alias("name")).where("name <> ''").groupBy("bundle_id", "name").agg(F.count(F.lit(1)).alias("uses"))


def listing(scopes: DataFrame, callees: DataFrame, *kinds: str) -> DataFrame:
    """bundle_id, kind, place, text of the kinds asked for, of 'scopes', 'callees' and 'vars'; of all, if none is."""
    parent = F.coalesce(F.col("parent_offset").cast("string"), F.lit("none"))
    parts = {
        "scopes": scopes.select("bundle_id", F.lit("scopes").alias("kind"), F.col("scope_offset").alias("place"), F.format_string("parent %s, flags %d: %s", parent, F.col("flags"), F.array_join("names", ", ")).alias("text")),
        "callees": callees.select("bundle_id", F.lit("callees").alias("kind"), F.col("address").alias("place"), F.col("name").alias("text")),
        "vars": variable_names(scopes).select("bundle_id", F.lit("vars").alias("kind"), F.lit(None).cast("long").alias("place"), F.col("name").alias("text")),
    }
    if unknown := set(kinds) - set(parts):
        raise ValueError(f"no such listing: {sorted(unknown)}")
    first, *others = (parts[k] for k in parts if not kinds or k in kinds)
    for other in others:
        first = first.unionByName(other)
    return first


def located(instructions: DataFrame, locations: DataFrame) -> DataFrame:
    """instructions with line and column of the last location not after them; null where a function has none."""
    last = locations.groupBy("bundle_id", "function_id", "bytecode_offset").agg(F.max_by(F.struct("line", "column"), "ordinal").alias("_l"))
    last = last.select("bundle_id", "function_id", "bytecode_offset", "_l.line", "_l.column")
    return as_of(instructions, last, ["bundle_id", "function_id"], "offset", "bytecode_offset", ["line", "column"])
