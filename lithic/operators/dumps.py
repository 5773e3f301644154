"""Structural dumps over the fact tables of bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

KINDS = ("strings", "functions", "identifiers", "bigints", "regexps", "shapes", "cjs-modules", "sections")
ALIASES = {"string": "strings", "function": "functions", "identifier": "identifiers", "bigint": "bigints", "regexp": "regexps", "regex": "regexps", "shape": "shapes", "cjs": "cjs-modules", "section": "sections"}


def table_kind(name: str) -> str:
    """The kind a user means: case and `_` do not matter, singulars are known."""
    kind = name.strip().lower().replace("_", "-")
    kind = ALIASES.get(kind, kind)
    if kind not in KINDS:
        raise ValueError(f"unknown table {name!r}; one of {', '.join(KINDS)}")
    return kind


def dump_strings(strings: DataFrame) -> DataFrame:
    return strings.select("bundle_id", "string_id", "value", F.when(F.col("is_identifier"), "identifier").otherwise("string").alias("kind"), "is_utf16")


def function_names(functions: DataFrame, strings: DataFrame) -> DataFrame:
    """functions with name; a missing or empty one is null."""
    names = strings.select("bundle_id", F.col("string_id").alias("name_id"), F.nullif(F.col("value"), F.lit("")).alias("name"))
    return functions.join(names, ["bundle_id", "name_id"], "left")


def dump_functions(functions: DataFrame, strings: DataFrame) -> DataFrame:
    named = function_names(functions, strings)
    return named.select("bundle_id", "function_id", F.coalesce("name", F.concat(F.lit("f"), F.col("function_id").cast("string"))).alias("name"), "param_count", "frame_size", "size", "offset")


def banner(functions: DataFrame, strings: DataFrame, handlers: DataFrame) -> DataFrame:
    """One line about each function: registers are parameters and frame, saturating at 32 bits."""
    counts = handlers.groupBy("bundle_id", "function_id").agg(F.count(F.lit(1)).alias("handlers"))
    named = function_names(functions, strings).join(counts, ["bundle_id", "function_id"], "left")
    flags = F.concat_ws(",", F.when(F.col("is_strict"), "strict"), F.when(F.col("overflowed"), "overflowed"), F.when(F.col("prohibit_construct"), "no-construct"))
    regs = F.least(F.col("param_count") + F.col("frame_size"), F.lit(4294967295))
    line = F.format_string(
        "%s params=%d frame=%d regs=%d size=%d offset=%d flags=%s handlers=%d",
        F.coalesce("name", F.lit("<anonymous>")), "param_count", "frame_size", regs, "size", "offset", flags, F.coalesce("handlers", F.lit(0).cast("long")),
    )
    return named.select("bundle_id", "function_id", line.alias("info"))


def regexp_sources(tables: DataFrame, instructions: DataFrame, strings: DataFrame, opcode: str = "CreateRegExp") -> DataFrame:
    """bundle_id, regexp_id, pattern, flags of the first creating instruction, by function and offset, both of whose strings resolve."""
    op = lambda k: F.col("operands")[k]["val_i"]
    made = instructions.where((F.col("name") == opcode) & (F.size("operands") >= 4)).select("bundle_id", "function_id", "offset", op(1).alias("p"), op(2).alias("f"), op(3).alias("regexp_id"))
    text = strings.select("bundle_id", "string_id", "value")
    both = made.join(text.select("bundle_id", F.col("string_id").alias("p"), F.col("value").alias("pattern")), ["bundle_id", "p"]).join(text.select("bundle_id", F.col("string_id").alias("f"), F.col("value").alias("flags")), ["bundle_id", "f"])
    first = both.groupBy("bundle_id", "regexp_id").agg(F.min_by(F.struct("pattern", "flags"), F.struct("function_id", "offset")).alias("s"))
    every = tables.where(F.col("table") == "reg_exp").select("bundle_id", F.col("ordinal").alias("regexp_id"), F.col("first").alias("offset"), F.col("second").alias("length"))
    return every.join(first, ["bundle_id", "regexp_id"], "left").select("bundle_id", "regexp_id", "offset", "length", "s.pattern", "s.flags")


def jump_labels(instructions: DataFrame) -> DataFrame:
    """bundle_id, function_id, offset of every place that needs a label: jump targets and what follows a jump, return or throw."""
    jump = F.col("name").startswith("J")
    target = F.filter("operands", lambda o: o["ty"].startswith("Addr"))[0]["val_i"]
    targets = instructions.where(jump).select("bundle_id", "function_id", (F.col("offset") + target).alias("offset"))
    after = instructions.where(jump | F.col("name").isin("Ret", "Throw")).select("bundle_id", "function_id", (F.col("offset") + F.col("length")).alias("offset"))
    return targets.union(after).distinct().join(instructions.select("bundle_id", "function_id", "offset"), ["bundle_id", "function_id", "offset"], "left_semi")


def disassembly(instructions: DataFrame, strings: DataFrame) -> DataFrame:
    """bundle_id, function_id, text: each function's lines in order, labels and string operands shown.

    String operands are looked up by a join of exploded operands; a function's lines meet in one row, as a function's text must.
    """
    at = instructions.select("bundle_id", "function_id", "offset", F.posexplode("operands").alias("k", "o"))
    text = strings.select("bundle_id", F.col("string_id").alias("_s"), "value")
    is_string = F.col("o.ty").isin("UInt8S", "UInt16S", "UInt32S")
    shown = at.join(text, (at["bundle_id"] == text["bundle_id"]) & is_string & (F.col("o.val_i") == F.col("_s")), "left")
    value = F.when(F.col("value").isNotNull(), F.concat(F.lit('"'), T.escape_js(F.col("value")), F.lit('"'))).when(F.col("o.ty").startswith("Reg"), F.concat(F.lit("r"), F.col("o.val_i").cast("string"))).otherwise(F.coalesce(F.col("o.val_i").cast("string"), F.col("o.val_f").cast("string")))
    args = shown.groupBy(at["bundle_id"], at["function_id"], at["offset"]).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", value.alias("v")))), lambda x: x["v"]), ", ").alias("args"))
    labels = jump_labels(instructions).withColumn("label", F.lit(True))
    key = ["bundle_id", "function_id", "offset"]
    lines = instructions.join(args, key, "left").join(labels, key, "left")
    line = F.concat(F.when(F.col("label"), F.concat(F.lit("L"), F.col("offset").cast("string"), F.lit(":\n"))).otherwise(""), F.lit("  "), F.col("name"), F.when(F.coalesce("args", F.lit("")) != "", F.concat(F.lit(" "), F.col("args"))).otherwise(""))
    return lines.groupBy("bundle_id", "function_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def diagnostics(bundles: DataFrame) -> DataFrame:
    return bundles.select("bundle_id", F.explode("diagnostics").alias("d")).select("bundle_id", "d.code", "d.detail")


def is_clean(bundles: DataFrame) -> DataFrame:
    return bundles.select("bundle_id", (F.size("diagnostics") == 0).alias("clean"))


def at_file_offset(functions: DataFrame, offsets: DataFrame) -> DataFrame:
    """offsets(bundle_id, at) with the function whose body holds them."""
    from .rows import in_interval

    bodies = functions.select("bundle_id", "function_id", F.col("offset").alias("s"), (F.col("offset") + F.col("size")).alias("e"))
    return in_interval(offsets, bodies, ["bundle_id"], "at", "s", "e", 4096).select("bundle_id", "at", "function_id", (F.col("at") - F.col("s")).alias("body_offset"))


def slice_of(buffer: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end), clamped to the buffer."""
    low = F.least(start, F.octet_length(buffer))
    return F.substring(buffer, (low + 1).cast("int"), F.greatest(F.least(end, F.octet_length(buffer)) - low, F.lit(0)).cast("int"))
