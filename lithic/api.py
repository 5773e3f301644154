"""One place to ask a set of bundles questions; every answer is a DataFrame."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names as N
from .functions import text as T
from .ir import text as program_text
from .operators import code, debug, diff, dumps, facts, program, rows, xref
from .sources import bundles


class Bundles:
    """Fact tables of the images under path, read when they are first asked for."""

    def __init__(self, spark: SparkSession, path: str, opcodes: str | None = None, layout: str | None = None):
        self.spark, self.tables = spark, bundles.read_bundles(spark, path, layout)
        self.opcodes = bundles.opcode_tables(spark, opcodes) if opcodes else None

    @cached_property
    def instructions(self) -> DataFrame:
        if self.opcodes is None:
            raise ValueError("decoding instructions needs opcode tables")
        return bundles.instructions(self.tables["bodies"], self.opcodes)

    def info(self) -> DataFrame:
        return self.tables["bundles"]

    def dump(self, kind: str) -> DataFrame:
        kind = dumps.table_kind(kind)
        if kind == "strings":
            return dumps.dump_strings(self.tables["strings"])
        if kind == "functions":
            return dumps.dump_functions(self.tables["functions"], self.tables["strings"])
        if kind == "identifiers":
            return self.tables["strings"].where("is_identifier").select("bundle_id", "string_id", "value")
        if kind == "sections":
            return self.tables["sections"]
        name = {"bigints": "big_int", "regexps": "reg_exp", "shapes": "obj_shapes", "cjs-modules": "cjs_modules"}[kind]
        return self.tables["pair_tables"].where(F.col("table") == name)

    def xref(self, query: str, limit: int = 100, offset: int = 0) -> DataFrame:
        """Instructions with a string operand that holds query, with their function's name; one page of them."""
        strings = self.tables["strings"].where(T.contains_ignoring_case(F.col("value"), query)).select("bundle_id", F.col("string_id").alias("val"))
        ops = self.instructions.select("bundle_id", "function_id", "offset", "name", F.explode("operands").alias("o")).where(F.col("o.ty").isin("UInt8S", "UInt16S", "UInt32S"))
        hits = ops.select("bundle_id", "function_id", "offset", F.col("name").alias("opcode"), F.col("o.val_i").alias("val")).join(strings, ["bundle_id", "val"], "left_semi").drop("val").distinct()
        named = dumps.dump_functions(self.tables["functions"], self.tables["strings"]).select("bundle_id", "function_id", "name")
        return rows.page(hits.join(named, ["bundle_id", "function_id"]), ["bundle_id", "function_id", "offset"], offset, limit)

    def functions_named(self, query: str) -> DataFrame:
        named = dumps.dump_functions(self.tables["functions"], self.tables["strings"])
        return named.where(T.contains_ignoring_case(F.col("name"), query))

    def references_to(self, function_id: int) -> DataFrame:
        """Instructions with any 16- or 32-bit operand equal to the id: a heuristic that may hit plain numbers."""
        ops = F.transform("operands", lambda o: F.struct(o["ty"].alias("ty"), o["val_i"].alias("val")))
        return xref.xref_operand(self.instructions.withColumn("ops", ops), "ops", ("UInt16", "UInt32"), function_id).drop("ops")

    def disassemble(self) -> DataFrame:
        return dumps.disassembly(self.instructions, self.tables["strings"])

    def decompile(self) -> DataFrame:
        return program_text.decompile(self.instructions, self.tables["functions"], self.tables["strings"])

    def blocks(self) -> DataFrame:
        return code.blocks(self.instructions, self.tables["exception_handlers"], self.switches())

    def flow(self) -> DataFrame:
        return code.edges(self.instructions, self.blocks(), self.tables["exception_handlers"], self.switches())

    def switches(self) -> DataFrame:
        return code.switch_cases(self.instructions, self.tables["tails"])

    def versions(self) -> DataFrame:
        """Versions that the opcode tables know."""
        if self.opcodes is None:
            raise ValueError("versions are those of opcode tables")
        return self.opcodes.select("version").distinct().orderBy("version")

    def builtin_calls(self, builtins: str) -> DataFrame:
        names = bundles.builtin_tables(self.spark, builtins)
        return program.builtin_calls(self.instructions, bundles.table_version(self.tables["bundles"], names), names)

    def debug_info(self, *kinds: str) -> DataFrame:
        return debug.listing(self.tables["scopes"], self.tables["callees"], *kinds)

    def variables(self) -> DataFrame:
        return debug.variable_map(self.tables["function_scopes"], self.tables["scopes"])

    def lines(self) -> DataFrame:
        """Instructions with the line and column that they come from."""
        return debug.located(self.instructions, self.tables["debug_locations"])

    def secrets(self, patterns: tuple = facts.SECRET_PATTERNS) -> DataFrame:
        found = facts.scan_secrets(self.tables["strings"].withColumn("_id", F.struct("bundle_id", "string_id")), "_id", "value", patterns)
        return found.select("_id.*", "category", "pattern_name", "value", "redacted")

    def warnings(self) -> DataFrame:
        return dumps.diagnostics(self.tables["bundles"])

    def compare(self, old: str, new: str) -> DataFrame:
        """Status of every function between two bundles, by disassembly without offsets."""
        text = self.disassemble().join(dumps.function_names(self.tables["functions"], self.tables["strings"]).select("bundle_id", "function_id", "name"), ["bundle_id", "function_id"])
        side = lambda b: text.where(F.col("bundle_id") == b).select(F.col("function_id").alias("id"), "name", T.strip_offsets(F.col("text")).alias("body"))
        return diff.statuses(diff.pair(side(old), side(new)), side(old), side(new))

    def identifiers(self) -> DataFrame:
        return self.tables["strings"].where("is_identifier").where(N.is_valid_identifier(F.col("value"))).select("bundle_id", "string_id", "value")
