"""Reading many images at once into typed fact tables, one task per file."""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import debug
from . import image as I

SCHEMAS = {
    "bundles": "bundle_id string, version int, layout string, file_length long, function_count long, string_count long, options_raw int, has_async boolean, diagnostics array<struct<code:string,detail:string>>",
    "functions": "bundle_id string, function_id long, name_id long, param_count long, frame_size long, size long, offset long, flags int, is_strict boolean, overflowed boolean, prohibit_construct boolean",
    "strings": "bundle_id string, string_id long, value string, is_utf16 boolean, is_identifier boolean",
    "exception_handlers": "bundle_id string, function_id long, ordinal int, start long, `end` long, target long",
    "sections": "bundle_id string, name string, offset long, size long, entries long",
    "pair_tables": "bundle_id string, table string, ordinal long, first long, second long",
    "bodies": "bundle_id string, version int, function_id long, body binary",
    "tails": "bundle_id string, function_id long, start long, size long, tail binary",
    "debug_status": "bundle_id string, status string",
    "debug_locations": "bundle_id string, function_id long, ordinal int, bytecode_offset long, line long, column long, scope_offset long",
    "function_scopes": "bundle_id string, function_id long, scope_offset long",
    "scopes": "bundle_id string, scope_offset long, parent_offset long, flags long, is_inner boolean, is_dynamic boolean, names array<string>",
    "callees": "bundle_id string, address long, name string",
}

#: Rows, and bytes of text in them, that a task holds as objects before they become a batch.
MOST_ROWS, MOST_BYTES = 4096, 1 << 22


def rows_of(kind: str, bundle: str, data: bytes, layout: str | None) -> Iterator[tuple]:
    """The rows of one fact table of one image; of an unreadable image only its `bundles` row, with the reason."""
    try:
        im = I.read(data, layout)
    except I.Damaged as why:
        if kind == "bundles":
            yield bundle, None, None, len(data), None, None, None, None, [{"code": "unreadable", "detail": str(why)}]
        return
    h = im.header
    if kind == "bundles":
        yield bundle, im.version, im.layout, h["file_length"], h["function_count"], h["string_count"], h["options_raw"], I.options(h["options_raw"], im.version)["has_async"], [{"code": c, "detail": d} for c, d in im.diagnostics]
    elif kind == "functions":
        for f in im.functions:
            flags = f["flags"]
            yield bundle, f["function_id"], f["name_id"], f["param_count"], f["frame_size"], f["size"], f["offset"], flags, bool(flags & I.STRICT), bool(flags & I.OVERFLOWED), flags & 3 == 1
    elif kind == "strings":
        yield from ((bundle, k, *s) for k, s in enumerate(im.strings))
    elif kind == "exception_handlers":
        yield from ((bundle, *x) for x in im.handlers)
    elif kind == "sections":
        yield from ((bundle, *s) for s in im.sections)
    elif kind == "pair_tables":
        yield from ((bundle, name, k, *p) for name, pairs in im.tables.items() for k, p in enumerate(pairs))
    elif kind == "bodies":
        yield from ((bundle, im.version, f["function_id"], data[f["offset"] : f["offset"] + f["size"]]) for f in im.functions)
    elif kind == "tails":  # what lies between a function's body and the next one: its jump tables
        starts = sorted({f["offset"] for f in im.functions} | {len(data) - I.FOOTER_SIZE})
        for f in im.functions:
            end = f["offset"] + f["size"]
            yield bundle, f["function_id"], f["offset"], f["size"], data[end : next(iter(starts[bisect_left(starts, end) :]), end)]
    else:
        found = debug.section(data, im)
        if kind == "debug_status":
            yield bundle, found.status
        elif kind == "debug_locations":
            yield from ((bundle, *x) for x in debug.each_location(data, im, found))
        elif kind == "function_scopes":
            yield from ((bundle, *x) for x in debug.each_function_scope(data, im, found))
        elif kind == "scopes":
            yield from ((bundle, at, parent, flags, bool(flags & debug.INNER), bool(flags & debug.DYNAMIC), names) for at, parent, flags, names in found.scopes())
        elif kind == "callees":
            yield from ((bundle, *x) for x in found.callees().items())


def batched(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """rows in batches of MOST_ROWS, or of fewer with MOST_BYTES of text; only one batch's rows are objects at a time."""
    wide = [k for k, t in enumerate(schema.types) if pa.types.is_string(t) or pa.types.is_binary(t)]
    batch = lambda found: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)
    found, size = [], 0
    for row in rows:
        found.append(row)
        size += sum(len(row[k]) for k in wide if row[k] is not None)
        if len(found) == MOST_ROWS or size > MOST_BYTES:
            yield batch(found)
            found, size = [], 0
    if found:
        yield batch(found)


def pieces(batches: Iterable[pa.RecordBatch], most: int = 64) -> Iterator[list[dict]]:
    """The rows of batches, at most `most` at a time: a whole batch as objects takes many times its size."""
    for b in batches:
        for k in range(0, b.num_rows, most):
            yield b.slice(k, most).to_pylist()


def facts(files: DataFrame, kind: str, layout: str | None = None) -> DataFrame:
    """A fact table of the images in files(path, content)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SCHEMAS[kind]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = ((path.as_py(), content.as_py() or b"") for b in batches for path, content in zip(b.column(0), b.column(1), strict=True))
        return batched((row for path, content in files for row in rows_of(kind, path, content, layout)), schema)

    return files.select("path", "content").mapInArrow(run, SCHEMAS[kind])


def read_bundles(spark: SparkSession, path: str, layout: str | None = None) -> dict[str, DataFrame]:
    files = spark.read.format("binaryFile").load(path)
    return {kind: facts(files, kind, layout) for kind in SCHEMAS}


def peeked_version(content: str = "content"):
    """The version of an image, without Python: four bytes, little-endian."""
    return F.conv(F.concat(*[F.hex(F.substring(content, k, 1)) for k in (12, 11, 10, 9)]), 16, 10).cast("int")


def opcode_tables(spark: SparkSession, path: str) -> DataFrame:
    """version, opcode, name, operand_types, is_jump of JSON opcode tables in a folder (data, not code: none is shipped)."""
    schema = "Version int, Definitions array<struct<Opcode:int,Name:string,OperandTypes:array<string>,IsJump:boolean>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.select(F.col("Version").alias("version"), F.explode("Definitions").alias("d")).select(
        "version", F.col("d.Opcode").alias("opcode"), F.col("d.Name").alias("name"), F.col("d.OperandTypes").alias("operand_types"), F.coalesce("d.IsJump", F.lit(False)).alias("is_jump")
    )


def builtin_tables(spark: SparkSession, path: str) -> DataFrame:
    """version, builtin, name of JSON lists of names in files whose names end with a version (data: none is shipped)."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"(\d+)\.json$", 1).cast("int").alias("version"), F.from_json("value", "array<string>").alias("names"))
    return raw.where("version IS NOT NULL").select("version", F.posexplode("names").alias("builtin", "name"))


def table_version(bundles: DataFrame, opcodes: DataFrame) -> DataFrame:
    """bundle_id, version, table_version: the latest table not after a bundle's version; a fixed, small dimension."""
    have = opcodes.select(F.col("version").alias("table_version")).distinct()
    hit = bundles.join(F.broadcast(have), F.col("table_version") <= F.col("version"), "left")
    return hit.groupBy("bundle_id", "version").agg(F.max("table_version").alias("table_version"))


def instructions(bodies: DataFrame, opcodes: DataFrame) -> DataFrame:
    """One row per instruction; each function is decoded on its own, by the table as of its bundle's version."""
    tables: dict[int, dict[int, tuple[str, list[str]]]] = {}
    for r in opcodes.collect():  # a few thousand rows: the fixed dimension of opcodes
        tables.setdefault(r["version"], {})[r["opcode"]] = (r["name"], list(r["operand_types"] or []))
    versions = sorted(tables)
    schema = "bundle_id string, function_id long, offset long, opcode int, name string, length int, operands array<struct<ty:string,val_i:bigint,val_f:double>>"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def decoded(r: dict) -> Iterator[tuple]:
        known = [v for v in versions if v <= r["version"]]
        for at, op, name, size, operands in I.decode_body(r["body"] or b"", tables[known[-1]]) if known else ():
            ops = [{"ty": t, "val_i": None if isinstance(v, float) else v, "val_f": v if isinstance(v, float) else None} for t, v in operands]
            yield r["bundle_id"], r["function_id"], at, op, name, size, ops

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched((row for rows in pieces(batches) for r in rows for row in decoded(r)), arrow)

    return bodies.mapInArrow(run, schema)


def proposals(spark: SparkSession, path: str) -> DataFrame:
    """function_id, name, role of a proposal artifact, with its version and bundle fingerprint."""
    schema = "version int, bundle struct<hbc_version:int,function_count:bigint,string_count:bigint,string_digest:string>, proposals array<struct<function_id:bigint,name:string,role:string>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.select("version", "bundle", F.explode("proposals").alias("p")).select("version", "bundle", "p.*")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_per_module(df: DataFrame, path: str, module: str = "module_id") -> None:
    """One folder per module; rows of a module come together first, so it is one file unless it is large."""
    df.repartition(F.col(module)).write.mode("overwrite").partitionBy(module).parquet(path)


def to_dot(edges: DataFrame, src: str, dst: str, name: str = "calls") -> DataFrame:
    """Lines of a DOT graph, in order."""
    body = edges.select(F.format_string("  n%s -> n%s;", F.col(src).cast("string"), F.col(dst).cast("string")).alias("line"), F.lit(1).alias("_o")).distinct()
    ends = edges.sparkSession.createDataFrame([(f"digraph {name} {{", 0), ("}", 2)], "line string, _o int")
    return ends.unionByName(body).orderBy("_o", "line").select("line")


def cached(spark: SparkSession, path: str, key: dict, build) -> DataFrame:
    """Parquet at path if it was written for key, else build() written there."""
    want = json.dumps(key, sort_keys=True)
    try:
        found = spark.read.parquet(path)
        row = spark.read.json(f"{path}-key").first()
        if row is not None and row["key"] == want:
            return found
    except Exception as e:  # no cache yet: Spark raises its own kinds for a missing path
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    build().write.mode("overwrite").parquet(path)
    spark.createDataFrame([(want,)], "key string").write.mode("overwrite").json(f"{path}-key")
    return spark.read.parquet(path)
