"""Comparing two builds: content-first pairing, statuses, renames, line alignment."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.bundles import batched, pieces
from .rows import numbered

ALIGNED = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "old", "new")]))


def pair(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns id, name, body of both sides -> name, old_id, new_id.

    Within a name, equal bodies pair in id order; what is left pairs by position; the rest has no partner. An empty
    or null name is a name like any other. Bodies are compared by their 256-bit digest.
    """

    def side(df: DataFrame, id_: str) -> DataFrame:
        rows = df.select(F.coalesce("name", F.lit("")).alias("name"), F.col("id").alias(id_), F.sha2(F.coalesce("body", F.lit("")), 256).alias("h"))
        return rows.withColumn("k", F.row_number().over(Window.partitionBy("name", "h").orderBy(id_)))

    a, b = side(old, "old_id"), side(new, "new_id")
    same = a.join(b, ["name", "h", "k"]).select("name", "old_id", "new_id")
    rest = lambda x, id_: x.join(same.select("name", id_), ["name", id_], "left_anti").select("name", id_)
    # Most functions of a bundle have no name: their positions are counted in parts.
    left = numbered(rest(a, "old_id"), ["name"], "old_id", "k").join(numbered(rest(b, "new_id"), ["name"], "new_id", "k"), ["name", "k"], "full").select("name", "old_id", "new_id")
    return same.unionByName(left)


def statuses(pairs: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """pairs with status: identical, modified, removed or added."""
    h = lambda df, id_, out: df.select(F.col("id").alias(id_), F.sha2(F.coalesce("body", F.lit("")), 256).alias(out))
    both = pairs.join(h(old, "old_id", "ha"), "old_id", "left").join(h(new, "new_id", "hb"), "new_id", "left")
    status = F.when(F.col("new_id").isNull(), "removed").when(F.col("old_id").isNull(), "added").when(F.col("ha") == F.col("hb"), "identical").otherwise("modified")
    return both.select("name", "old_id", "new_id", status.alias("status"))


def summary(statused: DataFrame) -> DataFrame:
    return statused.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("identical", "modified", "removed", "added")])


def renames(old: DataFrame, new: DataFrame) -> DataFrame:
    """Names only in one build with equal non-empty content: name, new_name; the smallest name on ties."""
    gone = old.join(new.select("name").distinct(), "name", "left_anti").where("body <> ''")
    come = new.join(old.select("name").distinct(), "name", "left_anti").where("body <> ''")
    target = come.groupBy(F.sha2("body", 256).alias("h")).agg(F.min("name").alias("new_name"))
    return gone.select("name", F.sha2("body", 256).alias("h")).distinct().join(target, "h").groupBy("name").agg(F.min("new_name").alias("new_name"))


def aligned(old: str | None, new: str | None) -> list[tuple[str, str | None, str | None]]:
    """(kind, old, new), line by line: same, changed, removed, added."""
    x, y = (old or "").split("\n"), (new or "").split("\n")
    out: list[tuple[str, str | None, str | None]] = []
    for tag, i, j, k, m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if tag == "equal":
            out += [("same", line, line) for line in x[i:j]]
            continue
        both = min(j - i, m - k)
        out += [("changed", p, q) for p, q in zip(x[i : i + both], y[k : k + both], strict=True)]
        out += [("removed", p, None) for p in x[i + both : j]]
        out += [("added", None, q) for q in y[k + both : m]]
    return out


@F.arrow_udf(ALIGNED)
def align_lines(old: pa.Array, new: pa.Array) -> pa.Array:
    """Line by line: same, changed, removed, added. A batch's lines are columns, and only one pair's are objects."""
    ends, columns = [0], [[], [], []]
    for a, b in zip(old, new, strict=True):
        lines = aligned(a.as_py(), b.as_py())
        ends.append(ends[-1] + len(lines))
        for column, values in zip(columns, zip(*lines, strict=True), strict=True):
            column.append(pa.array(values, pa.string()))
    whole = [pa.chunked_array(c, pa.string()).combine_chunks() for c in columns]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(whole, ["kind", "old", "new"]))


def aligned_lines(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """pairs without the columns old and new, a row a line of align_lines: kind, old, new. Lines leave in small batches."""
    from pyspark.sql.pandas.types import to_arrow_schema

    keep = [c for c in pairs.columns if c not in (old, new)]
    schema = T.StructType([*(pairs.schema[c] for c in keep), *ALIGNED.elementType.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((*(r[c] for c in keep), *line) for piece in pieces(batches) for r in piece for line in aligned(r[old], r[new]))
        return batched(rows, arrow)

    return pairs.mapInArrow(run, schema)
