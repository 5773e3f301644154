"""Row operators: run lengths, as-of lookups, carried values, islands, paging, first and last wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def expand_runs(runs: DataFrame, key: list[str], order: str, count: str, out: str = "position") -> DataFrame:
    """Run lengths to one row per position, numbered within key."""
    before = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(count).over(before), F.lit(0))
    spread = runs.withColumn("_start", start).where(F.col(count) > 0)
    return spread.withColumn(out, F.explode(F.sequence(F.col("_start"), F.col("_start") + F.col(count) - 1))).drop("_start")


def run_starts(runs: DataFrame, key: list[str], order: str, count: str, out: str = "start") -> DataFrame:
    before = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn(out, F.coalesce(F.sum(count).over(before), F.lit(0)))


def as_of(left: DataFrame, right: DataFrame, key: list[str], at: str, since: str, values: list[str]) -> DataFrame:
    """For each left row the values of the last right row with since <= at, by one sort of both sides within key.

    Both sides are merged into one stream per key and the last value is carried forward: no range join, and the work
    is linear in the rows. Of right rows with equal since the largest values win.
    """
    packed = F.struct(*[F.col(v) for v in values])
    latest = right.groupBy(*key, since).agg(F.max(packed).alias("_v")).withColumnRenamed(since, "_at").withColumn("_left", F.lit(0))
    names = [c for c in left.columns if c not in key]
    rows = left.select(*key, F.struct(*names).alias("_row"), F.col(at).alias("_at"), F.lit(1).alias("_left"))
    both = latest.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)).unionByName(rows.withColumn("_v", F.lit(None).cast(latest.schema["_v"].dataType)))
    w = Window.partitionBy(*key).orderBy("_at", "_left").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_left = 1")
    return carried.select(*key, *[F.col("_row")[n].alias(n) for n in names], *[F.col("_last")[v].alias(v) for v in values])


def carry_forward(df: DataFrame, key: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def first_wins(df: DataFrame, key: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.first(value, ignorenulls=True).over(w))


def accumulate(df: DataFrame, key: list[str], order: list[str], delta: str, out: str) -> DataFrame:
    """Running sums of deltas: addresses, lines, columns."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(delta).over(w))


def islands(df: DataFrame, key: list[str], order: list[str], member: Column, least: int) -> DataFrame:
    """Runs of at least `least` consecutive rows where member holds: key, island, first, rows."""
    w = Window.partitionBy(*key).orderBy(*order)
    marked = df.withColumn("_i", F.row_number().over(w)).withColumn("_in", member)
    inside = marked.where("_in").withColumn("island", F.col("_i") - F.row_number().over(w))
    return inside.groupBy(*key, "island").agg(F.min("_i").alias("first"), F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= least)


def block_starts(df: DataFrame, key: list[str], order: list[str], starts: Column, out: str = "block") -> DataFrame:
    """Number the blocks that begin where starts holds (and at the first row)."""
    w = Window.partitionBy(*key).orderBy(*order)
    flag = F.when((F.row_number().over(w) == 1) | starts, 1).otherwise(0)
    return df.withColumn("_flag", flag).withColumn(out, F.sum("_flag").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_flag")


def numbered(df: DataFrame, key: list[str], order: str, out: str, parts: int = 256) -> DataFrame:
    """out: the row's number from 1 within its key, by the whole number in order.

    A key's rows are dealt to ranges of order and numbered there, after the sizes of the ranges before: a key that
    holds a third of all rows takes many tasks, not one. Ties within (key, order) are not told apart.
    """
    bounds = df.agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    share = (F.col(order).cast("double") - F.col("_lo")) / (F.col("_hi").cast("double") - F.col("_lo") + 1)
    dealt = df.join(F.broadcast(bounds)).withColumn("_part", F.floor(share * parts).cast("int")).drop("_lo", "_hi")  # one row of bounds
    sizes = dealt.groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*key, "_part", F.coalesce(earlier, F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(*key, "_part").orderBy(order))
    return dealt.withColumn(out, within).join(starts, [*key, "_part"]).withColumn(out, F.col(out) + F.col("_start")).drop("_part", "_start")


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def first_per_key(df: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of each key's first row, by aggregation."""
    picked = df.groupBy(*key).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_v"))
    return picked.select(*key, *[F.col("_v")[v].alias(v) for v in values])


def in_interval(points: DataFrame, intervals: DataFrame, key: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """points joined with the intervals [start, end) of their key that hold them.

    Intervals are dealt to buckets of `width`, so the join is an equi-join with a filter, not a nested loop.
    """
    bucket = lambda c: F.expr(f"{c} div {width}")
    spread = intervals.where(F.col(end) > F.col(start)).withColumn("_b", F.explode(F.sequence(bucket(start), F.expr(f"({end} - 1) div {width}"))))
    hit = points.withColumn("_b", bucket(at)).join(spread, [*key, "_b"])
    return hit.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_b")
