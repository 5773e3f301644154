"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every document, in the order of a hash, joins its source's queue; its virtual finish time is the cumulative size
of its source up to and with it, divided by the source's target. Up to PASSES passes over a source are queued.
Queues are merged by finish time and cut at the total budget: a histogram over ranges of finish time finds the
range with the cut, and only that range is sorted.

Defined results: a null text has size 0, and a document of size 0 takes nothing. A null source is a source of its
own, last in order. An empty table gives an empty result. Repeated rows are documents of their own; equal ones are
dealt as often as all together are taken, evenly but for the remainder. A target never exceeds PASSES times its
source's size. Columns other than doc_id, text and source are ignored, and pass through repeated().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import BLANKS, buckets_for, cut, free

WEIGHTS = (5.0, 2.0, 1.0)
PASSES = 3
SEED = "mix-1"
#: So many rows are sorted in one task to find the cut.
MOST_SORTED = 100_000


def size_of(text: Column) -> Column:
    """Number of words, everything between ASCII blanks; null: 0."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{BLANKS}|{BLANKS}$", "")
    return F.when(body == "", 0).otherwise(F.size(F.split(body, BLANKS))).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """_src, source_size, target from _src, source_size: water filling in closed form over the table of sources.

    Shares are proportional to weight up to passes times the source's size. Sorted by cap / weight, the sources
    that are at their cap are a prefix; the level of the rest follows from what the prefix leaves.
    """
    order = Window.orderBy("_src")
    ranked = sizes.withColumn("_k", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_k") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size").cast("double") * passes)
    ranked = ranked.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    whole = Window.partitionBy()
    upto = Window.orderBy("_ratio", "_src")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns({
        "_left": F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
        "_rest": F.sum("_w").over(upto.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    # The level once all earlier ones are at their cap; the first source below its cap at that level fixes it.
    ranked = ranked.withColumn("_level", F.col("_left") / F.col("_rest"))
    ranked = ranked.withColumn("_final", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(whole))
    target = F.when(F.col("_final").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_final") * F.col("_w")))
    return ranked.select("_src", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, passes: int = PASSES, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for each document; see plan()."""
    return plan(docs.select("doc_id", F.col("text"), F.col("source").cast("string").alias("source")), weights, passes, seed)


def plan(docs: DataFrame, weights: tuple[float, ...], passes: int, seed: str) -> DataFrame:
    spread = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    src = F.when(F.col("source").isNull(), "t").otherwise(F.concat(F.lit("s"), F.col("source")))
    thin = cut(docs.select("doc_id", size_of(F.col("text")).alias("size"), src.alias("_src"), spread.alias("_h"), F.xxhash64("text").alias("_x")))
    counted = thin.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("total")).first()
    parts = buckets_for(counted["n"])
    budget = counted["total"]

    # A source's queue is cut into ranges of the hash, so that its running sum needs no single task.
    thin = thin.withColumn("_part", F.expr(f"int(least(_h div {(1 << 60) // parts}, {parts - 1}))"))
    ranges = thin.groupBy("_src", "_part").agg(F.sum("size").alias("_sum"))
    known = targets(ranges.groupBy("_src").agg(F.sum("_sum").alias("source_size")), weights, passes)
    earlier = Window.partitionBy("_src").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).join(known, "_src").select(
        F.col("_src").alias("_s"), F.col("_part").alias("_p"), "_before", "source_size", "target"
    )
    within = Window.partitionBy("_src", "_part").orderBy("_h", "doc_id", "size", "_x").rowsBetween(Window.unboundedPreceding, 0)
    queued = thin.withColumn("_run", F.sum("size").over(within)).join(starts, (F.col("_src") == F.col("_s")) & (F.col("_part") == F.col("_p")))
    queued = cut(queued.select("doc_id", "size", "source_size", "target", "_h", "_x", "_src", (F.col("_run") + F.col("_before")).alias("_cum")))

    def finish(k: int | Column) -> Column:
        late = F.col("_cum").cast("double") + F.lit(k).cast("double") * F.col("source_size") if isinstance(k, int) else F.col("_cum").cast("double") + k.cast("double") * F.col("source_size")
        return late / F.col("target")

    # All passes of all documents, as a histogram over ranges of finish time.
    copies = queued.where("size > 0 AND target > 0").withColumn("_pass", F.explode(F.array(*[F.lit(k) for k in range(passes)])))
    copies = copies.withColumn("_finish", finish(F.col("_pass")))
    fine = parts * 64
    copies = copies.withColumn("_range", F.least(F.floor(F.col("_finish") * fine), F.lit(2 * fine)).cast("long"))
    bars = copies.groupBy("_range").agg(F.sum("size").alias("_size"))
    total_up = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    at = bars.withColumn("_upto", F.sum("_size").over(total_up)).where(F.col("_upto") > budget).orderBy("_range").limit(1).first()
    if at is None:
        first_left = None
    else:
        in_range, at = narrowed(copies, at, fine, budget)
        rank = Window.orderBy("_finish", "_pass", "_h", "doc_id", "size", "_x").rowsBetween(Window.unboundedPreceding, 0)
        last = in_range.withColumn("_upto", F.sum("size").over(rank) + F.lit(at["_upto"] - at["_size"])).where(F.col("_upto") > budget)
        first_left = last.orderBy("_finish", "_pass", "_h", "doc_id", "size", "_x").limit(1).first()

    taken = F.lit(0).cast("long")  # of all passes
    for k in range(passes):
        f = finish(k)
        if first_left is None:
            inside = F.lit(True)
        else:
            key = [(f, first_left["_finish"]), (F.lit(k), first_left["_pass"]), (F.col("_h"), first_left["_h"]), (F.coalesce("doc_id", F.lit(-1)), -1 if first_left["doc_id"] is None else first_left["doc_id"]), (F.col("size"), first_left["size"])]
            inside = F.lit(False)
            for c, v in reversed(key):
                inside = (c < F.lit(v)) | ((c == F.lit(v)) & inside)
        taken = taken + F.when(inside, F.col("size")).otherwise(0)
    taken = F.when((F.col("size") > 0) & (F.col("target") > 0), taken).otherwise(F.lit(0)).cast("long")
    return queued.select("doc_id", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), taken.alias("taken"))


def narrowed(copies: DataFrame, at: Row, fine: int, budget: int) -> tuple[DataFrame, dict]:
    """The rows of the range at and its bar, cut down until few enough to be sorted in one task.

    Each step splits what is left by the next part of the order (finish time to 2**-32 of a range, pass, hash) into
    at most 65536 bars and keeps the one with the cut.
    """
    exact = F.col("_finish") * fine - F.col("_range")
    steps = [F.floor(exact * 65536), F.floor(exact * 65536 * 65536), F.col("_pass"), *(F.shiftright("_h", n) for n in (44, 28, 12))]
    rows, held = copies.where(F.col("_range") == at["_range"]), {"_upto": at["_upto"], "_size": at["_size"]}
    for step in steps:
        if rows.count() <= MOST_SORTED:
            break
        bars = rows.groupBy(step.cast("long").alias("_bar")).agg(F.sum("size").alias("_size"))
        before = F.lit(held["_upto"] - held["_size"])
        upto = F.sum("_size").over(Window.orderBy("_bar").rowsBetween(Window.unboundedPreceding, 0)) + before
        hit = bars.withColumn("_upto", upto).where(F.col("_upto") > budget).orderBy("_bar").limit(1).first()
        rows, held = rows.where(step.cast("long") == hit["_bar"]), {"_upto": hit["_upto"], "_size": hit["_size"]}
    return rows, held


def repeated(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, passes: int = PASSES, seed: str = SEED) -> DataFrame:
    """docs with each row as often as the mix takes it; rows without words, which no weight concerns, stay once."""
    mine, words, most, extra, rows, copy, nth = (free(n, docs.columns) for n in ("_id", "_words", "_most", "_extra", "_rows", "_copy", "_nth"))
    times = (F.col("taken") / F.col("size")).cast("long")
    # Rows that repeat id and size are told apart by nothing: all are taken as often as the sum allows, some once more.
    alike = mix(docs, weights, passes, seed).where("size > 0").groupBy(F.col("doc_id").alias(mine), F.col("size").alias("_" + words)).agg(F.sum(times).alias("_t"), F.count(F.lit(1)).alias(rows))
    taken = cut(alike.select(mine, "_" + words, rows, F.expr(f"_t div `{rows}`").alias(most), F.expr(f"_t % `{rows}`").alias(extra)))
    sized = docs.withColumn(words, size_of(F.col("text")))
    meet = F.col("doc_id").eqNullSafe(F.col(mine)) & (F.col(words) == F.col("_" + words))
    kept = [f"`{c}`" for c in docs.columns]

    def dealt(joined: DataFrame, times: Column) -> DataFrame:
        return joined.withColumn(copy, F.explode(F.when(times > 0, F.sequence(F.lit(1).cast("long"), times)).otherwise(F.array().cast("array<long>")))).select(*kept)

    # A hash join keeps the texts unsorted. Only rows that repeat and cannot be taken alike are numbered.
    even = sized.join(taken.where(f"`{extra}` = 0").hint("shuffle_hash"), meet, "left")
    uneven = taken.where(f"`{extra}` > 0 AND `{rows}` = 1").limit(1).count(), taken.where(f"`{extra}` > 0").limit(1).count()
    assert not uneven[0]  # one row has no remainder
    if not uneven[1]:
        return dealt(even, F.when(F.col(words) > 0, F.coalesce(most, F.lit(1).cast("long"))).otherwise(F.lit(1).cast("long")))
    odd = taken.where(f"`{extra}` > 0").hint("shuffle_hash")
    plain = sized.join(odd.select(mine, "_" + words), meet, "left_anti").join(taken.where(f"`{extra}` = 0").hint("shuffle_hash"), meet, "left")
    first = dealt(plain, F.when(F.col(words) > 0, F.coalesce(most, F.lit(1).cast("long"))).otherwise(F.lit(1).cast("long")))
    numbered = sized.join(odd, meet).withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", words).orderBy("source", F.xxhash64("text"))))
    return first.unionByName(dealt(numbered, F.col(most) + (F.col(nth) <= F.col(extra)).cast("long")))


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CASE WHEN source IS NULL THEN 't' ELSE 's' || source END AS src,
    CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY src) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size::DOUBLE * {PASSES} AS cap FROM s),
v AS (
  SELECT *, cap / w AS ratio, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM r),
f AS (SELECT max(rest / ws) AS level FROM v WHERE rest / ws <= ratio),
t AS (SELECT src, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS target FROM v, f),
q AS (SELECT d.*, source_size, target, (sum(size) OVER (PARTITION BY d.src ORDER BY h, doc_id, size))::DOUBLE AS cum FROM d JOIN t ON d.src = t.src),
c AS (SELECT *, (cum + k::DOUBLE * source_size) / target AS finish FROM q, (SELECT unnest([0, 1, 2]) AS k) WHERE size > 0 AND target > 0),
o AS (SELECT doc_id, h, size, src, k, sum(size) OVER (ORDER BY finish, k, h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM c),
n AS (SELECT doc_id, src, size, count(*) AS times FROM o WHERE upto <= (SELECT sum(size) FROM d) GROUP BY doc_id, src, size)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(n.times, 0) AS BIGINT) AS taken FROM q LEFT JOIN n ON q.doc_id = n.doc_id AND q.src = n.src AND q.size = n.size"""
