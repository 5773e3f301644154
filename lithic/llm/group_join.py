"""Exact n-gram Jaccard join of documents through a token-group matrix.

A document is the set of its word shingles, and a node is a distinct set. Similar sets are brought together first:
sets are cut into blocks of the token space, so that two sets over the threshold must agree in a whole block
(pigeonhole), and each set is compared with the leader of the block it shares most. Verified links make groups of
similar sets, whose members need no further comparison with each other. (Sets must agree in several blocks, so the
most frequent blocks of a set are left out, by the prefix principle.)

The token-group matrix then works between groups, over the sets that still share a block with another group: its
cells are the tokens that groups share, each set's rarest ones first, with the room that is left for a link after
them. Tokens that name one set of their largest group merge more groups, in rounds; then query sets ask the groups
with which a cell leaves room, the union of a group's tokens bounds the overlap of a query with any member, and only
groups whose bound reaches the threshold are opened, for the members with a common cell. No link between different
sets is lost; a pair within one group is never enumerated.

The sizes of sets fix the number of blocks: sizes fall into classes as wide as the threshold allows partners to
differ, and a set is cut by its own class and by the class below. Blocks that are empty on both sides do not count
as agreement; a set with too many empty blocks for the pigeonhole registers those too.

Defined results: words are what lies between ASCII blanks, A-Z lower-cased. Fewer words than the shingle width make
one shingle. Null, empty or blank texts have the empty set, n_shingles 0, and link with nothing (each is its own
component). Repeated rows are returned once each; they link through their equal sets unless these are empty. A null
id is kept and gets the component of its set. Extra columns are ignored. Sets and shingles are held as 64-bit
hashes and not compared beyond them: among n distinct sets two have equal digests with a chance of n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from .shared import cut, drop, free

U = np.uint64
ODD = [U(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
SALT = [U((int(x) * (j + 1)) % (1 << 64)) for j, x in enumerate(ODD)]
#: Bitmaps tell workers which ids or blocks matter; they grow with the input up to 2**MOST_BITS bits (32 MB). Where they
#: are too small, rows pass that need not: that costs time, never links.
LEAST_BITS, MOST_BITS = 18, 28
#: A key with 1/HOT of all rows or more is hot.
HOT = 1024
#: So many pairs are broadcast, for both sides at once: the driver builds two hash tables of about 100 bytes a pair.
FEW = 250_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - width + 1
    acc = np.zeros(n, np.uint64)
    for j in range(width):
        acc += mix(h[j : j + n] + SALT[j % len(SALT)]) * ODD[(j * 3 + 1) % len(ODD)]
    return np.unique(mix(acc))


def digest(tokens: np.ndarray) -> int:
    """64 bits that stand for the set."""
    if not len(tokens):
        return 0
    return int(mix(mix(tokens ^ ODD[4]).sum(keepdims=True) * ODD[5] + mix(tokens).sum(keepdims=True) + U(len(tokens)))[0])


@lru_cache(maxsize=8)
def size_classes(percent: int) -> np.ndarray:
    bounds = [1]
    while bounds[-1] < 1 << 40:
        bounds.append(bounds[-1] * 100 // percent + 1)
    return np.array(bounds)


@lru_cache(maxsize=4096)
def blocks(c: int, percent: int) -> tuple[int, int]:
    """(blocks, most blocks in which partners can differ) where the smaller set is of class c.

    More blocks than the pigeonhole needs, so that partners must agree in many, and rare ones suffice: half as many
    again, or a quarter where the threshold is low and blocks are many already.
    """
    top = int(size_classes(percent)[c + 1]) - 1
    most = (100 - percent) * (top + 100 * top // percent) // (100 + percent)
    return (most + 1) + (most + 1) // (2 if percent >= 85 else 4) if most else 1, most


@lru_cache(maxsize=512)
def edges(k: int) -> np.ndarray:
    return np.array([(j << 64) // k for j in range(1, k)], np.uint64)


def signatures(tokens: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, class, spare) of each block of the set, by its own class and the class below.

    A partner agrees in more than `spare` of a class's blocks, so the `spare` most frequent ones need not be looked up.
    """
    if not len(tokens):
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    own = int(np.searchsorted(size_classes(percent), len(tokens), side="right")) - 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ ODD[6]))])
    sigs, classes, spares = [], [], []
    for c in (own, own - 1) if own else (own,):
        k, most = blocks(c, percent)
        at = np.concatenate([[0], np.searchsorted(tokens, edges(k)), [len(tokens)]])
        content = sums[at[1:]] - sums[at[:-1]]
        sig = mix(content + mix((np.arange(k, dtype=np.uint64) << U(16)) + U(c + 1)))
        full = at[1:] > at[:-1]
        # Blocks empty on both sides agree too but are not registered, unless they could be all that agrees.
        spare = int(full.sum()) - most - 1
        if spare >= 0:
            sig = sig[full]
        sigs.append(sig)
        classes.append(np.full(len(sig), c, np.int32))
        spares.append(np.full(len(sig), max(spare, 0), np.int32))
    return np.concatenate(sigs), np.concatenate(classes), np.concatenate(spares)


def bits_for(rows: int) -> int:
    return min(max((64 * rows).bit_length(), LEAST_BITS), MOST_BITS)


def bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """The column's values as bits of a map of 2**bits.

    Executors pack the map's words, 12 bytes each, thousands in a row; the driver fetches them from a file, a partition
    at a time, and so holds little beside the map (a row for each word took it over 1.5 GB).
    """
    low = F.col(column).bitwiseAND((1 << bits) - 1)
    bit = F.expr("shiftleft(1L, cast(_b as int))")
    words = df.select(F.shiftright(low, 6).alias("_w"), low.bitwiseAND(63).alias("_b")).groupBy("_w").agg(F.bit_or(bit).alias("_v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, v = np.asarray(b.column(0)).astype(np.int32), np.asarray(b.column(1))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (at, v)], names=["at", "words"])

    packed = cut(words.mapInArrow(pack, "at binary, words binary"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    for r in packed.toLocalIterator():
        out[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["words"], np.uint64)
    drop(packed)
    return out


def sent(df: DataFrame, column: str, bits: int) -> Broadcast:
    """The bitmap, sent to workers; destroy() it after its last use."""
    return df.sparkSession.sparkContext.broadcast(bitmap(df, column, bits))


def hits(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    low = values.astype(np.uint64) & U(64 * len(bits) - 1)
    return (bits[(low >> U(6)).astype(np.int64)] >> (low & U(63))) & U(1) == 1


def sets(docs: DataFrame, width: int, percent: int, emit: str, ids_b: Broadcast | None = None, sigs_b: Broadcast | None = None) -> DataFrame:
    """One pass over texts (columns id, text).

    emit 'digest': id, n, d for every row. 'blocks': sig, d. 'tokens': d, tokens. Rows whose id is not in the bitmap
    ids_b, and blocks not in sigs_b, are left out.
    """
    schema = {"digest": "id long, n long, d long", "blocks": "sig long, d long, class int, spare int", "tokens": "d long, tokens array<long>"}[emit]
    if emit == "blocks" and sigs_b is None:
        schema = "sig long, d long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                if ids_b is not None:
                    own = part.column(0)
                    keep = hits(np.asarray(own.fill_null(0)).astype(np.int64), ids_b.value) | np.asarray(own.is_null())
                    part = part.filter(pa.array(keep))
                found = [shingle_set(t.as_py(), width) for t in part.column(1)]
                d = np.array([digest(x) for x in found], np.uint64).view(np.int64)
                if emit == "digest":
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array(d)], names=["id", "n", "d"])
                elif emit == "tokens":
                    yield pa.RecordBatch.from_arrays([pa.array(d), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], names=["d", "tokens"])
                else:
                    each = [signatures(x, percent) for x in found]
                    whose = np.repeat(d, [len(x[0]) for x in each])
                    flat = np.concatenate([*(x[0] for x in each), np.zeros(0, np.uint64)])
                    if sigs_b is None:
                        yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(whose)], names=["sig", "d"])
                        continue
                    on = hits(flat, sigs_b.value)
                    rest = [np.concatenate([*(x[k] for x in each), np.zeros(0, np.int32)]).astype(np.int32)[on] for k in (1, 2)]
                    yield pa.RecordBatch.from_arrays([pa.array(flat[on].view(np.int64)), pa.array(whose[on]), *map(pa.array, rest)], names=["sig", "d", "class", "spare"])

    return docs.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, schema)


def matched(left: DataFrame, key: str, right: DataFrame) -> DataFrame:
    """left joined with right, where key is unique; left is read from a file.

    Keys with 1/HOT of the left rows or more are at most HOT: their right rows are broadcast, the others are shuffled.
    """
    total = left.count()
    hot = F.broadcast(left.groupBy(key).agg(F.count(F.lit(1)).alias("_often")).where(F.col("_often") * HOT >= total + HOT).limit(HOT).select(key))
    few = F.broadcast(right.join(hot, key, "left_semi"))
    return left.join(hot, key, "left_anti").join(right, key).unionByName(left.join(few, key))


def components(links: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) for every node of links(a, b): smallest neighbour's label, then pointer jumping."""
    both = cut(links.select("a", F.col("b").alias("node")).union(links.select("b", "a")).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("node"), F.first("a")).alias("comp")).withColumnRenamed("a", "node"))
    while True:
        near = matched(both, "node", labels).groupBy("a").agg(F.min("comp").alias("_near"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("comp").alias("_old"), F.least("comp", "_near").alias("comp"))
        step = cut(step)
        jump = step.select(F.col("node").alias("comp"), F.col("comp").alias("_up"))
        after = cut(matched(step, "comp", jump).select("node", "_old", F.least("comp", "_up").alias("comp")))
        moved = after.where("comp <> _old").limit(1).count()
        drop(step)
        drop(labels)
        labels = after
        if not moved:
            drop(both)
            return labels.select("node", "comp")


def verified(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets, read from a file, that reach the threshold.

    Each side fetches its tokens by itself, and the two meet by pair, so that a set with many partners loads no one
    task. Up to FEW pairs are sent to where the tokens are; beyond, the tokens of hot sets are.
    """
    few = pairs.count() <= FEW

    def side(key: str, out: str) -> DataFrame:
        own = tokens.select(F.col("d").alias(key), F.col("tokens").alias(out))
        return own.join(F.broadcast(pairs), key) if few else matched(pairs, key, own)

    joined = side("a", "_ta").join(side("b", "_tb"), ["a", "b"])
    # Sets differ in size by the threshold at most; those arrays that differ by more are not compared.
    small, large = F.least(F.size("_ta"), F.size("_tb")), F.greatest(F.size("_ta"), F.size("_tb"))
    both = F.size(F.array_intersect("_ta", "_tb"))
    near = joined.where(small * 100 >= large * percent).select("a", "b", (F.size("_ta") + F.size("_tb")).alias("_sum"), both.alias("_both"))
    return near.where(F.col("_both") * 100 >= (F.col("_sum") - F.col("_both")) * percent).select("a", "b")


def merged(grouped: DataFrame, links: DataFrame) -> DataFrame:
    """grouped (d, g) with the groups that links (a, b) between sets join made one."""
    ends = links.join(grouped.toDF("a", "ga"), "a").join(grouped.toDF("b", "gb"), "b")
    joined = components(ends.select(F.col("ga").alias("a"), F.col("gb").alias("b")).where("a <> b").distinct())
    return cut(grouped.join(joined.select(F.col("node").alias("g"), "comp"), "g", "left").select("d", F.coalesce("comp", "g").alias("g")))


def open_sets(members: DataFrame, grouped: DataFrame) -> DataFrame:
    """d, g of the sets that share a block with a set of another group."""
    cells = members.select("sig", "d").join(grouped, "d")
    shared = cells.groupBy("sig").agg(F.min("g").alias("_lo"), F.max("g").alias("_hi")).where("_lo <> _hi").select("sig")
    return cells.join(shared, "sig", "left_semi").select("d", "g").distinct()


def matrix(members: DataFrame, grouped: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """token, d, n, room: the cells of the token-group matrix that can decide whether sets of two groups are linked.

    Each set's tokens are put in one order for all, those of one group only first, then the rarest. After the first
    token that two sets share they have no more in common than what follows it in either: room >= percent * n of the
    partner says that this is enough for a link, so each linked pair has such a token, on both sides. Frequent tokens
    (common passages, the text that a family of copies shares) come last and have no room.
    """
    each = cut(tokens.join(open_sets(members, grouped), "d").select("d", "g", F.size("tokens").alias("n"), F.explode("tokens").alias("token")))
    often = each.groupBy("token").agg(F.count(F.lit(1)).alias("often"), (F.min("g") != F.max("g")).alias("shared"))
    order = Window.partitionBy("d").orderBy(F.coalesce("shared", F.lit(False)), "often", "token")
    # Tokens of one set only join nothing and come first all the same.
    ranked = each.join(often.where("shared"), "token", "left").withColumn("_r", F.row_number().over(order))
    room = F.expr(f"(n - _r + 1) * {100 + percent} - {percent} * n")
    # A partner's size is at least percent / 100 of the set's.
    out = cut(ranked.where("shared").select("token", "d", "n", room.alias("room")).where(f"room * 100 >= {percent * percent} * n"))
    drop(each)
    return out


def still_open(cells: DataFrame, grouped: DataFrame) -> DataFrame:
    """token, d, n, room, g of the cells whose token different groups share."""
    named = cells.join(grouped, "d")
    shared = named.groupBy("token").agg(F.min("g").alias("_lo"), F.max("g").alias("_hi")).where("_lo <> _hi").select("token")
    return cut(named.join(shared, "token", "left_semi").select("token", "d", "n", "room", "g"))


def contracted(cells: DataFrame, grouped: DataFrame, tokens: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(open cells, d and g): groups merged in rounds, until a round finds little more.

    In a round each token names one set of its largest group, another one each time, and the token's sets of other
    groups are compared with it: a round's pairs are at most the cells, whatever the sizes of groups.
    """
    held, before, turn = still_open(cells, grouped), None, 0
    fits = f"g <> lead_g AND room >= {percent} * lead_n AND lead_room >= {percent} * n"
    while (now := held.count()) and (before is None or now < 0.8 * before):
        before, turn = now, turn + 1
        columns = held.groupBy("token", "g").agg(F.count(F.lit(1)).alias("size"), F.max_by(F.struct("d", "n", "room"), F.xxhash64("d", F.lit(turn))).alias("lead"))
        leads = columns.groupBy("token").agg(F.max_by(F.struct("lead", "g"), F.struct("size", "g")).alias("_l"))
        leads = leads.select("token", F.col("_l.lead.d").alias("lead"), F.col("_l.lead.n").alias("lead_n"), F.col("_l.lead.room").alias("lead_room"), F.col("_l.g").alias("lead_g"))
        asks = held.join(leads, "token").where(fits).groupBy("d", "lead_g", "lead").agg(F.count(F.lit(1)).alias("often"))
        pairs = cut(asks.groupBy("d", "lead_g").agg(F.max_by("lead", F.struct("often", "lead")).alias("b")).select(F.col("d").alias("a"), "b"))
        grouped = merged(grouped, verified(pairs, tokens, percent))
        drop(pairs)
        drop(held)
        held = still_open(cells, grouped)
    return held, grouped


def links_between(docs: DataFrame, known: DataFrame, width: int, percent: int, bits: int) -> DataFrame | None:
    """d, comp for the sets that have links; None if there are none. known: d, id (of one row with the set)."""
    texts = docs.select("id", "text")
    reps = sent(known.where("id IS NOT NULL"), "id", bits)
    rows = sets(texts, width, percent, "blocks", reps)
    shared = cut(rows.groupBy("sig").agg(F.min("d").alias("_lo"), F.max("d").alias("_hi"), F.count(F.lit(1)).alias("often")).where("_lo <> _hi").select("sig", "often"))
    if not shared.limit(1).count():
        reps.destroy()
        return None
    common = sent(shared, "sig", bits)
    again = sets(texts, width, percent, "blocks", reps, common)
    held = again.join(shared, "sig").groupBy("sig", "d", "class", "spare", "often").agg(F.count(F.lit(1)).alias("_n"))
    # Of each set's blocks of a class the `spare` most frequent are left out, in one order for all sets.
    own = Window.partitionBy("d", "class")
    ranked = held.withColumn("_r", F.row_number().over(own.orderBy(F.desc("often"), "sig"))).withColumn("weight", F.sum(F.log("often")).over(own))
    kept = cut(ranked.where("_r > spare").select("sig", "d", "weight"))
    reps.destroy()
    common.destroy()
    # The leader of a block is the set whose own blocks are shared most: the middle of a family, not its edge.
    leads = kept.groupBy("sig").agg(F.max_by("d", F.struct("weight", "d")).alias("lead"), F.min("d").alias("_lo"), F.max("d").alias("_hi")).where("_lo <> _hi").select("sig", "lead")
    members = cut(kept.join(leads, "sig").select("sig", "d", "lead"))
    involved = members.select("d").distinct()
    ids = sent(known.join(involved, "d", "left_semi").where("id IS NOT NULL"), "id", bits)
    tokens = cut(sets(texts, width, percent, "tokens", ids).join(involved, "d", "left_semi").dropDuplicates(["d"]))
    ids.destroy()

    # 1. Groups: each set against the leader with which it shares most blocks, then contraction in rounds.
    ranked = members.where("d <> lead").groupBy("d", "lead").agg(F.count(F.lit(1)).alias("n"))
    pairs = cut(ranked.groupBy("d").agg(F.max_by("lead", F.struct("n", "lead")).alias("lead")).select(F.col("d").alias("a"), F.col("lead").alias("b")))
    grouped = merged(cut(involved.select("d", F.col("d").alias("g"))), verified(pairs, tokens, percent))
    cells, grouped = contracted(matrix(members, grouped, tokens, percent), grouped, tokens, percent)

    # 2. Query sets against groups: the smaller group asks, where the sizes of sets allow a link.
    sizes = grouped.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    cells = cut(cells.join(sizes, "g"))
    columns = cells.groupBy("token", F.col("g").alias("grp"), F.col("size").alias("_size")).agg(F.min("n").alias("_n"), F.max("room").alias("_room"))
    reach = f"room >= {percent} * _n AND _room >= {percent} * n"
    asks = cells.join(columns, "token").where(f"g <> grp AND (size < _size OR (size = _size AND g < grp)) AND {reach}")
    asks = cut(asks.groupBy("d", "grp", "_size").agg(F.count(F.lit(1)).alias("often")))
    pairs = asks.where("_size = 1").select(F.col("d").alias("a"), F.col("grp").alias("b"))
    wide = asks.where("_size > 1").select("d", "grp")
    if wide.limit(1).count():
        # The union of a group's tokens bounds what any member shares with the query.
        held = tokens.join(grouped, "d").join(wide.select(F.col("grp").alias("g")).distinct(), "g", "left_semi")
        union = held.select(F.col("g").alias("grp"), F.explode("tokens").alias("token")).distinct()
        query = wide.join(tokens, "d").select("d", "grp", F.size("tokens").alias("_need"), F.explode("tokens").alias("token"))
        bound = query.join(union, ["grp", "token"]).groupBy("d", "grp", "_need").agg(F.count(F.lit(1)).alias("_both"))
        # What the group's union lacks of the query, every member lacks: that bounds the size of members in reach.
        bounded = F.expr(f"(_both * (100 + {percent})) div {percent} - _need")
        opened = bound.withColumn("_reach", bounded).where(F.col("_reach") * 100 >= F.col("_need") * percent).select("d", "grp", "_reach")
        asking = cells.select("token", "d", "n", "room").join(opened, "d")
        inside = cells.select("token", F.col("g").alias("grp"), F.col("d").alias("b"), F.col("n").alias("_n"), F.col("room").alias("_room"))
        near = asking.join(inside, ["token", "grp"]).where(f"_n <= _reach AND {reach}").select(F.col("d").alias("a"), "b")
        pairs = pairs.union(near.distinct())
    out = merged(grouped, verified(cut(pairs.distinct()), tokens, percent))
    drop(tokens)
    return out.select("d", F.col("g").alias("comp"))


def labelled(docs: DataFrame, width: int, percent: int, key: str, text: str) -> DataFrame:
    """id, n, d (the digest of its set), component_id for each row; see similar_documents."""
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    all_sets = cut(sets(texts, width, percent, "digest"))
    known = cut(all_sets.where("n > 0").groupBy("d").agg(F.min("id").alias("id")))
    linked = links_between(texts, known, width, percent, bits_for(known.count()))
    if linked is None:
        labels = known.select("d", F.col("id").alias("component_id"))
    else:
        named = known.join(linked, "d", "left").select("d", "id", F.coalesce("comp", "d").alias("comp"))
        smallest = named.groupBy("comp").agg(F.min("id").alias("component_id"))
        labels = named.join(smallest, "comp").select("d", "component_id")
    # Rows without a set match nothing and keep their own id.
    full = all_sets.where("n > 0").join(labels, "d").select("id", "n", "d", F.coalesce("component_id", "id").alias("component_id"))
    return full.unionByName(all_sets.where("n = 0").select("id", "n", "d", F.col("id").alias("component_id")))


def similar_documents(docs: DataFrame, width: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id for each row: the smallest key reachable through links of Jaccard >= percent / 100."""
    return labelled(docs, width, percent, key, text).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group of near copies: the one with the smallest id.

    Repeated rows (equal key and text) are reduced to one; rows without a key or without words stay. Only rows whose
    id may have to go (by a bitmap of fixed size, which errs to one side) are shuffled, the others pass straight through.
    Of an id with several texts only the rows go whose own set is a near copy: rows are told by id and digest.
    """
    found = cut(labelled(docs, width, percent, key, text))
    mine, of = free("_id", docs.columns), free("_digest", docs.columns)
    gone = found.where("id IS NOT NULL AND id <> component_id").select(F.col("id").alias(mine), F.col("d").alias("_" + of)).distinct()
    repeated = found.where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    gone = cut(gone)
    bits = sent(gone.select(F.col(mine).alias("id")).union(repeated), "id", bits_for(found.count()))
    columns = docs.columns
    at, where = columns.index(key), columns.index(text)
    with_digest = StructType([*docs.schema.fields, StructField(of, LongType())])

    def split(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(at).cast(pa.int64())
                on = hits(np.asarray(ids.fill_null(0)), bits.value) & ~np.asarray(ids.is_null())
                b = b.filter(pa.array(on == wanted))
                if wanted:
                    d = np.array([digest(shingle_set(t.as_py(), width)) for t in b.column(where)], np.uint64).view(np.int64)
                    b = pa.RecordBatch.from_arrays([*b.columns, pa.array(d)], names=[*columns, of])
                yield b

        return docs.mapInArrow(run, with_digest if wanted else docs.schema)

    same = (F.col(key) == F.col(mine)) & (F.col(of) == F.col("_" + of))
    checked = split(True).join(gone, same, "left_anti").dropDuplicates([key, text]).drop(of)
    return split(False).unionByName(checked)
