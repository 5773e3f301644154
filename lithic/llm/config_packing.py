"""Packing token sequences by a configuration linear program over the histogram of lengths.

Documents are encoded, an end id is appended, and only documents over the capacity are cut: full pieces from the
end, the remainder first. Piece lengths form a histogram of at most `capacity` bins, whatever the corpus. The linear
program with one variable per configuration (a multiset of lengths that fits) is solved by multiplicative weights:
lengths still short of their demand weigh more, the best configuration is priced by knapsack dynamic programming.
Steps are whole numbers of sequences and go on until every length is covered, so the configurations are the plan, of
a bounded number of intervals. Pieces get a rank within their length by two-level counting and look their place up in the plan.

Defined results: a null or empty text is the end id alone. Repeated rows, also of one id, are packed each. An empty
table gives no rows. Other columns are ignored; ids are per document row.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import buckets_for, cut

CAPACITY = 1024
END_ID = 2
CACHE = 300_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def latin_pattern() -> re.Pattern:
    """The byte-level pre-tokenizer's pattern for texts within Latin-1, with its classes spelled out for `re`."""
    kind = {c: unicodedata.category(chr(c))[0] for c in range(256)}
    cls = lambda f: "".join(f"\\x{c:02x}" for c in range(256) if f(c))
    space = cls(lambda c: chr(c) in "\t\n\x0b\x0c\r \x85\xa0")
    letter, number = cls(lambda c: kind[c] == "L"), cls(lambda c: kind[c] == "N")
    # Fixed value: the published pattern of the vocabulary.
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def byte_alphabet() -> dict[str, int]:
    """The byte-level vocabulary's printable stand-in of each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """ids of a text as little-endian unsigned 32-bit bytes, with a bounded cache of pre-token encodings.

    Pre-tokens of Latin-1 texts are split by the pattern above and merged by rank, which gives the ids of the
    tokenizer file (its ids are its ranks); other texts, and those with an added token's string, go through the
    tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        back = byte_alphabet()
        ranks = {bytes(back[c] for c in w): i for w, i in self.tokenizer.get_vocab().items() if w not in self.marks}
        self.merge = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pattern = latin_pattern()
        self.cache: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole(text)
        if any(m in text for m in self.marks):
            return self.whole(text)
        parts = self.pattern.findall(text)
        cache, merge = self.cache, self.merge
        if len(cache) > CACHE:
            cache.clear()
        for p in set(parts).difference(cache):
            cache[p] = array("I", merge(p)).tobytes()
        return b"".join(map(cache.__getitem__, parts))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first takes the remainder, the others are full."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and a hash of the piece's content for ties."""
    tail = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                rows, out = [], ([], [], [], [])
                for i, t in enumerate(part.column(1)):
                    ids = enc.encode(t.as_py() or "") + tail
                    for k, (start, n) in enumerate(cut_points(len(ids) // 4, capacity)):
                        rows.append(i)
                        for column, v in zip(out, (k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])), strict=True):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int32()), *(pa.array(x, pa.int64()) for x in out[1:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def price(values: np.ndarray, lengths: np.ndarray, limit: np.ndarray, capacity: int) -> np.ndarray:
    """A multiset of lengths within the limits, of largest total value: knapsack by dynamic programming over the capacity.

    The program knows no limits: what it takes beyond one is left out, and the room is priced again without that length.
    """
    worth, at = np.full(capacity + 1, -1.0), np.full(capacity + 1, -1)
    worth[lengths], at[lengths] = np.where(limit > 0, values, -1.0), np.arange(len(lengths))
    found, room, before = np.zeros(len(lengths), dtype=np.int64), capacity, -1
    while room not in (0, before):
        best, pick = np.zeros(room + 1), np.zeros(room + 1, dtype=np.int64)
        for c in range(1, room + 1):
            v = worth[1 : c + 1] + best[c - 1 :: -1]
            j = int(v.argmax())
            best[c], pick[c] = (v[j], j + 1) if v[j] > best[c - 1] else (best[c - 1], 0)
        before = c = room
        while c > 0:
            n = int(pick[c])
            c -= n or 1
            if n and found[at[n]] < limit[at[n]]:
                found[at[n]] += 1
                room -= n
            if n and found[at[n]] >= limit[at[n]]:
                worth[n] = -1.0
    return found


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, epsilon: float = 0.25) -> list[tuple[np.ndarray, int]]:
    """A cover of the whole demand: (configuration, how often), by multiplicative weights.

    Steps are whole, at most epsilon of the demand of the configuration's largest, so nothing is left to round. Each
    covers about epsilon of some length or ends one, which bounds their number by that of lengths, whatever the counts.
    """
    left, found = counts.copy(), {}
    while left.any():
        share = left / counts
        y = np.exp((share - share.max()) / epsilon)
        # Full sequences first; among those long pieces, for which room is scarce, and what is least covered.
        config = price(lengths * (1 + (0.3 + 0.05 * y) * lengths / capacity), lengths, left, capacity)
        used = config > 0
        step = min(int((left[used] // config[used]).min()), max(1, int(epsilon * (counts[used] / config[used]).max())))
        found.setdefault(config.tobytes(), [config, 0])[1] += step
        left -= config * step
    return [(c, x) for c, x in found.values()]


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Intervals (length, first rank, ranks, first sequence, copies per sequence, offset) and the number of sequences.

    Every rank of every length is in exactly one interval. The driver holds the histogram and the plan only.
    """
    order = np.argsort(lengths)
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    left, used, sequences = counts.copy(), np.zeros_like(counts), 0
    out: list[tuple[int, int, int, int, int, int]] = []

    def place(config: np.ndarray, times: int) -> None:
        nonlocal sequences
        offset = 0
        for j in np.flatnonzero(config)[::-1]:
            a = int(config[j])
            out.append((int(lengths[j]), int(used[j]), a * times, sequences, a, offset))
            used[j] += a * times
            left[j] -= a * times
            offset += a * int(lengths[j])
        sequences += times

    full = lengths == capacity
    if full.any():
        place(np.where(full, 1, 0), int(counts[full][0]))
    has = left > 0
    for config, times in solve(lengths[has], left[has], capacity):
        wide = np.zeros_like(counts)
        wide[has] = config
        place(wide, times)
    return out, sequences


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows with doc_id, piece, start, length, ids_crc32."""
    spark = parts.sparkSession
    spread = F.xxhash64("doc_id", "piece", "start", "ids_crc32")
    # A small fixed number of buckets per length is enough for ranks: the bucket count follows the input.
    histogram = parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most `capacity` rows
    total = int(histogram["n"].sum()) if len(histogram) else 0
    buckets = buckets_for(total)
    table, _ = plan(histogram["length"].to_numpy(), histogram["n"].to_numpy(), capacity) if total else ([], 0)
    schema = "_length long, _first long, _ranks long, _seq long, _copies long, _at long"
    places = spark.createDataFrame(table, schema)
    ranked = parts.withColumn("_b", F.pmod(spread, F.lit(buckets)).cast("int"))
    sizes = ranked.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(F.col("length").alias("_l"), F.col("_b").alias("_k"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = ranked.withColumn("_r", F.row_number().over(within) - 1).join(base, (F.col("length") == F.col("_l")) & (F.col("_b") == F.col("_k")))
    ranked = ranked.withColumn("_rank", F.col("_r") + F.col("_base"))
    # The plan has a bounded number of intervals (see solve), so it can be broadcast.
    hit = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_ranks"))
    placed = ranked.join(F.broadcast(places), hit)
    nth = F.col("_rank") - F.col("_first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_seq") + F.expr("(_rank - _first) div _copies")).alias("sequence_id"),
        (F.col("_at") + (nth % F.col("_copies")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return pack(cut(pieces(docs, tokenizer or default_tokenizer(), capacity, end_id)), capacity)
