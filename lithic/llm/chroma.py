"""Chroma audio fingerprints of media columns, and their alignment.

Audio becomes pitch-class frames (energy of twelve pitch classes, smoothed and normalised over time). Filters over
the integral image of the frames, a bank of box differences, are each quantised to two bits in Gray code and packed
into one 32-bit integer per frame. Two recordings align where the offsets of equal integers pile up in a histogram;
the share of differing bits over the overlap decides.

Defined results: null, empty or undecodable audio, and audio too short for one integer, has a null fingerprint and
takes no part in alignment. Recordings with equal fingerprints are one class, named by its smallest id; copies are
counted, not expanded into pairs. Ties between offsets go to the smaller absolute, then smaller, offset. An empty
table gives no rows. Extra columns pass through fingerprints(), but for one named like the result, and are ignored by
align().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .shared import cut

RATE, FRAME, HOP = 5512, 2048, 683
LOW_HZ, HIGH_HZ = 60.0, 2400.0
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
WIDTH = 16
LEVELS = (-0.12, 0.0, 0.12)
GRAY = np.array([0, 1, 3, 2], np.uint32)
#: An integer with more than 1/HOT of all rows of the index, and more than LEAST_SHARE, is dealt to several parts.
HOT, LEAST_SHARE = 256, 10_000


def filter_bank() -> list[tuple[int, int, int, int]]:
    """(shape, first pitch class, height, frames) of sixteen filters: four shapes at four scales each, by rule."""
    return [(shape, (5 * scale + 3 * shape) % (12 - height + 1), height, frames) for shape in range(4) for scale, (height, frames) in enumerate(((12, 4), (6, 8), (4, 12), (3, 16)))]


BANK = filter_bank()


def decode_wav(data: bytes | None) -> tuple[int, np.ndarray] | None:
    """(rate, mono samples in -1..1) of 8- or 16-bit PCM; None if it is none."""
    if not data or len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, form, body = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        chunk = data[at + 8 : at + 8 + size]
        if name == b"fmt " and len(chunk) >= 16:
            form = tuple(int.from_bytes(chunk[a:b], "little") for a, b in ((0, 2), (2, 4), (4, 8), (14, 16)))
        elif name == b"data":
            body = chunk
        at += 8 + size + (size & 1)
    if form is None or body is None or form[0] != 1 or form[1] < 1 or form[2] < 1 or form[3] not in (8, 16):
        return None
    _, channels, rate, bits = form
    if bits == 16:
        x = np.frombuffer(body[: len(body) // 2 * 2], "<i2") / 32768.0
    else:
        x = np.frombuffer(body, np.uint8) / 128.0 - 1.0
    x = x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1)
    return rate, x


@lru_cache(maxsize=8)
def pitch_map(frame: int, rate: int) -> np.ndarray:
    """Spectrum bins to pitch classes."""
    hz = np.fft.rfftfreq(frame, 1 / rate)
    out = np.zeros((len(hz), 12))
    on = np.flatnonzero((hz >= LOW_HZ) & (hz <= HIGH_HZ))
    out[on, np.round(12 * np.log2(hz[on] / 440.0)).astype(int) % 12] = 1
    return out


def chroma_frames(x: np.ndarray, rate: int) -> np.ndarray:
    if rate != RATE and len(x):
        n = int(len(x) * RATE / rate)
        x = np.interp(np.arange(n) * (rate / RATE), np.arange(len(x)), x)
    if len(x) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = np.empty((len(frames), 12))
    window, pitch = np.hanning(FRAME).astype(np.float32), pitch_map(FRAME, RATE)
    for at in range(0, len(frames), 256):  # long recordings in pieces
        power = np.abs(np.fft.rfft(frames[at : at + 256] * window, axis=1)) ** 2
        out[at : at + 256] = power @ pitch
    if len(out) < len(SMOOTH):
        return np.zeros((0, 12))
    out = sum(w * out[k : len(out) - len(SMOOTH) + 1 + k] for k, w in enumerate(SMOOTH))
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-6, out / np.maximum(norm, 1e-12), 0)


def fingerprint(x: np.ndarray, rate: int) -> np.ndarray | None:
    """One signed 32-bit integer for each frame with WIDTH frames from it on."""
    c = chroma_frames(x, rate)
    n = len(c) - WIDTH + 1
    if n < 1:
        return None
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return image[t + t1, y1] - image[t + t0, y1] - image[t + t1, y0] + image[t + t0, y0]

    packed = np.zeros(n, np.uint32)
    for shape, y, height, frames in BANK:
        h, f = height // 2, frames // 2
        if shape == 0:  # earlier against later
            a, b = area(0, f, y, y + height), area(f, frames, y, y + height)
        elif shape == 1:  # lower against upper
            a, b = area(0, frames, y, y + max(h, 1)), area(0, frames, y + height - max(h, 1), y + height)
        elif shape == 2:  # diagonal against the other diagonal
            a = area(0, f, y, y + h) + area(f, frames, y + h, y + height)
            b = area(f, frames, y, y + h) + area(0, f, y + h, y + height)
        else:  # middle against both ends
            a, b = area(frames // 4, frames - frames // 4, y, y + height), area(0, frames // 4, y, y + height) + area(frames - frames // 4, frames, y, y + height)
        packed = (packed << np.uint32(2)) | GRAY[np.searchsorted(LEVELS, np.log((1 + a) / (1 + b)), side="right")]
    return packed.view(np.int32)


def fingerprints(df: DataFrame, column: str, decode: Callable[[object], tuple[int, np.ndarray] | None] = decode_wav, out: str = "fingerprint") -> DataFrame:
    """df with array<int> fingerprints of a media column; decode gives (rate, samples) of a value, or None."""
    at = df.columns.index(column)
    kept = [k for k, n in enumerate(df.columns) if n != out]
    schema = StructType([*(df.schema[k] for k in kept), StructField(out, ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for v in b.column(at):
                sound = decode(v.as_py())
                made.append(None if sound is None else fingerprint(sound[1], sound[0]))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(made, pa.list_(pa.int32()))], names=schema.names)

    return df.mapInArrow(run, schema)


def bit_error_rate(a: Column, b: Column, offset: Column) -> tuple[Column, Column]:
    """(share of differing bits, integers compared) with b shifted by offset against a."""
    from_a, from_b = F.greatest(-offset, F.lit(0)), F.greatest(offset, F.lit(0))
    n = F.least(F.size(a) - from_a, F.size(b) - from_b)
    bits = F.zip_with(F.slice(a, from_a + 1, n), F.slice(b, from_b + 1, n), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda s, x: s + x) / (n * 32), n


def split_join(query: DataFrame, index: DataFrame, value: str) -> DataFrame:
    """query joined with index by value. A value with more than 1/HOT of index's rows is dealt to as many parts as it holds
    such shares; query's rows of it go to each. There are fewer than HOT such values, so they are broadcast.
    """
    per = cut(index.groupBy(value).agg(F.count(F.lit(1)).alias("_n")))
    share = max(LEAST_SHARE, (per.agg(F.sum("_n")).first()[0] or 0) / HOT)
    hot = F.broadcast(per.where(F.col("_n") > share).select(value, F.ceil(F.col("_n") / share).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = index.join(hot, value, "left").withColumn("_part", F.pmod(F.xxhash64("m", "pm"), parts).cast("int")).drop("_parts")
    copied = query.join(hot, value, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return copied.join(dealt, [value, "_part"]).drop("_part")


def align(marked: DataFrame, every: int = 20, most_errors: float = 0.25, least_overlap: int = 8, key: str = "id", fp: str = "fingerprint") -> DataFrame:
    """query_id, match_id, copies, offset, votes, bit_errors: rows whose key is divisible by `every`, against all.

    match_id is the smallest id of a class of equal fingerprints. A query's own class appears if it has other rows.
    """
    rows = cut(marked.where(F.col(fp).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(fp).alias("fp")).withColumn("h", F.xxhash64("fp")))
    classes = cut(rows.groupBy("h", "fp").agg(F.min("id").alias("match_id"), F.count(F.lit(1)).alias("copies")))
    asked = rows.where(F.col("id") % every == 0)
    asked_classes = cut(classes.join(asked.select("h").distinct(), "h", "left_semi"))
    index = classes.select(F.col("match_id").alias("m"), F.posexplode("fp").alias("pm", "value"))
    query = asked_classes.select(F.col("match_id").alias("q"), F.posexplode("fp").alias("pq", "value"))
    votes = split_join(query, index, "value").where("q <> m").groupBy("q", "m", (F.col("pm") - F.col("pq")).alias("offset")).agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("q", "m").agg(F.max_by(F.struct("offset", "votes"), F.struct("votes", F.negative(F.abs("offset")), F.negative("offset"))).alias("b"))
    left = asked_classes.select(F.col("match_id").alias("q"), F.col("fp").alias("_a"))
    right = classes.select(F.col("match_id").alias("m"), F.col("fp").alias("_b"), "copies")
    errors, n = bit_error_rate(F.col("_a"), F.col("_b"), F.col("offset"))
    pairs = best.select("q", "m", "b.offset", "b.votes").join(left, "q").join(right, "m").withColumn("bit_errors", errors).withColumn("_n", n)
    pairs = pairs.where((F.col("_n") >= least_overlap) & (F.col("bit_errors") <= most_errors)).select("q", F.col("m").alias("match_id"), "copies", "offset", "votes", "bit_errors")
    own = asked_classes.where("copies > 1").select(F.col("match_id").alias("q"), "match_id", "copies", F.lit(0).alias("offset"), F.size("fp").cast("long").alias("votes"), F.lit(0.0).alias("bit_errors"))
    found = pairs.unionByName(own)
    named = asked.join(asked_classes.select("h", F.col("fp").alias("_fp"), F.col("match_id").alias("q")), "h").where("fp = _fp").select(F.col("id").alias("query_id"), "q")
    return named.join(found, "q").select("query_id", "match_id", "copies", "offset", "votes", F.round("bit_errors", 6).alias("bit_errors"))


def catalogue(marked: DataFrame, every: int = 20, key: str = "id", fp: str = "fingerprint") -> DataFrame:
    """Every recording with its number of integers and its class; those asked for have a row for each alignment."""
    marked = cut(marked.select(F.col(key).cast("long").alias("id"), F.col(fp).alias("fingerprint")))
    has = marked.where(F.col("fingerprint").isNotNull() & F.col("id").isNotNull())
    classes = has.groupBy(F.xxhash64("fingerprint").alias("_h"), F.col("fingerprint").alias("_fp")).agg(F.min("id").alias("class_id"))
    sized = marked.select("id", "fingerprint", F.when(F.col("fingerprint").isNotNull(), F.size("fingerprint")).alias("n_ints"), F.when(F.col("fingerprint").isNotNull(), F.xxhash64("fingerprint")).alias("_k"))
    found = align(marked, every)
    return sized.join(classes, (F.col("_k") == F.col("_h")) & (F.col("fingerprint") == F.col("_fp")), "left").join(found, F.col("id") == F.col("query_id"), "left").select("id", "n_ints", "class_id", "match_id", "copies", "offset", "votes", "bit_errors")


def melody(values: list[float] | None) -> tuple[int, np.ndarray] | None:
    """A recording of a vector: a note of an eighth of a second for each component, its pitch by the component's size."""
    if not values or any(v is None or v != v or abs(v) == float("inf") for v in values):
        return None
    v = np.asarray(values, float)
    top = np.abs(v).max()
    pitch = np.floor((v / top + 1) / 2 * 11.99) if top > 0 else np.zeros(len(v))
    hz = 220.0 * 2 ** (np.minimum(pitch, 11) / 12)
    n = RATE // 8
    phase = 2 * np.pi * np.cumsum(np.repeat(hz, n)) / RATE
    return RATE, (0.6 * np.sin(phase) + 0.2 * np.sin(2 * phase)).astype(np.float32)
