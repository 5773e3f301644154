import random
import struct
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest

from lithic.llm import chroma


def wav(x, rate=chroma.RATE):
    body = (np.clip(x, -1, 1) * 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


def test_alignment_of_a_shifted_noisy_copy(spark):
    r = np.random.default_rng(2)
    song = chroma.melody(list(r.normal(size=100)))[1]
    other = chroma.melody(list(r.normal(size=100)))[1]
    shift = 10 * chroma.HOP
    noisy = song[shift:] + r.normal(0, 0.005, len(song) - shift)
    rows = [(0, wav(song)), (1, wav(noisy)), (2, wav(other)), (3, wav(song)), (4, None), (5, b""), (6, b"RIFFnothing"), (7, wav(song[:100])), (20, wav(other))]
    df = chroma.fingerprints(spark.createDataFrame(rows, "id long, audio binary"), "audio")
    found = sorted(tuple(x)[:4] for x in chroma.align(df).collect())
    assert found == [(0, 0, 2, 0), (0, 1, 1, -10), (20, 2, 2, 0)]
    every = {x.id: x for x in chroma.catalogue(df).collect() if x.match_id is None}
    assert every[4].n_ints is None and every[7].n_ints is None and every[3].class_id == 0


def test_every_filter_equals_brute_force():
    r = np.random.default_rng(3)
    x = chroma.melody(list(r.normal(size=60)))[1]
    c = chroma.chroma_frames(x, chroma.RATE)
    packed = chroma.fingerprint(x, chroma.RATE).view(np.uint32)
    assert {b[0] for b in chroma.BANK} == {0, 1, 2, 3} and len(chroma.BANK) == 16
    for t in (0, 7, len(packed) - 1):
        for k, (shape, y, height, frames) in enumerate(chroma.BANK):
            sums = [0.0, 0.0]
            for i in range(frames):
                for j in range(height):
                    early, low = i < frames // 2, j < height // 2
                    if shape == 1 and not (j < max(height // 2, 1) or j >= height - max(height // 2, 1)):
                        continue
                    inner = frames // 4 <= i < frames - frames // 4
                    side = (not early, not low, early != low, not inner)[shape]
                    sums[side] += c[t + i, y + j]
            v = np.log((1 + sums[0]) / (1 + sums[1]))
            assert packed[t] >> (30 - 2 * k) & 3 == chroma.GRAY[np.searchsorted(chroma.LEVELS, v, side="right")]


def brute_alignment(rows, every, most_errors, least_overlap):
    """Pairs of classes by all offsets of equal integers, counted one by one."""
    classes = {}
    for i, fp in rows:
        if i is not None and fp is not None:
            classes.setdefault(tuple(fp), []).append(i)
    out = []
    for a, of in classes.items():
        for b, others in classes.items():
            if a == b:
                best = (0, len(a), 0.0) if len(of) > 1 else None
            else:
                votes = {}
                for i, x in enumerate(a):
                    for j, y in enumerate(b):
                        if x == y:
                            votes[j - i] = votes.get(j - i, 0) + 1
                if not votes:
                    continue
                offset = min(votes, key=lambda o: (-votes[o], abs(o), o))
                both = [(a[i], b[i + offset]) for i in range(len(a)) if 0 <= i + offset < len(b)]
                errors = sum(bin((x ^ y) & 0xFFFFFFFF).count("1") for x, y in both) / (32 * len(both))
                rounded = float(Decimal(repr(errors)).quantize(Decimal("0.000001"), ROUND_HALF_UP))  # as Spark rounds
                best = (offset, votes[offset], rounded) if len(both) >= least_overlap and errors <= most_errors else None
            if best:
                out += [(q, min(others), len(others), *best) for q in of if q % every == 0]
    return sorted(out)


@pytest.mark.parametrize("least_share", [3, 10_000])
def test_alignment_against_brute_force(spark, monkeypatch, least_share):
    """With a third of all integers one value, ties of offsets, copies, nulls and an extra column."""
    monkeypatch.setattr(chroma, "LEAST_SHARE", least_share)
    r = random.Random(4)
    base = [r.choice([7, r.randrange(12), r.randrange(12)]) for _ in range(40)]
    rows = [(i, [x if r.random() < 0.9 else r.randrange(12) for x in base[r.randrange(8) :]][: r.randrange(6, 30)]) for i in range(24)]
    rows += [(24, rows[3][1]), (25, rows[3][1]), (28, [7] * 20), (32, [7] * 12), (33, None), (None, base), (36, [])]
    df = spark.createDataFrame([(i, fp, 1) for i, fp in rows], "id long, fingerprint array<int>, value int")
    got = sorted(tuple(x) for x in chroma.align(df, 4, 0.25, 5).collect())
    assert got == brute_alignment(rows, 4, 0.25, 5) and len(got) > 20


def test_empty_table(spark):
    df = chroma.fingerprints(spark.createDataFrame([], "id long, audio binary"), "audio")
    assert chroma.catalogue(df).collect() == []
