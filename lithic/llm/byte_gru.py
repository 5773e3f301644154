"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

The network labels every byte position of a text with a language distribution; a document's log probabilities are
pooled over all its positions. The state runs on across words and blanks. So that a text of any length takes bounded
memory, it is read in windows that label WINDOW positions each: the state of either direction enters a window CONTEXT
bytes before the first position it labels. Before and after a text stand blanks. A shorter text has one window of the
next of SHORT sizes; the last window of a longer one ends with the text, and labels what the window before it left.
Windows depend on the text alone, so equal texts get equal answers whatever stands beside them.

The squashing functions are x / (1 + |x|) for the candidate state and its half plus a half for the gates, which numpy
works out several times faster than tanh. Training is backpropagation through time over a bounded, documented sample
of labelled rows (MAX_DOCS), of which whole texts are read, in pieces of PIECE bytes.

Defined results: a null text, or one without a letter, is `und` with score 0. Without any labelled training row
every text is `und`. Ties go to the language first in code-point order. Repeated rows get equal answers. Extra
columns pass through, but for those named like a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .shared import fitted

WINDOW, CONTEXT = 256, 32
SHORT = (32, 64, 128, WINDOW)
#: So many windows are read together.
BLOCK = 2048
PIECE = 64
HIDDEN = 12
MAX_DOCS = 2000
SEED = 11


def squash(x: np.ndarray) -> None:
    """In place."""
    size = np.abs(x)
    size += 1
    x /= size


def slope(gate: np.ndarray) -> np.ndarray:
    """The derivative of a gate, from its value."""
    return 0.5 * (1 - np.abs(2 * gate - 1)) ** 2


def body(text: str) -> bytes:
    """The text's bytes, ASCII letters in lower case."""
    return text.encode("utf-8", "surrogatepass").lower()


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class ByteGRU:
    """Weights: per direction, x (256, 3h) input table, u (h, 3h) recurrence, b (h,) candidate bias; out (2h, L), bias (L,)."""

    langs: list[str]
    w: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, langs: list[str], hidden: int = HIDDEN, seed: int = SEED) -> ByteGRU:
        r = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w[d + "x"] = r.normal(0, 0.3, (256, 3 * hidden))
            w[d + "u"] = r.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
        w["out"] = r.normal(0, 0.3, (2 * hidden, len(langs)))
        w["bias"] = np.zeros(len(langs))
        return cls(langs, {k: v.astype(np.float32) for k, v in w.items()})

    def run(self, x: np.ndarray, d: str, keep: bool = False, skip: int = 0):
        """States (T - skip, n, h) over x (T, n) bytes, without the first `skip`; with keep, what backpropagation needs."""
        wx, u = self.w[d + "x"], self.w[d + "u"]
        h, n = u.shape[0], x.shape[1]
        x_gates, x_candidate, gates, candidate = (np.ascontiguousarray(a) for a in (wx[:, : 2 * h], wx[:, 2 * h :], u[:, : 2 * h], u[:, 2 * h :]))
        state = np.zeros((n, h), wx.dtype)
        states, saved = np.empty((x.shape[0] - skip, n, h), wx.dtype), []
        for t in range(x.shape[0]):
            zr = state @ gates
            zr += x_gates.take(x[t], axis=0)
            squash(zr)
            zr += 1
            zr *= 0.5
            z, r = zr[:, :h], zr[:, h:]
            c = (r * state) @ candidate
            c += x_candidate.take(x[t], axis=0)
            squash(c)
            if keep:
                saved.append((state, z, r, c))
            step = c - state
            step *= z
            state = np.add(state, step, out=states[t - skip] if t >= skip else None)
        return states, saved

    def logits(self, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = f.shape[-1]
        return f @ self.w["out"][:h] + b @ self.w["out"][h:] + self.w["bias"]

    def log_probs(self, held: np.ndarray, at: np.ndarray, size: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """(n, L): log probabilities of windows of `size` positions from `at` on in held, summed over positions first to last."""
        steps = np.arange(size + CONTEXT)[:, None]
        f = self.run(held[at + steps - CONTEXT], "f", skip=CONTEXT)[0]
        b = self.run(held[at + size + CONTEXT - 1 - steps], "b", skip=CONTEXT)[0][::-1]
        h, n = f.shape[-1], len(at)
        out = self.w["out"].T
        # Languages first: numpy is slow along short last axes.
        y = out[:, :h] @ f.reshape(-1, h).T + out[:, h:] @ b.reshape(-1, h).T + self.w["bias"][:, None]
        y -= y.max(axis=0)
        y -= np.log(np.exp(y).sum(axis=0))
        place = np.arange(size)[:, None]
        y = y.reshape(-1, size, n)
        y *= (place >= first) & (place < last)
        return y.sum(axis=1).T

    def gradients(self, x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients, by backpropagation through time; every position of a column has its target."""
        f, fs = self.run(x, "f", keep=True)
        b, bs = self.run(x[::-1], "b", keep=True)
        b = b[::-1]
        y = self.logits(f, b)
        y -= y.max(axis=-1, keepdims=True)
        p = np.exp(y)
        p /= p.sum(axis=-1, keepdims=True)
        cols = np.arange(len(target))
        scale = weight / (weight.sum() * x.shape[0])
        loss = float((-np.log(np.maximum(p[:, cols, target], 1e-9)) * scale).sum())
        dy = p
        dy[:, cols, target] -= 1
        dy = (dy * scale[None, :, None]).astype(np.float32)
        h = f.shape[-1]
        g = {"bias": dy.sum(axis=(0, 1)), "out": np.concatenate([np.tensordot(f, dy, ([0, 1], [0, 1])), np.tensordot(b, dy, ([0, 1], [0, 1]))])}
        for d, saved, bytes_, dh_all in (("f", fs, x, dy @ self.w["out"][:h].T), ("b", bs, x[::-1], (dy @ self.w["out"][h:].T)[::-1])):
            u = self.w[d + "u"]
            gx, gu, per_byte = np.zeros_like(self.w[d + "x"]), np.zeros_like(u), [None] * x.shape[0]
            carry = np.zeros((x.shape[1], h), np.float32)
            for t in range(x.shape[0] - 1, -1, -1):
                before, z, r, c = saved[t]
                dh = dh_all[t] + carry
                dc = dh * z * (1 - np.abs(c)) ** 2
                drs = dc @ u[:, 2 * h :].T
                dzr = np.concatenate([dh * (c - before) * slope(z), drs * before * slope(r)], axis=1)
                carry = dh * (1 - z) + drs * r + dzr @ u[:, : 2 * h].T
                gu[:, : 2 * h] += before.T @ dzr
                gu[:, 2 * h :] += (r * before).T @ dc
                per_byte[t] = np.concatenate([dzr, dc], axis=1)
            flat = bytes_.reshape(-1)
            order = np.argsort(flat, kind="stable")
            seen, first = np.unique(flat[order], return_index=True)
            gx[seen] = np.add.reduceat(np.concatenate(per_byte)[order], first, axis=0)
            g[d + "x"], g[d + "u"] = gx, gu
        return loss, g


def train(texts: list[str], langs: list[str], hidden: int = HIDDEN, steps: int = 600, batch: int = 128, seed: int = SEED) -> ByteGRU:
    """Whole passes over all pieces of the texts, in a random order each, of at least `steps` steps together."""
    names = sorted(set(langs))
    model = ByteGRU.fresh(names, hidden, seed)
    if len(names) < 2:
        return model
    r = np.random.default_rng(seed)
    found = [body(t).ljust(PIECE) for t in texts]
    held = np.frombuffer(b"".join(found), np.uint8)
    ends = np.cumsum([len(f) for f in found])
    per = [-(-len(f) // PIECE) for f in found]
    # The last piece of a text ends with it.
    at = np.concatenate([np.minimum(e - len(f) + np.arange(k) * PIECE, e - PIECE) for e, f, k in zip(ends, found, per, strict=True)])
    target = np.repeat([names.index(n) for n in langs], per)
    counts = np.bincount(target, minlength=len(names))
    weight = (counts.sum() / np.maximum(counts, 1)) ** 0.5
    one_pass = -(-len(at) // batch)
    steps = -(-max(steps, one_pass) // one_pass) * one_pass
    m = {k: np.zeros_like(v) for k, v in model.w.items()}
    v = {k: np.zeros_like(w) for k, w in model.w.items()}
    for step in range(1, steps + 1):
        if (step - 1) % one_pass == 0:
            order = r.permutation(len(at))
        pick = order[(step - 1) % one_pass * batch :][:batch]
        _, g = model.gradients(held[at[pick] + np.arange(PIECE)[:, None]], target[pick], weight[target[pick]])
        rate = 0.01 * min(1.0, step / 50) * (1 - step / (steps + 1)) + 1e-4
        for k, w in model.w.items():
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            w -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def fit(docs: DataFrame, max_docs: int = MAX_DOCS, text: str = "text", lang: str = "lang", key: str = "doc_id") -> ByteGRU | None:
    """Train on at most max_docs rows of docs with text and lang, chosen by a hash of the id."""
    usable = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    order = [F.xxhash64("_k"), F.col("_k")]
    # The sample is chosen by id alone; only its own texts travel.
    ids = usable.select(F.col(key).alias("_k")).where("_k IS NOT NULL").distinct().orderBy(*order).limit(max_docs)
    rows = usable.select(F.col(key).alias("_k"), F.col(text).alias("t"), F.col(lang).alias("l")).join(F.broadcast(ids), "_k")
    return fitted(rows.select("t", "l", "_k").orderBy(*order, "t", "l").limit(max_docs), lambda r: train_rows(r["t"].to_pylist(), r["l"].to_pylist()))


def train_rows(texts: list[str], langs: list[str]) -> ByteGRU | None:
    known = [(t, n) for t, n in zip(texts, langs, strict=True) if has_letter(t)]
    return train([t for t, _ in known], [n for _, n in known]) if known else None


def windows(n: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(positions of a window, where windows begin, their first position that is not yet labelled) of a text of n bytes."""
    if n <= WINDOW:
        return next(k for k in SHORT if n <= k), np.zeros(1, np.int64), np.zeros(1, np.int64)
    fresh = np.arange(0, n, WINDOW)
    at = np.minimum(fresh, n - WINDOW)
    return WINDOW, at, fresh - at


def pooled(model: ByteGRU, texts: list[str]) -> np.ndarray:
    """(texts, L): the documents' pooled probabilities."""
    blanks, found, begin = b" " * CONTEXT, [], 0
    sums, lengths = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts), np.int64)
    by_size: dict[int, list[tuple[np.ndarray, ...]]] = {}
    for i, text in enumerate(texts):
        read = body(text)
        lengths[i] = len(read)
        size, at, first = windows(len(read))
        found.append(blanks + read.ljust(size) + blanks)
        by_size.setdefault(size, []).append((begin + CONTEXT + at, first, len(read) - at, np.full(len(at), i)))
        begin += len(found[-1])
    held = np.frombuffer(b"".join(found), np.uint8)
    for size, rows in by_size.items():
        at, first, last, doc = (np.concatenate(x) for x in zip(*rows, strict=True))
        for k in range(0, len(at), BLOCK):
            part = slice(k, k + BLOCK)
            np.add.at(sums, doc[part], model.log_probs(held, at[part], size, first[part], last[part]))
    mean = sums / lengths[:, None]
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def label(docs: DataFrame, model: ByteGRU | None, text: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language and its probability under the names out, which replace columns of these names; narrow."""
    kept = [k for k, n in enumerate(docs.columns) if n not in out]
    fields = [docs.schema[k] for k in kept]
    if model is None:
        return docs.select(*[f"`{f.name}`" for f in fields], F.lit("und").alias(out[0]), F.lit(0.0).alias(out[1]))
    at = docs.columns.index(text)
    schema = StructType([*fields, StructField(out[0], StringType()), StructField(out[1], DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                texts = part.column(at).to_pylist()
                known = [i for i, t in enumerate(texts) if has_letter(t)]
                pred, score = ["und"] * len(texts), [0.0] * len(texts)
                if known:
                    p = pooled(model, [texts[i] for i in known])
                    for i, row in zip(known, p, strict=True):
                        pred[i], score[i] = model.langs[int(row.argmax())], round(float(row.max()), 6)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)
