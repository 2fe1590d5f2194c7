"""Language by a bidirectional gated recurrent network over bytes.

One small GRU reads the bytes forwards, another backwards; at every byte their
two states give a distribution over languages.  The network is trained here, in
numpy, by backpropagation through time.  A document is read whole: it is cut
into windows that overlap by CONTEXT bytes on both sides, all windows of a batch
step together, and the log probabilities of every position are pooled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import crc_fold, cut, only, small_side

FOLD, HELD_OUT = 4, 2
#: Documents that the network is fitted on at most (but ten of each language).
SAMPLE_ROWS = 3_000
#: Parts of a language that its first documents are looked for in, so that no task gets all of a language.
SAMPLE_PARTS = 16
HIDDEN = 8
WINDOW, CONTEXT = 224, 16
STEPS, BATCH, TRAIN_BYTES = 260, 128, 48
UNKNOWN = "und"


def _gate(x):
    """A cheap sigmoid: (1 + x / (1 + |x|)) / 2."""
    return 0.5 + 0.5 * x / (1 + np.abs(x))


def _gate_slope(x):
    return 0.5 / (1 + np.abs(x)) ** 2


def _squash(x):
    return x / (1 + np.abs(x))


def _squash_slope(x):
    return 1 / (1 + np.abs(x)) ** 2


class Direction:
    """A GRU over bytes: z and r gates, a candidate, h = h + z * (candidate - h)."""

    def __init__(self, hidden: int, rng):
        self.byte = (rng.standard_normal((256, 3 * hidden)) * 0.3).astype(np.float32)
        self.gates = (rng.standard_normal((hidden, 2 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.cand = (rng.standard_normal((hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)

    @property
    def params(self):
        return [self.byte, self.gates, self.cand]

    def run(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x: bytes (steps, batch).  States (steps, batch, hidden)."""
        steps, batch = x.shape
        k = len(self.cand)
        h = np.zeros((batch, k), np.float32)
        out = np.empty((steps, batch, k), np.float32)
        for t in range(steps):
            e = self.byte[x[t]]
            a = h @ self.gates
            a += e[:, : 2 * k]
            g = _gate(a)
            b = (g[:, k:] * h) @ self.cand
            b += e[:, 2 * k :]
            c = _squash(b)
            new = h + g[:, :k] * (c - h)
            if keep is not None:
                keep.append((h, a, g, b, c))
            h = out[t] = new
        return out

    def back(self, x: np.ndarray, kept: list, d_out: np.ndarray) -> list[np.ndarray]:
        """Gradients, by backpropagation through time."""
        k = len(self.cand)
        g_byte, g_gates, g_cand = (np.zeros_like(p) for p in self.params)
        dh = np.zeros(d_out.shape[1:], np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, a, g, b, c = kept[t]
            dh = dh + d_out[t]
            z, r = g[:, :k], g[:, k:]
            db = dh * z * _squash_slope(b)
            drh = db @ self.cand.T
            dg = np.concatenate([dh * (c - h), drh * h], 1)
            da = dg * _gate_slope(a)
            g_cand += (r * h).T @ db
            g_gates += h.T @ da
            np.add.at(g_byte, x[t], np.concatenate([da, db], 1))
            dh = dh * (1 - z) + drh * r + da @ self.gates.T
        return [g_byte, g_gates, g_cand]


class Network:
    def __init__(self, languages: int, hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.forward, self.backward = Direction(hidden, rng), Direction(hidden, rng)
        self.out = (rng.standard_normal((2 * hidden, languages)) * 0.3).astype(np.float32)
        self.bias = np.zeros(languages, np.float32)

    @property
    def params(self):
        return [*self.forward.params, *self.backward.params, self.out, self.bias]

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.concatenate([self.forward.run(x), self.backward.run(x[::-1])[::-1]], 2)
        return h @ self.out + self.bias

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over all positions and its gradients; y: the language of each window."""
        kf, kb = [], []
        h = np.concatenate([self.forward.run(x, kf), self.backward.run(x[::-1], kb)[::-1]], 2)
        p = _softmax(h @ self.out + self.bias)
        rows = np.arange(x.shape[1])
        loss = -float(np.log(p[:, rows, y] + 1e-9).mean())
        p[:, rows, y] -= 1
        p /= p.shape[0] * p.shape[1]
        k = len(self.forward.cand)
        dh = p @ self.out.T
        return loss, [
            *self.forward.back(x, kf, dh[:, :, :k]),
            *self.backward.back(x[::-1], kb, dh[::-1, :, k:]),
            np.einsum("tbi,tbj->ij", h, p, optimize=True),
            p.sum((0, 1)),
        ]


def _softmax(x):
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Model:
    """A trained network and the names of its languages."""

    def __init__(self, rows: list[tuple[str, str]], steps: int = STEPS, seed: int = 2):
        self.names = sorted({lang for _, lang in rows})
        self.net = None
        at = {n: i for i, n in enumerate(self.names)}
        texts = [(np.frombuffer(t.encode(), np.uint8), at[lang]) for t, lang in rows if lang in at and len(t) >= 2]
        if len(self.names) < 2 or not texts:
            return
        rng = np.random.default_rng(seed)
        by = [[t for t, y in texts if y == i] for i in range(len(self.names))]
        some = [i for i, own in enumerate(by) if own]
        self.net = Network(len(self.names))
        m, v = [np.zeros_like(p) for p in self.net.params], [np.zeros_like(p) for p in self.net.params]
        for step in range(1, steps + 1):
            y = rng.choice(some, BATCH)
            x = np.full((TRAIN_BYTES, BATCH), 32, np.uint8)
            for j, lang in enumerate(y):
                t = by[lang][rng.integers(len(by[lang]))]
                s = rng.integers(max(1, len(t) - TRAIN_BYTES + 1))
                x[: len(t[s : s + TRAIN_BYTES]), j] = t[s : s + TRAIN_BYTES]
                if rng.random() < 0.2:  # all capitals too
                    low = (x[:, j] >= 97) & (x[:, j] <= 122)
                    x[low, j] -= 32
            _, grads = self.net.gradients(x, y)
            rate = 0.02 * min(1, step / 20) * (1 - 0.9 * step / steps)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            for i, (p, g) in enumerate(zip(self.net.params, grads)):
                g = g * min(1, 1 / (norm + 1e-9))
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                p -= (rate * m[i] / (1 - 0.9**step) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)).astype(p.dtype)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language index, score) of each text of a slice."""
        n = len(offsets) - 1
        if self.net is None:
            return np.zeros(n, np.int64), np.full(n, 1.0 if self.names else 0.0)
        sizes = np.diff(offsets)
        windows = -(-sizes // WINDOW)
        doc = np.repeat(np.arange(n), windows)
        start = offsets[:-1][doc] + WINDOW * (np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows))
        end = np.minimum(start + WINDOW, offsets[1:][doc])
        total = np.zeros((n, len(self.names)))
        order = np.argsort(end - start, kind="stable")
        each = max(64, 16_384 // max(8, len(self.names)))  # windows at once: bounded memory for many languages
        for at in range(0, len(order), each):
            own = order[at : at + each]
            steps = int((end[own] - start[own]).max()) + 2 * CONTEXT
            place = start[own][None, :] - CONTEXT + np.arange(steps)[:, None]
            inside = (place >= offsets[:-1][doc[own]]) & (place < np.minimum(end[own] + CONTEXT, offsets[1:][doc[own]]))
            x = np.where(inside, data[np.clip(place, 0, max(len(data) - 1, 0))], np.uint8(32))
            e = self.net.logits(x)
            e -= e.max(2, keepdims=True)
            e -= np.log(np.exp(e).sum(2, keepdims=True))
            e *= ((place >= start[own]) & (place < end[own]))[:, :, None]
            np.add.at(total, doc[own], e.sum(0))
        # positions aren't independent: their mean, sharpened, rather than their sum
        p = _softmax(total / np.maximum(sizes, 1)[:, None] * np.minimum(sizes, 64)[:, None] / 8)
        best = p.argmax(1)
        return best, p[np.arange(n), best]


def _predictions(model: Model):
    names = np.array([*model.names, UNKNOWN], object)

    def run(batches):
        for batch in batches:
            lang, score = np.full(len(batch), len(names) - 1), np.zeros(len(batch))
            texts = batch.column("text")
            for first, end, data, offsets in tk.text_slices(texts, tk.SLICE_BYTES // 2):
                best, p = model.predict(data, offsets)
                for i in range(end - first):
                    text = texts[first + i].as_py()
                    if model.names and text and any(map(str.isalpha, text)):
                        lang[first + i], score[first + i] = best[i], p[i]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names[lang], pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def training_rows(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """(text, lang) of `rows` documents at most (ten of each language at least) that aren't held out, as many of each language as there are, by a hash of doc_id."""
    own = only(docs, doc_id="long", text="string", lang="string").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_fold(F.col("doc_id"), FOLD) != HELD_OUT))
    key = own.select("lang", F.xxhash64(F.lit(9), "doc_id").alias("k"), "doc_id", F.xxhash64("text").alias("h"), "text")
    each = max(10, rows // max(1, own.select("lang").distinct().count()))
    # the rows are chosen without their texts: the first `each` of every part of a language, and of those the first `each`
    place = lambda *by: F.row_number().over(W.partitionBy("lang", *by).orderBy("k", "doc_id", "h"))
    parts = key.select("lang", "k", "doc_id", "h", F.pmod(F.col("k"), F.lit(SAMPLE_PARTS)).alias("part"))
    chosen = parts.withColumn("r", place("part")).where(F.col("r") <= each).withColumn("r", place()).where(F.col("r") <= each)
    chosen = cut(chosen.groupBy("lang", "doc_id", "h").agg(F.min("r").alias("r")), "chosen")  # a repeated row counts once
    found = key.select("lang", "doc_id", "h", "text").join(small_side(chosen), ["lang", "doc_id", "h"])
    found = found.groupBy("lang", "r").agg(F.first("text").alias("text")).collect()
    return [(r.text, r.lang) for r in sorted(found, key=lambda r: (r.lang, r.r))]


def languages(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    The network learns every language, from `rows` documents at most (but ten of
    each language, if there are so many), none held
    out (crc32 of doc_id as text, mod 4, is 2), and reads the text alone, whole.
    A text that is null or has no letter is "und" with score 0; so is every text
    if no document has a language.  With one language only, that one is
    predicted with score 1.  held_out is null for a null doc_id.  Repeated rows
    score alike; extra columns are ignored.
    """
    model = Model(training_rows(docs, rows))
    rows = only(docs, doc_id="long", text="string").withColumn("held_out", crc_fold(F.col("doc_id"), FOLD) == HELD_OUT)
    return rows.mapInArrow(_predictions(model), "doc_id long, held_out boolean, lang_pred string, score double")
