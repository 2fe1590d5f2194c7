"""Quality by nearest-neighbour voting among latent-semantic vectors.

A text's terms are its words (hashed to a fixed number of buckets), runs of
three character classes, and marks of repetition.
Weighted by inverse document frequency and reduced by a truncated singular
value decomposition of the labelled sample, they give each text a unit vector.
The labelled vectors (a fixed number) go to every executor; documents come in
blocks, and one matrix product per block gives all cosines exactly.  The nearest
labelled vectors vote, each with a power of its cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import crc_fold, labelled_sample, only

#: Labelled rows of each label that vectors are made of at most.
SAMPLE_EACH = 1_500
FOLD, HELD_OUT = 5, 0
PREDICT_AT = 0.3
DIMENSIONS, NEIGHBOURS, POWER = 40, 25, 16

_CLASSES = 13
_CLASS = np.full(256, 11, np.uint8)
for _k, _set in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n\r\v\f", b".", b",;:", b"#", b"*$%&", b"|<>", b"!?")):
    _CLASS[list(_set)] = _k
_CLASS[128:] = 12
_REPEATS = 9
#: Buckets that words are hashed to.
WORD_TERMS = 1 << 10
TERMS = _CLASSES**3 + _REPEATS + WORD_TERMS


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of term shares, one row for each text of a slice."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    if len(data) >= 3:
        c = _CLASS[data].astype(np.int32)
        code = (c[:-2] * _CLASSES + c[1:-1]) * _CLASSES + c[2:]
        lengths = np.maximum(np.diff(offsets) - 2, 0)
        own = tk.spread(offsets[:-1], lengths)
        doc = np.repeat(np.arange(n), lengths)
        out[:, : _CLASSES**3] = np.bincount(doc * _CLASSES**3 + code[own], minlength=n * _CLASSES**3).reshape(n, -1)
    hashes, _, _, first = tk.words(data, offsets, tk.NOT_SPACE, tk.LOWER_ASCII)
    words = np.diff(first)
    doc = np.repeat(np.arange(n), words)
    same = np.zeros((_REPEATS, n))
    for k, lag in enumerate((1, 2, 3)):
        eq = np.zeros(len(hashes), bool)
        eq[lag:] = (hashes[lag:] == hashes[:-lag]) & (doc[lag:] == doc[:-lag])
        same[k] = np.bincount(doc[eq], minlength=n)
    for k, run in ((3, 1), (4, 3), (5, 5)):
        g = tk.grams(hashes, run)
        if len(g):
            own_doc = doc[: len(g)]
            whole = own_doc == doc[run - 1 :]
            # runs that occur again in their text: all but the first of equals
            d, v = own_doc[whole], g[whole]
            pair = np.lexsort((v, d))
            again = (v[pair][1:] == v[pair][:-1]) & (d[pair][1:] == d[pair][:-1])
            same[k] = np.bincount(d[pair][1:][again], minlength=n)
    share = same[:6] / np.maximum(words, 1)
    out[:, : _CLASSES**3] /= np.maximum(out[:, : _CLASSES**3].sum(1, keepdims=True), 1)
    out[:, _CLASSES**3 : _CLASSES**3 + 6] = share.T
    out[:, _CLASSES**3 + 6] = np.minimum(1, words / 1000)
    out[:, _CLASSES**3 + 7] = words < 10
    out[:, _CLASSES**3 + 8] = 0.02 * (words > 0)
    at = _CLASSES**3 + _REPEATS
    bucket = (hashes >> np.uint64(40)).astype(np.int64) % WORD_TERMS
    out[:, at:] = np.bincount(doc * WORD_TERMS + bucket, minlength=n * WORD_TERMS).reshape(n, -1)
    out[:, at:] /= np.maximum(words, 1)[:, None]
    return np.sqrt(out, out=out)


class Model:
    """Inverse document frequencies, the reduction, and the labelled vectors."""

    def __init__(self, rows: list[tuple[str, int]], counts: dict[int, int]):
        every = sum(counts.values())
        self.share = counts.get(1, 0) / every if every else 0.0
        self.vectors = None
        if not rows:
            return
        x = np.concatenate([term_counts(d, o) for _, _, d, o in tk.text_slices(pa.array([t for t, _ in rows], pa.string()))])
        label = np.array([y for _, y in rows], np.float32)
        self.idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 0.2).astype(np.float32)
        x *= self.idf
        rng = np.random.default_rng(5)
        k = min(DIMENSIONS, *x.shape)
        q = x @ rng.standard_normal((x.shape[1], min(k + 10, *x.shape)), dtype=np.float32)
        for _ in range(4):  # power iterations of the randomised decomposition
            q = np.linalg.qr(x @ (x.T @ np.linalg.qr(q)[0]))[0]
        _, _, vt = np.linalg.svd(q.T @ x, full_matrices=False)
        self.basis = np.ascontiguousarray(vt[:k].T)
        self.vectors = np.ascontiguousarray(self._unit(x @ self.basis).T)
        # the sample holds the labels evenly; a vote counts for the rows it stands for
        seen = {y: max(1, int((label == y).sum())) for y in (0, 1)}
        self.weight = np.where(label == 1, counts.get(1, 0) / every / seen[1], counts.get(0, 0) / every / seen[0]).astype(np.float32)
        self.label = label

    @staticmethod
    def _unit(v):
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, data: np.ndarray, offsets: np.ndarray, block: int = 256) -> np.ndarray:
        n = len(offsets) - 1
        out = np.full(n, self.share)
        if self.vectors is not None:
            for at in range(0, n, block):
                own = offsets[at : at + block + 1]
                v = self._unit((term_counts(data[own[0] : own[-1]], own - own[0]) * self.idf) @ self.basis)
                cosine = v @ self.vectors
                k = min(NEIGHBOURS, cosine.shape[1])
                near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
                vote = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6) ** POWER * self.weight[near]
                out[at : at + block] = (vote * self.label[near]).sum(1) / vote.sum(1)
        out[np.diff(offsets) == 0] = 0.0
        return np.clip(out, 0, 1)


def _scores(model: Model):
    def run(batches):
        for batch in batches:
            score = np.zeros(len(batch))
            for first, end, data, offsets in tk.text_slices(batch.column("text")):
                score[first:end] = model.score(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= PREDICT_AT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def quality(docs: DataFrame, labels: DataFrame, each: int = SAMPLE_EACH) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Vectors are made of `each` rows of each label at most, none held out (crc32
    of doc_id as text, mod 5, is 0).  Only the text is looked at, and all of it.
    A null or empty text scores 0.  Without any label the score is 0.  held_out
    is null for a null doc_id.  Ties among neighbours at the border of the
    nearest are broken alike for equal texts; repeated rows score alike; extra
    columns are ignored.
    """
    model = Model(*labelled_sample(docs, labels, "quality", FOLD, HELD_OUT, each))
    rows = only(docs, doc_id="long", text="string").withColumn("held_out", crc_fold(F.col("doc_id"), FOLD) == HELD_OUT)
    return rows.mapInArrow(_scores(model), "doc_id long, held_out boolean, score double, predicted int")
