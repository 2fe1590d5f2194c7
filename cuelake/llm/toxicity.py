"""Toxicity by gradient-boosted trees over dense features, calibrated isotonically.

The lexicon isn't given: words and word beginnings that mark label 1 are learned
from the labelled sample, and lexicon, trees and calibration are cross-fitted, so
that small samples serve all three.  All documents are then scored in one pass without a shuffle.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import crc_fold, fitted, labelled_rows, only

#: Labelled rows of each label that the model is fitted on at most.
SAMPLE_EACH = 3_000
FOLD, HELD_OUT = 4, 2
PREDICT_AT = 0.3
#: Parts of the sample in cross-fitting.
FOLDS = 5
PREFIX_BYTES = (4, 5, 6, 7)
NEAR_WORDS = 3

#: Second-person words of the languages at hand.
SECOND_PERSON = ("you your yours yourself ur thou thee thy du dich dir dein deine deiner deinen euch euer ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros").split()
_LEET = tk.LOWER_ASCII.copy()
for _a, _b in zip(b"0134578@$!|", b"oieastbasii"):
    _LEET[_a] = _b
_LEET_WORD = tk.ALNUM.copy()
_LEET_WORD[list(b"@$!|*")] = True

FEATURES = (
    "density hits prefix_hits strongest distinct near_you you_rate capitals shouted exclaim punctuation obfuscated leet_hits length repeated_marks".split()
)


def beginnings(data, starts, ends, length: int) -> np.ndarray:
    """Hash of the first bytes of each word; 0 for shorter words."""
    out = np.zeros(len(starts), np.uint64)
    long = np.flatnonzero(ends - starts >= length)
    value = np.zeros(len(long), np.uint64)
    for i in range(length):
        value += tk.BYTE_VALUE[tk.LOWER_ASCII[data[starts[long] + i]]] * tk.position_multipliers(length)[i]
    out[long] = tk.mix(value + np.uint64(length))
    return out


def distinct_texts(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Rows without exact and most near copies, which would make all their words look like marks of a label."""
    seen, out = set(), []
    for text, label in rows:
        h = tk.words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), tk.ALNUM, tk.LOWER_ASCII)[0]
        runs = tk.grams(h, 3) if len(h) >= 3 else h
        marks = {(i, int(tk.mix(runs * m).min())) for i, m in enumerate(tk.GRAM_MULTIPLIERS[:3])} if len(runs) else {(-1, 0)}
        if not marks & seen:
            out.append((text, label))
        seen |= marks
    return out


class Occurrences:
    """Which of some labelled texts hold which words and word beginnings, each once; of those that `least` texts of label 1 hold."""

    def __init__(self, rows: list[tuple[str, int]], least: int = 4):
        self.label, self.least = np.array([y for _, y in rows]), least
        texts = pa.array([t for t, _ in rows], pa.string())
        self.word = self._pairs(texts, 0)
        self.prefix = {n: self._pairs(texts, n) for n in PREFIX_BYTES}

    def _pairs(self, texts, length: int):
        """(names, name of each pair, text of each pair), read slice by slice."""
        keys, docs = [], []
        for row, _, data, offsets in tk.text_slices(texts):
            hashes, starts, ends, first = tk.words(data, offsets, tk.ALNUM, tk.LOWER_ASCII)
            key = beginnings(data, starts, ends, length) if length else hashes
            doc = np.repeat(np.arange(row, row + len(offsets) - 1, dtype=np.int32), np.diff(first))
            order = np.lexsort((doc, key))
            k, d = key[order], doc[order]
            some = k != 0
            some[1:] &= (k[1:] != k[:-1]) | (d[1:] != d[:-1])
            keys.append(k[some])
            docs.append(d[some])
        name, at = np.unique(np.concatenate(keys), return_inverse=True)
        doc = np.concatenate(docs)
        keep = np.bincount(at, self.label[doc], len(name)) >= self.least
        own = keep[at]
        return name[keep], (np.cumsum(keep) - 1)[at[own]], doc[own]


class Lexicon:
    """Words and word beginnings with the log odds of label 1 where they occur, from the texts marked in `use`."""

    def __init__(self, found: Occurrences, use: np.ndarray, odds: float = 2.8):
        marks = lambda pairs: self._marks(*pairs, found.label, use, found.least, odds)
        self.word = marks(found.word)
        self.prefix = {n: marks(pairs) for n, pairs in found.prefix.items()}

    @staticmethod
    def _marks(name, at, doc, label, use, least, odds):
        own = use[doc]
        at, ones = at[own], label[doc[own]]
        ones, every = np.bincount(at, ones, len(name)), np.bincount(at, minlength=len(name))
        n1, n0 = max(1, label[use].sum()), max(1, (1 - label[use]).sum())
        weight = np.log(((ones + 0.5) / (n1 + 1)) / ((every - ones + 0.5) / (n0 + 1)))
        keep = (ones >= least) & (weight >= odds)
        return name[keep], weight[keep]

    @staticmethod
    def weights(marks, keys) -> np.ndarray:
        name, weight = marks
        if not len(name) or not len(keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(name, keys), len(name) - 1)
        return np.where(name[at] == keys, weight[at], 0.0)


_YOU = np.sort(tk.words(np.frombuffer(" ".join(SECOND_PERSON).encode(), np.uint8), np.array([0, len(" ".join(SECOND_PERSON).encode())]), tk.ALNUM, tk.LOWER_ASCII)[0])
_UPPER, _LETTER = tk.byte_table(range(65, 91)), tk.byte_table([*range(65, 91), *range(97, 123), *range(128, 256)])
_EXCLAIM, _DIGIT = tk.byte_table(b"!?"), tk.byte_table(b"0123456789")
_PUNCTUATION = tk.byte_table(b for b in range(33, 127) if not chr(b).isalnum())


def features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """One row of FEATURES for each text of a slice."""
    n_docs = len(offsets) - 1
    hashes, starts, ends, first = tk.words(data, offsets, tk.ALNUM, tk.LOWER_ASCII)
    n = np.maximum(np.diff(first), 1)
    size = np.maximum(np.diff(offsets), 1)
    by_doc = lambda x, at=first: np.diff(np.concatenate([[0.0], np.cumsum(x)])[at])
    weight = lexicon.weights(lexicon.word, hashes)
    begins = np.zeros(len(hashes))
    for length, marks in lexicon.prefix.items():
        if len(marks[0]):
            begins = np.maximum(begins, lexicon.weights(marks, beginnings(data, starts, ends, length)))
    marked = np.maximum(weight, begins)
    hit = marked > 0
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    strongest = np.zeros(n_docs)
    np.maximum.at(strongest, doc[hit], marked[hit])
    distinct = np.bincount(np.unique(np.stack([doc[hit].astype(np.uint64), hashes[hit]], 1), axis=0)[:, 0].astype(np.int64), minlength=n_docs) if hit.any() else np.zeros(n_docs)
    you = np.isin(hashes, _YOU)
    near, where = np.zeros(len(hashes), bool), np.flatnonzero(you)
    for d in range(-NEAR_WORDS, NEAR_WORDS + 1):
        at = where + d
        ok = (at >= 0) & (at < len(hashes))
        ok[ok] &= doc[at[ok]] == doc[where[ok]]
        near[at[ok]] = True
    upper = _UPPER[data]
    caps = np.concatenate([[0], np.cumsum(upper)])
    shouted = (caps[ends] - caps[starts] == ends - starts) & (ends - starts > 1)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    mixed = digits[ends] - digits[starts]
    obfuscated = (mixed > 0) & (mixed < ends - starts)
    leet, ls, le, lfirst = tk.words(data, offsets, _LEET_WORD, _LEET)
    signs = np.concatenate([[0], np.cumsum(~_LETTER[data])])
    leet_hit = (lexicon.weights(lexicon.word, leet) > 0) & (signs[le] > signs[ls])
    mark = _PUNCTUATION[data]
    again = np.zeros(len(data), bool)
    again[1:] = mark[1:] & (data[1:] == data[:-1])
    letters = np.maximum(by_doc(_LETTER[data], offsets), 1)
    hits, prefix_hits = by_doc(weight > 0), by_doc(begins > 0)
    columns = [
        by_doc(marked) / n * 100, np.log1p(hits), np.log1p(prefix_hits), strongest, distinct, by_doc(hit & near) / np.maximum(by_doc(hit), 1), by_doc(you) / n, by_doc(upper, offsets) / letters,
        by_doc(shouted) / n, by_doc(_EXCLAIM[data], offsets) / size, by_doc(mark, offsets) / size, by_doc(obfuscated) / n, np.log1p(by_doc(leet_hit, lfirst)), np.log1p(n), by_doc(again, offsets) / size,
    ]
    return np.stack(columns, 1).astype(np.float32)


class Boosted:
    """Gradient-boosted trees for logistic loss, on features cut into quantile bins."""

    def __init__(self, x, y, weight, trees: int = 30, depth: int = 2, rate: float = 0.1, bins: int = 32, ridge: float = 1.0):
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = self._bin(x)
        p = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
        self.base, self.depth, self.trees = float(np.log(p / (1 - p))), depth, []
        raw = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            tree, leaf = self._grow(binned, weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6), depth, ridge, bins)
            tree = (*tree, rate * leaf[1])
            self.trees.append(tree)
            raw += tree[2][leaf[0]]

    def _bin(self, x):
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], 1)

    @staticmethod
    def _grow(binned, gradient, hessian, depth, ridge, bins):
        """Each level splits every node by its own best feature and bin."""
        node = np.zeros(len(binned), np.int64)
        feature, at = np.zeros((2**depth - 1,), np.int64), np.full((2**depth - 1,), bins + 1)
        for level in range(depth):
            count = 2**level
            best = np.full(count, 1e-9)
            for j in range(binned.shape[1]):
                cell = node * (bins + 1) + binned[:, j]
                g = np.bincount(cell, gradient, count * (bins + 1)).reshape(count, -1)
                h = np.bincount(cell, hessian, count * (bins + 1)).reshape(count, -1)
                gl, hl = np.cumsum(g, 1), np.cumsum(h, 1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                k = gain.argmax(1)
                better = gain[np.arange(count), k] > best
                best = np.where(better, gain[np.arange(count), k], best)
                feature[count - 1 : 2 * count - 1][better] = j
                at[count - 1 : 2 * count - 1][better] = k[better]
            node = node * 2 + (binned[np.arange(len(node)), feature[count - 1 + node]] > at[count - 1 + node])
        value = np.bincount(node, gradient, 2**depth) / (np.bincount(node, hessian, 2**depth) + ridge)
        return (feature, at), (node, value)

    def raw(self, x) -> np.ndarray:
        binned, out, rows = self._bin(x), np.full(len(x), self.base), np.arange(len(x))
        for feature, at, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                k = 2**level - 1 + node
                node = node * 2 + (binned[rows, feature[k]] > at[k])
            out += value[node]
        return out


def isotonic(x, y, weight) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots and rising values of the best monotone fit."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for k, v, w in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist()):
        blocks.append([k, k, v, w])
        while len(blocks) > 1 and (blocks[-2][2] >= blocks[-1][2] or blocks[-2][1] == blocks[-1][0]):
            a, b = blocks[-2], blocks.pop()
            blocks[-1] = [a[0], b[1], (a[2] * a[3] + b[2] * b[3]) / (a[3] + b[3]), a[3] + b[3]]
    return np.array([x for b in blocks for x in (b[0], b[1])]), np.array([b[2] for b in blocks for _ in (0, 1)])


class Model:
    """Lexicon, trees and calibration, cross-fitted over FOLDS parts of the rows.

    A row's features for the trees come from a lexicon learned on the other
    parts, and its raw score for the calibration from trees fitted on the other
    parts, so that no row vouches for itself; lexicon and trees that score new
    texts are learned from all rows."""

    def __init__(self, rows: list[tuple[str, int]], counts: dict[int, int]):
        rows = distinct_texts(rows)
        label = np.array([y for _, y in rows], float)
        self.constant = None
        if len(rows) < 30 or label.min() == label.max():
            every = sum(counts.values())
            self.constant = counts.get(1, 0) / every if every else 0.0
            return
        part = np.zeros(len(rows), int)
        for y in (0, 1):  # each part gets its share of both labels
            own = np.flatnonzero(label == y)
            part[own] = np.arange(len(own)) % FOLDS
        x = np.zeros((len(rows), len(FEATURES)), np.float32)
        found = Occurrences(rows)
        for k in range(FOLDS):
            lexicon = Lexicon(found, part != k)
            x[part == k] = self._features([t for (t, _), p in zip(rows, part) if p == k], lexicon)
        seen = {y: max(1, int((label == y).sum())) for y in (0, 1)}
        total = sum(counts.values())
        weight = np.where(label == 1, counts.get(1, 0) / total / seen[1], counts.get(0, 0) / total / seen[0]) * len(rows)
        raw = np.zeros(len(rows))
        for k in range(FOLDS):
            raw[part == k] = Boosted(x[part != k], label[part != k], weight[part != k]).raw(x[part == k])
        self.lexicon = Lexicon(found, part >= 0)
        self.trees = Boosted(x, label, weight)
        self.knots = isotonic(raw, label, weight)

    @staticmethod
    def _features(texts: list[str], lexicon: Lexicon) -> np.ndarray:
        return np.concatenate([features(d, o, lexicon) for _, _, d, o in tk.text_slices(pa.array(texts, pa.string()))])

    def score(self, data, offsets) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        return np.clip(np.interp(self.trees.raw(features(data, offsets, self.lexicon)), *self.knots), 0, 1)


def _model(docs: DataFrame, labels: DataFrame, each: int) -> Model:
    return fitted(*labelled_rows(docs, labels, "toxic", FOLD, HELD_OUT, each), Model)


def _scores(model: Model):
    def run(batches):
        for batch in batches:
            score = np.zeros(len(batch))
            for first, end, data, offsets in tk.text_slices(batch.column("text")):
                score[first:end] = model.score(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= PREDICT_AT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, each: int = SAMPLE_EACH) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    The model learns from `each` rows of each label at most, none held out
    (crc32 of doc_id as text, mod 4, is 2).  Only the text is looked at.  A null
    or empty text is scored as a text without words.  Without labels of both
    kinds the score is label 1's share, or 0 without any.  held_out is null for a
    null doc_id.  Repeated rows are scored alike; extra columns are ignored.
    """
    model = _model(docs, labels, each)
    rows = only(docs, doc_id="long", text="string").withColumn("held_out", crc_fold(F.col("doc_id"), FOLD) == HELD_OUT)
    return rows.mapInArrow(_scores(model), "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, each: int = SAMPLE_EACH, at: float = PREDICT_AT) -> DataFrame:
    """The rows of docs that score below `at`, whole, in one pass without a shuffle."""
    model = _model(docs, labels, each)

    def keep(batches):
        for batch in batches:
            score = np.zeros(len(batch))
            for first, end, data, offsets in tk.text_slices(batch.column("text")):
                score[first:end] = model.score(data, offsets)
            yield batch.filter(pa.array(score < at))

    return docs.mapInArrow(keep, docs.schema)
