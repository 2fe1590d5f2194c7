"""Benchmark decontamination by winnowed fingerprints.

Both sides are cut into runs of GRAM words; of the WINDOW - GRAM + 1 runs inside
every WINDOW consecutive words the one with the smallest hash is the window's
fingerprint (Schleimer et al., "Winnowing").  Equal windows have equal
fingerprints, so texts that share WINDOW words or more share a fingerprint at
each of these windows, and a text without a fingerprint of the benchmark shares
none.

1. A filter of the benchmark's fingerprints and windows, of a fixed size at
   most, goes to the tasks that read documents.  A fingerprint that passes is
   extended to the windows that it was chosen for; windows that pass too go on.
   The filter only saves work: the join decides.
2. Windows of documents are joined with those of the benchmark by equal key, hot
   ones salted by their counted number.  A window stands in the benchmark's
   table once, with the name of the list of items that hold it.
3. Joint windows of a document are united to spans; lists of items are united
   once for each combination that occurs, however many documents have it.

Items of fewer than WINDOW words are one window of their own length each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import cut, only, salted_join, small_side

WINDOW = 13
GRAM = 8
#: Bits of the filter for each key, and bits at most (16 MB); a benchmark beyond that passes more windows on to the join.
KEY_BITS, MOST_BITS = 16, 1 << 27

_HIT = np.dtype([("key", "<i8"), ("at", "<i4"), ("size", "<i4")])


def fingerprints(runs: np.ndarray, neighbours: int) -> np.ndarray:
    """The smallest of every `neighbours` consecutive run hashes."""
    n = max(0, len(runs) - neighbours + 1)
    best = runs[:n].copy()
    for i in range(1, neighbours):
        np.minimum(best, runs[i : i + n], out=best)
    return best


def window_at(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each place on, as grams() gives it."""
    out = np.zeros(len(at), np.uint64)
    for i in range(size):
        out += hashes[at + i] * tk.GRAM_MULTIPLIERS[i]
    return tk.mix(out + np.uint64(size))


def _within(word_of: np.ndarray, size: int) -> np.ndarray:
    """Places of a slice's words from which `size` words lie in one text."""
    return tk.spread(word_of[:-1], np.maximum(0, np.diff(word_of) - size + 1))


def _item_keys(window: int, gram: int):
    """(item_id, key, size, fingerprint) for every window of the items; a short item has itself as its fingerprint."""

    def run(batches):
        for batch in batches:
            ids = batch.column("item_id")
            for first, _, data, offsets in tk.text_slices(batch.column("text")):
                hashes, _, _, word_of = tk.words(data, offsets, tk.ALNUM, tk.LOWER_ASCII)
                words = np.diff(word_of)
                item, key, size, mark = [], [], [], []
                long = _within(word_of, window)
                if len(long):
                    item.append(np.searchsorted(word_of, long, "right") - 1)
                    key.append(window_at(hashes, long, window))
                    mark.append(fingerprints(tk.grams(hashes, gram), window - gram + 1)[long])
                    size.append(np.full(len(long), window))
                for k in np.unique(words[(words > 0) & (words < window)]):
                    own = np.flatnonzero(words == k)
                    item.append(own)
                    key.append(window_at(hashes, word_of[own], int(k)))
                    mark.append(key[-1])
                    size.append(np.full(len(own), k))
                if item:
                    key, mark = np.concatenate(key).view(np.int64), np.concatenate(mark).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(np.concatenate(item) + first)), pa.array(key), pa.array(np.concatenate(size).astype(np.int32)), pa.array(mark)],
                        names=["item_id", "key", "size", "mark"],
                    )

    return run


class Filter:
    """A Bloom filter with two bits for each key."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = np.uint64(bits), words

    @staticmethod
    def places(key: np.ndarray, bits: np.uint64):
        key = key.view(np.uint64)
        return key & (bits - np.uint64(1)), tk.mix(key) & (bits - np.uint64(1))

    def holds(self, key: np.ndarray) -> np.ndarray:
        """Whether each key may be one of the filter's."""
        one, two = self.places(key, self.bits)
        found = self._set(one)
        at = np.flatnonzero(found)
        found[at] = self._set(two[at])
        return found

    def _set(self, place):
        return (self.words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _filter_words(bits: int):
    def run(batches):
        for batch in batches:
            key = np.concatenate([np.asarray(batch.column(c)) for c in ("key", "mark")])
            place = np.unique(np.concatenate(Filter.places(key, np.uint64(bits))))
            word = place >> np.uint64(6)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
            value = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), first) if len(word) else word
            yield pa.RecordBatch.from_arrays([pa.array(word[first].astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "value"])

    return run


def _filter(keys: DataFrame) -> Filter:
    """The filter of all keys: its size is bounded, and so is what comes to the driver."""
    n = 2 * keys.count()
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(10, (KEY_BITS * n).bit_length()))
    rows = keys.select("key", "mark").mapInArrow(_filter_words(bits), "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[np.asarray(rows.column("word"))] = np.asarray(rows.column("value")).astype(np.int64).view(np.uint64)
    return Filter(bits, words)


def _scan(held: Filter, short: list[int], window: int, gram: int, carried: list[str]):
    """Of each text: words, and its windows that may be the benchmark's, packed; null where there are none."""

    def windows(hashes, word_of):
        out = []
        at = _within(word_of, window)
        if len(at):
            at = at[held.holds(fingerprints(tk.grams(hashes, gram), window - gram + 1)[at])]
            out.append((at, window_at(hashes, at, window), window))
        for k in short:
            at = _within(word_of, k)
            if len(at):
                out.append((at, window_at(hashes, at, k), k))
        found = []
        for at, key, size in out:
            some = held.holds(key)
            hit = np.zeros(int(some.sum()), _HIT)
            hit["at"], hit["key"], hit["size"] = at[some], key[some].view(np.int64), size
            found.append(hit)
        return np.concatenate(found) if found else np.zeros(0, _HIT)

    def run(batches):
        for batch in batches:
            n_words, packed = np.zeros(len(batch), np.int64), [None] * len(batch)
            for first, end, data, offsets in tk.text_slices(batch.column("text")):
                hashes, _, _, word_of = tk.words(data, offsets, tk.ALNUM, tk.LOWER_ASCII)
                n_words[first:end] = np.diff(word_of)
                found = windows(hashes, word_of)
                doc = np.searchsorted(word_of, found["at"], "right") - 1
                found["at"] -= word_of[doc].astype(np.int32)
                for i in np.unique(doc):
                    packed[first + i] = found[doc == i].tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(n_words), pa.array(packed, pa.binary())], names=[*carried, "n_words", "windows"])

    return run


def _unpacked(batches):
    for batch in batches:
        blobs = batch.column("windows").to_pylist()
        hit = np.frombuffer(b"".join(blobs), _HIT)
        row = np.repeat(np.asarray(batch.column("row")), [len(b) // _HIT.itemsize for b in blobs])
        yield pa.RecordBatch.from_arrays([pa.array(row), *(pa.array(np.ascontiguousarray(hit[c])) for c in ("key", "at", "size"))], names=["row", "key", "at", "size"])


def _spans(batches):
    """Of each document: words inside its joint windows, and the names of its lists of items in order."""
    for batch in batches:
        n_hit, lists = np.zeros(len(batch), np.int64), []
        for i, hits in enumerate(batch.column("hits").to_pylist()):
            at, size = np.array([h["at"] for h in hits], np.int64), np.array([h["size"] for h in hits], np.int64)
            order = np.argsort(at, kind="stable")
            start, end = at[order], np.maximum.accumulate((at + size)[order])
            n_hit[i] = int(end[0] - start[0] + np.maximum(0, end[1:] - np.maximum(start[1:], end[:-1])).sum())
            lists.append(sorted({h["list"] for h in hits}))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n_hit), pa.array(lists, pa.list_(pa.int64()))], names=["row", "n_hit", "lists"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of characters other than ASCII non-alphanumerics, A-Z folded.
    A null or empty text has no words and is clean; an empty benchmark leaves all
    clean; item rows with a null id or text, or without words, have no window;
    several texts of one item_id count as one item.  Extra columns are ignored.
    Repeated rows give repeated results.
    """
    return _judged(only(docs, doc_id="long", text="string"), benchmark, window, gram).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The columns of docs but text, and those of contamination()."""
    carried = [c for c in docs.columns if c != "text"]
    items = only(benchmark, item_id="string", text="string").where("item_id is not null and text is not null")
    keys = cut(items.mapInArrow(_item_keys(window, gram), "item_id string, key long, size int, mark long"), "items")
    held = _filter(keys)
    short = sorted(r["size"] for r in keys.where(F.col("size") < window).select("size").distinct().collect())  # window - 1 rows at most
    # each window once, with the name of its list of items; each list once
    listed = keys.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items")).withColumn("list", F.xxhash64("items"))
    listed = cut(listed, "listed")
    items_of = cut(listed.select("list", "items").dropDuplicates(["list"]), "lists")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    scanned = numbered.mapInArrow(_scan(held, short, window, gram, [*carried, "row"]), f"{schema}, row long, n_words long, windows binary")
    scanned = cut(scanned, "scanned")
    hits = cut(scanned.where("windows is not null").select("row", "windows").mapInArrow(_unpacked, "row long, key long, at int, size int"), "candidates")
    joint = salted_join(hits, listed.select("key", "list"), "key")
    per_row = joint.groupBy("row").agg(F.collect_list(F.struct("at", "size", "list")).alias("hits"))
    per_row = cut(per_row.mapInArrow(_spans, "row long, n_hit long, lists array<long>").withColumn("combination", F.xxhash64("lists")), "hits")
    combined = per_row.select("combination", "lists").dropDuplicates(["combination"]).select("combination", F.explode("lists").alias("list"))
    combined = combined.join(small_side(items_of), "list").select("combination", F.explode("items").alias("item"))
    combined = combined.groupBy("combination").agg(F.array_sort(F.collect_set("item")).alias("items"))
    combined = cut(combined.select("combination", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")), "combined")
    verdict = cut(per_row.select("row", "n_hit", "combination").join(small_side(combined), "combination").drop("combination"), "verdict")
    out = scanned.drop("windows").join(small_side(verdict), "row", "left").drop("row").fillna(0, ["n_hit", "n_items"]).fillna({"items_sha256": EMPTY_SHA256})
    return out.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


#: SHA-256 of no bytes.
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text isn't contaminated, whole; doc_id plays no part, so repeated or null ones don't matter."""
    text = F.col("text").cast("string")
    named = docs.select(F.xxhash64(text).alias("hash"), F.octet_length(text).alias("bytes"), text.alias("text"))
    bad = cut(_judged(named, benchmark).where("contaminated").select(F.col("hash").alias("_hash"), F.col("bytes").alias("_bytes")).distinct(), "bad")
    bad = small_side(bad)
    docs_text = docs["text"].cast("string")
    return docs.join(bad, (F.xxhash64(docs_text) == bad["_hash"]) & (F.octet_length(docs_text) == bad["_bytes"]), "left_anti").select(docs.columns)
