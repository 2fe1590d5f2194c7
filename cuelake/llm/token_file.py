"""Token ids in a compressed file: canonical length-limited Huffman codes in independent blocks.

File format.  A file is a Parquet table in the shared folder, one row per block,
so that any store Spark reads can hold it:

  part, block   place of the block: files hold documents in ascending doc_id
                order by (part, block)
  doc_ids       int64 little-endian, one per document of the block
  doc_tokens    int64 little-endian, ids of each document, the end id included
  n_tokens      their sum
  bits          the codes of all ids, most significant bit first
  checkpoints   int64 little-endian: bit offset of id 0, 128, 256, ... of the block

and a second table with the code length of every id (0: the id doesn't occur).
Lengths alone fix the codes: they are canonical, by rising length and then id.
A block is decoded by itself; from its checkpoints all its parts are decoded side
by side, one table lookup per id.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import textkernel as tk
from .common import cut, drop_cut, only, partitions, small_side

END_ID = 0
MOST_BITS = 18
CHECKPOINT_TOKENS = 128
BLOCK_TOKENS = 1 << 17
#: Distinct pieces of text whose ids a worker remembers in each of two generations, and pieces that the library gets at once.
MEMORY_PIECES, JOINED_PIECES = 500_000, 1_000
#: Ids of one partition of a file, about.
PART_TOKENS = 1 << 22


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memory:
    """Ids of pieces by key.  Sorted keys, places and counts of ids: a large level, and a small one that new pieces go to."""

    def __init__(self):
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32))
        self.levels = [none, none]
        self.ids, self.used = np.zeros(1 << 16, np.uint16), 0

    def __len__(self) -> int:
        return sum(len(keys) for keys, _, _ in self.levels)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and count of ids of each piece; count -1 for pieces not held."""
        at, count = np.zeros(len(key), np.int32), np.full(len(key), -1, np.int32)
        for keys, places, counts in self.levels:
            if len(keys):
                i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[i] == key
                at[hit], count[hit] = places[i[hit]], counts[i[hit]]
        return at, count

    def add(self, key: np.ndarray, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Takes distinct pieces that it doesn't hold yet; ids are those of all of them in turn."""
        need = self.used + len(ids)
        if ids.max(initial=0) > 0xFFFF:
            self.ids = self.ids.astype(np.uint32)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(need + need // 4 - self.used, self.ids.dtype)])
        self.ids[self.used : need] = ids
        at = (self.used + np.cumsum(count) - count).astype(np.int32)
        self.used = need
        self.levels[1] = _merged(self.levels[1], (key, at, count))
        if len(self.levels[1][0]) > max(1 << 16, len(self.levels[0][0]) // 4):
            self.levels = [_merged(*self.levels), tuple(x[:0] for x in self.levels[1])]
        return at, count


def _merged(a, b):
    """Two levels as one, sorted by key."""
    keys, *rest = (np.concatenate(x) for x in zip(a, b))
    order = np.argsort(keys, kind="stable")
    return (keys[order], *(x[order] for x in rest))


#: No white space but one leading space; Python counts a few more characters as white space than the pre-tokenizer does.
_JOINABLE = re.compile(r" ?\S+").fullmatch


class Encoder:
    """Ids of whole texts by the tokenizers library, which sees each distinct piece once.

    Texts are cut into pieces at places where this vocabulary's byte-level
    pre-tokenizer cuts too, whatever else stands around them (see _pieces), so a
    piece has the same ids wherever it stands.  Pieces are told apart by 64-bit
    hashes of their bytes.  Ids are remembered in two generations: a young one
    that is full becomes the old one, whose pieces come back to the young one
    when they are seen again, so common pieces are never forgotten.
    """

    def __init__(self, path: str, memory: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tok.get_vocab()
        # a token is written with one character for each of its bytes
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int32)
        self.token_bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.memory = memory or MEMORY_PIECES
        self.young, self.old = Memory(), Memory()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids of the texts in turn, ids of each text)."""
        if not len(data):
            return np.zeros(0, np.uint16), np.zeros(len(offsets) - 1, np.int64)
        starts = self._pieces(data, offsets)
        ends = np.append(starts, len(data)).astype(np.int32)
        # Arrow finds the distinct pieces; the buffers are shared, not copied
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        which = pieces.indices.to_numpy()
        at, count = self._look_up(pieces.dictionary)
        at, count = at[which], count[which]
        total = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        place = np.arange(total[-1], dtype=np.int32)
        place += np.repeat(at - total[:-1].astype(np.int32), count)
        return self.young.ids[place], np.diff(total[np.searchsorted(starts, offsets)])

    def _look_up(self, names: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the young generation, and count of ids, of distinct pieces."""
        if len(self.young) > self.memory:
            self.young, self.old = Memory(), self.young
        _, where, raw = names.buffers()
        where = np.frombuffer(where, np.int32, len(names) + 1)
        lengths = np.diff(where)
        value = tk.BYTE_VALUE[np.frombuffer(raw, np.uint8, where[-1])]
        value *= tk.position_multipliers(int(lengths.max()))[np.arange(where[-1], dtype=np.int32) - np.repeat(where[:-1], lengths)]
        key = tk.mix(np.add.reduceat(value, where[:-1]) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at, count = self.young.find(key)
        new = np.flatnonzero(count < 0)
        if len(new):
            old_at, old_count = self.old.find(key[new])
            seen = old_count >= 0
            if seen.any():
                again = new[seen]
                at[again], count[again] = self.young.add(key[again], self.old.ids[tk.spread(old_at[seen], old_count[seen])], old_count[seen])
            new = new[~seen]
            if len(new):
                at[new], count[new] = self.young.add(key[new], *self._tokenise(names.take(pa.array(new)).cast(pa.string()).to_pylist()))
        return at, count

    def _tokenise(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct pieces in turn, ids of each).

        Most are joined and encoded many at once: a line feed between pieces
        without inner white space is always a token by itself, and the tokens'
        lengths tell where each piece ends."""
        joined = [bool(_JOINABLE(t)) for t in texts]
        found: list = [None] * len(texts)
        line = np.flatnonzero(joined)
        for a in range(0, len(line), JOINED_PIECES):
            own = line[a : a + JOINED_PIECES].tolist()
            ids = np.array(self.tok.encode_batch_fast(["\n".join([texts[i] for i in own])], add_special_tokens=False)[0].ids, np.uint32)
            until = np.cumsum(self.token_bytes[ids])
            stop = np.cumsum([len(texts[i].encode()) + 1 for i in own]) - 1
            last = np.minimum(np.searchsorted(until, stop), len(until) - 1)
            if (until[last] == stop).all() and until[-1] == stop[-1]:
                for i, f, e in zip(own, [0, *(last[:-1] + 2).tolist()], (last + 1).tolist()):
                    found[i] = ids[f:e]
        rest = [i for i, f in enumerate(found) if f is None]
        for i, e in zip(rest, self.tok.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            found[i] = np.array(e.ids, np.uint32)
        return np.concatenate(found), np.fromiter(map(len, found), np.int32, len(found))

    @staticmethod
    def _pieces(data, offsets):
        """First bytes of the pieces.

        A piece begins where a text begins; at a single space between two bytes
        that aren't white space; at and after a single line feed between two such
        bytes; where an ASCII letter or digit is followed by an ASCII character of
        another kind (letter, digit, sign), since runs of letters and of digits
        never reach over that.  A byte beyond ASCII isn't white space if it is no
        C2, E1, E2 or E3 (the first bytes of white space beyond ASCII) or, as the
        last byte of a character, follows a byte C3 to DF.
        """
        n = len(data)
        cut = np.zeros(n + 1, bool)
        if n > 2:
            kind = _KIND[data]
            cut[1:n] = (kind[:-1] <= 2) & (kind[1:] <= 3) & (kind[:-1] != kind[1:])
            after = kind <= 4
            last = kind <= 3
            last[1:] |= (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
            between = last[:-2] & after[2:]
            cut[1 : n - 1] |= (data[1:-1] == 0x20) & between
            line = np.flatnonzero((data[1:-1] == 0x0A) & between) + 1
            cut[line] = True
            cut[line + 1] = True
        some = np.diff(offsets) > 0
        # a space that ends a text doesn't stand between two bytes of it
        lone = offsets[1:][some] - 1
        cut[lone[data[lone] == 0x20]] = False
        cut[offsets[:-1][some]] = True
        return np.flatnonzero(cut[:n])


#: Kinds of bytes: 1 letter, 2 digit, 3 sign (ASCII), 4 what begins a character beyond ASCII other than white space, 5 any other.
_KIND = np.full(256, 5, np.uint8)
for _b in range(256):
    if 0x21 <= _b < 0x7F:
        _KIND[_b] = 1 if chr(_b).isalpha() else 2 if chr(_b).isdigit() else 3
    elif _b >= 0xC3 and _b not in (0xE1, 0xE2, 0xE3):
        _KIND[_b] = 4


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _tokenise(path: str, end_id: int):
    def run(batches):
        enc = encoder(path)
        total = np.zeros(len(enc.token_bytes), np.int64)
        for batch in batches:
            counts, blobs = np.zeros(len(batch), np.int64), [b""] * len(batch)
            for first, end, data, offsets in tk.text_slices(batch.column("text")):
                ids, n = enc.encode(data, offsets)
                total += np.bincount(ids, minlength=len(total))
                total[end_id] += end - first
                if ids.max(initial=end_id) > 0xFFFF:
                    ids = ids.astype("<u4")
                width = ids.dtype.itemsize
                raw, stops = ids.tobytes(), (np.cumsum(n) * width).tolist()
                tail = np.array([end_id], ids.dtype).tobytes()
                a = 0
                for i, b in enumerate(stops, first):
                    blobs[i] = raw[a:b] + tail
                    a = b
                counts[first:end] = n + 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), pa.array(blobs, pa.binary()), pa.nulls(len(batch), pa.binary())], names=["doc_id", "n_tokens", "ids", "id_counts"])
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["doc_id", "n_tokens", "ids", "id_counts"])

    return run


def _ids(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if len(blob) == 2 * n else "<u4")


def _added_counts(batches):
    """The sum of all counts of a partition, by id."""
    total = None
    for batch in batches:
        for blob in batch.column("id_counts").to_pylist():
            own = np.frombuffer(blob, np.int64)
            total = own if total is None else total + own
    if total is not None:
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Best code lengths of at most `most` bits (more where there are over 2**most ids), by package-merge.  One id alone gets length 1."""
    some = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(some) <= 1:
        out[some] = 1
        return out
    most = max(most, int(np.ceil(np.log2(len(some)))))
    order = some[np.argsort(counts[some], kind="stable")]
    weight = counts[order].astype(np.float64)
    # level by level: packages of two of the level below, merged with the leaves; only how many leaves come first matters
    levels, row = [], weight
    for _ in range(most):
        levels.append(row)
        pairs = len(row) // 2
        packed = row[: 2 * pairs].reshape(-1, 2).sum(1)
        row = np.sort(np.concatenate([weight, packed]), kind="stable")
    take, length = 2 * len(weight) - 2, np.zeros(len(weight), np.int64)
    for k in range(most - 1, -1, -1):
        below = levels[k - 1] if k else np.zeros(0)
        packed = below[: len(below) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.argsort(np.concatenate([weight, packed]), kind="stable")[:take]
        leaves = int((merged < len(weight)).sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = length
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of every id: by rising length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, last = 0, 0
    by = lengths[order].astype(np.int64)
    for size in np.unique(by):
        code <<= int(size - last)
        own = order[by == size]
        codes[own] = code + np.arange(len(own), dtype=np.uint32)
        code += len(own)
        last = size
    return codes


def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of ids in turn, and the bit offset of every CHECKPOINT_TOKENS-th of them."""
    size = lengths[ids].astype(np.int64)
    start = np.cumsum(size) - size
    total = int(size.sum())
    words = np.zeros(total // 32 + 3, np.uint64)
    # a code lies in one or two neighbouring 32-bit words; those of one word don't overlap, so they may be added
    shifted = codes[ids].astype(np.uint64) << (np.uint64(64) - size.astype(np.uint64) - (start & 31).astype(np.uint64))
    word = start >> 5
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
    if len(word):
        both = np.add.reduceat(shifted, first)
        words[word[first]] += both >> np.uint64(32)
        words[word[first] + 1] += both & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").tobytes()[: (total + 7) // 8], start[::CHECKPOINT_TOKENS]


class Decoder:
    """One lookup table of 2**(longest length) entries."""

    def __init__(self, lengths: np.ndarray):
        self.bits = int(max(1, lengths.max(initial=0)))
        codes = canonical_codes(lengths)
        self.symbol, self.size = np.zeros(1 << self.bits, np.uint32), np.ones(1 << self.bits, np.uint8)
        some = np.flatnonzero(lengths)
        at = codes[some].astype(np.int64) << (self.bits - lengths[some].astype(np.int64))
        width = np.int64(1) << (self.bits - lengths[some].astype(np.int64))
        where = tk.spread(at, width)
        self.symbol[where] = np.repeat(some, width)
        self.size[where] = np.repeat(lengths[some], width)

    def unpack(self, bits: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """n ids; all stretches between checkpoints side by side."""
        data = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint64)
        # the 40 bits from each byte on
        window = data[:-4] << np.uint64(32) | data[1:-3] << np.uint64(24) | data[2:-2] << np.uint64(16) | data[3:-1] << np.uint64(8) | data[4:]
        at = checkpoints.astype(np.int64).copy()
        out = np.zeros((len(at), CHECKPOINT_TOKENS), np.uint32)
        mask, limit = np.uint64((1 << self.bits) - 1), len(window) - 1
        for k in range(CHECKPOINT_TOKENS):
            w = window[np.minimum(at >> 3, limit)]
            index = (w >> (np.uint64(40 - self.bits) - (at & 7).astype(np.uint64))) & mask
            out[:, k] = self.symbol[index]
            at += self.size[index]
        return out.reshape(-1)[:n]


def _encode_blocks(lengths: np.ndarray):
    codes = canonical_codes(lengths)

    def block(part, number, docs, sizes, ids):
        sizes, ids = np.concatenate(sizes), np.concatenate(ids)
        bits, checkpoints = pack_bits(ids, lengths, codes)
        return pa.RecordBatch.from_arrays(
            [pa.array([x], t) for x, t in ((part, pa.int32()), (number, pa.int32()), (np.concatenate(docs).tobytes(), pa.binary()), (sizes.astype("<i8").tobytes(), pa.binary()), (len(ids), pa.int64()), (bits, pa.binary()), (checkpoints.astype("<i8").tobytes(), pa.binary()))],
            names=["part", "block", "doc_ids", "doc_tokens", "n_tokens", "bits", "checkpoints"],
        )

    def run(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        docs, sizes, ids, held = [], [], [], 0
        for batch in batches:
            doc = batch.column("doc_id").cast(pa.int64()).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            n = batch.column("n_tokens").to_numpy()
            ends = np.cumsum(n)
            flat = _batch_ids(batch.column("ids"), n)
            a = 0
            while a < len(n):
                # rows up to the one that fills the block
                base = int(ends[a - 1]) if a else 0
                b = min(len(n), int(np.searchsorted(ends, base + BLOCK_TOKENS - held)) + 1)
                docs.append(doc[a:b])
                sizes.append(n[a:b])
                ids.append(flat[base : int(ends[b - 1])])
                held += int(ends[b - 1]) - base
                a = b
                if held >= BLOCK_TOKENS:
                    yield block(part, number, docs, sizes, ids)
                    number += 1
                    docs, sizes, ids, held = [], [], [], 0
        if docs:
            yield block(part, number, docs, sizes, ids)

    return run


def _batch_ids(column: pa.BinaryArray, n: np.ndarray) -> np.ndarray:
    """All ids of some rows, in turn; rows may be of two or four bytes an id."""
    _, where, raw = column.buffers()
    where = np.frombuffer(where, np.int32, len(column) + 1, column.offset * 4)
    if (np.diff(where) == 2 * n).all():
        return np.frombuffer(raw, "<u2", int(n.sum()), int(where[0]))
    return np.concatenate([_ids(blob, k) for blob, k in zip(column.to_pylist(), n.tolist())]).astype(np.uint32)


BLOCK_SCHEMA = "part int, block int, doc_ids binary, doc_tokens binary, n_tokens long, bits binary, checkpoints binary"


def write_token_file(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> tuple[DataFrame, DataFrame]:
    """Encodes every text of docs, ascending by doc_id (nulls first), and writes the file; returns its tables read back: blocks, code lengths.

    path is the tokenizer's file, which every executor must have.  Texts equal in
    doc_id follow each other in any order.  A null text counts as empty and
    gives the end id alone.  An empty table gives a file without blocks.
    """
    spark = docs.sparkSession
    path = path or tokenizer_path()
    tokens = only(docs, doc_id="long", text="string").mapInArrow(_tokenise(path, end_id), "doc_id long, n_tokens long, ids binary, id_counts binary")
    tokens = cut(tokens.withColumn("tie", F.hash("ids")), "tokens")
    # each task has left one row of counts by id; no more than one row per id of the vocabulary comes here
    counted = tokens.where("id_counts is not null").select("id_counts").mapInArrow(_added_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = np.asarray(counted.column("id")), np.asarray(counted.column("n"))
    counts = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
    counts[ids] = n
    lengths = code_lengths(counts)
    parts = partitions(spark, int(counts.sum()), PART_TOKENS)
    placed = tokens.where("ids is not null").select("doc_id", "n_tokens", "ids", "tie").repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    blocks = cut(placed.mapInArrow(_encode_blocks(lengths), BLOCK_SCHEMA), "blocks")
    some = np.flatnonzero(lengths)
    table = cut(spark.createDataFrame(pa.table({"id": pa.array(some), "length": pa.array(lengths[some].astype(np.int32))}), "id long, length int"), "lengths")
    drop_cut(tokens)
    return blocks, table


def _decode(lengths: np.ndarray, with_ids: bool):
    def run(batches):
        decoder = Decoder(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                ids = decoder.unpack(row["bits"], np.frombuffer(row["checkpoints"], "<i8"), row["n_tokens"])
                docs, sizes = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["doc_tokens"], "<i8")
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                own = [raw[4 * (e - s) : 4 * e] for s, e in zip(sizes.tolist(), ends.tolist())]
                columns = [pa.array(docs, mask=docs == -(2**63)), pa.array(row["before"] + ends - sizes), pa.array(sizes), pa.array(list(map(zlib.crc32, own)), pa.int64())]
                if with_ids:
                    columns.append(pa.array(list(map(bytes, own)), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return run


def read_token_file(blocks: DataFrame, lengths: DataFrame, with_ids: bool = True) -> DataFrame:
    """One row per document of the file: doc_id, start, n_tokens, ids_crc32 and, unless left out, ids (uint32 little-endian)."""
    found = lengths.toArrow()
    ids = np.asarray(found.column("id"))
    own = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint8)
    own[ids] = np.asarray(found.column("length"))
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = totals.select("part", before.alias("part_before"))  # one row per file part
    inside = F.coalesce(F.sum("n_tokens").over(W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("part", "block", inside.alias("inside")).join(small_side(parts), "part").select("part", "block", (F.col("part_before") + F.col("inside")).alias("before"))
    placed = blocks.join(small_side(starts), ["part", "block"])
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return placed.select("doc_ids", "doc_tokens", "n_tokens", "bits", "checkpoints", "before").mapInArrow(_decode(own, with_ids), schema)


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of docs, from the written file: doc_id, start, n_tokens, ids_crc32."""
    return read_token_file(*write_token_file(docs, path), with_ids=False)
