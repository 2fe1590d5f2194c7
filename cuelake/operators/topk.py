"""Top-k retrieval and samples."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..functions.similarity import token_set_ratios

#: Rows of one block of queries and of memory, and the most queries that are broadcast.
QUERY_BLOCK, MEMORY_BLOCK, BROADCAST_QUERIES = 200, 256, 50_000
#: The same for vectors, and how many pairs are scored anew at once.
QUERY_VECTORS, MEMORY_VECTORS, SCORED_AT_ONCE = 512, 1024, 1 << 15


def top_k(pairs: DataFrame, query: list[str], score: str, tie: list[str], k: int, least: float | None = None) -> DataFrame:
    """The k best of each query, and of them those that score `least`: the limit comes first."""
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy(*query).orderBy(F.desc(score), *tie))).where(F.col("rank") <= k)
    return ranked if least is None else ranked.where(F.col(score) >= least)


def _blocks(rows: int):
    """Rows of one struct column as arrays of so many."""

    def run(batches):
        for batch in batches:
            for first in range(0, len(batch), rows):
                part = batch.column(0).slice(first, rows)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)], names=[batch.schema.names[0]])

    return run


def _best_of_blocks(query_text: str, memory_text: str, k: int, least: float | None):
    def run(batches):
        """Of each pair of blocks (q, m): per query the k best rows and all that equal the last of them.  A null text has no score."""
        for batch in batches:
            for row in range(len(batch)):
                q, m = batch.column("q")[row].values, batch.column("m")[row].values
                a, b = q.field(query_text).to_pylist(), m.field(memory_text).to_pylist()
                score = token_set_ratios([x or "" for x in a], [x or "" for x in b])
                score[[x is None for x in a]] = -1
                score[:, [x is None for x in b]] = -1
                last = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else score.min(1)
                i, j = np.nonzero(score >= np.maximum(last, -1 if least is None else least)[:, None])
                if len(i):
                    found = score[i, j]
                    yield pa.RecordBatch.from_arrays([q.take(pa.array(i)), m.take(pa.array(j)), pa.array(found, mask=found < 0)], names=["q", "m", "score"])

    return run


def _block_pairs(queries: DataFrame, memory: DataFrame, query_block: int = QUERY_BLOCK, memory_block: int = MEMORY_BLOCK):
    """Blocks of queries (the small side) beside blocks of memory rows, as structs q and m; and the type of a query."""
    spark = queries.sparkSession
    kind = lambda df: df.select(F.struct("*").alias("x")).schema["x"].dataType
    rows = lambda df, name, n: df.select(F.struct("*").alias(name)).mapInArrow(_blocks(n), StructType([StructField(name, ArrayType(kind(df)))]))
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = rows(queries, "q", query_block)
    if queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES:
        asked = F.broadcast(asked)
    return rows(memory, "m", memory_block).repartition(tasks).join(asked), kind(queries)


def fuzzy_top_k(queries: DataFrame, memory: DataFrame, query_text: str, memory_text: str, query: list[str], tie: list[str], k: int = 3, least: float = 70.0) -> DataFrame:
    """Memory rows nearest to each query by token-set ratio.

    Every pair is scored, at every size: blocks of queries (the small side)
    meet blocks of memory rows, and only the best of a block go on."""
    pairs, kind = _block_pairs(queries, memory)
    row = memory.select(F.struct("*").alias("x")).schema["x"].dataType
    best = pairs.mapInArrow(_best_of_blocks(query_text, memory_text, k, least), StructType([StructField("q", kind), StructField("m", row), StructField("score", DoubleType())]))
    return top_k(best.select("q.*", "m.*", "score"), query, "score", tie, k, least)


def _grams(text: str, k: int) -> np.ndarray:
    """The distinct runs of k characters (3 at most), as numbers."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    out = np.zeros(max(0, len(c) - k + 1), np.uint64)
    for i in range(k):
        out = (out << np.uint64(21)) | c[i : len(c) - k + 1 + i]
    return np.unique(out)


def _common_of_blocks(text: str, row: str, k: int, best: int):
    def run(batches):
        """Of each pair of blocks (q, m): per query its grams and the `best` rows that share most grams with it, the smaller row first among equals."""
        for batch in batches:
            for at in range(len(batch)):
                q, m = batch.column("q")[at].values, batch.column("m")[at].values
                asked = [_grams(x or "", k) for x in q.field(text).to_pylist()]
                held = [_grams(x or "", k) for x in m.field(text).to_pylist()]
                ids = np.asarray(m.field(row))
                gram, owner = np.concatenate(asked), np.repeat(np.arange(len(asked)), list(map(len, asked)))
                order = np.argsort(gram, kind="stable")
                gram, owner = gram[order], owner[order]
                other = np.concatenate(held)
                first, last = np.searchsorted(gram, other, "left"), np.searchsorted(gram, other, "right")
                n = last - first
                where = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
                cell = np.repeat(np.repeat(np.arange(len(held)), list(map(len, held))), n) * len(asked) + owner[where]
                common = np.bincount(cell, minlength=len(held) * len(asked)).reshape(len(held), len(asked))
                by_id = np.argsort(ids, kind="stable")
                top = by_id[np.argsort(-common[by_id], axis=0, kind="stable")[:best]]
                i, j = np.broadcast_to(np.arange(len(asked)), top.shape).ravel(), top.ravel()
                some = common[j, i] > 0
                i, j = i[some], j[some]
                if len(i):
                    size = np.array(list(map(len, asked)), np.int64)
                    yield pa.RecordBatch.from_arrays([q.take(pa.array(i)), m.field(row).take(pa.array(j)), pa.array(size[i]), pa.array(common[j, i].astype(np.int64))], names=["q", row, "n", "common"])

    return run


def gram_overlaps(queries: DataFrame, memory: DataFrame, query: str, row: str, text: str, k: int = 3) -> DataFrame:
    """(query, row, common, n, runner_up): the memory row that shares most distinct character k-grams with each query, the number
    of its grams, and what the next best row shares.  Rows are told apart by an integer column.

    Every pair of texts is compared, whole, in blocks; only the two best of a block go on.  Queries without a common gram have no row."""
    pairs, kind = _block_pairs(queries.select(query, text), memory.select(row, text))
    found = pairs.mapInArrow(_common_of_blocks(text, row, k, 2), StructType([StructField("q", kind), memory.schema[row], StructField("n", LongType()), StructField("common", LongType())]))
    w = W.partitionBy(query).orderBy(F.desc("common"), row)
    ranked = found.select(f"q.{query}", row, "n", "common").withColumns({"r": F.row_number().over(w), "runner_up": F.coalesce(F.lead("common").over(w), F.lit(0).cast("long"))})
    return ranked.where("r = 1").drop("r")


def _vectors(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers as the rows of a matrix, filled up with zeros, and their lengths.  A null list or number is NaN."""
    size = np.asarray(lists.value_lengths().fill_null(-1))
    out = np.zeros((len(size), max(1, size.max(initial=0))))
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    out[size < 0] = np.nan
    return out, size


def _in_turn(x: np.ndarray) -> np.ndarray:
    """Row sums, added from left to right as functions.text.cosine adds."""
    return np.cumsum(x, axis=1)[:, -1]


def _of_equals(rows: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the rows of the `most` smallest ids among bitwise equal rows; ids ascend."""
    bits = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel()
    _, copy = np.unique(bits, return_inverse=True)
    order = np.argsort(copy, kind="stable")
    copy, ids = copy[order], ids[order]
    other = np.cumsum(np.r_[True, (copy[1:] != copy[:-1]) | (ids[1:] != ids[:-1])])
    return np.sort(order[other - other[np.searchsorted(copy, copy, "left")] < most])


def _bounded(score: np.ndarray, odd: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What functions.text.cosine makes of quotients: within 0 and 1, no number is 1, no length is 0."""
    score = np.where(np.isnan(score) | odd, 1.0, np.clip(score, 0.0, 1.0))
    return np.where((a < 1e-8) | (b < 1e-8), 0.0, score)


def _nearest_of_blocks(query: str, row: str, vector: str, k: int, band: float):
    def best(found):
        """Of pairs (query, row, score): per query those that may be among its k best, of equal scores the k smallest rows; and the k-th score."""
        q, ids, score = found
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        opens = np.r_[True, (q[1:] != q[:-1]) | (score[1:] != score[:-1])]
        place = np.arange(len(q)) - np.maximum.accumulate(np.where(opens, np.arange(len(q)), 0))
        q, ids, score = (x[place < k] for x in (q, ids, score))
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        size = np.diff(np.r_[first, len(q)])
        last = np.where(size >= k, score[np.minimum(first + k - 1, len(q) - 1)], -1.0)
        stays = score >= np.repeat(last, size) - band
        return (q[stays], ids[stays], score[stays]), q[first], last

    def run(batches):
        """Of all pairs of blocks (q, m) of a task: per query the k best rows and all within `band` of the last of them.

        A matrix product tells which pairs may be; they alone are scored as functions.text.cosine does."""
        held: dict[bytes, list] = {}
        for batch in batches:
            for at in range(len(batch)):
                q, m = batch.column("q")[at].values, batch.column("m")[at].values
                asked, known = np.asarray(q.field(query)), np.asarray(m.field(row))
                a, a_size = _vectors(q.field(vector))
                b, b_size = _vectors(m.field(vector))
                by_id = np.argsort(known, kind="stable")
                kept = by_id[_of_equals(np.column_stack([b_size, b])[by_id], known[by_id], k + 1)]  # one of the k + 1 may be the query
                known, b, b_size = known[kept], b[kept], b_size[kept]
                wide = max(a.shape[1], b.shape[1])
                a, b = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (a, b))
                with np.errstate(all="ignore"):
                    la, lb = np.sqrt(_in_turn(a * a)), np.sqrt(_in_turn(b * b))
                    raw = (a / la[:, None]) @ (b / lb[:, None]).T
                    odd = a_size[:, None] != b_size
                    near = _bounded(raw, odd, la[:, None], lb)
                    other = asked[:, None] != known
                    near[~other] = -1.0
                    kth = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] >= k else np.full(len(asked), -1.0)
                    before = held.setdefault(blake2b(asked.tobytes() + a.tobytes(), digest_size=16).digest(), [asked, (np.zeros(0, np.int64), np.zeros(0, known.dtype), np.zeros(0)), np.full(len(asked), -1.0)])
                    chosen = other & (near >= np.maximum(kth, before[2])[:, None] - band - 1e-9)
                    null = chosen & ~odd & (raw < -1e-9) & (la[:, None] >= 1e-8) & (lb >= 1e-8)
                    chosen &= ~null | (np.cumsum(null, axis=1) <= k)  # what is 0 for certain: the k smallest rows
                    i, j = np.nonzero(chosen)
                    score = np.zeros(len(i))
                    for s in range(0, len(i), SCORED_AT_ONCE):
                        x, y = i[s : s + SCORED_AT_ONCE], j[s : s + SCORED_AT_ONCE]
                        score[s : s + SCORED_AT_ONCE] = _bounded(_in_turn(a[x] * b[y]) / (la[x] * lb[y]), odd[x, y], la[x], lb[y])
                if len(i):
                    before[1], whose, last = best([np.concatenate(c) for c in zip(before[1], (i, known[j], score))])
                    before[2][whose] = last
        for asked, (i, ids, score), _ in held.values():
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(asked[i]), pa.array(ids), pa.array(score)], names=[query, row, "score"])

    return run


def cosine_candidates(queries: DataFrame, memory: DataFrame, query: str, row: str, vector: str, k: int, digits: int) -> DataFrame:
    """(query, row, score): for each query the rows of another id that can be among the k of the highest functions.text.cosine
    rounded to `digits`, with that cosine, unrounded.  Ids are integers; of equal scores the smaller row comes first.

    Every pair of vectors is compared, in blocks; only what can be among the best of a task goes on."""
    some = lambda df, key: df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), vector)
    pairs, _ = _block_pairs(some(queries, query), some(memory, row), QUERY_VECTORS, MEMORY_VECTORS)
    return pairs.mapInArrow(_nearest_of_blocks(query, row, vector, k, 1.1 * 10.0**-digits), f"{query} long, {row} long, score double")


def evenly_spaced(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """n rows of each group at even distances, the first and the last among them."""
    w = W.partitionBy(*by)
    ranked = df.withColumns({"_k": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    wanted = F.transform(F.sequence(F.lit(0), F.lit(max(0, n - 1))), lambda i: F.bround(i * (F.col("_n") - 1) / max(1, n - 1)).cast("int"))
    return ranked.where((F.col("_n") <= n) | F.array_contains(wanted, F.col("_k").cast("int"))).drop("_k", "_n")


def references(df: DataFrame, by: list[str], order: list[str], source: str, k: int = 8) -> DataFrame:
    """The first k distinct sources in order."""
    first = df.withColumn("_r", F.row_number().over(W.partitionBy(*by, source).orderBy(*order))).where("_r = 1").drop("_r")
    return first.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= k).drop("_k")


def job_references(lines: DataFrame, memory: DataFrame, job: list[str], queries: int = 400, each: int = 2, most: int = 40) -> DataFrame:
    """References for a job: its longest lines are the queries, the best matches of each in turn, distinct by source; the last query that
    is needed to reach `most` is used whole."""
    q = lines.where(F.trim("source") != "").withColumn("_q", F.row_number().over(W.partitionBy(*job).orderBy(F.desc(F.length("source")), "idx"))).where(F.col("_q") <= queries)
    found = fuzzy_top_k(q.select(*job, "_q", "source"), memory, "source", "source_text", [*job, "_q"], ["source_text"], each)
    first = found.withColumn("_r", F.row_number().over(W.partitionBy(*job, "source_text").orderBy("_q", "rank"))).where("_r = 1")
    so_far = F.count(F.lit(1)).over(W.partitionBy(*job).orderBy("_q").rangeBetween(W.unboundedPreceding, -1))
    return first.withColumn("_before", so_far).where(F.col("_before") < most).select(*job, F.col("_q").alias("query_rank"), "rank", "source_text", "target_text", "score")
