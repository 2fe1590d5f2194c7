"""Mixing sources to target weights by weighted sampling without replacement.

Within a source every document draws an exponential key: -ln(u) / weight, u
from a hash of the document (Efraimidis and Spirakis).  The smallest keys come
first, so a document's chance to be early grows with its quality weight.  A
source's target is filled by complete epochs over all its documents and then by
the leading part of the key order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import cut, only, prefix_sums, small_side

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = 17
#: A source whose taken words miss its target by more than this share is refilled.
LOOSE = 0.01
_ORDER = ["key", "doc_id", "text_hash"]

_JUNK = tk.byte_table(b"#*$%&|<>")


def _sizes(batches):
    """Words, and a quality weight from 0.05 to 1: the share of characters that aren't junk symbols, and of word starts that don't repeat their forerunner."""
    for batch in batches:
        size, weight = np.zeros(len(batch), np.int64), np.ones(len(batch))
        for first, end, data, offsets in tk.text_slices(batch.column("text")):
            hashes, _, _, word_of = tk.words(data, offsets, tk.NOT_SPACE)
            n = np.diff(word_of)
            size[first:end] = n
            sums = lambda x, at: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
            junk = sums(_JUNK[data], offsets) / np.maximum(np.diff(offsets), 1)
            same = np.zeros(len(hashes), np.int64)
            same[1:] = hashes[1:] == hashes[:-1]
            same[word_of[:-1][n > 0]] = 0  # a text's first word has no forerunner
            weight[first:end] = np.maximum(0.05, (1 - np.minimum(1, 5 * junk)) * (1 - sums(same, word_of) / np.maximum(n, 1)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("text_hash"), pa.array(size), pa.array(weight)], names=["doc_id", "source", "text_hash", "size", "weight"])


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) -> also target.

    Sources by code point, null last, weigh weights[0], [1], ... in turn;
    together they get `share` of all sizes, each at most `most` times its own
    size; what that leaves over is shared by weight among the others until none
    is above.  The share per weight rises from round to round, by two aggregates
    over the table of sources, until no further source is above its limit.
    """
    ranked = prefix_sums(totals.withColumns({"one": F.lit(1).cast("long"), "last": F.col("source").isNull()}), ["last", "source"], {"one": "rank"})
    wanted = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    now = cut(ranked.select("source", "source_size", wanted.alias("w"), (most * F.col("source_size")).cast("double").alias("cap")), "weights")
    level, total = 0.0, now.agg(F.sum("source_size")).first()[0] or 0
    while True:
        full = F.col("cap") < F.col("w") * level
        low, free = now.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w")))).first()
        new = (share * total - (low or 0.0)) / free if free else level
        if new <= level * (1 + 1e-12):
            break
        level = new
    return now.select("source", "source_size", F.least("cap", F.col("w") * level).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, copies, source, text_hash.

    size: words of the text (null or wordless: 0).  target: the words that the
    row's source shall give.  copies: how often the mix takes the text whole;
    taken: copies * size.  With e = floor(target / source_size), every document
    is taken e times, and once more those whose middle word lies in the first
    target - e * source_size words of the key order, so that a source's taken
    words differ from its target by half a document at most.  Where that is more
    than LOOSE of the target (sources of few documents), the document at the
    border gives way to later ones that fit.  A null source is a source of its
    own, last in order.  Equal rows draw equal keys and tie in any order.  A
    source without words has target 0.  Reruns agree: keys depend on doc_id, text
    and seed alone.
    """
    rows = only(docs, doc_id="long", source="string", text="string").withColumn("text_hash", F.xxhash64("text"))
    rows = cut(rows.mapInArrow(_sizes, "doc_id long, source string, text_hash long, size long, weight double"), "sizes")
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    keyed = rows.select("doc_id", "source", "size", (-F.log(u) / F.col("weight")).alias("key"), "text_hash")
    placed = cut(prefix_sums(keyed, _ORDER, {"size": "before"}, group="source").withColumn("rid", F.monotonically_increasing_id()), "mix")
    totals = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    targets = cut(source_targets(totals, weights, share, most), "targets").withColumnRenamed("source", "_source")
    joined = placed.join(small_side(targets), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    joined = joined.withColumns({"epochs": epochs, "rest": F.col("target") - epochs * F.col("source_size")})
    more = (F.col("size") > 0) & (F.col("epochs") < most) & (F.col("before") + F.col("size") / 2 <= F.col("rest"))
    chosen = joined.withColumn("more", more)
    got = F.sum(F.when(F.col("more"), F.col("size")).otherwise(F.lit(0)))
    loose = cut(chosen.groupBy("source", "target", "rest").agg(got.alias("got")).where(F.abs(F.col("rest") - F.col("got")) > LOOSE * F.col("target")).select(F.col("source").alias("_source")), "loose")
    if loose.limit(1).count():
        mine = joined.join(small_side(loose), F.col("source").eqNullSafe(F.col("_source"))).drop("_source").where("size > 0 and rest > 0")
        picks = small_side(_refill(mine).withColumn("picked", F.lit(True)))
        marked = small_side(loose.withColumn("loose", F.lit(True)))
        chosen = chosen.join(picks, "rid", "left").join(marked, F.col("source").eqNullSafe(F.col("_source")), "left")
        chosen = chosen.withColumn("more", F.when(F.col("loose"), F.coalesce("picked", F.lit(False))).otherwise(F.col("more")))
    copies = (F.col("epochs") + F.col("more").cast("long")).cast("long")
    return chosen.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source", "text_hash")


def _refill(rows: DataFrame) -> DataFrame:
    """(rid) of the documents taken once more by sources of few documents: the leading ones that fit wholly, then, round by
    round until nothing more fits or the source is near its target, the next ones in key order that fit what is left, and
    at last one that comes nearest."""
    fits = F.col("before") + F.col("size") <= F.col("rest")
    picked = cut(rows.where(fits).select("rid", "source", "size"), "picked")
    other = rows.where(~fits)
    while True:
        given = picked.groupBy(F.col("source").alias("_source")).agg(F.sum("size").alias("_given"))
        left = other.join(small_side(given), F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("_left", F.col("rest") - F.coalesce("_given", F.lit(0)))
        near = F.col("_left") <= LOOSE * F.col("target")
        open_ = cut(left.where(~near & (F.col("size") <= F.col("_left"))).select("rid", "source", "size", "rest", "target", "key", "doc_id", "text_hash", "_left"), "open")
        if not open_.limit(1).count():
            break
        placed = cut(prefix_sums(open_, [*_ORDER, "rid"], {"size": "_b"}, group="source"), "refill")
        new = F.col("_b") + F.col("size") <= F.col("_left")
        picked = cut(picked.unionByName(placed.where(new).select("rid", "source", "size")), "picked")
        other = placed.where(~new).drop("_b", "_left")
    # one document more, if some document brings the words nearer to the target
    given = picked.groupBy(F.col("source").alias("_source")).agg(F.sum("size").alias("_given"))
    free = rows.join(picked.select("rid"), "rid", "left_anti").join(small_side(given), F.col("source").eqNullSafe(F.col("_source")), "left")
    miss = F.abs(F.col("rest") - F.coalesce("_given", F.lit(0)) - F.col("size"))
    nearer = free.where(miss < F.col("rest") - F.coalesce("_given", F.lit(0)))
    last = nearer.groupBy("source").agg(F.min_by("rid", F.struct(miss, "key", "doc_id", "text_hash", "rid")).alias("rid"))
    return picked.select("rid").unionByName(last.select("rid"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """docs with every row as often as the mix takes it; all columns, whole texts.  Wordless rows take part in complete epochs only.

    Rows that are equal in doc_id, text and source tie; where the mix takes some
    of them more often than others, the first ones in the order of the table's
    partitions are those.
    """
    chosen = mix(docs, **how).groupBy("doc_id", "text_hash", "source").agg(F.min("copies").alias("least"), F.sum("copies").alias("all"), F.count(F.lit(1)).alias("rows"))
    chosen = cut(chosen.where("all > 0").select("doc_id", "text_hash", "source", "least", (F.col("all") - F.col("rows") * F.col("least")).alias("more")), "chosen")
    chosen = small_side(chosen)
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    source = F.col("row.source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    on = F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.col("row.text").cast("string")) == F.col("text_hash")) & source.eqNullSafe(F.col("source"))
    found = own.join(chosen, on)
    # ties of rows with one copy number, which is nearly all, need no place among themselves
    even = found.where("more = 0").select("row", F.col("least").alias("copies"))
    border = found.where("more > 0").withColumns({"tie": F.xxhash64("doc_id", "text_hash", "source"), "one": F.lit(1).cast("long"), "at": F.monotonically_increasing_id()})
    uneven = prefix_sums(border, ["at"], {"one": "place"}, group="tie").select("row", (F.col("least") + (F.col("place") < F.col("more")).cast("long")).alias("copies"))
    taken = even.unionByName(uneven).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
