"""Set operations, upserts and order-preserving merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(base: DataFrame, new: DataFrame, keys: list[str], newest: str | None = None) -> DataFrame:
    """base with new's rows in place of those with equal keys; of several new ones the newest."""
    if newest:
        new = new.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(newest)))).where("_r = 1").drop("_r")
    return base.join(new.select(*keys), keys, "left_anti").select(base.columns).unionByName(new.select(base.columns))


def ordered_distinct(parts: list[DataFrame], key, order: list[str]) -> DataFrame:
    """Rows of all parts, the first of equal keys: earlier parts first, then by order."""
    both = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        both = p if both is None else both.unionByName(p)
    return both.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy("_part", *order))).where("_r = 1").drop("_r", "_part")


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys), keys, "left_anti")


def merge_fields(df: DataFrame, by: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Per group the newest value of each field that isn't blank."""
    pick = lambda c: F.max_by(F.col(c), F.when(F.trim(c) != "", F.struct(*order)))
    return df.groupBy(*by).agg(*(pick(c).alias(c) for c in fields))


def last_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last in order."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*(F.desc(o) for o in order)))).where("_r = 1").drop("_r")


def missing_numbers(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """Numbers between each group's least and greatest that it lacks."""
    bounds = df.groupBy(*by).agg(F.min(number).alias("_lo"), F.max(number).alias("_hi"))
    wanted = bounds.select(*by, F.explode(F.sequence("_lo", "_hi")).alias(number))
    return wanted.join(df.select(*by, number), [*by, number], "left_anti")


def batch_verdict(sent: DataFrame, got: DataFrame, by: list[str], number: str, patch_share: float = 0.15) -> DataFrame:
    """Per batch: missing, extra and repeated numbers, and ok, patch (few are missing) or retry."""
    s = sent.select(*by, number).distinct()
    g = got.groupBy(*by, number).agg(F.count(F.lit(1)).alias("_n"))
    j = s.withColumn("_s", F.lit(1)).join(g, [*by, number], "full")
    out = j.groupBy(*by).agg(F.count("_s").alias("sent"), F.count(F.when(F.col("_n").isNull(), 1)).alias("missing"), F.count(F.when(F.col("_s").isNull(), 1)).alias("extra"), F.count(F.when(F.col("_n") > 1, 1)).alias("repeated"))
    verdict = F.when((F.col("missing") == 0) & (F.col("repeated") == 0) & (F.col("extra") == 0), "ok").when((F.col("repeated") == 0) & (F.col("extra") == 0) & (F.col("missing") <= patch_share * F.col("sent")), "patch").otherwise("retry")
    return out.withColumn("verdict", verdict)


def stage_pivot(df: DataFrame, index: list[str], stage: str, stages: list[str], value: str) -> DataFrame:
    return df.groupBy(*index).pivot(stage, stages).agg(F.first(value))


def merge_rosters(df: DataFrame, by: list[str], order: list[str], aliases: str) -> DataFrame:
    """Entries in order; one that shares an alias with an accepted entry is dropped.  Sequential within a group."""
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        seen: set[str] = set()
        keep = []
        for names in pdf.sort_values(order)[aliases]:
            own = {n.strip().lower() for n in names if n and n.strip()}
            keep.append(bool(own) and not own & seen)
            if keep[-1]:
                seen |= own
        return pdf.sort_values(order)[keep]

    return df.groupBy(*by).applyInPandas(fold, df.schema)


def cached_plan(plans: DataFrame, signature: str, wanted: int, order: str) -> DataFrame:
    """The stored rows of a signature, if there are as many as wanted; else none."""
    rows = plans.where(F.col("signature") == signature)
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(F.broadcast(n.where(F.col("_n") == wanted)), F.lit(True), "left_semi").orderBy(order)
