"""Ordered operators per video that plain windows express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _w(by: list[str], order: list[str]):
    return W.partitionBy(*by).orderBy(*order)


def sessionize(df: DataFrame, by: list[str], ts: str, gap, order: list[str] | None = None, out: str = "session_no") -> DataFrame:
    """Numbers sessions from 1: a row opens one if it is more than `gap` after its forerunner."""
    w = _w(by, [ts, *(order or [])])
    prev = F.lag(ts).over(w)
    return df.withColumn(out, F.sum(F.when(prev.isNull() | (F.col(ts) - prev > gap), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))


def run_lengths(df: DataFrame, by: list[str], value: str, order: list[str], out: str = "run_no") -> DataFrame:
    """Numbers runs of equal neighbouring values from 1; nulls are equal."""
    w = _w(by, order)
    first = F.row_number().over(w) == 1
    return df.withColumn(out, F.sum(F.when(first | ~F.col(value).eqNullSafe(F.lag(value).over(w)), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))


def absorbed_runs(df: DataFrame, by: list[str], value: str, order: list[str], at: str, noise: int = 2) -> DataFrame:
    """Runs of equal values (white space apart) as rows by, run_no, value, start_<at>, end_<at>, n; a run of up to `noise` rows
    belongs to what stands before it, and neighbours that are equal then are one.  A first run stands however short it is."""
    plain = df.withColumn("_key", F.regexp_replace(F.coalesce(value, F.lit("")), r"\s", ""))
    runs = run_lengths(plain, by, "_key", order, "_run").groupBy(*by, "_run").agg(
        F.first("_key").alias("_key"), F.min_by(value, F.struct(*order)).alias(value), F.min(at).alias("_start"), F.max(at).alias("_end"), F.count(F.lit(1)).alias("_n")
    )
    w = _w(by, ["_run"])
    stands = runs.withColumn("_strong", F.when((F.col("_n") > noise) | (F.col("_run") == 1), F.col("_key")))
    last = F.last("_strong", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    opens = F.col("_strong").isNotNull() & (last.isNull() | (F.col("_strong") != last))
    numbered = stands.withColumn("_opens", opens).withColumn("run_no", F.sum(F.col("_opens").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    out = numbered.groupBy(*by, "run_no").agg(F.min_by(value, "_run").alias(value), F.min("_start").alias(f"start_{at}"), F.max("_end").alias(f"end_{at}"), F.sum("_n").alias("n"))
    return out


def merge_intervals(df: DataFrame, by: list[str], start: str, end: str, window=0) -> DataFrame:
    """One row per island of intervals that start at most `window` after the farthest end so far: by, island, start, end, n."""
    w = _w(by, [start, end])
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach + window), 1).otherwise(0))
    marked = marked.withColumn("island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*by, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n"))


def pad_and_clip(df: DataFrame, start: str, end: str, pad, low, high) -> DataFrame:
    return df.withColumns({start: F.greatest(F.lit(low), F.col(start) - pad), end: F.least(F.lit(high), F.col(end) + pad)})


def reindex(df: DataFrame, by: list[str], order: list[str], out: str = "idx") -> DataFrame:
    return df.withColumn(out, F.row_number().over(_w(by, order)))


def step_sample(df: DataFrame, by: list[str], ts: str, step, tie: str, skip=0) -> DataFrame:
    """The first row of each step of the fixed grid skip + k * step."""
    w = W.partitionBy(*by, "bucket").orderBy(ts, tie)
    bucketed = df.where(F.col(ts) >= skip).withColumn("bucket", F.floor((F.col(ts) - skip) / step))
    return bucketed.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def carry_forward(df: DataFrame, by: list[str], order: list[str], value: str, reset: Column | None = None, out: str = "carried") -> DataFrame:
    """The last value that isn't null, since the last row where `reset` holds."""
    w = _w(by, order).rowsBetween(W.unboundedPreceding, 0)
    if reset is not None:
        df = df.withColumn("_part", F.sum(F.when(reset, 1).otherwise(0)).over(w))
        w = _w([*by, "_part"], order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, True).over(w)).drop("_part")


def trailing_rates(df: DataFrame, by: list[str], ts: str, span: int, amount: str) -> DataFrame:
    """Requests and amounts in the `span` up to each row, its own instant included and the far edge not."""
    w = W.partitionBy(*by).orderBy(ts).rangeBetween(-span + 1, 0)
    return df.withColumns({"n_recent": F.count(F.lit(1)).over(w), "sum_recent": F.sum(amount).over(w)})


def close_overlaps(df: DataFrame, by: list[str], order: list[str], start: str = "start_sec", end: str = "end_sec", gap: float = 0.0) -> DataFrame:
    """end = next start - gap where that leaves the cue a length; else as it is."""
    nxt = F.lead(start).over(_w(by, order))
    return df.withColumn(end, F.when(nxt.isNotNull() & (F.col(end) > nxt - gap) & (nxt - gap > F.col(start)), nxt - gap).otherwise(F.col(end)))


def retime_for_speech(df: DataFrame, by: list[str], order: list[str], gap: float = 0.04, least: float = 0.1) -> DataFrame:
    """end at most next start - gap, and at least start + least."""
    nxt = F.lead("start_sec").over(_w(by, order))
    return df.withColumn("end_sec", F.greatest(F.col("start_sec") + least, F.least(F.col("end_sec"), F.coalesce(nxt - gap, F.col("end_sec")))))


def speech_window(df: DataFrame, by: list[str], order: list[str], gap: float = 0.10, most: float = 2.0, out: str = "window_sec") -> DataFrame:
    """Own length and what silence follows, less `gap`, `most` at most; the last cue gets `most`."""
    nxt = F.lead("start_sec").over(_w(by, order))
    length = F.col("end_sec") - F.col("start_sec")
    return df.withColumn(out, length + F.when(nxt.isNull(), F.lit(most)).otherwise(F.least(F.greatest(F.lit(0.0), nxt - F.col("end_sec") - gap), F.lit(most))))


def batches_with_context(df: DataFrame, by: list[str], order: list[str], text: str, size: int, around: int) -> DataFrame:
    """batch_no of `size` rows each, and the texts of up to `around` rows before and after."""
    w = _w(by, order)
    return df.withColumns(
        {
            "batch_no": F.floor((F.row_number().over(w) - 1) / size),
            "before": F.collect_list(text).over(w.rowsBetween(-around, -1)),
            "after": F.collect_list(text).over(w.rowsBetween(1, around)),
        }
    )


def speaker_tags(df: DataFrame, by: list[str], order: list[str], speaker: str, effect: Column, out: str = "tag") -> DataFrame:
    """The speaker where it changes; a sound effect has no tag and makes the next speaker appear again."""
    w = _w(by, order)
    marked = df.withColumn("_fx", effect).withColumn("_part", F.sum(F.when(F.col("_fx"), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    named = F.when(~F.col("_fx") & (F.coalesce(F.trim(speaker), F.lit("")) != ""), F.trim(speaker))
    last = F.last(named, True).over(_w([*by, "_part"], order).rowsBetween(W.unboundedPreceding, -1))
    return marked.withColumn("_named", named).withColumn("_last", last).withColumn(out, F.when(F.col("_named").isNotNull() & ~F.col("_named").eqNullSafe(F.col("_last")), F.col("_named"))).drop("_fx", "_part", "_named", "_last")


def adjacent_duplicates(df: DataFrame, by: list[str], order: list[str], source: str, target: str, out: str = "repeats_previous") -> DataFrame:
    """The target equals the previous row's, not blank, though the source differs."""
    w = _w(by, order)
    return df.withColumn(out, F.coalesce((F.trim(F.lag(target).over(w)) == F.trim(target)) & (F.trim(target) != "") & (F.trim(F.lag(source).over(w)) != F.trim(source)), F.lit(False)))


def cue_review(df: DataFrame, by: list[str], order: list[str], text: str, start: str, end: str, confidence: str | None = None, least_confidence: float = 0.7) -> DataFrame:
    """Duration, gap to the next cue (under 1 ms: 0; negative: overlap) and flags."""
    from ..functions.text import TOO_FAST_CPS, TOO_SHORT_SEC, cps

    gap = F.lead(start).over(_w(by, order)) - F.col(end)
    return df.withColumns(
        {
            "duration_sec": F.col(end) - F.col(start),
            "gap_sec": F.when(F.abs(gap) < 0.001, F.lit(0.0)).otherwise(gap),
            "too_short": F.col(end) - F.col(start) < TOO_SHORT_SEC,
            "too_fast": cps(text, start, end) > TOO_FAST_CPS,
            "weak": F.lit(False) if confidence is None else F.col(confidence) < least_confidence,
        }
    )


def eviction_plan(df: DataFrame, size: str, age: str, tie: str, most_age, most_bytes, exempt: Column) -> DataFrame:
    """evict: over age, or beyond `most_bytes` counted from the youngest; exempt files stay but count.

    A running sum over all files needs their total order, so files are first
    summed by age (one row per age) and only those sums are ordered globally."""
    live = df.withColumn("_old", (F.col(age) > most_age) & ~exempt)
    by_age = live.where("not _old").groupBy(age).agg(F.sum(size).alias("_s"))
    before = by_age.withColumn("_before", F.coalesce(F.sum("_s").over(W.orderBy(age).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    inside = F.sum(F.when(F.col("_old"), F.lit(0)).otherwise(F.col(size))).over(W.partitionBy(age).orderBy(tie).rowsBetween(W.unboundedPreceding, 0))
    return live.withColumn("_inside", inside).join(before, age, "left").withColumn("evict", F.col("_old") | (~exempt & (F.coalesce("_before", F.lit(0)) + F.col("_inside") > most_bytes))).drop("_old", "_inside", "_before")


def drifting_sample(df: DataFrame, by: list[str], ts: str, step: float) -> DataFrame:
    """Rows at least `step` after the last one taken: the grid moves with the rows, so this is a fold per group."""
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, keep, target = pdf.sort_values(ts, kind="stable"), [], float("-inf")
        for t in pdf[ts]:
            keep.append(t >= target)
            target = t + step if keep[-1] else target
        return pdf[keep]

    return df.groupBy(*by).applyInPandas(fold, df.schema)
