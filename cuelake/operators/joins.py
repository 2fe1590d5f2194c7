"""Interval, as-of and positional joins.

Spark has no interval join operator, so a range predicate alone becomes a
nested loop.  interval_join() gives both sides equi-keys: each interval is put
into the time buckets it touches, and a pair is kept only in the first bucket
that both touch, so no pair comes out twice and no distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _bucketed(df: DataFrame, start: str, end: str, width, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(F.col(start), F.col(end)) / width))))


def interval_join(a: DataFrame, b: DataFrame, by: list[str], a_span: tuple[str, str], b_span: tuple[str, str], width, closed: bool = False, reach=0) -> DataFrame:
    """Pairs of rows of a and b, equal in `by`, whose spans overlap (or, closed, touch), each widened by `reach` on b's side.

    Columns other than `by` must differ in name.  width: bucket width, about the usual length of a span."""
    lo, hi = f"_{b_span[0]}", f"_{b_span[1]}"
    b = b.withColumns({lo: F.col(b_span[0]) - reach, hi: F.col(b_span[1]) + reach})
    x, y = _bucketed(a, *a_span, width, "_k"), _bucketed(b, lo, hi, width, "_k")
    hit = ((F.col(a_span[0]) <= F.col(hi)) & (F.col(lo) <= F.col(a_span[1]))) if closed else ((F.col(a_span[0]) < F.col(hi)) & (F.col(lo) < F.col(a_span[1])))
    first = F.greatest(F.floor(F.col(a_span[0]) / width), F.floor(F.col(lo) / width))
    return x.join(y, [*by, "_k"]).where(hit & (F.col("_k") == first)).drop("_k", lo, hi)


def best_overlap(truth: DataFrame, built: DataFrame, by: list[str], width, least, truth_key: str, built_key: str) -> DataFrame:
    """Each truth row with the built row that overlaps it most (over `least`; ties: smallest built_key), or nulls.

    truth has t_start, t_end; built has b_start, b_end."""
    pairs = interval_join(truth, built, by, ("t_start", "t_end"), ("b_start", "b_end"), width)
    pairs = pairs.withColumn("overlap", F.least("t_end", "b_end") - F.greatest("t_start", "b_start")).where(F.col("overlap") > least)
    best = pairs.withColumn("_r", F.row_number().over(W.partitionBy(*by, truth_key).orderBy(F.desc("overlap"), built_key))).where("_r = 1").drop("_r", "t_start", "t_end")
    carried = [c for c in best.columns if c not in truth.columns or c in [*by, truth_key]]
    return truth.join(best.select(*carried), [*by, truth_key], "left")


def points_in_intervals(points: DataFrame, spans: DataFrame, by: list[str], ts: str, span: tuple[str, str], width, tolerance=0) -> DataFrame:
    """Pairs of points and closed spans, widened by `tolerance`."""
    p = points.withColumn("_p", F.col(ts))
    return interval_join(p, spans, by, (ts, "_p"), span, width, closed=True, reach=tolerance).drop("_p")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, carry: list[str], prefix: str = "asof_") -> DataFrame:
    """For each left row the last right row at or before it: one union, one sort, no pairs."""
    a = left.select("*", F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(right_ts, *carry).alias("s")).schema[0].dataType).alias("_r"))
    b = right.select(*by, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.struct(right_ts, *carry).alias("_r"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = W.partitionBy(*by).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_r", F.last("_r", True).over(w)).where("_side = 1")
    return found.select(*left.columns, *(F.col(f"_r.{c}").alias(prefix + c) for c in (right_ts, *carry)))


def nearest_edge(left: DataFrame, edges: DataFrame, by: list[str], ts: str, edge: str, within) -> DataFrame:
    """For each left row the nearest edge at most `within` away (ties: the earlier), or null.

    Two as-of joins, one in each direction, instead of all pairs within reach."""
    before = asof_join(left, edges, by, ts, edge, [], "_b_")
    neg = lambda d, c: d.withColumn(f"_n_{c}", -F.col(c))
    after = asof_join(neg(before, ts), neg(edges, edge).select(*by, f"_n_{edge}"), by, f"_n_{ts}", f"_n_{edge}", [], "_a_")
    b, a = F.col(f"_b_{edge}"), -F.col(f"_a__n_{edge}")
    b, a = F.when(F.col(ts) - b <= within, b), F.when(a - F.col(ts) <= within, a)
    snapped = F.when(a.isNull() | (F.col(ts) - b <= a - F.col(ts)), b).otherwise(a)
    return after.withColumn("snapped", snapped).select(*left.columns, "snapped")


def positional_overlay(base: DataFrame, patch: DataFrame, by: list[str], base_order: list[str], patch_order: list[str], chosen: Column, column: str) -> DataFrame:
    """patch's k-th value replaces that of base's k-th chosen row; blank values and missing ones leave it."""
    w = W.partitionBy(*by, "_chosen").orderBy(*base_order)
    ranked = base.withColumn("_chosen", chosen).withColumn("_k", F.row_number().over(w))
    values = patch.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(*patch_order))).select(*by, "_k", F.col(column).alias("_new"), F.lit(True).alias("_chosen"))
    joined = ranked.join(values, [*by, "_k", "_chosen"], "left")
    return joined.withColumn(column, F.coalesce(F.when(F.trim("_new") != "", F.col("_new")), F.col(column))).select(*base.columns)


def merge_by_line(lines: DataFrame, answers: DataFrame, by: list[str], line: str, column: str) -> DataFrame:
    """answers' text by line number; those left over are dealt, in order, to lines without one; blanks keep the line's own."""
    direct = lines.join(answers.select(*by, line, F.col(column).alias("_new"), F.lit(1).alias("_hit")), [*by, line], "left")
    rest = answers.join(lines.select(*by, line), [*by, line], "left_anti").withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(line))).select(*by, "_k", F.col(column).alias("_late"))
    free = direct.withColumn("_k", F.when(F.col("_hit").isNull(), F.row_number().over(W.partitionBy(*by, "_hit").orderBy(line))))
    joined = free.join(rest, [*by, "_k"], "left")
    new = F.coalesce("_new", "_late")
    return joined.withColumn(column, F.when(F.trim(new) != "", new).otherwise(F.col(column))).select(*lines.columns)


def enrich(lines: DataFrame, cues: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """cues' values where they aren't blank, else the line's own."""
    c = cues.select(*on, *(F.col(x).alias(f"_{x}") for x in columns))
    joined = lines.join(c, on, "left")
    return joined.withColumns({x: F.coalesce(F.when(F.trim(f"_{x}") != "", F.col(f"_{x}")), F.col(x)) for x in columns}).select(*lines.columns)


def bilingual(translated: DataFrame, source: DataFrame, on: list[str], text: str, translated_first: bool = True) -> DataFrame:
    """Two lines per cue; equal or missing texts give one."""
    s = source.select(*on, F.col(text).alias("_src"))
    joined = translated.join(s, on, "left")
    a, b = (F.col(text), F.col("_src")) if translated_first else (F.col("_src"), F.col(text))
    one = F.col("_src").isNull() | (F.trim("_src") == F.trim(text)) | (F.trim("_src") == "")
    return joined.withColumn(text, F.when(one, F.col(text)).otherwise(F.concat_ws("\n", a, b))).select(*translated.columns)


def glossary_violations(lines: DataFrame, glossary: DataFrame, source: str, target: str) -> DataFrame:
    """Lines whose source holds a term while the target lacks its translation; letter case doesn't matter.

    The glossary is a hand-written list; it is broadcast where a count shows at
    most 20,000 terms, otherwise Spark chooses the nested-loop side itself."""
    g = glossary.where("trim(source_term) <> '' and trim(target_term) <> ''")
    g = F.broadcast(g) if g.limit(20_001).count() <= 20_000 else g
    hit = F.contains(F.lower(F.col(source)), F.lower("source_term")) & ~F.contains(F.lower(F.col(target)), F.lower("target_term"))
    return lines.join(g, hit)


def replace_cues(cues: DataFrame, new: DataFrame, remove: DataFrame, least: float = 0.05) -> DataFrame:
    """cues without those in `remove` (video_id, uid), clipped against new's spans, and new's rows; shorter rests than `least` go.

    A cue that covers a new one's start ends there; one that starts inside a new
    one starts at its end; new spans are taken in order."""
    spans = new.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("start_sec", "end_sec"))).alias("_new"))
    kept = cues.join(remove.select("video_id", "uid"), ["video_id", "uid"], "left_anti").join(spans, "video_id", "left")
    clip = F.aggregate(
        F.coalesce("_new", F.array().cast("array<struct<start_sec:double,end_sec:double>>")),
        F.struct(F.col("start_sec").alias("s"), F.col("end_sec").alias("e")),
        lambda acc, n: F.when((acc["e"] <= n["start_sec"]) | (acc["s"] >= n["end_sec"]), acc)
        .when(acc["s"] < n["start_sec"], F.struct(acc["s"].alias("s"), n["start_sec"].alias("e")))
        .otherwise(F.struct(n["end_sec"].alias("s"), acc["e"].alias("e"))),
    )
    clipped = kept.withColumn("_c", clip).withColumns({"start_sec": F.col("_c.s"), "end_sec": F.col("_c.e")}).where(F.col("end_sec") - F.col("start_sec") >= least)
    return clipped.select(*cues.columns).unionByName(new.select(*cues.columns))


def visible(cues: DataFrame, t0: float, t1: float) -> DataFrame:
    """Cues that meet the closed range, those that span it among them."""
    return cues.where((F.col("start_sec") <= t1) & (F.col("end_sec") >= t0))
