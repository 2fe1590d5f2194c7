"""Matching that is sequential within a video: candidates by interval join, assignment by a fold."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import indel_ratio_udf
from .joins import interval_join


def greedy_match(result: DataFrame, reference: DataFrame, by: list[str], reach: float = 5.0, iou: float = 0.30, weak_iou: float = 0.05, similar: float = 0.75, fuzzy: bool = True) -> DataFrame:
    """One-to-one pairs (by, r_idx, f_idx, iou, similarity).

    result: by, r_idx, r_text, r_start, r_end; reference alike with f_.  A pair
    fits with an overlap ratio of `iou`, or `weak_iou` and like texts; results in
    time order each take the best free reference."""
    pairs = interval_join(result, reference, by, ("r_start", "r_end"), ("f_start", "f_end"), 4 * reach, closed=True, reach=reach)
    pairs = pairs.withColumn("iou", T.time_iou("r_start", "r_end", "f_start", "f_end"))
    pairs = pairs.withColumn("similarity", indel_ratio_udf("r_text", "f_text") if fuzzy else F.lit(0.0))
    fits = pairs.where((F.col("iou") >= iou) | ((F.col("iou") >= weak_iou) & (F.col("similarity") >= similar)))
    schema = fits.select(*by, "r_idx", "f_idx", "iou", "similarity").schema

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        used_r, used_f, keep = set(), set(), []
        # by time of the result, then the best overlap, then the earliest reference
        pdf = pdf.sort_values(["r_start", "r_idx", "iou", "f_start", "f_idx"], ascending=[True, True, False, True, True], kind="stable")
        for i, r, f in zip(pdf.index, pdf["r_idx"], pdf["f_idx"]):
            if r not in used_r and f not in used_f:
                used_r.add(r)
                used_f.add(f)
                keep.append(i)
        return pdf.loc[keep, [*by, "r_idx", "f_idx", "iou", "similarity"]]

    return fits.groupBy(*by).applyInPandas(assign, schema)


def overlapping_duplicates(spans: DataFrame, by: list[str], key: str, start: str, end: str, weight: str, least: float = 0.80) -> DataFrame:
    """Spans without those that mostly overlap a heavier one kept before: greedy in start order, per group."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values([start, end, key], kind="stable").itertuples(index=True))
        kept: list = []
        live = 0  # kept spans before this index end before everything still to come
        reach: list = []
        for r in rows:
            s, e = getattr(r, start), getattr(r, end)
            while live < len(kept) and reach[live] < s:
                live += 1
            for k in range(live, len(kept)):
                a, b = getattr(kept[k], start), getattr(kept[k], end)
                both, short = min(b, e) - max(a, s), min(b - a, e - s)
                if both > 0 and short > 0 and both / short >= least:
                    if getattr(r, weight) > getattr(kept[k], weight):
                        kept[k] = r
                        reach[k] = max(reach[k], e)
                    break
            else:
                kept.append(r)
                reach.append(max(e, reach[-1] if reach else e))
        return pdf.loc[[r.Index for r in kept]].sort_values([start, end, key], kind="stable")

    return spans.groupBy(*by).applyInPandas(fold, spans.schema)
