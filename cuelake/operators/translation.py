"""Steps around translation: noise round trips, name tables, request keys, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .filters import translatable_lines
from .windows import merge_intervals


def without_noise(lines: DataFrame, by: list[str], line: str, text: str, cjk_source: bool) -> DataFrame:
    """Lines worth translating, numbered densely as `dense_no`, the old number kept."""
    kept = translatable_lines(lines, by, text, cjk_source)
    return kept.withColumn("dense_no", F.row_number().over(W.partitionBy(*by).orderBy(line)))


def put_back(lines: DataFrame, kept: DataFrame, answers: DataFrame, by: list[str], line: str, text: str) -> DataFrame:
    """answers (by, dense_no, text) laid over the full list; noise lines and blank answers keep their text."""
    a = answers.select(*by, "dense_no", F.col(text).alias("_new"))
    mapped = kept.select(*by, line, "dense_no").join(a, [*by, "dense_no"]).select(*by, line, "_new")
    return lines.join(mapped, [*by, line], "left").withColumn(text, F.coalesce(F.when(F.trim("_new") != "", F.col("_new")), F.col(text))).select(lines.columns)


def patch_windows(missing: DataFrame, by: list[str], line: str, around: int, last: str) -> DataFrame:
    """Ranges of lines to ask again: each missing one and `around` beside it, touching ranges as one."""
    r = missing.select(*by, F.greatest(F.lit(1), F.col(line) - around).alias("first_line"), F.least(F.col(last), F.col(line) + around).alias("last_line"))
    return merge_intervals(r, by, "first_line", "last_line", 1)


def chunk_coverage(batches: DataFrame, chunks: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of batches (t_start, t_end) and chunks (c_start, c_end) that overlap; touching isn't overlap."""
    from .joins import interval_join

    return interval_join(batches, chunks, by, ("t_start", "t_end"), ("c_start", "c_end"), 600)


def canonical_names(lines: DataFrame, names: DataFrame, speaker: str = "speaker") -> DataFrame:
    """Speakers by their canonical name (alias, name); of "A & B" each part is looked up."""
    sep = r"\s*[&/,+]\s*"
    table = names.select(T.canonical_name("alias").alias("_a"), F.col("name").alias("_n")).dropDuplicates(["_a"])
    parts = lines.withColumn("_id", F.monotonically_increasing_id())
    one = parts.select("_id", F.posexplode(F.split(F.col(speaker), sep)).alias("_k", "_p")).withColumn("_a", T.canonical_name("_p")).join(table, "_a", "left")
    named = one.groupBy("_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.coalesce("_n", F.trim("_p")).alias("n")))), lambda s: s["n"]), " & ").alias("_named"))
    return parts.join(named, "_id", "left").withColumn(speaker, F.coalesce("_named", speaker)).select(lines.columns)


def request_key(texts: Column, **settings) -> Column:
    """SHA-256 of the settings as canonical JSON and the ordered texts."""
    import json

    return F.sha2(F.concat_ws("::", F.lit(json.dumps(settings, sort_keys=True, separators=(",", ":"))), F.array_join(texts, "\n")).cast("binary"), 256)


def stage_hashes(analysis: Column, stages: list[Column]) -> Column:
    """Each stage's hash holds its forerunner's, so a change invalidates all that follow."""
    h, out = F.sha2(analysis.cast("binary"), 256), []
    for s in stages:
        h = F.sha2(F.concat_ws("::", h, s).cast("binary"), 256)
        out.append(h)
    return F.array(*out)


def request_estimate(jobs: DataFrame, by: list[str], lines: str, batch: int) -> DataFrame:
    return jobs.groupBy(*by).agg(F.count(F.lit(1)).alias("jobs"), F.sum(F.ceil(F.col(lines) / batch)).alias("requests"))


def merge_context(parts: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Series context: the newest overview that isn't blank, and glossary terms by folded source, the first of each kept."""
    from .sets import merge_fields

    overview = merge_fields(parts, by, order, ["overview"])
    terms = parts.select(*by, *order, F.posexplode("terms").alias("_k", "_t"))
    w = W.partitionBy(*by, F.lower("_t.source")).orderBy(*order, "_k")
    first = terms.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    merged = first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "_k", "_t"))), lambda s: s["_t"]).alias("terms"))
    return overview.join(merged, by, "left")
