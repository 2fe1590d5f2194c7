"""Votes, robust statistics, scores and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def mode_vote(df: DataFrame, by: list[str], value: str, ts: str, least_share: float = 0.0) -> DataFrame:
    """The most common value (ties: seen first, then smallest) with its votes and share; null below least_share."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("votes"), F.min(ts).alias("_first"))
    w = W.partitionBy(*by)
    ranked = counts.withColumns({"total": F.sum("votes").over(w), "_r": F.row_number().over(w.orderBy(F.desc("votes"), "_first", value))})
    share = F.col("votes") / F.col("total")
    return ranked.where("_r = 1").select(*by, F.when(share >= least_share, F.col(value)).alias("winner"), "votes", "total", share.alias("share"))


def weighted_confidence(df: DataFrame, by: list[str], confidence: str = "confidence", weight: str = "frame_count") -> DataFrame:
    return df.groupBy(*by).agg((F.sum(F.col(confidence) * F.col(weight)) / F.sum(weight)).alias("confidence"), F.sum(weight).alias(weight))


def box_union(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def largest_box_centre(df: DataFrame, by: list[str], pos: str) -> DataFrame:
    """Whole-number centre of the largest box; of equals the first."""
    best = F.max_by(F.struct(((F.col("x0") + F.col("x1")) / 2).cast("int").alias("x"), ((F.col("y0") + F.col("y1")) / 2).cast("int").alias("y")), F.struct((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), -F.col(pos)))
    return df.groupBy(*by).agg(best.alias("centre"))


def quantiles(df: DataFrame, by: list[str], value: str, **shares: float) -> DataFrame:
    """by, and one exact quantile for each name=share: between the two nearest values in proportion.  Nulls don't count; a group of
    nulls has no row.

    Equal values are counted first, on the map side too, and a running sum over the distinct values finds the ranks: a sort that
    can spill, where the aggregate function would hold all distinct values of a group in memory."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*by)
    ranked = counts.withColumns({"_until": F.sum("_n").over(w.orderBy("_v").rowsBetween(W.unboundedPreceding, 0)), "_all": F.sum("_n").over(w)})
    out, picks = [], []
    for name, share in shares.items():
        place = F.lit(float(share)) * (F.col("_all") - 1)
        for end, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            picks.append(F.max(F.when((F.col("_until") - F.col("_n") <= at) & (at < F.col("_until")), F.col("_v"))).alias(f"_{end}_{name}"))
        place = F.lit(float(share)) * (F.col("_total") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append(F.when(F.floor(place) == F.ceil(place), lo.cast("double")).otherwise((F.ceil(place) - place) * lo + (place - F.floor(place)) * hi).alias(name))
    return ranked.groupBy(*by).agg(F.max("_all").alias("_total"), *picks).select(*by, *out)


def mad_score(df: DataFrame, by: list[str], value: str, floor: float = 1e-6, out: str = "mad_z") -> DataFrame:
    """|x - median| / (1.4826 * max(MAD, floor)); null for a null value."""
    med = quantiles(df, by, value, _med=0.5)
    dev = df.join(med, by, "left").withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    mad = quantiles(dev, by, "_dev", _mad=0.5)
    return dev.join(mad, by, "left").withColumn(out, F.col("_dev") / (1.4826 * F.greatest(F.col("_mad"), F.lit(floor)))).drop("_med", "_dev", "_mad")


def tukey_bounds(df: DataFrame, by: list[str], value: str, k: float = 2.0, least: int = 6) -> DataFrame:
    """low and high per group; without bound for fewer than `least` values."""
    n = df.groupBy(*by).agg(F.count(value).alias("n"))
    q = n.join(quantiles(df, by, value, q1=0.25, q3=0.75), by, "left")
    r = F.col("q3") - F.col("q1")
    return q.select(*by, "n", F.when(F.col("n") >= least, F.col("q1") - k * r).alias("low"), F.when(F.col("n") >= least, F.col("q3") + k * r).alias("high"))


def tukey_keep(df: DataFrame, by: list[str], value: str, k: float = 2.0, least: int = 6) -> DataFrame:
    b = tukey_bounds(df, by, value, k, least)
    return df.join(b, by).where(F.col("low").isNull() | F.col(value).between(F.col("low"), F.col("high"))).select(df.columns)


def dense_bins(df: DataFrame, by: list[str], value: str, width: float, least: int, share: int = 100, spread: int = 2) -> DataFrame:
    """Rows in bins that hold max(least, n // share) rows, or `spread` bins beside one.  A group without dense bin keeps all its rows."""
    binned = df.withColumn("bin", F.floor(F.col(value) / width).cast("long"))
    counts = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    dense = counts.join(total, by).where(F.col("_n") >= F.greatest(F.lit(least), F.floor(F.col("_total") / share)))
    near = dense.select(*by, F.explode(F.sequence(F.col("bin") - spread, F.col("bin") + spread)).alias("bin")).distinct()
    none = total.join(dense.select(*by).distinct(), by, "left_anti").select(*by)
    return binned.join(near, [*by, "bin"], "left_semi").unionByName(binned.join(none, by, "left_semi"))


def band_presence(df: DataFrame, by: list[str], value: str, width: float, member: str, least_share: float) -> DataFrame:
    """Bands of neighbouring bins in which at least `least_share` of the group's distinct members appear."""
    bins = df.withColumn("bin", F.floor(F.col(value) / width).cast("long"))
    per = bins.groupBy(*by, "bin").agg(F.countDistinct(member).alias("members"))
    total = df.groupBy(*by).agg(F.countDistinct(member).alias("total"))
    kept = per.join(total, by).where(F.col("members") >= least_share * F.col("total"))
    island = F.col("bin") - F.row_number().over(W.partitionBy(*by).orderBy("bin"))
    return kept.withColumn("_i", island).groupBy(*by, "_i").agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.max("members").alias("peak")).drop("_i")


def envelope(df: DataFrame, by: list[str], position: str, value: str, step) -> DataFrame:
    return df.groupBy(*by, F.floor(F.col(position) / step).alias("bucket")).agg(F.max(F.abs(value)).alias("peak"))


def subtitle_score(matches: DataFrame, built_count: DataFrame, by: list[str], exact: str, error: str, hit: str) -> DataFrame:
    """recall, exact rate, spurious rate, mean CER and quality per group.

    matches has a row per truth cue; hit says if a built cue matched, exact if
    its text did, error its CER.  built_count: by, built, used (distinct built
    cues, and those of them that matched)."""
    s = matches.groupBy(*by).agg(
        F.count(F.lit(1)).alias("truth"), F.sum(F.col(hit).cast("long")).alias("matched"), F.sum((F.col(hit) & F.col(exact)).cast("long")).alias("exact"), F.avg(F.when(F.col(hit), F.col(error))).alias("mean_cer")
    )
    s = s.join(built_count, by, "left").withColumns({"spurious": F.coalesce(F.col("built") - F.col("used"), F.lit(0)), "mean_cer": F.coalesce("mean_cer", F.lit(1.0))})
    s = s.withColumns({"recall": F.col("matched") / F.col("truth"), "exact_rate": F.col("exact") / F.col("truth"), "spurious_rate": F.coalesce(F.col("spurious") / F.nullif(F.col("built"), F.lit(0)), F.lit(0.0))})
    quality = 0.5 * F.col("exact_rate") + 0.25 * (1 - F.least(F.lit(1.0), F.col("mean_cer"))) + 0.2 * F.col("recall") - 0.1 * F.col("spurious_rate")
    f1 = F.when(F.col("truth") + F.coalesce("built", F.lit(0)) > 0, 2 * F.col("matched") / (F.col("truth") + F.coalesce("built", F.lit(0))))
    return s.withColumns({"quality": F.greatest(F.lit(0.0), F.least(F.lit(1.0), quality)), "f1": F.least(F.lit(1.0), f1)})


def indexed_percentile(values, share: float):
    """sorted[int(share * n)] of an array column: no interpolation."""
    s = F.array_sort(values)
    return F.element_at(s, F.least(F.floor(F.size(s) * share), F.size(s) - 1).cast("int") + 1)


def quality_report(frames_in_cue: DataFrame, by: list[str]) -> DataFrame:
    """Per group: detection recall, exact share, mean, median and p90 of each cue's least CER, share of garbage, p25 confidence.

    One row per cue: best_cer (null if never seen), garbage, confidence."""
    seen = F.filter(F.collect_list("best_cer"), lambda x: x.isNotNull())
    return frames_in_cue.groupBy(*by).agg(
        F.avg(F.col("best_cer").isNotNull().cast("double")).alias("recall"), F.avg(F.coalesce((F.col("best_cer") == 0).cast("double"), F.lit(0.0))).alias("exact"),
        F.avg("best_cer").alias("mean_cer"), F.median("best_cer").alias("median_cer"), indexed_percentile(seen, 0.9).alias("p90_cer"),
        F.avg(F.col("garbage").cast("double")).alias("garbage"), indexed_percentile(F.collect_list("confidence"), 0.25).alias("p25_confidence"),
    )


def boundary_f1(truth: DataFrame, built: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """F1 of start times that have a counterpart within `tolerance`."""
    from .joins import nearest_edge

    def hits(a, b, name):
        found = nearest_edge(a.select(*by, F.col("start_sec").alias("_s")), b.select(*by, F.col("start_sec").alias("_e")), by, "_s", "_e", tolerance)
        return found.groupBy(*by).agg(F.count(F.lit(1)).alias(f"{name}_n"), F.count("snapped").alias(f"{name}_hit"))

    j = hits(truth, built, "t").join(hits(built, truth, "b"), by, "full").na.fill(0)
    r, p = F.col("t_hit") / F.nullif("t_n", F.lit(0)), F.col("b_hit") / F.nullif("b_n", F.lit(0))
    r, p = F.coalesce(r, F.lit(0.0)), F.coalesce(p, F.lit(0.0))
    return j.select(*by, p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def ceiling(truth: DataFrame, by: list[str]) -> DataFrame:
    """Counts of achieved (built text right), recoverable (right text in some frame) and input-limited cues.

    One row per truth cue: built_right, frame_right."""
    kind = F.when(F.col("built_right"), "achieved").when(F.col("frame_right"), "recoverable").otherwise("input_limited")
    return truth.groupBy(*by).agg(*(F.sum((kind == k).cast("long")).alias(k) for k in ("achieved", "recoverable", "input_limited")))


def quality_flags(pairs: DataFrame, by: list[str], order: list[str], source: str, target: str) -> DataFrame:
    """identical, empty, odd_length and repeats_previous for each translated line.

    odd_length: target / source length below .35 or over 2.5, where CJK source
    characters count three and the source has twelve and more."""
    from .windows import adjacent_duplicates

    s, t = F.trim(F.col(source)), F.trim(F.col(target))
    weight = T.visible_length(s) + 2 * T.cjk_count(s)
    ratio = T.visible_length(t) / F.nullif(weight, F.lit(0))
    flagged = pairs.withColumns(
        {
            "identical": (s == t) & (s != "") & ~T.untranslatable(source),
            "empty": (t == "") & (s != ""),
            "odd_length": F.coalesce((weight >= 12) & (t != "") & ((ratio < 0.35) | (ratio > 2.5)), F.lit(False)),
        }
    )
    return adjacent_duplicates(flagged, by, order, source, target)


def under_translated(pairs: DataFrame, job: list[str], source: str, target: str, threshold: float = 0.35, cjk_threshold: float = 0.50, cjk_share: float = 0.20, least_lines: int = 12, least_chars: int = 4) -> DataFrame:
    """Lines whose target/source length ratio is below the job's median ratio times the threshold.

    A job with at least `cjk_share` CJK source lines has its own threshold; one
    with fewer than `least_lines` usable lines gives nothing."""
    n, m = F.length(F.trim(source)), F.length(F.trim(target))
    usable = pairs.where((n >= least_chars) & (m > 0)).withColumn("ratio", m / n)
    stats = usable.groupBy(*job).agg(F.count(F.lit(1)).alias("_n"), F.avg(T.contains_cjk(source).cast("double")).alias("_cjk")).join(quantiles(usable, job, "ratio", median_ratio=0.5), job)
    limit = F.when(F.col("_cjk") >= cjk_share, cjk_threshold).otherwise(threshold)
    found = usable.join(stats.where(F.col("_n") >= least_lines), job).where(F.col("ratio") < F.col("median_ratio") * limit)
    return found.withColumn("severity", F.col("ratio") / F.col("median_ratio")).drop("_n", "_cjk")


def passthrough(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Share of comparable pairs (neither blank) that a stage left as they were."""
    ok = (F.trim(a) != "") & (F.trim(b) != "")
    same = F.sum((ok & (F.trim(a) == F.trim(b))).cast("long"))
    n = F.sum(ok.cast("long"))
    return pairs.groupBy(*by).agg(same.alias("unchanged"), n.alias("comparable"), F.coalesce(same / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("ratio"))


def roster_overlap(a, b):
    """|A and B| / min(|A|, |B|) of two array columns."""
    n = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def gated_level(df: DataFrame, by: list[str], level: str, absolute: float, relative: float, order: list[str]) -> DataFrame:
    """Two-pass gated mean: over the absolute gate, then over that mean less `relative`.

    Both means are summed in the order of `order`, a key of the rows: a mean on the gate, or halfway between two
    rounded values, is then the same however the rows are dealt."""
    w = W.partitionBy(*by).orderBy(*order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = df.where(F.col(level) > absolute).dropna(subset=by).select(*by, *order, level).withColumn("_m", F.avg(level).over(whole))
    second = first.where(F.col(level) > F.col("_m") - relative)
    return second.select(*by, F.avg(level).over(whole).alias("level"), F.row_number().over(w).alias("_r")).where("_r = 1").drop("_r")


def gated_loudness(samples: DataFrame, by: list[str], place: str, value: str, rate: float, block_ms: float = 400.0, absolute: float = -70.0, relative: float = -10.0) -> DataFrame:
    """(by, loudness) of a numeric series by blocks with two gates.

    `place` numbers the samples of a series from 0, `rate` a second.  The power of
    a block is its mean square, its loudness -0.691 + 10 log10 of that; a rest
    shorter than a block is left out, and a series shorter than one block is
    measured whole.  Blocks over the absolute gate give a first level; those
    over that level + `relative` are measured (if none is, the first ones).
    Null: silence."""
    size = max(1, int(rate * block_ms / 1000.0))
    loud = lambda p: F.when(p > 1e-12, F.lit(-0.691) + 10 * F.log10(p))
    blocks = samples.where(F.col(value).isNotNull()).groupBy(*by, F.floor(F.col(place) / size).alias("_block")).agg(F.avg(F.col(value).cast("double") ** 2).alias("_power"), F.count(F.lit(1)).alias("_n"))
    whole = blocks.groupBy(*by).agg((F.sum(F.col("_power") * F.col("_n")) / F.sum("_n")).alias("_all"), F.sum((F.col("_n") == size).cast("int")).alias("_full"), F.avg(F.when((F.col("_n") == size) & (loud(F.col("_power")) > absolute), F.col("_power"))).alias("_first"))
    joined = blocks.where(F.col("_n") == size).join(whole.select(*by, "_first"), by)
    final = joined.where((loud(F.col("_power")) > absolute) & (loud(F.col("_power")) > loud(F.col("_first")) + relative)).groupBy(*by).agg(F.avg("_power").alias("_final"))
    power = F.when(F.col("_full") == 0, F.col("_all")).otherwise(F.when(F.col("_first") > 1e-12, F.coalesce("_final", "_first")))
    return whole.join(final, by, "left").select(*by, loud(power).alias("loudness"))


def watermark_lines(cues: DataFrame, by: list[str], key: str, text: str, least: int = 5, share: float = 0.08, latin: float = 0.5) -> DataFrame:
    """Lines that recur: in at least `least` and `share` of the group's multi-line cues, most of their characters ASCII letters."""
    lines = F.split(F.col(text), "\n")
    multi = cues.where(F.size(lines) > 1)
    total = multi.groupBy(*by).agg(F.count(F.lit(1)).alias("cues"))
    each = multi.select(*by, key, F.explode(lines).alias("line")).withColumn("line", F.trim("line")).where("line <> ''").distinct()
    counts = each.groupBy(*by, "line").agg(F.count(F.lit(1)).alias("n"))
    letters = F.length(F.regexp_replace("line", "[^A-Za-z]", "")) / F.length("line")
    return counts.join(total, by).where((F.col("n") >= least) & (F.col("n") >= share * F.col("cues")) & (letters > latin))


def without_lines(cues: DataFrame, marks: DataFrame, by: list[str], text: str) -> DataFrame:
    """cues less the lines in marks (by, line); cues left without text go."""
    listed = marks.groupBy(*by).agg(F.collect_set("line").alias("_marks"))
    kept = F.filter(F.split(F.col(text), "\n"), lambda x: ~F.array_contains(F.coalesce("_marks", F.array().cast("array<string>")), F.trim(x)))
    return cues.join(listed, by, "left").withColumn(text, F.array_join(kept, "\n")).where(F.trim(text) != "").select(cues.columns)
