"""Frame, cue and line filters, plans and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import partial_ratio_udf

#: Short Latin tokens that stay beside CJK text.
LATIN_KEPT = ("OK", "TV", "CEO", "VIP", "KTV", "DNA", "APP", "WIFI", "AI", "PK", "NO", "YES", "HI", "BYE", "GPS", "USB", "CD", "DVD", "MV", "IQ", "EQ")

#: How near a neighbour is that a text may be a part of, and how alike.
EDGE_SEC, EDGE_RATIO = 0.40, 80.0


def noise_box(text: Column, conf: Column) -> Column:
    """A box that is no text: blank, signs alone, or a weak single or repetitive token."""
    t = F.trim(text)
    return (
        (t == "")
        | ~t.rlike(r"[\p{L}\p{N}]")
        | (t.rlike(r"^[A-Za-z0-9]$") & (conf < 0.95))
        | (t.rlike(f"^{T.CJK_CLASS}$") & (conf < 0.40))
        | (t.rlike(r"^[\d\s]{4,}$") & (conf < 0.85))
        | ((F.length(t) >= 4) & t.rlike(r"([A-Za-z])\1\1") & (conf < 0.80))
    )


def clean_boxes(frames: DataFrame, typos: dict[str, str] | None = None) -> DataFrame:
    """Boxes without noise; short capital tokens go where half of a neighbour box is CJK; frames left without box go."""
    fixed = F.transform("boxes", lambda b: b.withField("text", T.fix_typos(F.trim(b["text"]), typos or {})))
    kept = F.filter(fixed, lambda b: ~noise_box(b["text"], b["confidence"]))
    f = frames.withColumn("boxes", kept)
    cjk = F.exists("boxes", lambda b: T.predominantly_cjk(b["text"]))
    mark = lambda b: b["text"].rlike("^[A-Z0-9]{2,10}$") & ~b["text"].isin(*LATIN_KEPT)
    f = f.withColumn("boxes", F.when((F.size("boxes") >= 2) & cjk, F.filter("boxes", lambda b: ~mark(b))).otherwise(F.col("boxes")))
    return f.where(F.size("boxes") > 0)


def latin_gibberish(text: Column, conf: Column, frames: Column) -> Column:
    """A short Latin token whose vowels or capitals no word has, seen weakly or briefly."""
    t = F.trim(text)
    letters = F.regexp_count(t, F.lit("[A-Za-z]"))
    vowels = F.regexp_count(t, F.lit("[AEIOUaeiou]")) / F.greatest(letters, F.lit(1))
    capitals = F.regexp_count(t, F.lit("[A-Z]"))
    odd = (vowels <= 0.20) | (vowels >= 0.75)
    mixed = t.rlike("[a-z][A-Z]") | ((capitals >= 2) & (capitals < letters))
    weak = (conf < 0.80) | (frames <= 2)
    return (letters > 0) & (F.length(t) <= 12) & ~t.isin(*LATIN_KEPT) & ((odd & weak) | (mixed & weak & (conf < 0.90)) | ((letters <= 2) & (conf < 0.60)))


def confident_frames(frames: DataFrame, least: float) -> DataFrame:
    """Frames with boxes whose mean confidence is `least`, or whose first box has three quarters of it."""
    mean = F.aggregate("boxes", F.lit(0.0), lambda s, b: s + b["confidence"]) / F.size("boxes")
    return frames.where((F.size("boxes") > 0) & ((mean >= least) | (F.get("boxes", F.lit(0))["confidence"] >= 0.75 * least)))


def y_outliers(boxes: DataFrame, roi_height: float | None = None, bin_px: float = 5.0) -> DataFrame:
    """Boxes (video_id, frame_index, y) at the video's usual heights.

    With four frames and six boxes: those in or near dense 5-pixel bins; without
    a dense bin those near the median by MAD.  All stay if all would go."""
    from .aggregates import mad_score

    by = ["video_id"]
    stats = boxes.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.countDistinct("frame_index").alias("_f"), F.median("y").alias("_mid"))
    b = boxes.join(stats, by).withColumn("_bin", F.floor(F.col("y") / bin_px).cast("long"))
    dense = b.groupBy(*by, "_bin", "_n").count().where(F.col("count") >= F.greatest(F.lit(30), F.floor(F.col("_n") / 100)))
    near = dense.select(*by, F.explode(F.sequence(F.col("_bin") - 2, F.col("_bin") + 2)).alias("_bin"), F.lit(True).alias("_near")).distinct()
    b = b.join(near, [*by, "_bin"], "left").join(dense.select(*by, F.lit(True).alias("_dense")).distinct(), by, "left")
    b = mad_score(b, by, "y", 2.0, "_z")
    reach = F.lit(max(10.0, (roi_height or 0) / 2))
    keep = F.when((F.col("_f") < 4) | (F.col("_n") < 6), True).when(F.col("_dense"), F.coalesce("_near", F.lit(False))).otherwise((F.col("_z") <= 4) | (F.abs(F.col("y") - F.col("_mid")) <= reach))
    b = b.withColumn("_keep", keep)
    any_kept = F.max(F.col("_keep").cast("int")).over(W.partitionBy(*by)) == 1
    return b.withColumn("_any", any_kept).where(F.col("_keep") | ~F.col("_any")).select(boxes.columns)


def rescue_stacks(boxes: DataFrame, roi_height: float) -> DataFrame:
    """Of frames without a kept box: stacks of two and more boxes, close above one another, whose centre is near the kept boxes' median.

    boxes: video_id, frame_index, x0, y0, x1, y1, kept."""
    by = ["video_id", "frame_index"]
    y = (F.col("y0") + F.col("y1")) / 2
    med = boxes.where("kept").groupBy("video_id").agg(F.median(y).alias("_med"))
    lost = boxes.join(boxes.where("kept").select(*by).distinct(), by, "left_anti")
    w = W.partitionBy(*by).orderBy("y0", "x0")
    apart = (F.lag("x1").over(w) <= F.col("x0")) | (F.lag("x0").over(w) >= F.col("x1")) | (F.col("y0") - F.lag("y1").over(w) > 0.8 * (F.col("y1") - F.col("y0")))
    lost = lost.withColumn("_new", F.when(F.lag("y0").over(w).isNull() | apart, 1).otherwise(0)).withColumn("_s", F.sum("_new").over(w)).drop("_new")
    stack = lost.groupBy(*by, "_s").agg(F.count(F.lit(1)).alias("_k"), ((F.min("y0") + F.max("y1")) / 2).alias("_c"))
    good = stack.join(med, "video_id").where((F.col("_k") >= 2) & (F.abs(F.col("_c") - F.col("_med")) <= roi_height / 2)).select(*by, "_s")
    return lost.join(good, [*by, "_s"], "left_semi").select(boxes.columns)


def pure_latin_marks(cues: DataFrame, dominance: float = 0.80) -> DataFrame:
    """cues without capital Latin tokens, in videos where `dominance` of the cues are CJK."""
    share = cues.groupBy("video_id").agg(F.avg(T.contains_cjk("text").cast("double")).alias("_cjk"))
    mark = F.trim("text").rlike("^[A-Z]{2,12}$") & ~F.trim("text").isin(*LATIN_KEPT)
    return cues.join(share, "video_id").where(~(mark & (F.col("_cjk") >= dominance))).select(cues.columns)


def flash_fragments(cues: DataFrame, shortest: float = 0.18, rows: int = 3, seconds: float = 4.0, similar: float = 0.66) -> DataFrame:
    """cues without those under `shortest` that are a lone character, digits, or a fragment of a longer neighbour."""
    from ..functions.similarity import indel_ratio_udf

    w = W.partitionBy("video_id").orderBy("start_sec", "idx")
    n = cues.withColumn("_k", F.row_number().over(w))
    brief = n.where(F.col("end_sec") - F.col("start_sec") < shortest)
    lone = ((T.cjk_count("text") <= 1) & (F.length(F.trim("text")) <= 2)) | F.trim("text").rlike(r"^[\d\s:.,-]+$")
    near = n.select("video_id", F.col("_k").alias("_j"), F.col("text").alias("_t"), F.col("start_sec").alias("_s"))
    pairs = brief.withColumn("_j", F.explode(F.array(*(F.col("_k") + i for i in range(-rows, rows + 1) if i)))).join(near, ["video_id", "_j"])
    pairs = pairs.where((F.abs(F.col("_s") - F.col("start_sec")) <= seconds) & (F.length("_t") > F.length("text")))
    part = pairs.where(indel_ratio_udf("text", "_t") >= similar).select("video_id", "_k").distinct()
    gone = brief.where(lone).select("video_id", "_k").unionByName(part).distinct()
    return n.join(gone, ["video_id", "_k"], "left_anti").select(cues.columns)


def short_texts(cues: DataFrame, latin_least: int = 0) -> DataFrame:
    """cues without short weak texts; kept texts are trimmed.

    Limits go by CJK characters k, other letters and digits r, confidence and
    frames.  A part of a neighbour within EDGE_SEC (contained in it, or alike by
    EDGE_RATIO) is a text that appears or fades, and so is a single CJK
    character that begins the next text; these stay.  Without a letter or digit
    a text goes.  With `latin_least`, shorter texts go (CJK texts: one
    character is enough).  A null confidence or frame count goes as 0."""
    order = W.partitionBy("video_id").orderBy("start_sec", "idx")
    clean = F.regexp_replace("_t", r"[^\p{L}\p{N}]", "")
    seen = cues.withColumns({"_t": F.trim(F.coalesce("text", F.lit(""))), "_c": F.coalesce("confidence", F.lit(0.0)), "_f": F.coalesce("frame_count", F.lit(0))})
    seen = seen.withColumns({"_w": clean, "_x": F.regexp_replace("_t", " ", "")})
    for side, at in (("before", F.lag), ("after", F.lead)):
        gap = F.col("start_sec") - at("end_sec").over(order) if side == "before" else at("start_sec").over(order) - F.col("end_sec")
        seen = seen.withColumns({f"_{side}": at("_x").over(order), f"_{side}_gap": gap})
    seen = seen.withColumn("_next", F.lead("_t").over(order)).withColumns({"_k": T.cjk_count("_w"), "_n": F.length("_w")}).withColumn("_r", F.col("_n") - F.col("_k"))
    k, r, n, c, f = (F.col(f"_{x}") for x in "krncf")
    flash = F.expr("_r = 0 and _k between 3 and 24 and _f <= 2 and _c < 0.78")
    garbled = F.expr("_r = 0 and _k between 4 and 24 and _f between 3 and 15 and _c < 0.76 and end_sec - start_sec < 0.80")
    unsure = flash | garbled
    edge = F.lit(False)
    for side in ("before", "after"):
        near = unsure & (F.coalesce(F.col(f"_{side}"), F.lit("")) != "") & (F.col(f"_{side}_gap") <= EDGE_SEC)
        # texts that needn't be compared are blank, and equal blanks are scored once a batch
        alike = partial_ratio_udf(F.when(near, F.col("_x")).otherwise(F.lit("")), F.when(near, F.col(f"_{side}")).otherwise(F.lit("")))
        edge |= near & (F.contains(F.col(f"_{side}"), F.col("_x")) | (alike >= EDGE_RATIO))
    intro = F.expr("_after_gap between 0.0 and 0.5 and length(_next) >= 3 and _c >= 0.60") & (F.substring("_next", 1, 1) == F.substring("_w", 1, 1))
    one = (k == 1) & (r == 0) & ~F.coalesce(intro, F.lit(False)) & F.expr("_f <= 2 or _c < if(_f >= 5, 0.72, 0.75)")
    cjk = F.expr(
        "(_k >= 25 and _c < 0.80 and _f <= 15) or (_k <= 2 and _r >= greatest(_k, 2) and _c < 0.85) or (_k <= 3 and _r >= 1 and _f <= 2 and _c < 0.75)"
        " or (_k = 2 and _r = 0 and (_f <= 1 or _c < 0.65)) or (_k >= 3 and _r >= 1 and _f <= 2 and _c < 0.82)"
    )
    latin = latin_gibberish(F.col("_w"), c, f) | F.expr("_f <= 2 and _n <= 2 and _c < 0.90") | (F.expr("_f <= 2 and _c < 0.80 and _n <= 10") & ~F.upper("_w").isin(*LATIN_KEPT))
    drop = (n == 0) | F.when(k > 0, cjk | one | (unsure & ~edge)).otherwise(latin)
    if latin_least > 0:
        drop |= n < T.adaptive_least_chars("_w", latin_least)
    return seen.where(~drop).withColumn("text", F.col("_t")).select(cues.columns)


def translatable_lines(lines: DataFrame, by: list[str], text: str, cjk_source: bool, noise_share: float = 0.90) -> DataFrame:
    """Lines with letters; of a CJK source only those with CJK, unless that would drop `noise_share` of them."""
    letters = F.col(text).rlike(r"\p{L}")
    if not cjk_source:
        return lines.where(letters)
    share = lines.groupBy(*by).agg(F.avg((~T.contains_cjk(text)).cast("double")).alias("_share"))
    return lines.join(share, by).where(letters & (T.contains_cjk(text) | (F.col("_share") >= noise_share))).select(lines.columns)


def box_anomalies(boxes: DataFrame, width: float) -> DataFrame:
    """Boxes of plausible confidence, size and shape for their video; two medians are joined back."""
    w, h = F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")
    med = boxes.groupBy("video_id").agg(F.median("confidence").alias("_c"), F.median(F.least(w, h)).alias("_t"))
    least = F.least(F.when(F.col("_c") >= 0.95, F.greatest(F.lit(0.85), F.col("_c") - 0.05)).otherwise(0.85), F.lit(0.90))
    elite = F.col("confidence") >= 0.90
    shape = (F.least(w, h) <= 5 * F.col("_t")) & (w / h).between(0.05, 50) & (w <= 0.95 * width) & ~((w / h).between(0.67, 1.5) & (F.least(w, h) > 3 * F.col("_t")))
    return boxes.join(med, "video_id").where((F.col("confidence") >= least) & (w >= 6) & (h >= 6) & (w * h >= 40) & (elite | shape)).select(boxes.columns)


def size_outliers(boxes: DataFrame, k: float = 1.5, least: int = 4) -> DataFrame:
    """Boxes within Tukey's fences of width and of height."""
    from .aggregates import tukey_bounds

    b = boxes.withColumns({"_w": F.col("x_max") - F.col("x_min"), "_h": F.col("y_max") - F.col("y_min")})
    for c in ("_w", "_h"):
        q = tukey_bounds(b, ["video_id"], c, k, least).select("video_id", F.col("low").alias(f"{c}0"), F.col("high").alias(f"{c}1"))
        b = b.join(q, "video_id").where(F.col(f"{c}0").isNull() | F.col(c).between(F.col(f"{c}0"), F.col(f"{c}1")))
    return b.select(boxes.columns)


def off_margin(boxes: DataFrame, width: float, height: float, margin: float = 0.05) -> DataFrame:
    x, y = (F.col("x_min") + F.col("x_max")) / 2, (F.col("y_min") + F.col("y_max")) / 2
    return boxes.where((F.col("confidence") >= 0.90) | (x.between(margin * width, (1 - margin) * width) & y.between(margin * height, (1 - margin) * height)))


def aligned_lines(lines: DataFrame, roi_x: float, roi_w: float, alignment: str = "CENTER") -> DataFrame:
    """Lines of boxes (x0, x1, text, confidence) that sit as the region's text does."""
    centre = (F.col("x0") + F.col("x1")) / 2
    scale = F.when(F.length("text") <= 2, 0.40).when(F.col("confidence") < 0.80, 0.65).otherwise(0.95)
    reach = F.greatest(F.lit(0.10 * roi_w), F.lit(60.0)) * scale
    fits = {"LEFT": F.abs(F.col("x0") - roi_x) <= reach * 2, "RIGHT": F.abs(roi_x + roi_w - F.col("x1")) <= reach * 2}.get(alignment, F.abs(centre - (roi_x + roi_w / 2)) <= reach)
    return lines.where((F.col("x1") - F.col("x0") <= 1.02 * roi_w) & fits)


def preflight(projects: DataFrame) -> DataFrame:
    """One row per problem of a project: video_id, severity, issue."""
    rules = (
        ("error", "no_region", F.col("roi").isNull()),
        ("error", "no_duration", F.coalesce("duration_sec", F.lit(0.0)) <= 0),
        ("warning", "coarse_step", F.col("sample_step_sec") > 0.5),
        ("warning", "many_frames", F.col("duration_sec") / F.col("sample_step_sec") > 200_000),
        ("warning", "high_threshold", F.col("min_confidence") > 0.95),
    )
    issues = F.filter(F.array(*(F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(i).alias("issue"))) for s, i, c in rules)), lambda x: x.isNotNull())
    return projects.select("video_id", F.explode(issues).alias("i")).select("video_id", "i.*")


def empty_result_reason(stages: DataFrame) -> DataFrame:
    """Why a video gave no cue: the first stage that left nothing (frames, with_text, confident, grouped, kept)."""
    order = ("frames", "with_text", "confident", "grouped", "kept")
    reason = F.coalesce(*(F.when(F.coalesce(F.col(c), F.lit(0)) == 0, F.lit(c)) for c in order))
    return stages.select("video_id", F.concat(F.lit("nothing_left_at_"), reason).alias("reason")).where("reason is not null")


def batch_status(items: DataFrame, width: int, height: int) -> DataFrame:
    """READY, ROI_SCALED, SKIPPED or INVALID for each video, with the region scaled from width x height to the video's size."""
    x, y = F.col("video_width") / width, F.col("video_height") / height
    r = F.col("roi")
    scaled = F.struct(*(F.greatest(F.lit(lo), F.bround(r[n] * f).cast("int")).alias(n) for n, f, lo in (("x", x, 0), ("y", y, 0), ("w", x, 1), ("h", y, 1))))
    clipped = F.struct(
        F.least(scaled["x"], F.col("video_width") - 1).alias("x"), F.least(scaled["y"], F.col("video_height") - 1).alias("y"),
        F.least(scaled["w"], F.col("video_width") - F.least(scaled["x"], F.col("video_width") - 1)).alias("w"), F.least(scaled["h"], F.col("video_height") - F.least(scaled["y"], F.col("video_height") - 1)).alias("h"),
    )
    status = F.when(F.col("video_width").isNull() | (F.col("video_width") <= 0) | r.isNull(), "INVALID").when(F.coalesce("done", F.lit(False)), "SKIPPED").when((F.col("video_width") == width) & (F.col("video_height") == height), "READY").otherwise("ROI_SCALED")
    return items.withColumns({"status": status, "roi": F.when(status != "INVALID", clipped)})


def probe_window(videos: DataFrame, duration: str, seconds: float, ratio: float = 0.5) -> DataFrame:
    """A window of `seconds` centred at ratio of the duration, moved inside it."""
    length = F.least(F.lit(seconds), F.col(duration))
    start = F.greatest(F.lit(0.0), F.least(F.col(duration) * ratio - length / 2, F.col(duration) - length))
    return videos.withColumns({"start_sec": start, "end_sec": start + length})


def chunk_budget(token_budget: float, tokens_per_second: float, most: float) -> float:
    return max(30.0, min(token_budget / tokens_per_second, most))


def chunk_plan(videos: DataFrame, duration: str, budget: float) -> DataFrame:
    """Equal parts of at most `budget` seconds; the last ends exactly at the duration.  Numbers from 0."""
    n = F.when(F.col(duration) <= budget, F.lit(1)).otherwise(F.ceil(F.col(duration) / budget)).cast("int")
    parts = videos.withColumn("_n", n).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    start = F.col("chunk") * F.col(duration) / F.col("_n")
    end = F.when(F.col("chunk") == F.col("_n") - 1, F.col(duration)).otherwise((F.col("chunk") + 1) * F.col(duration) / F.col("_n"))
    return parts.withColumns({"start_sec": start, "end_sec": end}).drop("_n")
