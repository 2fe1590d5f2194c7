"""Raw OCR and speech files: versioned JSON, plain or gzipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import OCR_FILE, SPEECH_FILE

MAJOR = "1"


def _supported(df: DataFrame) -> DataFrame:
    """Only the major version counts."""
    return df.where(F.split_part("version", F.lit("."), F.lit(1)) == MAJOR)


def read_ocr(spark: SparkSession, path: str) -> DataFrame:
    """path, meta, frame_index, timestamp_sec, boxes of every supported file; gzip by suffix; unknown keys are ignored."""
    f = _supported(spark.read.schema(OCR_FILE).option("multiLine", True).json(path).withColumn("path", F.input_file_name()))
    frames = f.select("path", "meta", F.explode("frames").alias("f"))
    boxes = F.transform("f.boxes", lambda b: F.struct(b["t"].alias("text"), b["c"].alias("confidence"), F.transform(b["p"], lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))).alias("polygon")))
    return frames.select("path", "meta", F.col("f.fi").alias("frame_index"), F.col("f.ts").alias("timestamp_sec"), boxes.alias("boxes"))


def write_ocr(frames: DataFrame, path: str, gzip: bool = False) -> None:
    """One JSON object per video_id, compact keys, under path; frames in order of index."""
    box = lambda b: F.struct(b["text"].alias("t"), b["confidence"].alias("c"), F.transform(b["polygon"], lambda p: F.array(p["x"], p["y"])).alias("p"))
    one = F.struct(F.col("frame_index").alias("fi"), F.col("timestamp_sec").alias("ts"), F.transform("boxes", box).alias("boxes"))
    files = frames.groupBy("video_id").agg(F.array_sort(F.collect_list(one)).alias("frames"))
    meta = F.struct(F.col("video_id").alias("video_name"), F.size("frames").alias("frame_count"))
    files.select("video_id", F.lit("1.0").alias("version"), meta.alias("meta"), "frames").repartition("video_id").write.partitionBy("video_id").option("compression", "gzip" if gzip else "none").json(path)


def read_speech(spark: SparkSession, path: str) -> DataFrame:
    """path, meta, pos, start, end, text, speaker, words of every supported file."""
    f = _supported(spark.read.schema(SPEECH_FILE).option("multiLine", True).json(path).withColumn("path", F.input_file_name()))
    return f.select("path", "meta", F.posexplode("segments").alias("pos", "s")).select("path", "meta", "pos", "s.*")


def write_speech(segments: DataFrame, path: str) -> None:
    """(video_id, pos, start, end, text, speaker, words) -> one object per video."""
    one = F.struct("pos", "start", "end", "text", "speaker", "words")
    files = segments.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda s: s.dropFields("pos")).alias("segments"))
    words = F.aggregate("segments", F.lit(0), lambda n, s: n + F.coalesce(F.size(s["words"]), F.lit(0)))
    files.select("video_id", F.lit("1.0").alias("version"), F.struct(F.col("video_id").alias("media_path"), F.size("segments").alias("segment_count"), words.alias("word_count")).alias("meta"), "segments").write.partitionBy("video_id").json(path)


def parse_results(raw: DataFrame) -> DataFrame:
    """(key, texts, scores, polygons) -> key, boxes: zipped by place; arrays of different size are an error, scores are kept within 0 and 1, points rounded."""
    same = (F.size("texts") == F.size("scores")) & (F.size("texts") == F.size("polygons"))
    zipped = F.transform(
        F.arrays_zip("texts", "scores", "polygons"),
        lambda z: F.struct(z["texts"].alias("text"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), z["scores"])).alias("confidence"), F.transform(z["polygons"], lambda p: F.struct(F.bround(F.get(p, F.lit(0))).cast("int").alias("x"), F.bround(F.get(p, F.lit(1))).cast("int").alias("y"))).alias("polygon")),
    )
    return raw.select("key", F.when(same, zipped).otherwise(F.raise_error(F.lit("texts, scores and polygons differ in size"))).alias("boxes"))


def cue_json(cue: str = "cue"):
    """A visual cue struct (speaker, addressee, scene) with compact keys; blank values are left out."""
    blank = lambda c: F.nullif(F.trim(F.col(f"{cue}.{c}")), F.lit(""))
    return F.to_json(F.struct(blank("speaker").alias("s"), blank("addressee").alias("a"), blank("scene").alias("c")))


def cue_from_json(text: str):
    j = F.from_json(text, "s string, a string, c string")
    return F.struct(F.coalesce(j["s"], F.lit("")).alias("speaker"), F.coalesce(j["a"], F.lit("")).alias("addressee"), F.coalesce(j["c"], F.lit("")).alias("scene"))


def salvage_json(text: str) -> str:
    """JSON that was cut off, closed again: the last complete value stays, open strings and brackets are ended."""
    import json

    start = min((i for i in (text.find("["), text.find("{")) if i >= 0), default=-1)
    if start < 0:
        return ""
    body, stack, quoted, skip, good = text[start:], [], False, False, []
    for i, c in enumerate(body):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "[{":
            stack.append("]" if c == "[" else "}")
        elif c in "]}":
            if not stack or stack[-1] != c:
                break
            stack.pop()
            good.append((i + 1, list(stack)))
            if not stack:
                return body[: i + 1]
        elif c == ",":
            good.append((i, list(stack)))
    for end, open_ in reversed(good):
        try:
            tried = body[:end] + "".join(reversed(open_))
            json.loads(tried)
            return tried
        except ValueError:
            continue
    return ""


def diagnostics(cues: DataFrame, flags: list[str]) -> DataFrame:
    """One JSON report per video: counts of cues and of each flag, and the flagged cues."""
    any_flag = F.lit(False)
    for f in flags:
        any_flag |= F.col(f)
    flagged = F.array_sort(F.collect_list(F.when(any_flag, F.struct("idx", "text", *flags))))
    counts = F.struct(F.count(F.lit(1)).alias("cues"), *(F.sum(F.col(f).cast("long")).alias(f) for f in flags))
    return cues.groupBy("video_id").agg(counts.alias("counts"), flagged.alias("flagged")).select("video_id", F.to_json(F.struct("counts", "flagged")).alias("report"))
