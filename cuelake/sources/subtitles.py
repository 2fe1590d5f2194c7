"""SRT and ASS files: parsed and written with DataFrame expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

_TIME = r"(\d{1,3}:\d{1,2}:\d{1,2}[,.]\d{1,3}|\d{1,2}:\d{1,2}[,.]\d{1,3})"
_ARROW = rf"(?m)^[ \t]*{_TIME}[ \t]*-[ \t]*-?[ \t]*-?[ \t]*>[ \t]*{_TIME}[^\n]*$"


def _clean(content: Column) -> Column:
    """Without byte-order marks and zero-width characters; no-break spaces and line ends made plain."""
    c = F.regexp_replace(content, "[\\uFEFF\\u200B-\\u200F\\u2060\\u202A-\\u202E]", "")
    return F.regexp_replace(F.regexp_replace(c, " ", " "), r"\r\n?", "\n")


def parse_srt(files: DataFrame) -> DataFrame:
    """(path, content) -> path, idx, start_sec, end_sec, text, confidence.

    Timing lines are found wherever they are; what stands between two of them is
    the first one's text, without a last line that is the next cue's number.
    Arrows may be broken (->, - ->).  Cues without text are left out and the
    rest numbered from 1."""
    f = files.select("path", _clean(F.col("content")).alias("c"))
    times = lambda g: F.regexp_extract_all("c", F.lit(_ARROW), F.lit(g))
    f = f.select("path", times(1).alias("a"), times(2).alias("b"), F.slice(F.split("c", _ARROW), 2, 1 << 30).alias("t"))
    one = f.select("path", F.posexplode(F.arrays_zip("a", "b", "t")).alias("k", "z"))
    body = F.regexp_replace(F.col("z.t"), r"\n[ \t]*\d+[ \t]*\n*$", "")
    # the last cue of a file may end in a number that is its text
    last = F.row_number().over(_by_path().orderBy(F.desc("k"))) == 1
    text = F.trim(F.regexp_replace(F.when(last, F.col("z.t")).otherwise(body), r"(?m)^[ \t]+|[ \t]+$", ""))
    text = F.regexp_replace(text, r"^\n+|\n+$", "")
    rows = one.select("path", "k", T.parse_time("z.a").alias("start_sec"), T.parse_time("z.b").alias("end_sec"), text.alias("text")).where("text <> ''")
    return rows.select("path", F.row_number().over(_by_path().orderBy("k")).alias("idx"), "start_sec", "end_sec", "text", F.lit(1.0).alias("confidence"))


def _by_path():
    from pyspark.sql import Window as W

    return W.partitionBy("path")


def parse_ass(files: DataFrame) -> DataFrame:
    """(path, content) -> path, idx, start_sec, end_sec, text, style.

    Only [Events] counts; the Format line gives the columns, and the last one
    may hold commas.  Override blocks go, escaped braces stay, \\N is a line end."""
    f = files.select("path", _clean(F.col("content")).alias("c"))
    events = F.regexp_extract("c", r"(?is)\[Events\][^\n]*\n(.*?)(?=\n\[[^\n\]]+\]|\z)", 1)
    fields = F.transform(F.split(F.regexp_extract(events, r"(?im)^Format:\s*([^\n]*)$", 1), ","), lambda x: F.lower(F.trim(x)))
    f = f.select("path", fields.alias("fields"), F.posexplode(F.regexp_extract_all(events, F.lit(r"(?im)^Dialogue:[ \t]*([^\n]*)$"), F.lit(1))).alias("k", "line"))
    f = f.where(F.size("fields") > 1).withColumn("v", F.expr("split(line, ',', size(fields))"))
    value = lambda n: F.get("v", F.array_position("fields", n).cast("int") - 1)
    t = F.regexp_replace(value("text"), r"\\\{", "\u0001")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\\\}", "\u0002"), r"\{[^}]*\}", ""), "\u0001", "{")
    t = F.regexp_replace(F.regexp_replace(t, "\u0002", "}"), r"\\[Nn]", "\n")
    rows = f.select("path", "k", T.parse_time(value("start")).alias("start_sec"), T.parse_time(value("end")).alias("end_sec"), F.trim(F.regexp_replace(t, r"\\h", " ")).alias("text"), value("style").alias("style"))
    return rows.where("text <> '' and start_sec is not null and end_sec is not null").select("path", F.row_number().over(_by_path().orderBy("start_sec", "k")).alias("idx"), "start_sec", "end_sec", "text", "style")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: path, raw bytes."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("raw"))


#: Byte-order marks, longest first.
MARKS = (("FFFE0000", "utf-32-le"), ("0000FEFF", "utf-32-be"), ("EFBBBF", "utf-8"), ("FFFE", "utf-16-le"), ("FEFF", "utf-16-be"))
#: Codecs that are tried when a file isn't UTF-8.
CODECS = ("gb18030", "big5", "shift_jis", "euc_kr", "cp1252", "cp1258")


def plausibility(text: str) -> int:
    """Letters, three for each CJK or kana punctuation, less three for each control character."""
    score = 0
    for c in text:
        if c.isalpha():
            score += 1
        if c in "，。！？、；：「」『』【】《》…“”":
            score += 3
        elif (ord(c) < 32 and c not in "\r\n\t") or 0x7F <= ord(c) < 0xA0 or c == "�":
            score -= 3
    return score


def decode_text(raw: bytes) -> tuple[str, str]:
    """(text, encoding): by mark, then strict UTF-8, then the most plausible codec (of equals the first)."""
    for mark, codec in MARKS:
        if raw.startswith(bytes.fromhex(mark)):
            return raw.decode(codec, "replace").lstrip("﻿"), codec
    try:
        return raw.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        pass
    best = None
    for codec in CODECS:
        text = raw.decode(codec, "replace")
        score = plausibility(text)
        if best is None or score > best[0]:
            best = (score, text, codec)
    return best[1], best[2]


def decode_files(files: DataFrame) -> DataFrame:
    """(path, raw) -> path, content, encoding, in Arrow batches."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            found = [decode_text(bytes(r)) for r in pdf["raw"]]
            yield pd.DataFrame({"path": pdf["path"], "content": [t for t, _ in found], "encoding": [e for _, e in found]})

    return files.mapInPandas(run, "path string, content string, encoding string")


def _ordered(cues: DataFrame, line: Column, between: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("l")))), lambda s: s["l"]), between)


def srt_body(cues: DataFrame, plain: bool = False) -> DataFrame:
    """(video_id, body): numbered cues in order; plain strips markup."""
    from pyspark.sql import Window as W

    n = cues.withColumn("idx", F.row_number().over(W.partitionBy("video_id").orderBy("idx")))
    text = T.strip_markup("text") if plain else F.col("text")
    line = F.concat(F.col("idx").cast("string"), F.lit("\n"), T.srt_time("start_sec"), F.lit(" --> "), T.srt_time("end_sec"), F.lit("\n"), text, F.lit("\n"))
    return n.groupBy("video_id").agg(_ordered(n, line, "\n").alias("body"))


#: The head of a written ASS file.
ASS_HEAD = """[Script Info]
ScriptType: v4.00+
PlayResX: 1920
PlayResY: 1080

[V4+ Styles]
Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding
Style: Default,Arial,48,&H00FFFFFF,&H000000FF,&H00000000,&H64000000,0,0,0,0,100,100,0,0,1,2,0,2,10,10,40,1

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
"""


def ass_body(cues: DataFrame) -> DataFrame:
    """(video_id, body): braces escaped, b, i and u as override tags, other tags dropped."""
    t = F.regexp_replace(F.regexp_replace(F.col("text"), r"\{", r"\\{"), r"\}", r"\\}")
    for tag in "biu":
        t = F.regexp_replace(F.regexp_replace(t, f"(?i)<{tag}>", rf"{{\\{tag}1}}"), f"(?i)</{tag}>", rf"{{\\{tag}0}}")
    t = F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", ""), "\n", r"\\N")
    line = F.concat(F.lit("Dialogue: 0,"), T.ass_time("start_sec"), F.lit(","), T.ass_time("end_sec"), F.lit(",Default,,0,0,0,,"), t)
    return cues.groupBy("video_id").agg(F.concat(F.lit(ASS_HEAD), _ordered(cues, line, "\n"), F.lit("\n")).alias("body"))


def write_bodies(bodies: DataFrame, path: str, mark: bool = True) -> None:
    """One text file per video under path/video_id=..., UTF-8 with a byte-order mark; Spark's committer makes it atomic."""
    head = F.lit("﻿" if mark else "")
    bodies.select("video_id", F.concat(head, F.col("body")).alias("value")).repartition("video_id").write.partitionBy("video_id").option("lineSep", "\n").text(path)


def detect_language_sidecars(videos: DataFrame, files: DataFrame) -> DataFrame:
    """(video_path), (path) -> video_path, path: the subtitle beside each video.

    Same folder; the stem equal or followed by a dot, case ignored.  srt before
    ass before ssa, exact stems first, then by name."""
    from pyspark.sql import Window as W

    folder = lambda c: F.regexp_extract(c, r"^(.*?)[^/]*$", 1)
    stem = lambda c: F.lower(F.regexp_extract(c, r"([^/]+?)(\.[^./]+)?$", 1))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    v = videos.select("video_path", folder("video_path").alias("_d"), stem("video_path").alias("_stem"))
    # every dotted head of a file's stem is a key: "film.en" is found for "film" by equality, without a prefix join
    s = files.where(ext.isin("srt", "ass", "ssa")).select("path", folder("path").alias("_d"), stem("path").alias("_own"), ext.alias("_e"))
    parts = F.split("_own", r"\.")
    s = s.withColumn("_stem", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))))
    rank = W.partitionBy("video_path").orderBy((F.col("_own") != F.col("_stem")).cast("int"), F.expr("array_position(array('srt', 'ass', 'ssa'), _e)"), "path")
    return v.join(s, ["_d", "_stem"]).withColumn("_r", F.row_number().over(rank)).where("_r = 1").select("video_path", "path")
