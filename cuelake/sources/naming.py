"""Files beside files: natural order, stems, languages and content hashes."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

VIDEO_SUFFIXES = ("mp4", "mkv", "avi", "mov", "webm", "ts", "m4v", "flv", "wmv")
#: Language tags that end a subtitle's stem.
LANGUAGE_TAGS = "en eng vi vie zh chi zho ja jpn ko kor fr fra de deu ger es spa ru rus pt por it ita th tha id ind zh-cn zh-tw zh-hans zh-hant pt-br".split()
#: ISO 639 codes to recogniser languages.
RECOGNISER = {"zh": "ch", "zho": "ch", "chi": "ch", "zh-cn": "ch", "zh-tw": "chinese_cht", "zh-hant": "chinese_cht", "ja": "japan", "jpn": "japan", "ko": "korean", "kor": "korean", "en": "en", "eng": "en", "vi": "vi", "vie": "vi", "fr": "french", "fra": "french", "fre": "french", "de": "german", "deu": "german", "ger": "german", "es": "es", "spa": "es", "ru": "ru", "rus": "ru", "pt": "pt", "por": "pt", "it": "it", "ita": "it", "th": "th", "tha": "th"}


def folder_order(files: DataFrame, path: str = "path", suffixes: tuple[str, ...] = VIDEO_SUFFIXES) -> DataFrame:
    """Video files with their place in natural order within their folder."""
    f = files.where(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*suffixes)).withColumn("folder", F.regexp_extract(path, r"^(.*?)/?[^/]*$", 1))
    return f.withColumn("rank", F.row_number().over(W.partitionBy("folder").orderBy(T.natural_key(F.regexp_extract(path, r"([^/]+)$", 1)), path)))


def candidate_stems(path) -> Column:
    """A subtitle's stem, and it again without each language tag at its end."""
    stem = F.lower(F.regexp_extract(T.col(path), r"([^/]+?)(\.[^./]+)?$", 1))
    tags = "|".join(t.replace("-", "[-_]") for t in LANGUAGE_TAGS)
    one = F.regexp_replace(stem, rf"[._ -]({tags})$", "")
    return F.array_distinct(F.array(stem, one, F.regexp_replace(one, rf"[._ -]({tags})$", "")))


def sibling_videos(subtitles: DataFrame, videos: DataFrame) -> DataFrame:
    """(path), (video_path) -> path, video_path: the video in the same folder whose stem a subtitle's is, with the fewest tags taken off."""
    folder = lambda c: F.regexp_extract(c, r"^(.*?)[^/]*$", 1)
    s = subtitles.select("path", folder("path").alias("_d"), F.posexplode(candidate_stems("path")).alias("_k", "_stem"))
    v = videos.select("video_path", folder("video_path").alias("_d"), F.lower(F.regexp_extract("video_path", r"([^/]+?)(\.[^./]+)?$", 1)).alias("_stem"))
    w = W.partitionBy("path").orderBy("_k", "video_path")
    return s.join(v, ["_d", "_stem"]).withColumn("_r", F.row_number().over(w)).where("_r = 1").select("path", "video_path")


def recogniser_language(code) -> Column:
    table = F.create_map(*(x for k, v in RECOGNISER.items() for x in (F.lit(k), F.lit(v))))
    c = F.lower(F.replace(T.col(code), F.lit("_"), F.lit("-")))
    return F.coalesce(F.element_at(table, c), F.element_at(table, F.split_part(c, F.lit("-"), F.lit(1))), F.lit("ch"))


def language_conflict(label, text_ratio) -> Column:
    """Whether a CJK label meets text without CJK, or the other way round; the label itself is never changed."""
    cjk = F.lower(F.substring(T.col(label), 1, 2)).isin("zh", "ja", "ko")
    return (cjk & (T.col(text_ratio) < 0.10)) | (~cjk & (T.col(text_ratio) > 0.50))


SAMPLE = 1 << 20


def content_hash(raw: bytes, sample: int = SAMPLE) -> str:
    """First 16 hex digits of SHA-256 over the size and three samples: head, middle, tail; small files are read whole."""
    h = hashlib.sha256(str(len(raw)).encode())
    if len(raw) <= 3 * sample:
        h.update(raw)
    else:
        for at in (0, len(raw) // 2 - sample // 2, len(raw) - sample):
            h.update(raw[at : at + sample])
    return h.hexdigest()[:16]


def hash_files(files: DataFrame) -> DataFrame:
    """(path, raw) -> path, video_hash."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "video_hash": [content_hash(bytes(r)) for r in pdf["raw"]]})

    return files.mapInPandas(run, "path string, video_hash string")
