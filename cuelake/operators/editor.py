"""Edits of a cue table as functions from table to table.  Undo keeps the table before: tables never change."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .windows import reindex


def renumber(cues: DataFrame) -> DataFrame:
    return reindex(cues, ["video_id"], ["start_sec", "end_sec", "uid"])


def update_texts(cues: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: video_id, uid, new_text."""
    return cues.join(edits.select("video_id", "uid", "new_text"), ["video_id", "uid"], "left").withColumn("text", F.coalesce("new_text", "text")).select(cues.columns)


def retime(cues: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: video_id, uid, new_start, new_end; an end at or before its start is refused."""
    e = edits.where("new_start >= 0 and new_end > new_start").select("video_id", "uid", "new_start", "new_end")
    out = cues.join(e, ["video_id", "uid"], "left").withColumns({"start_sec": F.coalesce("new_start", "start_sec"), "end_sec": F.coalesce("new_end", "end_sec")})
    return renumber(out.select(cues.columns))


def insert_after(cues: DataFrame, video_id: str, uid: str, text: str, seconds: float = 2.0, gap: float = 0.05, least: float = 0.15) -> DataFrame:
    """A cue after the named one: `seconds` long, `gap` clear of both neighbours, `least` long whatever they leave."""
    nxt = F.lead("start_sec").over(W.partitionBy("video_id").orderBy("start_sec", "end_sec", "uid"))
    at = cues.withColumn("_next", nxt).where((F.col("video_id") == video_id) & (F.col("uid") == uid))
    start = F.col("end_sec") + gap
    end = F.greatest(start + least, F.least(start + seconds, F.coalesce(F.col("_next") - gap, start + seconds)))
    new = at.withColumns({"_s": start, "_e": end}).withColumns({"start_sec": F.col("_s"), "end_sec": F.col("_e"), "text": F.lit(text), "confidence": F.lit(1.0), "frame_count": F.lit(1), "uid": F.sha2(F.concat_ws("|", "video_id", F.lit(uid), F.lit(text)), 256)})
    return renumber(cues.unionByName(new.select(cues.columns)))


def delete(cues: DataFrame, gone: DataFrame) -> DataFrame:
    return renumber(cues.join(gone.select("video_id", "uid"), ["video_id", "uid"], "left_anti").select(cues.columns))


def split_point(text: str) -> int:
    """Where to cut a text: after a punctuation or at a space nearest its middle within a third, else at the middle; never inside a tag
    or before a combining mark."""
    import unicodedata

    mid, reach = len(text) // 2, max(1, len(text) // 3)
    inside = [False] * (len(text) + 1)
    for m in re.finditer(r"<[^>]*>|\{[^}]*\}", text):
        for i in range(m.start() + 1, m.end()):
            inside[i] = True
    ok = lambda i: 0 < i < len(text) and not inside[i] and not unicodedata.combining(text[i])
    for good in (lambda i: text[i - 1] in "。！？.!?，,；;、\n", lambda i: text[i - 1].isspace()):
        for d in range(reach + 1):
            for i in (mid + d, mid - d):
                if ok(i) and good(i):
                    return i
    return next((i for d in range(len(text)) for i in (mid + d, mid - d) if ok(i)), mid)


def split_cues(cues: DataFrame, which: DataFrame) -> DataFrame:
    """The named cues as two each; the time is shared by the length of their texts."""
    hit = cues.join(which.select("video_id", "uid"), ["video_id", "uid"], "left_semi")

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                i = split_point(r["text"])
                a, b = r["text"][:i].strip(), r["text"][i:].strip()
                if not a or not b:
                    rows.append(r)
                    continue
                at = r["start_sec"] + (r["end_sec"] - r["start_sec"]) * len(a) / (len(a) + len(b))
                rows += [r | {"text": a, "end_sec": at}, r | {"text": b, "start_sec": at, "uid": f"{r['uid']}+"}]
            yield pd.DataFrame(rows, columns=pdf.columns)

    kept = cues.join(which.select("video_id", "uid"), ["video_id", "uid"], "left_anti").select(cues.columns)
    return renumber(kept.unionByName(hit.select(cues.columns).mapInPandas(run, cues.schema)))


def merge_cues(cues: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: video_id, first_uid, second_uid; one cue with both texts, both times and the plain mean of the confidences."""
    a, b = cues.alias("a"), cues.alias("b")
    j = pairs.join(a, (F.col("a.video_id") == pairs["video_id"]) & (F.col("a.uid") == F.col("first_uid"))).join(b, (F.col("b.video_id") == pairs["video_id"]) & (F.col("b.uid") == F.col("second_uid")))
    new = {
        "text": T.join_text("a.text", "b.text"), "start_sec": F.least("a.start_sec", "b.start_sec"), "end_sec": F.greatest("a.end_sec", "b.end_sec"), "confidence": (F.col("a.confidence") + F.col("b.confidence")) / 2, "frame_count": F.col("a.frame_count") + F.col("b.frame_count"),
    }
    merged = j.select(*(new.get(c, F.col(f"a.{c}")).alias(c) for c in cues.columns))
    gone = pairs.select("video_id", F.explode(F.array("first_uid", "second_uid")).alias("uid"))
    return renumber(cues.join(gone, ["video_id", "uid"], "left_anti").select(cues.columns).unionByName(merged))


def shift(cues: DataFrame, seconds: float) -> DataFrame:
    """All cues later (or earlier); an error when the rows are read if one would start before 0."""
    start = F.col("start_sec") + seconds
    checked = F.when(start < 0, F.raise_error(F.lit("a cue would start before 0"))).otherwise(start)
    return cues.withColumns({"end_sec": F.col("end_sec") + seconds, "start_sec": checked})


def replace_text(cues: DataFrame, find: str, by: str) -> DataFrame:
    """Literal, letter case ignored, outside of <...> and {...}."""

    def run(texts: pd.Series) -> pd.Series:
        want = re.compile(re.escape(find), re.I)
        cut = lambda t: "".join(p if i % 2 else want.sub(lambda _: by, p) for i, p in enumerate(re.split(r"(<[^>]*>|\{[^}]*\})", t)))
        return texts.map(lambda t: None if t is None else cut(t))

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return cues.withColumn("text", F.pandas_udf(run, "string")("text"))


class History:
    """Undo and redo of table edits."""

    def __init__(self, cues: DataFrame, most: int = 50):
        self.past, self.now, self.future, self.most = [], cues, [], most

    def do(self, edit, *args, **kw) -> DataFrame:
        self.past = [*self.past, self.now][-self.most :]
        self.now, self.future = edit(self.now, *args, **kw), []
        return self.now

    def undo(self) -> DataFrame:
        if self.past:
            self.future.append(self.now)
            self.now = self.past.pop()
        return self.now

    def redo(self) -> DataFrame:
        if self.future:
            self.past.append(self.now)
            self.now = self.future.pop()
        return self.now
