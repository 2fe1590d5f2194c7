"""Speech timing: windows, speeds, a dub timeline and sentence splitting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

#: Syllables spoken a second, characters of a syllable, and bounds of speed.
SYLLABLES_A_SECOND, CHARS_A_SYLLABLE = 4.5, 4.2
SLOWEST, FASTEST = 0.85, 1.6


def expected_seconds(text) -> Column:
    return T.syllables(text) / SYLLABLES_A_SECOND


def floor_seconds(text, fastest: float = FASTEST) -> Column:
    """The shortest time in which the text can be said."""
    return expected_seconds(text) / fastest


def speed_ratio(spoken, window) -> Column:
    """Speed that fits `spoken` seconds into the window, within bounds."""
    return F.greatest(F.lit(SLOWEST), F.least(F.lit(FASTEST), T.col(spoken) / F.greatest(T.col(window), F.lit(1e-6))))


def length_hint(window) -> Column:
    """Characters that a translation should have at most."""
    return F.greatest(F.lit(6), F.floor(F.floor(T.col(window) * SYLLABLES_A_SECOND) * CHARS_A_SYLLABLE)).cast("int")


def abnormal_length(spoken, text, low: float = 0.4, high: float = 2.5) -> Column:
    ratio = T.col(spoken) / F.nullif(expected_seconds(text), F.lit(0.0))
    return F.coalesce((ratio < low) | (ratio > high), F.lit(False))


def lead_in(gap_before, most: float = 0.25) -> Column:
    """How much earlier a line may begin: half of the silence before it."""
    return F.greatest(F.lit(0.0), F.least(F.lit(most), T.col(gap_before) / 2))


def capped(value, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), T.col(value)))


def schedule(lines: DataFrame, gap: float = 0.7, longest: float = 10.0, pause: float = 0.08, smooth: float = 0.5, jump: float = 0.25) -> DataFrame:
    """(video_id, idx, start_sec, end_sec, spoken_sec) -> out_start, out_end, speed, drift.

    Lines are cut into segments at silences of `gap` and, while a segment is over
    `longest`, at its widest gap.  Within one, lines follow each other: the speed
    is what fits the rest of the segment, smoothed and with limited jumps; what
    doesn't fit drifts into the next line."""
    w = W.partitionBy("video_id").orderBy("start_sec", "idx")
    opens = lines.withColumn("_new", F.when(F.coalesce(F.col("start_sec") - F.lag("end_sec").over(w) >= gap, F.lit(True)), 1).otherwise(0))
    parts = opens.withColumn("_seg", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")
    schema = f"{lines.schema.toDDL()}, out_start double, out_end double, speed double, drift double"

    def segments(rows: list[dict]) -> list[list[dict]]:
        if len(rows) < 2 or rows[-1]["end_sec"] - rows[0]["start_sec"] <= longest:
            return [rows]
        k = max(range(1, len(rows)), key=lambda i: (rows[i]["start_sec"] - rows[i - 1]["end_sec"], -abs(i - len(rows) / 2)))
        return segments(rows[:k]) + segments(rows[k:])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, now, mean = pdf.sort_values(["start_sec", "idx"]).drop(columns="_seg").to_dict("records"), float("-inf"), 1.0
        for seg in segments(rows):
            limit = seg[-1]["end_sec"]
            for i, r in enumerate(seg):
                begin = max(r["start_sec"], now)
                left = sum(x["spoken_sec"] for x in seg[i:])
                room = max(limit - begin - pause * (len(seg) - i - 1), 1e-6)
                want = min(FASTEST, max(SLOWEST, left / room, r["spoken_sec"] / max(r["end_sec"] - begin, 1e-6) if r["end_sec"] > begin else 0))
                speed = min(mean + jump, max(mean - jump, smooth * mean + (1 - smooth) * want))
                speed = min(FASTEST, max(SLOWEST, speed))
                r |= {"out_start": begin, "out_end": begin + r["spoken_sec"] / speed, "speed": speed, "drift": begin - r["start_sec"]}
                now, mean = r["out_end"] + pause, speed
        return pd.DataFrame(rows)

    return parts.groupBy("video_id", "_seg").applyInPandas(fold, schema)


_ENDS = ("。", "！", "？", ".", "!", "?", "…")


def split_words(words: list[tuple[str, float, float]], target: int = 24, most: int = 42, seconds: float = 4.0, pause: float = 0.3) -> list[tuple[str, float, float]]:
    """Sentences of (word, start, end): cut after a sentence end, at a pause once half the target is said, softly at the target, hard
    at `most` characters or `seconds`, where the widest pause or a comma makes the best cut."""
    out, held = [], []

    def emit(n: int):
        own = held[:n]
        del held[:n]
        text = ""
        for word, _, _ in own:
            text += ("" if not text or (T_CJK(text[-1]) and T_CJK(word[:1])) or word[:1] in ",.!?;:，。！？" else " ") + word
        if text.strip():
            out.append((text.strip(), own[0][1], own[-1][2]))

    def size() -> int:
        return sum(len(w) for w, _, _ in held) + max(0, len(held) - 1)

    for k, item in enumerate(words):
        held.append(item)
        nxt = words[k + 1] if k + 1 < len(words) else None
        quiet = nxt[1] - item[2] if nxt else 0
        if item[0].endswith(_ENDS):
            emit(len(held))
        elif nxt and quiet >= pause and size() >= max(2, target / 2):
            emit(len(held))
        elif size() >= target and (quiet >= pause / 2 or item[0].endswith((",", "，", ";", "；", "、"))):
            emit(len(held))
        elif size() >= most or item[2] - held[0][1] >= seconds:
            cuts = range(1, len(held))
            best = max(cuts, key=lambda c: (held[c][1] - held[c - 1][2] + (0.5 if held[c - 1][0].endswith((",", "，")) else 0) - 0.05 * abs(c - len(held) / 2), c), default=len(held))
            emit(best)
    emit(len(held))
    return out


def T_CJK(c: str) -> bool:
    from ..functions.similarity import has_cjk

    return has_cjk(c)


def repair_times(words: DataFrame, by: list[str], order: str) -> DataFrame:
    """Missing word times from their neighbours: a start from the last end, an end from the next start; never backwards."""
    w = W.partitionBy(*by).orderBy(order)
    last = F.last("end", True).over(w.rowsBetween(W.unboundedPreceding, -1))
    first = F.first("start", True).over(w.rowsBetween(1, W.unboundedFollowing))
    start = F.coalesce("start", last, F.lit(0.0))
    return words.withColumns({"start": start, "end": F.greatest(start, F.coalesce("end", first, start + 0.1))})


def sentences(words: DataFrame, by: list[str], order: str = "pos", **how) -> DataFrame:
    """(by, pos, word, start, end) -> by, idx, text, start_sec, end_sec."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.select(*by).schema)

    def fold(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        own = split_words(list(pdf[["word", "start", "end"]].itertuples(index=False, name=None)), **how)
        return pd.DataFrame({**{c: [k] * len(own) for c, k in zip(by, key)}, "idx": range(1, len(own) + 1), "text": [s[0] for s in own], "start_sec": [s[1] for s in own], "end_sec": [s[2] for s in own]})

    return repair_times(words, by, order).groupBy(*by).applyInPandas(fold, f"{schema}, idx int, text string, start_sec double, end_sec double")
