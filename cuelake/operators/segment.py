"""From frames to cues: folds in which each step sees what the last one changed.

Windows cannot express them, so they run in one pass over sorted rows, which costs
no start per group.  The group isn't the video but a piece of it: videos are cut where nothing happens for longer
than any rule looks (the gap rules reach twice the merge gap, the flash rule four
seconds), so one long video is many tasks.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import LIBRARY, CueParams
from ..functions.similarity import _CJK, builder_similarity, effective_similarity, indel_ratio, path_similarity
from ..schemas import CUE
from .consensus import Votes, mostly_cjk, vote

REPEAT_GAP, STABLE = 0.35, 0.30
#: Cues of one output batch.
CUES_OUT = 5_000
Y_FREE, Y_COST = 50.0, 0.01
_EDGE_SIGNS = re.compile(r"^[\s，。！？、；：“”‘’（）《》【】…—·,.!?;:\"'()\[\]~-]+|[\s，。！？、；：“”‘’（）《》【】…—·,.!?;:\"'()\[\]~-]+$")


@dataclass
class Cue:
    text: str
    start: float
    end: float
    weight: float  # sum of confidences
    frames: int
    members: list[tuple[float, str]] = field(default_factory=list)

    @property
    def conf(self) -> float:
        return self.weight / self.frames if self.frames else 0.0

    @property
    def length(self) -> float:
        return self.end - self.start


@dataclass
class Frame:
    t: float
    text: str
    conf: float
    y: float = 0.0


def plain(text: str) -> str:
    return _EDGE_SIGNS.sub("", text)


def _open(f: Frame) -> Cue:
    return Cue(f.text, f.t, f.t, f.conf, 1, [(f.t, f.text)])


def group_greedy(frames: list[Frame], p: CueParams) -> list[Cue]:
    """Joins each frame to the current group or opens a new one; the group's text is voted anew after each join."""
    out: list[Cue] = []
    votes = Votes()
    for f in frames:
        g = out[-1] if out else None
        gap = f.t - g.end if g else 0.0
        joins = g is not None and gap <= p.merge_gap
        if joins and gap >= REPEAT_GAP and g.length >= STABLE and f.text and f.text == g.text:
            joins = False  # the same words said again
        if joins:
            need = p.similarity
            if gap <= 1.5 * p.step:
                need = max(0.60, need - 0.30) if f.conf < g.conf else max(0.50, need - 0.10)
            joins = effective_similarity(g.text, f.text, g.conf, f.conf, gap) >= need
        if not joins:
            out.append(_open(f))
            votes = Votes((f.text, f.conf))
            continue
        votes.add(f.text, f.conf)
        g.end, g.weight, g.frames = f.t, g.weight + f.conf, g.frames + 1
        g.members.append((f.t, f.text))
        g.text = votes.text()
    return out


def path_labels(frames: list[Frame], p: CueParams, max_gap: float | None = None, least: float | None = None) -> list[int]:
    """Cheapest segmentation by dynamic programming, looking back at most `look_back` frames.

    A segment costs its frames' distance to its most confident text, an opening
    fee, a fee for spread in height and one for cutting between like frames."""
    n = len(frames)
    max_gap = p.merge_gap if max_gap is None else max_gap
    least = max(0.50, p.similarity - 0.15) if least is None else least
    cost, back = [0.0] + [float("inf")] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        for start in range(end - 1, max(-1, end - 2 - p.look_back), -1):
            own = frames[start:end]
            spoken = [i for i, f in enumerate(own) if f.text.strip()]
            a = max(spoken, key=lambda i: own[i].conf) if spoken else len(own) - 1
            error, fits = 0.0, True
            for i, f in enumerate(own):
                s = path_similarity(f.text, own[a].text)
                light = abs(f.t - own[a].t) <= 1.5 * p.step and f.conf < own[a].conf
                if (i and f.t - own[i - 1].t > max_gap) or (s < least and not light):
                    fits = False
                    break
                error += (1 - s) * (0.5 if light else 1.0)
            if not fits:
                break
            ys = [f.y for f in own if f.y > 0]
            spread = max(0.0, max(ys) - min(ys) - Y_FREE) * Y_COST if ys else 0.0
            cut = 0.5 * path_similarity(frames[start - 1].text, own[0].text) if start and frames[start - 1].text and own[0].text else 0.0
            total = cost[start] + error + p.open_cost + spread + cut
            if total < cost[end]:
                cost[end], back[end] = total, start
    marks, end = [], n
    while end:
        marks.append((back[end], end))
        end = back[end]
    return [k for k, (a, b) in enumerate(reversed(marks)) for _ in range(a, b)]


def group_path(frames: list[Frame], p: CueParams) -> list[Cue]:
    out: list[Cue] = []
    for label, f in zip(path_labels(frames, p), frames):
        if label == len(out):
            out.append(_open(f))
        else:
            g = out[-1]
            g.end, g.weight, g.frames = f.t, g.weight + f.conf, g.frames + 1
            g.members.append((f.t, f.text))
    conf = {f.t: f.conf for f in frames}
    for g in out:
        g.text = vote([(t, conf[s]) for s, t in g.members])
    return out


def lines_alike(a: str, b: str, least: float) -> bool:
    """Both of as many lines, which are alike on average."""
    x, y = a.split("\n"), b.split("\n")
    return len(x) == len(y) > 1 and sum(builder_similarity(s, t) for s, t in zip(x, y)) / len(x) >= least


def merge_neighbours(groups: list[Cue], p: CueParams) -> list[Cue]:
    """Groups that the grouping cut in two are one again; the text with more confidence in all stays."""
    out: list[Cue] = []
    for g in groups:
        last = out[-1] if out else None
        if last is not None and (gap := g.start - last.end) <= p.merge_gap:
            a, b = plain(last.text), plain(g.text)
            repeated = a == b and gap >= REPEAT_GAP and min(last.length, g.length) >= STABLE
            if not repeated and (effective_similarity(a, b, last.conf, g.conf, gap) >= p.similarity or (p.line_similarity > 0 and lines_alike(a, b, p.line_similarity))):
                if g.weight > last.weight:
                    last.text = g.text
                last.end, last.weight, last.frames = g.end, last.weight + g.weight, last.frames + g.frames
                last.members += g.members
                continue
        out.append(g)
    return out


def _echo(cue: Cue, near: Cue | None, gap: float, reach: float, conf: float, ratio: float) -> bool:
    return near is not None and 0 <= gap <= reach and near.conf >= conf and bool(plain(near.text)) and indel_ratio(plain(near.text), plain(cue.text)) >= ratio


def absorb_echoes(groups: list[Cue], p: CueParams, rounds: int = 3) -> list[Cue]:
    """Weak remains of a fading cue go into the strong one beside them; the one before is prolonged."""
    for _ in range(rounds):
        out: list[Cue] = []
        for i, g in enumerate(groups):
            if g.frames <= 3 and g.conf < 0.65 and plain(g.text):
                last, nxt = out[-1] if out else None, groups[i + 1] if i + 1 < len(groups) else None
                if _echo(g, last, g.start - last.end if last else 0, 1.5 * p.merge_gap, 0.80, 0.20):
                    last.end = max(last.end, g.end)
                    continue
                if _echo(g, nxt, nxt.start - g.end if nxt else 0, 1.5 * p.merge_gap, 0.80, 0.20):
                    continue
            out.append(g)
        if len(out) == len(groups):
            break
        groups = out
    return groups


def runs_of(members: list[tuple[float, str]]) -> list[list]:
    """[key, text, start, end, count] of equal neighbouring texts, white space apart."""
    out: list[list] = []
    for t, text in members:
        key = "".join(text.split())
        if out and out[-1][0] == key:
            out[-1][3], out[-1][4] = t, out[-1][4] + 1
        else:
            out.append([key, text, t, t, 1])
    return out


def absorb_noise_runs(runs: list[list], noise: int = 2) -> list[list]:
    """Runs of up to `noise` frames belong to what stands before them; equal neighbours join."""
    out: list[list] = []
    for r in runs:
        if out and (r[4] <= noise or r[0] == out[-1][0]):
            out[-1][3], out[-1][4] = r[3], out[-1][4] + r[4]
        else:
            out.append(list(r))
    return out


def two_utterances(a: str, b: str) -> bool:
    """Whether two steady texts are two cues: one continues the other by CJK characters, or they have little in common."""
    a, b = sorted(("".join(a.split()), "".join(b.split())), key=len)
    if not a or a == b:
        return False
    if b.startswith(a):
        rest, least = b[len(a) :], 1
    elif b.endswith(a):
        rest, least = b[: len(b) - len(a)], 2
    else:
        return indel_ratio(a, b) < 0.5
    return len(rest) >= least and all(_CJK.match(c) for c in rest)


def split_variants(groups: list[Cue], least_frames: int = 6) -> list[Cue]:
    """Groups that hold several steady texts are cut between those that are different utterances."""
    out: list[Cue] = []
    for g in groups:
        steady = [r for r in absorb_noise_runs(runs_of(g.members)) if r[4] >= least_frames and r[3] - r[2] >= STABLE and len(r[0]) >= 2]
        if len(g.members) < 2 * least_frames or len({r[0] for r in steady}) != len(steady):
            out.append(g)
            continue
        parts: list[list[list]] = []
        for r in steady:
            if parts and not two_utterances(parts[-1][-1][1], r[1]):
                parts[-1].append(r)
            else:
                parts.append([r])
        if len(parts) < 2:
            out.append(g)
            continue
        for part in parts:
            a, b, n = part[0][2], part[-1][3], sum(r[4] for r in part)
            out.append(Cue(max(part, key=lambda r: r[4])[1], a, b, g.conf * n, n, [m for m in g.members if a <= m[0] <= b]))
    return out


def extend_into_dropped(groups: list[Cue], dropped: list[float], p: CueParams) -> list[Cue]:
    """Groups grow to frames that a filter dropped half to one and a half steps beyond them, never into a neighbour."""
    dropped = sorted(dropped)
    for i, g in enumerate(groups):
        lo = groups[i - 1].end if i else float("-inf")
        hi = groups[i + 1].start if i + 1 < len(groups) else float("inf")
        near = lambda a, b: dropped[bisect_left(dropped, a) : bisect_right(dropped, b)]
        before = [t for t in near(g.start - 2 * p.step, g.start) if 0.5 * p.step <= g.start - t <= 1.5 * p.step and t > lo]
        after = [t for t in near(g.end, g.end + 2 * p.step) if 0.5 * p.step <= t - g.end <= 1.5 * p.step and t < hi]
        g.start, g.end = min([g.start, *before]), max([g.end, *after])
    return groups


def to_cues(groups: list[Cue], p: CueParams) -> list[Cue]:
    """Padded ends; starts after the last cue's end, ends before the next group's start, one millisecond at least."""
    out: list[Cue] = []
    for i, g in enumerate(groups):
        start, end = max(0.0, g.start), g.end + p.padding
        if out and start <= out[-1].end:
            start = out[-1].end + 0.001
        if i + 1 < len(groups) and end >= groups[i + 1].start:
            end = groups[i + 1].start - 0.001
        out.append(Cue(g.text, start, max(end, start + 0.001), g.weight, g.frames, g.members))
    return out


def _effective_length(text: str) -> int:
    seen = "".join(text.split())
    return len(seen) + len(_CJK.findall(seen))


def absorb_flickers(cues: list[Cue], p: CueParams) -> list[Cue]:
    """Cues shorter than the least duration: junk goes, readings of a neighbour join the better one, weak ones go, the rest is prolonged."""
    if p.least_duration <= 0:
        return cues
    cues, out = list(cues), []
    for i, c in enumerate(cues):
        if not re.search(r"[^\W_]", c.text):
            continue
        if c.length >= p.least_duration:
            out.append(c)
            continue
        size = _effective_length(c.text)
        readable = c.length < 0.1 or size / c.length <= 35.0
        guarded = c.conf >= 0.70 and readable
        if c.length <= 0.085 and size <= 3 and not guarded:
            continue
        last, nxt = out[-1] if out else None, cues[i + 1] if i + 1 < len(cues) else None
        before = _flicker_score(c, last, c.start - last.end if last else 0, p)
        after = _flicker_score(c, nxt, nxt.start - c.end if nxt else 0, p)
        if before is not None and (after is None or before >= after):
            out[-1] = Cue(last.text, last.start, max(last.end, c.end), last.weight + c.weight, last.frames + c.frames, last.members)
        elif after is not None:
            cues[i + 1] = Cue(nxt.text, min(nxt.start, c.start), nxt.end, nxt.weight + c.weight, nxt.frames + c.frames, nxt.members)
        elif c.length >= p.least_duration / 5 or guarded:
            end = c.start + p.least_duration
            if nxt is not None:
                end = min(end, nxt.start - 0.001)
            end = max(end, c.end)
            out.append(Cue(c.text, c.start, end if end > c.start else c.start + 0.05, c.weight, c.frames, c.members))
    return out


def _flicker_score(c: Cue, near: Cue | None, gap: float, p: CueParams) -> float | None:
    if near is None or gap > p.merge_gap:
        return None
    score = builder_similarity(c.text, near.text)
    if score == 0 and c.length <= 0.10 and (raw := indel_ratio(c.text, near.text)) > 0.80:
        score = raw
    need = min(p.flicker_similarity, 0.55) if 0 < len(_CJK.findall(c.text)) <= 6 else p.flicker_similarity
    return score if score >= need else None


def one_character_more(a: str, b: str) -> bool:
    """Mostly CJK texts of which one is the other and one CJK character more."""
    short, long = sorted((a, b), key=len)
    if len(long) - len(short) != 1 or len(short) < 2 or not (mostly_cjk(a) and mostly_cjk(b)):
        return False
    return any(long[:i] + long[i + 1 :] == short and re.match("[㐀-鿿]", long[i]) for i in range(len(long)))


def _merged(a: Cue, b: Cue, text: str) -> Cue:
    return Cue(text, a.start, max(a.end, b.end), a.weight + b.weight, a.frames + b.frames, a.members + b.members)


def _pick(a: Cue, b: Cue) -> str:
    if min(a.frames, b.frames) <= 4 and one_character_more(a.text, b.text):
        return a.text if len(a.text) >= len(b.text) else b.text
    return a.text if a.weight >= b.weight else b.text


def merge_repeats(cues: list[Cue], p: CueParams) -> list[Cue]:
    """Duplicates that are left: compared with the last cue, and over a blink with the one before it."""
    out: list[Cue] = []
    for c in cues:
        last = out[-1] if out else None
        if last is not None:
            a, b, gap = plain(last.text), plain(c.text), c.start - last.end
            blinks = last.frames <= 8 and c.frames <= 8
            if gap <= p.merge_gap * (2 if a == b and blinks else 1):
                if a == b and gap >= REPEAT_GAP and last.frames > 8 and c.frames > 8:
                    out.append(c)
                    continue
                more = one_character_more(a, b)
                distinct = more and min(last.frames, c.frames) >= 5 and max(len(a), len(b)) <= 4
                if effective_similarity(a, b, last.conf, c.conf, gap) >= p.similarity and not distinct:
                    out[-1] = _merged(last, c, _pick(last, c))
                    continue
                if more and min(last.frames, c.frames) <= 4:
                    out[-1] = _merged(last, c, max(last.text, c.text, key=len))
                    continue
            if len(out) >= 2 and last.length <= 0.25 and (gap2 := c.start - out[-2].end) <= 1.5 * p.merge_gap:
                if effective_similarity(plain(out[-2].text), b, out[-2].conf, c.conf, gap2) >= p.similarity:
                    out.pop()
                    out[-1] = _merged(out[-1], c, _pick(out[-1], c))
                    continue
        out.append(c)
    return out


def drop_echoes(cues: list[Cue], p: CueParams) -> list[Cue]:
    """Short weak cues, and lone frames, that resemble a strong neighbour."""
    out: list[Cue] = []
    for i, c in enumerate(cues):
        weak = c.length < 0.20 and c.conf < 0.65
        lone = c.frames == 1 and c.length < 0.12 and 0.65 <= c.conf < 0.90
        if (weak or lone) and plain(c.text):
            conf, ratio = (0.80, 0.20) if weak else (0.90, 0.65)
            last, nxt = out[-1] if out else None, cues[i + 1] if i + 1 < len(cues) else None
            if _echo(c, last, c.start - last.end if last else 0, 1.5 * p.merge_gap, conf, ratio) or _echo(c, nxt, nxt.start - c.end if nxt else 0, 1.5 * p.merge_gap, conf, ratio):
                continue
        out.append(c)
    return out


def build(frames: list[Frame], p: CueParams) -> list[Cue]:
    """All steps in turn on one piece of a video, frames in time order."""
    kept = [f for f in frames if f.text.strip() and f.conf >= 0.75 * p.least_confidence]
    groups = group_path(kept, p) if p.path else group_greedy(kept, p)
    groups = split_variants(absorb_echoes(merge_neighbours(groups, p), p))
    seen = {f.t for f in kept}
    groups = extend_into_dropped(groups, [f.t for f in frames if f.t not in seen and f.text.strip()], p)
    return drop_echoes(merge_repeats(absorb_flickers(to_cues(groups, p), p), p), p)


def _cues_of_pieces(params: CueParams):
    def pieces(batches):
        """(video_id, frames) of each piece, from rows sorted by piece; a piece may go on over several batches."""
        open_key, own = None, []
        for batch in batches:
            video, piece, *columns = (c.to_pylist() for c in batch.columns)
            rows = list(map(Frame, *columns))
            first = 0
            for i, key in enumerate(zip(video, piece)):
                if key != open_key:
                    own += rows[first:i]
                    if own:
                        yield open_key[0], own
                    open_key, own, first = key, [], i
            own += rows[first:]
        if own:
            yield open_key[0], own

    def run(batches):
        out: list[tuple] = []
        for video, own in pieces(batches):
            out += [(video, i, c.text, c.start, c.end, min(1.0, max(0.0, c.conf)), c.frames) for i, c in enumerate(build(own, params), 1)]
            if len(out) >= CUES_OUT:
                yield _cue_batch(out)
                out = []
        if out:
            yield _cue_batch(out)

    return run


def _cue_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["video_id", "idx", "text", "start_sec", "end_sec", "confidence", "frame_count"])


FRAME = "video_id string, timestamp_sec double, text string, confidence double, y double"


def build_cues(frames: DataFrame, params: CueParams = LIBRARY) -> DataFrame:
    """(video_id, timestamp_sec, text, confidence, y) -> cues, numbered per video.

    Frames of equal time are taken by text.  A video without text gives no row;
    a null text, confidence or height counts as empty, 0 and unknown."""
    w = W.partitionBy("video_id").orderBy("timestamp_sec", "text")
    quiet = max(2 * params.merge_gap, 4.0) + params.least_duration + params.padding
    prev = F.lag("timestamp_sec").over(w)
    f = frames.select("video_id", F.col("timestamp_sec").cast("double").alias("timestamp_sec"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"), F.coalesce(F.col("y").cast("double"), F.lit(0.0)).alias("y"))
    f = f.where("video_id is not null and timestamp_sec is not null")
    opens = f.withColumn("_new", F.when(prev.isNull() | (F.col("timestamp_sec") - prev > quiet), 1).otherwise(0))
    pieces = opens.withColumn("piece", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")

    spark = frames.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = pieces.select("video_id", "piece", "timestamp_sec", "text", "confidence", "y")
    dealt = own.repartition(tasks, "video_id", "piece").sortWithinPartitions("video_id", "piece", "timestamp_sec", "text", F.desc("confidence"), "y")
    cues = dealt.mapInArrow(_cues_of_pieces(params), CUE)
    return cues.withColumn("idx", F.row_number().over(W.partitionBy("video_id").orderBy("start_sec", "end_sec", "text")))


def fold_cues(cues: DataFrame, step, params: CueParams = LIBRARY) -> DataFrame:
    """One of the cue steps above (a list of Cue and the parameters in, a list out) per video, and new numbers."""

    def fold(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_sec", "end_sec", "idx"], kind="stable")
        own = [Cue(t, s, e, c * n, n) for t, s, e, c, n in pdf[["text", "start_sec", "end_sec", "confidence", "frame_count"]].itertuples(index=False)]
        out = step(own, params)
        return pd.DataFrame({"video_id": [key[0]] * len(out), "idx": range(1, len(out) + 1), "text": [c.text for c in out], "start_sec": [c.start for c in out], "end_sec": [c.end for c in out], "confidence": [c.conf for c in out], "frame_count": [c.frames for c in out]})

    return cues.select("video_id", "idx", "text", "start_sec", "end_sec", "confidence", "frame_count").groupBy("video_id").applyInPandas(fold, CUE)


def overlap_of_shorter(a: Cue, b: Cue) -> float:
    both, short = min(a.end, b.end) - max(a.start, b.start), min(a.length, b.length)
    return both / short if both > 0 and short > 0 else 0.0


def drop_overlapping(cues: list[Cue], p: CueParams | None = None, overlap: float = 0.80, similar: float = 0.80) -> list[Cue]:
    """Of cues of several regions that say the same at the same time, the more confident."""
    kept: list[Cue] = []
    for c in sorted(cues, key=lambda c: (c.start, c.end)):
        for k, other in enumerate(kept):
            if other.end >= c.start and overlap_of_shorter(other, c) >= overlap and indel_ratio(other.text.strip(), c.text.strip()) >= similar:
                if c.conf > other.conf:
                    kept[k] = c
                break
        else:
            kept.append(c)
    return sorted(kept, key=lambda c: (c.start, c.end))


def similar_runs(cues: list[Cue], max_gap: float = 0.5, least: float = 0.8) -> list[list[int]]:
    """Chains of two and more cues, each close to the one before and like the chain's first; lengths differ by half at most."""
    out, chain = [], [0] if cues else []
    for i in range(1, len(cues)):
        a, b = cues[chain[0]].text, cues[i].text
        longer = max(len(a), len(b))
        if cues[i].start - cues[i - 1].end <= max_gap and longer and abs(len(a) - len(b)) <= 0.5 * longer and builder_similarity(a, b) >= least:
            chain.append(i)
        else:
            out.append(chain)
            chain = [i]
    return [c for c in [*out, chain] if len(c) > 1]


def merge_similar(cues: list[Cue], p: CueParams | None = None, max_gap: float = 0.5, least: float = 0.8) -> list[Cue]:
    """Each chain of similar_runs as one cue: its longest text, up to its latest end."""
    gone, out = set(), list(cues)
    for chain in similar_runs(cues, max_gap, least):
        own = [cues[i] for i in chain]
        out[chain[0]] = Cue(max((c.text for c in own), key=len), own[0].start, max(c.end for c in own), sum(c.weight for c in own), sum(c.frames for c in own))
        gone.update(chain[1:])
    return [c for i, c in enumerate(out) if i not in gone]


def fix_timeline(cues: list[Cue], p: CueParams | None = None, least_gap: float = 0.150) -> list[Cue]:
    """Overlaps and gaps under `least_gap` are closed at their middle, one after the other."""
    out = sorted((Cue(c.text, c.start, c.end, c.weight, c.frames, c.members) for c in cues), key=lambda c: (c.start, c.end))
    for a, b in zip(out, out[1:]):
        if b.start - a.end < least_gap:
            mid = (a.end + b.start) / 2
            if a.start < mid - 0.001 and mid + 0.001 < b.end:
                a.end, b.start = mid - 0.001, mid + 0.001
    return out
