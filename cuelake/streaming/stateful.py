"""Streams of frames and outcomes.

Each operator keeps a few values per key, so state stays small however long a
stream runs; the same step functions serve the batch forms.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def session_windows(frames: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Sessions by gap alone; late rows within `late` are counted."""
    return frames.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last")).select(key, F.col("session_window.start").alias("start"), "last", "n")


def step_windows(frames: DataFrame, key: str, ts: str, step: str, late: str, value: str) -> DataFrame:
    """The first frame of each step."""
    return frames.withWatermark(ts, late).groupBy(key, F.window(ts, step)).agg(F.min_by(value, ts).alias(value), F.min(ts).alias(ts))


def rate_windows(events: DataFrame, key: str, ts: str, span: str, slide: str, late: str, amount: str) -> DataFrame:
    """Requests and amounts in sliding windows."""
    return events.withWatermark(ts, late).groupBy(key, F.window(ts, span, slide)).agg(F.count(F.lit(1)).alias("requests"), F.sum(amount).alias("amount"))


def keep_changed(state: tuple | None, rows: list[tuple], most_bits: int = 5, most_difference: float = 0.01) -> tuple[list[tuple], tuple | None]:
    """Rows (ts, phash, difference, text) that aren't like the last kept one: over `most_bits` apart, or too different."""
    kept = []
    for r in rows:
        if state is None or bin((state[1] ^ r[1]) & (2**64 - 1)).count("1") > most_bits or r[2] > most_difference:
            kept.append(r)
            state = r
    return kept, state


class ChangedFrames(StatefulProcessor):
    """Drops frames that repeat the last kept one of their key.  In: key, ts, phash, difference, text."""

    def __init__(self, most_bits: int = 5, most_difference: float = 0.01):
        self.limits = (most_bits, most_difference)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts double, phash long, difference double, text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        new = sorted((r for pdf in rows for r in pdf[["ts", "phash", "difference", "text"]].itertuples(index=False, name=None)), key=lambda r: r[0])
        state = self.last.get() if self.last.exists() else None
        kept, state = keep_changed(tuple(state) if state is not None else None, new, *self.limits)
        if state is not None:
            self.last.update(state)
        if kept:
            yield pd.DataFrame([(key[0], *r) for r in kept], columns=["key", "ts", "phash", "difference", "text"])

    def close(self) -> None:
        pass


def changed_frames(frames: DataFrame, most_bits: int = 5, most_difference: float = 0.01) -> DataFrame:
    return frames.groupBy("key").transformWithStateInPandas(ChangedFrames(most_bits, most_difference), "key string, ts double, phash long, difference double, text string", "Append", "none")


def carry(state: str | None, rows: list[tuple]) -> tuple[list[tuple], str | None]:
    """Rows (ts, kind, text): a duplicate takes the last text, an error forgets it."""
    out = []
    for ts, kind, text in rows:
        state = None if kind == "error" else state if kind == "duplicate" else text
        out.append((ts, kind, state))
    return out, state


class CarriedTexts(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("text", "text string")

    def handleInputRows(self, key, rows, timers):
        new = sorted((r for pdf in rows for r in pdf[["ts", "kind", "text"]].itertuples(index=False, name=None)), key=lambda r: r[0])
        state = self.last.get()[0] if self.last.exists() else None
        out, state = carry(state, new)
        if state is None:
            self.last.clear()
        else:
            self.last.update((state,))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["key", "ts", "kind", "text"])

    def close(self) -> None:
        pass


def carried_texts(frames: DataFrame) -> DataFrame:
    return frames.groupBy("key").transformWithStateInPandas(CarriedTexts(), "key string, ts double, kind string, text string", "Append", "none")


def adapt(state: tuple, outcomes: list[bool], floor: int = 2, ceiling: int = 32, least: int = 4, share: float = 0.25, streak: int = 8) -> tuple[list[int], tuple]:
    """Concurrency after each outcome.  state: (limit, successes in a row, failures and outcomes of the window).

    With `least` outcomes of which `share` failed the limit is halved and the
    window starts anew; `streak` successes raise it by one."""
    limit, good, bad, seen = state
    out = []
    for ok in outcomes:
        seen, bad, good = seen + 1, bad + (not ok), good + 1 if ok else 0
        if seen >= least and bad >= share * seen:
            limit, good, bad, seen = max(floor, limit // 2), 0, 0, 0
        elif good >= streak:
            limit, good = min(ceiling, limit + 1), 0
            bad = seen = 0
        out.append(limit)
    return out, (limit, good, bad, seen)


class AdaptiveLimit(StatefulProcessor):
    """In: key, ts, ok.  Out: key, ts, concurrency."""

    def __init__(self, start: int = 8):
        self.start = start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "a int, b int, c int, d int")

    def handleInputRows(self, key, rows, timers):
        new = sorted((r for pdf in rows for r in pdf[["ts", "ok"]].itertuples(index=False, name=None)), key=lambda r: r[0])
        state = tuple(self.now.get()) if self.now.exists() else (self.start, 0, 0, 0)
        limits, state = adapt(state, [bool(ok) for _, ok in new])
        self.now.update(tuple(map(int, state)))
        yield pd.DataFrame({"key": key[0], "ts": [t for t, _ in new], "concurrency": limits})

    def close(self) -> None:
        pass


def adaptive_limits(outcomes: DataFrame, start: int = 8) -> DataFrame:
    return outcomes.groupBy("key").transformWithStateInPandas(AdaptiveLimit(start), "key string, ts double, concurrency int", "Append", "none")


def changed_frames_batch(frames: DataFrame, most_bits: int = 5, most_difference: float = 0.01) -> DataFrame:
    """The batch form of changed_frames."""

    def fold(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values("ts", kind="stable")[["ts", "phash", "difference", "text"]].itertuples(index=False, name=None))
        kept, _ = keep_changed(None, rows, most_bits, most_difference)
        return pd.DataFrame([(key[0], *r) for r in kept], columns=["key", "ts", "phash", "difference", "text"])

    return frames.groupBy("key").applyInPandas(fold, "key string, ts double, phash long, difference double, text string")


def adaptive_limits_batch(outcomes: DataFrame, start: int = 8) -> DataFrame:
    def fold(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        limits, _ = adapt((start, 0, 0, 0), pdf["ok"].astype(bool).tolist())
        return pd.DataFrame({"key": key[0], "ts": pdf["ts"].to_numpy(), "concurrency": limits})

    return outcomes.groupBy("key").applyInPandas(fold, "key string, ts double, concurrency int")


#: The day of a quota begins at midnight there; a window of requests and tokens is this many seconds.
QUOTA_ZONE, QUOTA_SEC = ZoneInfo("America/Los_Angeles"), 60.0
QUOTA_SCHEMA = "key string, ts double, id string, kind string, outcome string, wait_sec double, requests int, tokens long, day_left int"
_QUOTA_COLUMNS = [c.split()[0] for c in QUOTA_SCHEMA.split(", ")]


def quota_day(ts: float) -> str:
    return datetime.datetime.fromtimestamp(ts, QUOTA_ZONE).date().isoformat()


def quota_step(state: dict | None, row: tuple, limits: tuple[int, int, int]) -> tuple[dict, tuple]:
    """(new state, (outcome, wait_sec, requests, tokens, day_left)) of one event (ts, id, kind, amount).

    limits: requests and tokens a window, requests a day.  Kinds: `acquire` asks
    for a request of so many tokens: "granted", "exhausted" for the day, or, with
    the seconds to wait, what stands in the way: "cooldown", "requests" or
    "tokens" (the last of them that does; the longest wait).  `reconcile` puts
    the tokens really used in place of the reserved ones; `release` gives all of
    a request back, its place in the day too; `limited` starts a cooldown of
    `amount` seconds, never shortening one; `day_out` marks the day as used up.
    Nothing is kept of a request whose window has passed."""
    ts, id_, kind, amount = row
    per_window, most_tokens, per_day = limits
    state = state or {"held": [], "day": None, "count": 0, "cool": 0.0}
    held = [h for h in state["held"] if ts - h[1] < QUOTA_SEC]
    day = quota_day(ts)
    count = state["count"] if state["day"] == day else 0
    cool, outcome, wait = state["cool"], "done", 0.0
    tokens = sum(h[2] for h in held)
    amount = 0.0 if amount is None else amount
    if kind == "acquire":
        asked = max(1, int(amount))
        if count >= per_day:
            outcome = "exhausted"
        else:
            oldest = QUOTA_SEC - (ts - held[0][1]) if held else 0.0
            blocks = [("cooldown", cool - ts)] * (cool > ts) + [("requests", oldest)] * (len(held) >= per_window) + [("tokens", oldest)] * (bool(held) and tokens + asked > most_tokens)
            if blocks:
                outcome, wait = blocks[-1][0], max(w for _, w in blocks)
            else:
                outcome, count = "granted", count + 1
                held.append([id_, ts, asked])
    elif kind == "reconcile":
        held = [[i, t, max(1, int(amount)) if i == id_ else n] for i, t, n in held]
    elif kind == "release":
        held, count = [h for h in held if h[0] != id_], max(0, count - 1)
    elif kind == "limited":
        cool = max(cool, ts + amount) if amount > 0 else cool
    elif kind == "day_out":
        count = max(count, per_day)
    new = {"held": held, "day": day, "count": count, "cool": cool}
    return new, (outcome, float(wait), len(held), sum(h[2] for h in held), max(0, per_day - count))


def _quota_rows(key: str, state: dict | None, events: list[tuple], limits) -> tuple[pd.DataFrame, dict | None]:
    out = []
    for ts, id_, kind, amount in events:
        state, answer = quota_step(state, (ts, id_, kind, amount), limits)
        out.append((key, ts, id_, kind, *answer))
    return pd.DataFrame(out, columns=_QUOTA_COLUMNS), state


def _quota_events(frames) -> list[tuple]:
    rows = [r for pdf in frames for r in pdf[["ts", "id", "kind", "amount"]].itertuples(index=False, name=None)]
    return sorted(((ts, id_, kind, None if amount != amount else amount) for ts, id_, kind, amount in rows), key=lambda r: r[0])


class Quota(StatefulProcessor):
    """quota_step over a stream; the state is one window's requests, the day's count and the cooldown."""

    def __init__(self, limits: tuple[int, int, int]):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "state string")

    def handleInputRows(self, key, rows, timers):
        state = json.loads(self.now.get()[0]) if self.now.exists() else None
        out, state = _quota_rows(key[0], state, _quota_events(rows), self.limits)
        self.now.update((json.dumps(state),))
        yield out

    def close(self) -> None:
        pass


def quota(events: DataFrame, limits: tuple[int, int, int]) -> DataFrame:
    """key, ts (seconds), id, kind, amount -> what becomes of each event; keys (account and model) have limits of their own."""
    return events.groupBy("key").transformWithStateInPandas(Quota(limits), QUOTA_SCHEMA, "Append", "none")


def quota_batch(events: DataFrame, limits: tuple[int, int, int]) -> DataFrame:
    """The batch form of quota."""
    return events.groupBy("key").applyInPandas(lambda key, pdf: _quota_rows(key[0], None, _quota_events([pdf]), limits)[0], QUOTA_SCHEMA)


def tuned_size(size: int, elapsed: float, index: int, target: float = 1.5, least: int = 1, most: int = 256) -> int:
    """The batch size after batch `index` (from 0): set once, after the second batch, to what takes `target` seconds."""
    return max(least, min(most, int(size * target / elapsed))) if index == 1 and elapsed > 0 else size


def tuned_batches(batches: DataFrame, by: list[str], order: list[str], elapsed: str, start: int = 16, target: float = 1.5, least: int = 1, most: int = 256) -> DataFrame:
    """batches with the size each of them has: `start` for the first two, then that of tuned_size.  A null time tunes nothing."""
    w = W.partitionBy(*by)
    ranked = batches.withColumn("_i", F.row_number().over(w.orderBy(*order)))
    second = F.max(F.when(F.col("_i") == 2, F.col(elapsed).cast("double"))).over(w)
    tuned = F.when(second > 0, F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.lit(start * target) / second)))).otherwise(F.lit(start))
    return ranked.withColumn("batch_size", F.when(F.col("_i") <= 2, F.lit(start)).otherwise(tuned).cast("long")).drop("_i")


class FrameCache:
    """Frames of one source at a time, whole or not at all: a table of more than `most` rows isn't kept, since a cut one would lose cues."""

    def __init__(self, most: int = 20_000):
        self.most, self.key, self.frames = most, None, None

    @staticmethod
    def signature(source: str, **settings) -> str:
        """A key that differs whenever any setting that changes the frames does."""
        return source + "|" + json.dumps(settings, sort_keys=True, default=str)

    def get(self, key: str) -> DataFrame | None:
        return self.frames if self.key == key else None

    def put(self, key: str, frames: DataFrame) -> bool:
        """Whether the frames are kept; they take the place of the last ones."""
        if frames.limit(self.most + 1).count() > self.most:
            return False
        kept = frames.persist()
        self.clear()
        self.key, self.frames = key, kept
        return True

    def clear(self) -> None:
        if self.frames is not None:
            self.frames.unpersist()
        self.key = self.frames = None
