"""Parameter search: grids, and coordinate descent that evaluates a sweep's candidates in one job."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Axis:
    name: str
    low: float
    high: float
    steps: int = 5
    whole: bool = False
    flag: bool = False

    def clamp(self, v: float) -> float:
        v = min(self.high, max(self.low, v))
        return float(round(v)) if self.whole else round(v, 6)

    def grid(self, centre: float | None = None, width: float = 1.0) -> list[float]:
        """Values around the centre over `width` of the range, ends included; a flag has both."""
        if self.flag:
            return [0.0, 1.0]
        span = (self.high - self.low) * width
        mid = (self.low + self.high) / 2 if centre is None else centre
        n = max(2, self.steps)
        return sorted({self.clamp(mid - span / 2 + span * i / (n - 1)) for i in range(n)})


def grid(axes: list[Axis]) -> list[dict[str, float]]:
    return [dict(zip((a.name for a in axes), v)) for v in itertools.product(*(a.grid() for a in axes))]


def one_at_a_time(axes: list[Axis], base: dict[str, float]) -> list[dict[str, float]]:
    seen, out = set(), []
    for c in [base, *(base | {a.name: v} for a in axes for v in a.grid())]:
        if (k := json.dumps(c, sort_keys=True)) not in seen:
            seen.add(k)
            out.append(c)
    return out


#: The recogniser's parameters as they are in use, and those that each space tries.
RECOGNISER = dict(
    detector="mobile", recogniser="mobile", det_thresh=0.30, box_thresh=0.6, unclip=1.5, rec_score=0.0, side_len=960, step_sec=0.04, batch=16,
    contrast=True, contrast_clip=3.0, sharpen=False, height=96, border=True, border_px=8,
)
MINIMAL = dict(det_thresh=[0.3, 0.2], rec_score=[0.0, 0.4], step_sec=[0.04, 0.08])
EXHAUSTIVE = dict(
    detector=["mobile", "server"], recogniser=["mobile", "server"], det_thresh=[0.15, 0.20, 0.30], box_thresh=[0.5, 0.6], unclip=[1.5, 2.0, 2.5], side_len=[736, 960, 1280],
    step_sec=[0.04, 0.08], contrast=[True, False], sharpen=[False, True], height=[96, 128],
)
#: Parts of the standard space: what is changed for the whole part, and what it tries.
STANDARD = (
    ({}, dict(recogniser=["mobile", "server"], det_thresh=[0.30, 0.20, 0.15], unclip=[1.5, 2.0, 2.5])),
    (dict(detector="server", recogniser="server", det_thresh=0.15, box_thresh=0.5, unclip=2.0, batch=8, height=128, border_px=12), dict(sharpen=[False, True], contrast_clip=[3.0, 4.0])),
    ({}, dict(step_sec=[0.04, 0.06, 0.08, 0.10, 0.15])),
    ({}, dict(side_len=[736, 960, 1280, 1600])),
)
SINGLE = dict(side_len=[736, 1280, 1600], box_thresh=[0.4, 0.5, 0.7], unclip=[1.8, 2.0, 2.5], det_thresh=[0.15, 0.20, 0.40], rec_score=[0.3, 0.5, 0.7], recogniser=["server"], detector=["server"])


def combinations(values: dict[str, list], base: dict = RECOGNISER) -> list[dict]:
    """Every combination of the values, on top of base; the last name varies fastest."""
    return [base | dict(zip(values, v)) for v in itertools.product(*values.values())]


def recogniser_space(name: str) -> list[dict]:
    """Settings of a named space: minimal, standard, exhaustive, or single (the base and each change alone, then both models)."""
    if name == "single":
        alone = [RECOGNISER | {k: v} for k, tried in SINGLE.items() for v in tried]
        return [RECOGNISER, *alone, RECOGNISER | dict(detector="server", recogniser="server")]
    parts = {"minimal": (({}, MINIMAL),), "exhaustive": (({}, EXHAUSTIVE),), "standard": STANDARD}[name]
    return [c for changed, values in parts for c in combinations(values, RECOGNISER | changed)]


def params_frame(spark: SparkSession, candidates: list[dict[str, float]]) -> DataFrame:
    """candidate (number) and its parameters as a small table, to be cross-joined or broadcast."""
    names = sorted(candidates[0])
    return spark.createDataFrame([(i, *(float(c[n]) for n in names)) for i, c in enumerate(candidates)], "candidate int, " + ", ".join(f"{n} double" for n in names))


def descend(axes: list[Axis], start: dict[str, float], scores: Callable[[list[dict[str, float]]], list[float]], levels: int = 3, sweeps: int = 2, shrink: float = 0.4, least: float = 1e-4) -> tuple[dict[str, float], float, int]:
    """Best parameters, their score, and how many candidates were scored.

    Each level searches each axis around the incumbent and shrinks the range;
    a level ends early when a sweep gains less than `least`.  scores() gets all
    new candidates of an axis at once and should run them as one job."""
    memo: dict[str, float] = {}
    key = lambda c: json.dumps(c, sort_keys=True)

    def score(cands):
        new = [c for i, c in enumerate(cands) if key(c) not in memo and key(c) not in map(key, cands[:i])]
        if new:
            memo.update(zip(map(key, new), scores(new)))
        return [memo[key(c)] for c in cands]

    best = dict(start)
    top = score([best])[0]
    width = 1.0
    for _ in range(levels):
        for _ in range(sweeps):
            before = top
            for a in axes:
                cands = [best | {a.name: v} for v in a.grid(best[a.name], width)]
                for c, s in zip(cands, score(cands)):
                    if s > top + 1e-12:
                        best, top = c, s
            if top - before < least:
                break
        width *= shrink
    return best, top, len(memo)


def save_state(path: str, best: dict[str, float], score: float) -> None:
    with open(path, "w") as f:
        json.dump({"best": best, "score": score}, f, sort_keys=True)


def load_state(path: str) -> tuple[dict[str, float], float] | None:
    try:
        with open(path) as f:
            d = json.load(f)
        return d["best"], d["score"]
    except (OSError, ValueError, KeyError):
        return None
