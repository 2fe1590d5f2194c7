"""One text out of many readings of it."""

from __future__ import annotations

import re
from collections import Counter
from statistics import median

from ..functions.similarity import _CJK, edit_operations

MAJORITY = 0.45
ANCHOR_BONUS, INSERT_SHARE, INNER_INSERT, SPACE_FOR_LETTER = 2.5, 0.5, 0.3, 0.2
_EDGE = re.compile(r"^[^\w!?.…\"'()\[\]，。！？《》「」]+|[^\w!?.…\"'()\[\]，。！？《》「」]+$")


def tidy(text: str) -> str:
    return _EDGE.sub("", re.sub(r"[ \t]+", " ", text)).strip()


def mostly_cjk(text: str) -> bool:
    seen = re.sub(r"\s", "", text)
    return bool(seen) and len(_CJK.findall(seen)) >= 0.5 * len(seen)


def anchor(readings: list[tuple[str, float]]) -> str:
    """The reading with the best of .6 frequency + .4 confidence - .15 length deviation (in MADs); of equals the first."""
    n = len(readings)
    counts = Counter(t for t, _ in readings)
    lengths = [len(t) for t, _ in readings]
    mid = median(lengths)
    mad = 1.4826 * max(median(abs(x - mid) for x in lengths), 1e-6)
    return max(readings, key=lambda r: 0.6 * counts[r[0]] / n + 0.4 * r[1] - 0.15 * abs(len(r[0]) - mid) / mad)[0]


def _first_best(votes: Counter) -> tuple[str, float]:
    return max(votes.items(), key=lambda kv: kv[1])


#: The stroke that is lost most, what counts as a strong and a fair reading, and how many of either bring back that stroke and any other character.
LOST, STRONG, FAIR = "一", 0.92, 0.85
ENOUGH_LOST, ENOUGH_OTHER = (1, 2), (2, 4)
_IDEOGRAPH = re.compile("[\u4e00-\u9fff\u3400-\u4dbf\u3040-\u30ff]")


def _longest_run(text: str) -> int:
    return max((len(m[0]) for m in re.finditer(r"(.)\1*", text, re.S)), default=0)


def _with_one_more(text: str, reading: str) -> tuple[int, str] | None:
    """Where and what a reading of one character more adds: at the front, else at the end any CJK character, else LOST inside."""
    if len(reading) != len(text) + 1:
        return None
    if reading[1:] == text and _IDEOGRAPH.match(reading[0]):
        return 0, reading[0]
    if reading[:-1] == text and _IDEOGRAPH.match(reading[-1]):
        return len(text), reading[-1]
    inner = (i for i in range(1, len(reading)) if reading[i] == LOST and reading[:i] + reading[i + 1 :] == text)
    at = next(inner, None)
    return None if at is None else (at, LOST)


def restore_dropped(text: str, readings: list[tuple[str, float]]) -> str:
    """A character that weak strokes hide comes back if readings of trust have it.

    Any CJK character may come back at either end, LOST inside too.  Of several
    the one with most evidence (strong readings count twice, the first among
    equals) is looked at: LOST needs ENOUGH_LOST, others ENOUGH_OTHER (strong
    readings, or fair ones).  Nothing comes back that would make a longer run of
    one character than the text has."""
    longer: dict[str, list[int]] = {}
    for reading, conf in readings:
        if len(reading) == len(text) + 1:
            _count_trust(longer, reading, conf)
    return _restored(text, longer)


def _count_trust(seen: dict[str, list[int]], reading: str, conf: float) -> None:
    trust = seen.setdefault(reading, [0, 0])
    trust[0] += conf >= STRONG
    trust[1] += FAIR <= conf < STRONG


def _restored(text: str, longer: dict[str, list[int]]) -> str:
    """restore_dropped by how often each reading of one character more is strong and fair."""
    evidence = {added: trust for reading, trust in longer.items() if (added := _with_one_more(text, reading))}
    if not evidence:
        return text
    (at, char), (strong, fair) = max(evidence.items(), key=lambda e: 2 * e[1][0] + e[1][1])
    least_strong, least_fair = ENOUGH_LOST if char == LOST else ENOUGH_OTHER
    restored = text[:at] + char + text[at:]
    enough = strong >= least_strong or fair >= least_fair
    return restored if enough and _longest_run(restored) <= _longest_run(text) else text


def restore_spaces(text: str, readings: list[tuple[str, float]], strong: float = 0.92, fair: float = 0.85) -> str:
    """Spaces of the best trusted reading that has the same letters but more spaces."""
    bare = text.replace(" ", "")
    same = [(t, c) for t, c in readings if t.count(" ") > text.count(" ") and t.replace(" ", "") == bare]
    if sum(c >= strong for _, c in same) >= 1 or sum(c >= fair for _, c in same) >= 2:
        return max(same, key=lambda r: r[1])[0]
    return text


def vote(readings: list[tuple[str, float]]) -> str:
    """Consensus of (text, confidence) readings in time order.

    A reading with 45 % of all wins at once; a CJK anchor stands as it is.
    Otherwise every reading is aligned to the anchor and votes, with its
    confidence, for each character and for what it inserts."""
    readings = [r for r in readings if r[0].strip()]
    if not readings:
        return ""
    top, n = _first_best(Counter(t for t, _ in readings))
    if len(readings) == 1 or n / len(readings) >= MAJORITY:
        return tidy(restore_dropped(top, readings))
    base = anchor(readings)
    if mostly_cjk(base):
        return tidy(restore_dropped(base, readings))
    lead = next(c for t, c in readings if t == base)
    here = [Counter({ch: lead * ANCHOR_BONUS}) for ch in base]
    added: list[Counter] = [Counter() for _ in range(len(base) + 1)]
    skipped = False
    for text, conf in sorted(readings, key=lambda r: (r[0] != base, -r[1])):
        if text == base and not skipped:
            skipped = True
            continue
        changed, pending = set(), {}
        for kind, i, j in edit_operations(base, text):
            if kind == "replace":
                changed.add(i)
                here[i][text[j]] += conf * (SPACE_FOR_LETTER if text[j] == " " and base[i] != " " else 1)
            elif kind == "delete":
                changed.add(i)
            else:
                pending.setdefault(i, []).append(text[j])
        for i, chars in pending.items():
            part = "".join(chars)
            edge = i == 0 or i == len(base) or base[i - 1].isspace() or base[i].isspace()
            added[i][part] += conf * (1 if part.isspace() or edge else INNER_INSERT)
        for i in range(len(base)):
            if i not in changed:
                here[i][base[i]] += conf
    need = INSERT_SHARE * sum(c for _, c in readings)
    out = []
    for i in range(len(base) + 1):
        if added[i]:
            part, score = _first_best(added[i])
            if score > need:
                out.append(part)
        if i < len(base):
            out.append(_first_best(here[i])[0])
    return tidy(restore_spaces(restore_dropped("".join(out), readings), readings))


class Votes:
    """vote() of readings that come one by one: while one of them has the majority, a step costs what that text costs, not all readings."""

    def __init__(self, *readings: tuple[str, float]):
        self.readings: list[tuple[str, float]] = []
        self.counts: dict[str, list[int]] = {}  # how often, and its place among the distinct ones
        self.by_length: dict[int, dict[str, list[int]]] = {}
        self.top = ""
        for r in readings:
            self.add(*r)

    def add(self, text: str, conf: float) -> None:
        if not text.strip():
            return
        self.readings.append((text, conf))
        own = self.counts.setdefault(text, [0, len(self.counts)])
        own[0] += 1
        _count_trust(self.by_length.setdefault(len(text), {}), text, conf)
        if not self.top or (own[0], -own[1]) > (self.counts[self.top][0], -self.counts[self.top][1]):
            self.top = text

    def text(self) -> str:
        n = len(self.readings)
        if n and (n == 1 or self.counts[self.top][0] / n >= MAJORITY):
            return tidy(_restored(self.top, self.by_length.get(len(self.top) + 1, {})))
        return vote(self.readings)
