"""Fuzzy string similarity: plain functions, and Arrow-batched UDFs over them.

No library for these is at hand, so they are written from their published
definitions.  Each is symmetric; equal texts give 1, an empty one against
another 0.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_CJK = re.compile("[一-鿿㐀-䶿가-힯぀-ゟ゠-ヿ豈-﫿]")
_SIGNS = re.compile(r"[^\w\s]|_")


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, 1 bit per character of a (Hyyrö's bit-parallel recurrence)."""
    mask: dict[str, int] = {}
    for i, c in enumerate(a):
        mask[c] = mask.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & mask.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """2 * LCS / (|a| + |b|)."""
    if a == b:
        return 1.0
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a and b else 0.0


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    """Jaro with the Winkler prefix boost for Jaro values over 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used) if u]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro > 0.7:
        prefix = 0
        for x, y in zip(a[:4], b[:4]):
            if x != y:
                break
            prefix += 1
        jaro += prefix * weight * (1 - jaro)
    return jaro


def partial_ratio(a: str, b: str) -> float:
    """Best indel ratio of the shorter text with a window of the longer, 0 to 100."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    sides = [(a, b)] if len(a) < len(b) else [(b, a)] if len(b) < len(a) else [(a, b), (b, a)]
    best = 0.0
    for short, long in sides:
        n = len(short)
        for i in range(-n + 1, len(long)):
            best = max(best, indel_ratio(short, long[max(0, i) : i + n]))
            if best == 1.0:
                return 100.0
    return 100 * best


def token_set_ratio(a: str, b: str) -> float:
    """Best indel ratio among common words, common words with a's rest, and with b's rest; 100 if one side has no rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    ra, rb = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not ra or not rb):
        return 100.0
    with_a, with_b = " ".join(filter(None, (both, ra))), " ".join(filter(None, (both, rb)))
    scores = [indel_ratio(with_a, with_b)]
    if both:
        scores += [indel_ratio(both, with_a), indel_ratio(both, with_b)]
    return 100 * max(scores)


def token_set_ratios(queries: list[str], texts: list[str], pack: int = 256) -> np.ndarray:
    """token_set_ratio of each query with each text, as a matrix.

    Texts are packed into one long bit pattern with a free bit between two, so
    that a step of lcs_length serves all of them.  Common words match nothing:
    on the texts' side their bits are left out, on the query's side they are
    skipped where a text has them; they lead both sides and count whole."""
    out = np.zeros((len(queries), len(texts)))
    asked = [sorted(set(q.split())) for q in queries]
    to_int = lambda bits: int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    for first in range(0, len(texts), pack):
        own = [sorted(set(t.split())) for t in texts[first : first + pack]]
        places: dict[str, list[tuple[int, int]]] = {}
        starts, at = np.zeros(len(own), np.int64), 0
        for i, words in enumerate(own):
            starts[i] = at
            for w in words:
                places.setdefault(w, []).append((i, at))
                at += len(w) + 1
            at += 1
        size = np.diff(np.append(starts, at)) - 1
        signs = np.frombuffer("".join("".join(" " + w for w in words) + "\n" for words in own).encode("utf-32-le", "surrogatepass"), np.uint32)
        full, masks = to_int(signs != 10), {}
        for k, words in enumerate(asked):
            if not words:
                continue
            alive, common, shared = signs != 10, np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            for w in words:
                for i, a in places.get(w, ()):
                    alive[a : a + len(w) + 1] = False
                    common[i] += len(w) + 1
                    shared[i] += 1
            live, s = to_int(alive), full
            for w in words:
                here = live
                if w in places:
                    there = np.ones(len(signs), bool)
                    for i, _ in places[w]:
                        there[starts[i] : starts[i] + size[i]] = False
                    here &= to_int(there)
                for c in " " + w:
                    if c not in masks:
                        masks[c] = to_int(signs == ord(c))
                    u = s & masks[c] & here
                    s = ((s + u) | (s ^ u)) & full
            zeros = np.unpackbits(np.frombuffer((full ^ s).to_bytes(len(signs) // 8 + 1, "little"), np.uint8), bitorder="little")
            lcs = np.add.reduceat(zeros[: len(signs)], starts, dtype=np.int64)
            la, lb, both = sum(len(w) + 1 for w in words) - 1, np.maximum(size - 1, 0), np.maximum(common - 1, 0)
            score = 2 * (common - 1 + lcs) / (la + lb)
            score = np.maximum(score, np.maximum(2 * both / (both + la), 2 * both / np.maximum(both + lb, 1)))
            score[(shared > 0) & ((shared == len(words)) | (common == size))] = 1.0
            score[size <= 0] = 0.0
            out[k, first : first + len(own)] = 100 * score
    return out


def edit_operations(a: str, b: str) -> list[tuple[str, int, int]]:
    """One shortest script of (replace | delete | insert, position in a, position in b)."""
    n, m = len(a), len(b)
    if n * m > 2_000:
        # the same table, a row at a time
        place, y = np.arange(m + 1), np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32)
        d = np.zeros((n + 1, m + 1), np.int64)
        d[0] = place
        for i in range(1, n + 1):
            d[i, 0] = i
            d[i, 1:] = np.minimum(d[i - 1, :-1] + (y != ord(a[i - 1])), d[i - 1, 1:] + 1)
            d[i] = np.minimum.accumulate(d[i] - place) + place
    else:
        d = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                d[i][j] = min(d[i - 1][j - 1] + (a[i - 1] != b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    out, i, j = [], n, m
    while i or j:
        if i and j and a[i - 1] == b[j - 1] and d[i][j] == d[i - 1][j - 1]:
            i, j = i - 1, j - 1
        elif i and j and d[i][j] == d[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
            out.append(("replace", i, j))
        elif i and d[i][j] == d[i - 1][j] + 1:
            i -= 1
            out.append(("delete", i, j))
        else:
            j -= 1
            out.append(("insert", i, j))
    return out[::-1]


#: Characters that turn a short CJK sentence around, or are its pronouns.
CRITICAL_CHARACTERS = frozenset("不没別别非无無未勿我你您他她它咱是否有")


def has_cjk(text: str) -> bool:
    return bool(_CJK.search(text))


def turns_meaning(a: str, b: str) -> bool:
    """Short CJK texts that differ in one or two characters, one of them critical."""
    if max(len(a), len(b)) > 6:
        return False
    ops = edit_operations(a, b)
    return 0 < len(ops) <= 2 and any((b[j] if kind == "insert" else a[i]) in CRITICAL_CHARACTERS for kind, i, j in ops)


@lru_cache(1 << 14)
def _builder(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = (_SIGNS.sub("", t).replace(" ", "").lower() for t in (a, b))
    if x == y:
        return 0.95 if x else 0.0
    cjk = has_cjk(x) or has_cjk(y)
    if has_cjk(x) and has_cjk(y) and turns_meaning(x, y):
        return 0.0
    short, long = sorted((x, y), key=len)
    gap = len(long) - len(short)
    if len(long) > 4 and len(long) > 2 * len(short):
        return 0.0
    score = indel_ratio(a, b)
    if not cjk:
        score = max(score, jaro_winkler(x, y))
    if gap:
        score -= 0.40 * gap / len(long)
    elif not cjk and score >= 0.60:
        score += 0.10
    if cjk and len(short) >= 2 and short in long and len(long) >= 4 and gap <= 2:
        score = max(score, 0.85)
    return min(1.0, max(0.0, score))


def builder_similarity(a: str, b: str) -> float:
    """Similarity of two readings of one cue: punctuation and case count little, length differences cost."""
    return _builder(*sorted((a, b)))


@lru_cache(1 << 14)
def _path(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    long, short = max(len(a), len(b)), min(len(a), len(b))
    if long > 4 and long > 2 * short:
        return 0.0
    score = indel_ratio(a, b)
    if score < 0.30:
        return 0.0
    if long != short:
        score -= (long - short) / long * (1.2 if long <= 3 else 0.8 if long <= 5 else 0.6)
    elif long <= 3:
        if score >= (0.66 if has_cjk(a) or has_cjk(b) else 0.45):
            score = max(score, 0.85)
    elif score >= 0.60:
        score += 0.10
    return min(1.0, max(0.0, score))


def path_similarity(a: str, b: str) -> float:
    """The variant that the segmentation path uses: steeper length costs, floors for very short texts."""
    return _path(*sorted((a, b)))


def effective_similarity(a: str, b: str, conf_a: float = 1.0, conf_b: float = 1.0, gap: float = 0.0) -> float:
    """Builder similarity with CJK shortcuts: one edit in two or three characters, or a good ratio over a short gap, is the same cue; unless the texts are distinct utterances."""
    if a == b:
        return 1.0
    if has_cjk(a) and has_cjk(b):
        x, y = (_SIGNS.sub("", t).replace(" ", "") for t in (a, b))
        if turns_meaning(x, y):
            return 0.0
        if len(x) == len(y) and 2 <= len(x) <= 3 and len(edit_operations(x, y)) == 1:
            return 1.0 if min(conf_a, conf_b) < 0.9 and gap <= 0.2 else builder_similarity(a, b)
        if max(len(x), len(y)) >= 4 and indel_ratio(x, y) >= (0.74 if gap <= 0.2 else 0.78):
            return 1.0
    return builder_similarity(a, b)


def _pairwise(f):
    """UDF of two string columns; each distinct pair of a batch is scored once.  Null in, null out."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        memo: dict[tuple[str, str], float] = {}
        out = []
        for p in zip(a, b):
            if p[0] is None or p[1] is None:
                out.append(None)
                continue
            if p not in memo:
                memo[p] = f(*p)
            out.append(memo[p])
        return pd.Series(out, dtype="float64")

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, DoubleType())


indel_ratio_udf = _pairwise(indel_ratio)
jaro_winkler_udf = _pairwise(jaro_winkler)
partial_ratio_udf = _pairwise(partial_ratio)
token_set_ratio_udf = _pairwise(token_set_ratio)
builder_similarity_udf = _pairwise(builder_similarity)
path_similarity_udf = _pairwise(path_similarity)
