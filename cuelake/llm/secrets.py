"""Secrets by patterns, and by a battery of randomness tests; DataFrame and SQL functions alone.

Beside the pattern kinds, every long run of encoding characters is a candidate.
Its encoding is inferred as the smallest alphabet that holds it; the string is
then read as alphabet positions and put to tests:

* chi-squared uniformity over the alphabet's symbols and over its classes
  (digits, lower, upper, signs),
* a runs test of positions below and above the alphabet's middle,
* lag-one serial correlation of the positions.

Each gives a p value under "uniformly random"; the least of them, times their
number, is the battery's.  Within bands of length, because long strings show
small departures and short ones hardly any, a Benjamini-Hochberg step over the
battery's p values of all candidates tells which are not random.  These show how
often ordinary strings change class between neighbours.  Against that rate the
others' class changes have p values too, and a second step within the same bands
tells which are not ordinary.  A candidate that is not ordinary, and isn't told
to be not random, is a span of kind "random".

Matches are rows from the start: places are running sums inside a text, and what
overlaps is found in their order, so a text with many matches costs no more for
each than one with few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, only, small_side


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The pattern kinds.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
VALUE = r"[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
ASSIGN = "(?:" + "|".join(_either_case(k) for k in KEYWORDS) + ")" + VALUE
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
ASSIGN_LEAST = 6

CANDIDATE = "[A-Za-z0-9+/_-]{20,}={0,2}"
#: Encodings by size of the alphabet; the first whose symbols hold the string is inferred.
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Share of neighbours of different class in ordinary strings, where the table has none that shows it.
TEXT_CHANGES = 0.08
FALSE_DISCOVERIES = 0.01
#: Steps of p, as powers of ten, at which the Benjamini-Hochberg line is looked at.
STEPS_PER_DECADE, DECADES = 4, 60
BANDS = (24, 32, 48, 64, 128)


def _two_sided(z: str) -> str:
    """SQL: p of a standard normal beyond |z| on both sides, by the logistic approximation."""
    return f"least(1.0D, 2.0D / (1.0D + exp(0.07056D * pow(abs({z}), 3) + 1.5976D * abs({z}))))"


def _upper(z: str) -> str:
    return f"(1.0D / (1.0D + exp(0.07056D * pow({z}, 3) + 1.5976D * ({z}))))"


def _chi_z(chi: str, free: str) -> str:
    """SQL: a chi-squared value as a normal one (Wilson and Hilferty); only an excess counts."""
    return f"greatest(0.0D, (pow({chi} / ({free}), 1.0D / 3) - (1 - 2.0D / (9 * ({free})))) / sqrt(2.0D / (9 * ({free}))))"


def _lower(z: str) -> str:
    return f"least(1.0D, 2.0D * {_upper(z)})"


_CLASS_SETS = {"d": "0123456789", "l": "abcdefghijklmnopqrstuvwxyz", "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "o": "+/-_"}


def _count(of: str, chars: str) -> str:
    return f"(length({of}) - length(translate({of}, '{chars}', '')))"


def _steps(p: str) -> str:
    """SQL: p as a whole number of steps, rounded to the weaker side."""
    return f"cast(floor(least({DECADES}.0D, -log10(greatest({p}, 1e-300))) * {STEPS_PER_DECADE} + 1e-9) as int)"


def battery(found: DataFrame) -> DataFrame:
    """Rows with a string x -> those with an inferred encoding; also n, changes, band and random_step, the battery's p in steps."""
    core = found.withColumn("x", F.expr("rtrim('=', x)"))
    # an alphabet holds the string if nothing is left after taking its symbols away
    alphabet = "CASE " + " ".join(f"WHEN length(translate(x, '{a}', '')) = 0 THEN '{a}'" for _, a in ALPHABETS) + " ELSE NULL END"
    read = core.withColumns({"a": F.expr(alphabet), "n": F.expr("cast(length(x) as double)")}).where("a is not null").withColumn("m", F.expr("cast(length(a) as double)"))
    classes = "translate(x, '0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/-_', concat(repeat('d', 10), repeat('l', 26), repeat('u', 26), repeat('o', 4)))"
    cells = "filter(array(" + ", ".join(f"named_struct('k', cast({_count('x', s)} as double), 'w', cast({_count('a', s)} as double))" for s in _CLASS_SETS.values()) + "), z -> z.w > 0)"
    read = read.withColumns({
        "at": F.expr("transform(split(x, ''), y -> cast(instr(a, y) as double) - 0.5D - m / 2.0D)"),
        "cls": F.expr(classes),
        "cells": F.expr(cells),
        "chi": F.expr("m / n * aggregate(sequence(1, length(a)), 0.0D, (acc, i) -> acc + pow(length(x) - length(replace(x, substr(a, i, 1), '')), 2)) - n"),
    })
    read = read.withColumns({
        "chi_class": F.expr("aggregate(cells, 0.0D, (acc, z) -> acc + pow(z.k - n * z.w / m, 2) / (n * z.w / m))"),
        "below": F.expr("cast(size(filter(at, y -> y < 0)) as double)"),
        "runs": F.expr("1.0D + size(filter(zip_with(slice(at, 1, size(at) - 1), slice(at, 2, size(at) - 1), (p, q) -> (p < 0) != (q < 0)), y -> y))"),
        "serial": F.expr("aggregate(zip_with(slice(at, 1, size(at) - 1), slice(at, 2, size(at) - 1), (p, q) -> p * q), 0.0D, (acc, y) -> acc + y) / ((m * m - 1) / 12.0D * sqrt(n - 1))"),
        "changes": F.expr("cast(length(cls) - length(regexp_replace(cls, r'(.)(?!\\1)(?=.)', '')) as long)"),
    })
    above = "(n - below)"
    mean = f"(1 + 2 * below * {above} / n)"
    var = f"(2 * below * {above} * (2 * below * {above} - n) / (n * n * (n - 1)))"
    runs_p = f"CASE WHEN below * {above} < 1 THEN pow(2.0D, 1 - n) WHEN {var} <= 0 THEN 1.0D ELSE {_two_sided(f'((runs - {mean}) / sqrt({var}))')} END"
    chi_p = _lower(_chi_z("chi", "(m - 1)"))
    class_p = f"CASE WHEN size(cells) < 2 THEN 1.0D ELSE {_lower(_chi_z('chi_class', '(size(cells) - 1)'))} END"
    random_p = f"least(1.0D, 4 * least({runs_p}, {chi_p}, {class_p}, {_two_sided('serial')}))"
    band = "CASE " + " ".join(f"WHEN n < {b} THEN {i}" for i, b in enumerate(BANDS)) + f" ELSE {len(BANDS)} END"
    return read.select(*(c for c in found.columns if c != "x"), "n", "changes", F.expr(band).alias("band"), F.expr(_steps(random_p)).alias("random_step"))


def text_step(rate: float) -> str:
    """SQL: the p of so many class changes or more, at the rate of ordinary strings, in steps."""
    z = f"((changes - 0.5D - (n - 1) * {rate!r}D) / sqrt((n - 1) * {rate * (1 - rate)!r}D))"
    return _steps(f"CASE WHEN {z} <= 0 THEN 1.0D ELSE {_upper(z)} END")


def discovery_steps(found: DataFrame, step: str) -> dict[int, int]:
    """{band: least step that is a discovery}: Benjamini-Hochberg on counts of p by band and step, a table of fixed size."""
    counts: dict[int, dict[int, int]] = {}
    for r in found.groupBy("band", F.col(step).alias("step")).count().collect():
        counts.setdefault(r.band, {})[r.step] = r["count"]
    out = {}
    for band, by in counts.items():
        n, so_far = sum(by.values()), 0
        for at in sorted(by, reverse=True):
            so_far += by[at]
            if 10 ** (-at / STEPS_PER_DECADE) <= so_far * FALSE_DISCOVERIES / n:
                out[band] = at
    return out


def _discovered(steps: dict[int, int], step: str):
    return F.expr(" or ".join(f"(band = {b} and {step} >= {s})" for b, s in sorted(steps.items())) or "false")


def _scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (row, doc_id, kinds): of each kind that occurs its matches, and the lengths of the text before each."""
    found = docs.withColumn("row", F.monotonically_increasing_id())
    for k, pattern in enumerate(PATTERNS):
        found = found.withColumn(f"x{k}", F.expr(f"regexp_extract_all(text, r'{pattern}', 0)"))
    # the text between matches is what split() leaves
    gaps = lambda k, p: f"CASE WHEN size(x{k}) > 0 THEN transform(slice(split(text, r'{p}', -1), 1, size(x{k})), y -> length(y)) ELSE cast(array() as array<int>) END"
    kinds = "filter(array(" + ", ".join(f"named_struct('k', {k}, 'gaps', {gaps(k, p)}, 'found', x{k})" for k, p in enumerate(PATTERNS)) + "), z -> size(z.found) > 0)"
    return cut(found.select("row", "doc_id", F.expr(kinds).alias("kinds")), "scanned")


def _matches(scanned: DataFrame) -> DataFrame:
    """(row, k, s, e, x): every match of every pattern, kinds numbered as in PATTERNS."""
    found = scanned.where("size(kinds) > 0").select("row", F.explode("kinds").alias("z")).select("row", "z.k", F.posexplode(F.arrays_zip("z.gaps", "z.found")).alias("i", "m"))
    until = W.partitionBy("row", "k").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    found = found.select("row", "k", "i", F.col("m.gaps").alias("gap"), F.col("m.found").alias("x"))
    end = F.sum(F.col("gap") + F.length("x")).over(until)
    return found.select("row", "k", (end - F.length("x")).alias("s"), end.alias("e"), "x")


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Spans are matches, as code points, end exclusive.  Matches of a kind are
    leftmost and don't overlap; those that are too short are dropped after
    matching.  A null text counts as empty: no spans.  A "random" span never
    overlaps a pattern's.  Which of them are reported depends on the whole
    table, through the false-discovery steps.  Equal rows get equal results; extra
    columns are ignored; an empty table gives an empty result.
    """
    scanned = _scanned(only(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit(""))))
    found = _matches(scanned)
    # the value is what follows the first sign and blanks; its length decides
    long_enough = F.expr(f"k <> 0 or length(regexp_extract(x, r'{VALUE}$', 1)) >= {ASSIGN_LEAST}")
    found = found.where(long_enough)
    # a candidate overlaps a base span if one that begins earlier ends behind its start, or the next one begins before its end
    order = W.partitionBy("row").orderBy("s", "k")
    base = F.col("k") < RANDOM
    reach = F.max(F.when(base, F.col("e"))).over(order.rowsBetween(W.unboundedPreceding, -1))
    following = F.min(F.when(base, F.col("s"))).over(order.rowsBetween(1, W.unboundedFollowing))
    placed = cut(found.withColumns({"reach": reach, "following": following}).where(base | ((F.coalesce("reach", F.lit(0)) <= F.col("s")) & (F.coalesce("following", F.col("e")) >= F.col("e")))).drop("reach", "following"), "placed")
    tested = cut(battery(placed.where(~base)), "tested")
    not_random = _discovered(discovery_steps(tested, "random_step"), "random_step")
    changes, pairs = tested.where(not_random).agg(F.sum("changes"), F.sum(F.col("n") - 1)).first()
    rate = min(0.5, max(0.01, changes / pairs)) if pairs else TEXT_CHANGES
    read = tested.withColumn("text_step", F.expr(text_step(rate)))
    added = read.where(~not_random & _discovered(discovery_steps(read, "text_step"), "text_step")).select("row", "k", "s", "e")
    spans = placed.where(base).select("row", "k", "s", "e").unionByName(added)
    listed = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s", "k", "e"))).alias("own"))
    names = F.array(*map(F.lit, KINDS))
    text = lambda col: F.array_join(F.transform(col, lambda m: F.concat_ws(":", F.element_at(names, m["k"] + 1), m["s"].cast("string"), m["e"].cast("string"))), ",")
    number = lambda k: F.size(F.filter("own", lambda m: m["k"] == k)).cast("long")
    listed = listed.select(
        "row", *(number(k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.sha2(text(F.filter("own", lambda m: m["k"] < RANDOM)).cast("binary"), 256).alias("base_sha256"), text(F.col("own")).alias("spans"),
    )
    out = scanned.select("row", "doc_id").join(small_side(cut(listed, "listed")), "row", "left")
    count = lambda name: F.coalesce(f"n_{name}", F.lit(0).cast("long")).alias(f"n_{name}")
    return out.select("doc_id", *map(count, KINDS[:RANDOM]), F.coalesce("base_sha256", F.lit(EMPTY_SHA256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), count(KINDS[RANDOM]))


PATTERNS = (ASSIGN, ACCESS, HEX, CANDIDATE)
KINDS = ("assign", "access", "hex", "random")
RANDOM = 3
#: SHA-256 of no bytes.
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
