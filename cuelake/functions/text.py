"""Text as Column expressions: all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six blocks that count as CJK.
CJK_CLASS = r"[一-鿿㐀-䶿가-힯぀-ゟ゠-ヿ豈-﫿]"
#: Reading speeds in characters a second, and the shortest reading time.
CJK_SPEED, LATIN_SPEED, LEAST_READING_SEC = 3.5, 12.0, 0.3
TOO_SHORT_SEC, TOO_FAST_CPS = 0.5, 20.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def visible_length(c) -> Column:
    """Characters without white space."""
    return F.length(F.regexp_replace(col(c), r"(?U)\s+", ""))


def cjk_count(c) -> Column:
    return F.regexp_count(col(c), F.lit(CJK_CLASS))


def contains_cjk(c) -> Column:
    return col(c).rlike(CJK_CLASS)


def cjk_ratio(c) -> Column:
    n = visible_length(c)
    return F.when(n == 0, F.lit(0.0)).otherwise(cjk_count(c) / n)


def predominantly_cjk(c, threshold: float = 0.5) -> Column:
    return cjk_ratio(c) >= threshold


def effective_length(c) -> Column:
    """A CJK character counts as two."""
    return visible_length(c) + cjk_count(c)


def reading_seconds(c) -> Column:
    n = cjk_count(c)
    return F.when(F.trim(col(c)) == "", F.lit(LEAST_READING_SEC)).otherwise(F.greatest(F.lit(LEAST_READING_SEC), n / CJK_SPEED + (visible_length(c) - n) / LATIN_SPEED))


def adaptive_least_chars(c, latin: int = 2) -> Column:
    return F.when(predominantly_cjk(c), F.lit(1)).otherwise(F.lit(latin))


def cps(c, start, end) -> Column:
    """Visible characters a second; 0 for a cue without duration."""
    d = col(end) - col(start)
    return F.when(d <= 0, F.lit(0.0)).otherwise(visible_length(c) / d)


def fix_typos(c, table: dict[str, str]) -> Column:
    """Literal replacements, in the table's order."""
    out = col(c)
    for a, b in table.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def trim_edges(c, letters: str = r"\p{L}\p{N}", keep: str = "!?.…\"'()\\[\\]") -> Column:
    """Drops signs at both ends that are neither letters, digits nor kept punctuation."""
    return F.regexp_replace(col(c), f"^[^{letters}{keep}]+|[^{letters}{keep}]+$", "")


#: Punctuation trimmed at both ends of a CJK line.
CJK_EDGE = "，。！？、；：“”‘’（）《》【】…—·,.!?;:\"'()\\[\\]~\\-"


def trim_cjk_punctuation(c) -> Column:
    return F.regexp_replace(col(c), rf"^[\s{CJK_EDGE}]+|[\s{CJK_EDGE}]+$", "")


def translate_characters(c, pairs: dict[str, str]) -> Column:
    """One-to-one character map, such as traditional to simplified."""
    return F.translate(col(c), "".join(pairs), "".join(pairs.values()))


def strip_markup(c) -> Column:
    """Without <...> and {...}."""
    return F.regexp_replace(F.regexp_replace(col(c), r"<[^>]*>", ""), r"\{[^}]*\}", "")


def squeeze(c) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def repair_newlines(c) -> Column:
    """A written backslash and n becomes a line break."""
    return F.replace(col(c), F.lit("\\n"), F.lit("\n"))


def join_text(a, b) -> Column:
    """Two cues' texts; no space where CJK meets CJK."""
    a, b = col(a), col(b)
    cjk = a.rlike(CJK_CLASS + "$") & b.rlike("^" + CJK_CLASS)
    return F.when(F.trim(a) == "", b).when(F.trim(b) == "", a).when(cjk, F.concat(a, b)).otherwise(F.concat_ws(" ", a, b))


def is_sound_effect(c) -> Column:
    t = F.trim(col(c))
    return t.rlike(r"^\([^)]*\)$|^\[[^\]]*\]$") | t.startswith("♪") | t.endswith("♪")


def drop_spans(c, round_: bool = True, square: bool = True, curly: bool = True, music: bool = True) -> Column:
    """Bracketed and sung spans by option, squeezed."""
    out = col(c)
    for on, pattern in ((round_, r"\([^)]*\)|（[^）]*）"), (square, r"\[[^\]]*\]"), (curly, r"\{[^}]*\}"), (music, r"♪[^♪]*♪?")):
        if on:
            out = F.regexp_replace(out, pattern, " ")
    return squeeze(out)


def speakable(c) -> Column:
    return col(c).rlike(r"[\p{L}\p{N}]")


def hallucinated(c, blocked: list[str]) -> Column:
    """A blocked phrase, or four and more characters that are all one."""
    t = F.trim(col(c))
    phrases = [F.contains(F.lower(t), F.lit(b.lower())) for b in blocked]
    out = (F.length(t) >= 4) & (F.size(F.array_distinct(F.split(F.regexp_replace(t, r"\s", ""), ""))) == 1)
    for p in phrases:
        out |= p
    return out


def untranslatable(c) -> Column:
    """Up to four tokens, each a number or a name-like word."""
    tokens = F.split(F.trim(strip_markup(c)), r"\s+")
    return (F.size(tokens) <= 4) & (F.trim(col(c)) != "") & F.forall(tokens, lambda t: t.rlike(r"^[\p{P}]*(\p{Lu}[\p{L}'’.-]*|[\p{N}.,:%$€£+-]+)[\p{P}]*$"))


def syllables(c) -> Column:
    """Word tokens; a CJK character is one."""
    return cjk_count(c) + F.size(F.filter(F.split(F.regexp_replace(col(c), CJK_CLASS, " "), r"[^\p{L}\p{N}'’]+"), lambda t: F.length(t) > 0))


def soften_capitals(c, acronyms: tuple[str, ...] = ("TV", "USA", "UK", "FBI", "CIA", "OK", "NASA", "DNA")) -> Column:
    """A line of four and more letters, 80 % of them capitals, in sentence case but for acronyms."""
    t = col(c)
    letters, capitals = F.regexp_count(t, F.lit(r"\p{L}")), F.regexp_count(t, F.lit(r"\p{Lu}"))
    low = F.lower(t)
    soft = F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1 << 20))
    for a in acronyms:
        soft = F.regexp_replace(soft, rf"(?i)\b{a}\b", a)
    return F.when((letters >= 4) & (capitals >= 0.8 * letters), soft).otherwise(t)


def character_grams(c, k: int = 3) -> Column:
    """Distinct runs of k characters; an empty array for shorter texts."""
    t = col(c)
    return F.when(F.length(t) < k, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - (k - 1))), lambda i: F.substr(t, i, F.lit(k)))))


def natural_key(c, width: int = 20) -> Column:
    """Sort key in which digit runs compare as numbers."""
    parts = F.regexp_extract_all(F.lower(col(c)), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, width, "0")).otherwise(p)), "")


def _clock(ms: Column, sign: str, digits: int) -> Column:
    unit = 1000 if digits == 3 else 100
    return F.format_string(
        "%02d:%02d:%02d" + sign + f"%0{digits}d" if digits == 3 else "%d:%02d:%02d" + sign + f"%0{digits}d",
        F.floor(ms / (3600 * unit)).cast("long"), F.floor(ms / (60 * unit)).cast("long") % 60, F.floor(ms / unit).cast("long") % 60, ms % unit,
    )


def srt_time(seconds) -> Column:
    """HH:MM:SS,mmm; milliseconds rounded half to even, negative times are 0."""
    return _clock(F.greatest(F.lit(0), F.bround(col(seconds) * 1000)).cast("long"), ",", 3)


def ass_time(seconds) -> Column:
    """H:MM:SS.cc; centiseconds cut off."""
    return _clock(F.greatest(F.lit(0), F.floor(col(seconds) * 100 + 1e-6)).cast("long"), ".", 2)


def display_time(seconds) -> Column:
    """HH:MM:SS.mmm; milliseconds cut off."""
    return _clock(F.greatest(F.lit(0), F.floor(col(seconds) * 1000 + 1e-6)).cast("long"), ".", 3)


def parse_time(c) -> Column:
    """Seconds of [h:]mm:ss with , or . and up to three digits; null for anything else."""
    p = r"^\s*(?:(\d+):)?(\d{1,2}):(\d{1,2})(?:[.,](\d{1,3}))?\s*$"
    g = lambda i: F.coalesce(F.nullif(F.regexp_extract(col(c), p, i), F.lit("")), F.lit("0"))
    return F.when(col(c).rlike(p), g(1).cast("long") * 3600 + g(2).cast("long") * 60 + g(3).cast("long") + F.rpad(g(4), 3, "0").cast("double") / 1000)


def cosine(a, b) -> Column:
    """Cosine of two float arrays within 0 and 1; 0 for a vector without length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    a, b = col(a), col(b)
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na < 1e-8) | (nb < 1e-8), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / (na * nb))))


def hybrid_similarity(lexical, semantic, cjk) -> Column:
    """Lexical alone when it is clear; otherwise a mix that trusts meaning more for CJK."""
    x, s = col(lexical), col(semantic)
    return F.when((x > 0.90) | (x < 0.20) | s.isNull(), x).when(cjk, 0.4 * x + 0.6 * s).otherwise(0.7 * x + 0.3 * s)


def hamming(a, b) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def chained_hash(items: Column, separator: str = "\n") -> Column:
    """SHA-256 of an ordered array of strings, each followed by the separator."""
    return F.sha2(F.concat(F.array_join(items, separator), F.lit(separator)).cast("binary"), 256)


def match_text(c) -> Column:
    """For scoring: lower case, without white space and punctuation."""
    return F.regexp_replace(F.lower(col(c)), r"[\s\p{P}\p{S}]+", "")


def cer(reference, built, normalise: bool = True) -> Column:
    """Character error rate: edits by reference length.  An empty reference: 0 if built is empty too, else 1."""
    r, b = (match_text(reference), match_text(built)) if normalise else (col(reference), col(built))
    return F.when(F.length(r) == 0, F.when(F.length(b) == 0, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(F.levenshtein(r, b) / F.length(r))


def overlap_seconds(a0, a1, b0, b1) -> Column:
    return F.greatest(F.lit(0.0), F.least(col(a1), col(b1)) - F.greatest(col(a0), col(b0)))


def time_iou(a0, a1, b0, b1) -> Column:
    both = overlap_seconds(a0, a1, b0, b1)
    union = F.greatest(col(a1), col(b1)) - F.least(col(a0), col(b0))
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def overlap_of_shorter(a0, a1, b0, b1) -> Column:
    shorter = F.least(col(a1) - col(a0), col(b1) - col(b0))
    return F.when(shorter > 0, overlap_seconds(a0, a1, b0, b1) / shorter).otherwise(F.lit(0.0))


def overlaps_closed(a0, a1, b0, b1) -> Column:
    """Touching counts."""
    return (col(a0) <= col(b1)) & (col(b0) <= col(a1))


def overlaps_open(a0, a1, b0, b1) -> Column:
    return (col(a0) < col(b1)) & (col(b0) < col(a1))


#: Separators of a glossary line, in the order they are tried.
GLOSSARY_SEPARATORS = ("=>", "->", "→", "=", "：", ":", "\t")


def glossary_entry(c, separators: tuple[str, ...] = GLOSSARY_SEPARATORS) -> Column:
    """struct(source, target) of a glossary line at its first separator by priority; null without one."""
    t = F.trim(col(c))
    out = F.lit(None).cast("struct<source:string,target:string>")
    for s in reversed(separators):
        at = F.instr(t, s)
        pair = F.struct(F.trim(F.substr(t, F.lit(1), at - 1)).alias("source"), F.trim(F.substr(t, at + len(s))).alias("target"))
        out = F.when(at > 1, pair).otherwise(out)
    return F.when(t.startswith("#"), F.lit(None)).otherwise(F.when((out["source"] != "") & (out["target"] != ""), out))


def series_key(path) -> Column:
    """Folder name, or the file's stem without episode numbers and language tags, folded."""
    stem = F.regexp_replace(F.regexp_extract(col(path), r"([^/\\]+?)(\.[A-Za-z0-9]{1,5})?$", 1), r"(?i)[\s._-]*(s\d+)?[\s._-]*(e|ep|episode|tap|第)?[\s._-]*\d+.*$", "")
    return F.lower(F.trim(F.when(stem == "", F.regexp_extract(col(path), r"([^/\\]+)[/\\][^/\\]+$", 1)).otherwise(stem)))


def canonical_name(c) -> Column:
    return F.lower(F.regexp_replace(F.trim(col(c)), r"[\s._-]+", " "))


def strip_margin_marks(c, keep: tuple[str, ...] = ()) -> Column:
    """A cue without a first or last line that looks like a station mark, and without a trailing capital token.

    A mark is a line of at most three words, 80 % of its letters capitals, all
    ASCII.  Only texts that keep CJK are changed."""
    lines = F.split(col(c), "\n")
    shape = lambda x: F.lit(True) & x.rlike(r"^[\x20-\x7E]+$") & (F.size(F.split(F.trim(x), r"\s+")) <= 3) & (F.regexp_count(x, F.lit("[A-Z]")) >= 0.8 * F.regexp_count(x, F.lit("[A-Za-z]"))) & x.rlike("[A-Z]") & ~F.trim(x).isin(*(keep or ("",)))
    first, last = F.element_at(lines, 1), F.element_at(lines, -1)
    body = F.when(shape(first), F.slice(lines, 2, F.size(lines))).otherwise(lines)
    body = F.when((F.size(body) > 1) & shape(last), F.slice(body, 1, F.greatest(F.lit(1), F.size(body) - 1))).otherwise(body)
    text = F.regexp_replace(F.array_join(body, "\n"), r"(?<=[^A-Za-z\s])\s*[A-Z]{2,8}$", "")
    return F.when((F.size(lines) >= 1) & contains_cjk(text), text).otherwise(col(c))
