"""Document quality rules, and verdicts on hosts from the share of their documents that fail each rule.

A host with few documents says little by its raw share of failures.  For each
rule a beta prior is fitted by moments to the shares of all other hosts, and a
host's rate is its posterior mean: (failures + a) / (documents + a + b).  A host
fails a rule if its rate is so far above what that prior leads to expect, and
high enough to say something about its documents.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import cut, only, small_side

LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
REPEAT_WINDOW = 5
#: The rules whose failures are counted for each host, over the columns of a document.
RULES = {
    "few_words": f"n_words < {LEAST_WORDS}",
    "repeats": f"100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
}
#: A host fails a rule if its shrunk rate is above this, and above the prior's mean by more than so many of its standard deviations.
LEAST_LIMIT, DEVIATIONS = 0.25, 3

_SYMBOLS = tk.byte_table(b"#*$%&|<>")


def repeated_words(hashes: np.ndarray, k: int = REPEAT_WINDOW) -> int:
    """Words that lie in a run of k words which the sequence holds twice or more."""
    runs = tk.grams(hashes, k)
    if len(runs) < 2:
        return 0
    order = np.argsort(runs, kind="stable")
    s = runs[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(runs), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    edge[: len(runs)] += twice
    edge[k : k + len(runs)] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(text: str) -> tuple[int, int]:
    """(\\n-split lines that hold a word and equal an earlier line, all lines that hold a word)."""
    seen, n, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            lines += 1
            n += line in seen
            seen.add(line)
    return n, lines


def _features(batches):
    for batch in batches:
        texts = batch.column("text")
        out = {k: np.zeros(len(batch), np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")}
        for first, end, data, offsets in tk.text_slices(texts):
            hashes, _, _, word_of = tk.words(data, offsets, tk.NOT_SPACE)
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])  # noqa: E731, B023
            out["n_words"][first:end] = np.diff(word_of)
            out["word_chars"][first:end] = total(tk.NOT_SPACE[data] & tk.code_points(data))
            out["n_symbols"][first:end] = total(_SYMBOLS[data])
            lines = total(data == 10)
            out["n_lines"][first:end] = np.diff(word_of) > 0
            for i in range(end - first):
                a, b = word_of[i], word_of[i + 1]
                if b - a > REPEAT_WINDOW:
                    out["n_repeat_words"][first + i] = repeated_words(hashes[a:b])
                if lines[i]:
                    out["n_dup_lines"][first + i], out["n_lines"][first + i] = duplicate_lines(texts[first + i].as_py())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *(pa.array(x) for x in out.values())], names=["doc_id", "host", *out])


def _verdict(rule: str, hosts: float, rates: float, squares: float):
    """(shrunk rate, whether the host fails the rule) as columns; given are the number of hosts with two documents or more, and the sums of their rates and squared rates."""
    own = F.col("documents") >= 2
    rate = F.col(f"failed_{rule}") / F.col("documents")
    # what the other hosts show
    n = F.lit(float(hosts)) - own.cast("int")
    mean = (F.lit(rates) - F.when(own, rate).otherwise(0.0)) / n
    var = (F.lit(squares) - F.when(own, rate * rate).otherwise(0.0)) / n - mean * mean
    inside = F.least(F.greatest(mean, F.lit(1e-3)), F.lit(1 - 1e-3))
    # hosts that are all alike make a firm prior
    strength = F.when(n < 2, 2.0).when((var <= 1e-12) | (mean <= 0) | (mean >= 1), 100.0).otherwise(F.greatest(F.lit(1e-3), inside * (1 - inside) / var - 1))
    mean = F.when(n < 2, 0.5).otherwise(inside)
    shrunk = F.round((F.col(f"failed_{rule}") + mean * strength) / (F.col("documents") + strength), 9)
    limit = mean + DEVIATIONS * F.sqrt(mean * (1 - mean) / (strength + 1))
    return shrunk, (shrunk > LEAST_LIMIT) & (shrunk > limit)


def host_verdicts(found: DataFrame) -> DataFrame:
    """(host, columns of a document) -> host, documents, rate_<rule> for each rule, host_failed: the rules that the host fails, comma-joined."""
    counted = found.groupBy("host").agg(F.count(F.lit(1)).alias("documents"), *(F.sum(F.expr(test).cast("long")).alias(f"failed_{rule}") for rule, test in RULES.items()))
    hosts = cut(counted, "hosts")
    rate = lambda rule: F.col(f"failed_{rule}") / F.col("documents")
    sums = hosts.where("documents >= 2").agg(F.count(F.lit(1)), *(F.sum(x) for rule in RULES for x in (rate(rule), rate(rule) * rate(rule)))).first()
    columns = {rule: _verdict(rule, sums[0], sums[1 + 2 * i] or 0.0, sums[2 + 2 * i] or 0.0) for i, rule in enumerate(RULES)}
    failed = F.concat_ws(",", *(F.when(bad, F.lit(rule)) for rule, (_, bad) in columns.items()))
    return hosts.select("host", "documents", *(shrunk.alias(f"rate_{rule}") for rule, (shrunk, _) in columns.items()), failed.alias("host_failed"))


def host_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, a rate of the host for each rule, host_failed.

    base_failed: fewer than 10 words, or more than 20 % of the words in repeated
    5-word windows.  kept: not base_failed, and the row's host fails no rule
    (see RULES; n_lines counts lines that hold a word).  Rows without a host
    (null) are judged as one host of their own; where fewer than two other hosts
    have two documents or more, no host fails.  A null or empty text has no
    words and fails.  An empty table gives an empty result; extra columns are
    ignored; repeated rows count and come out as often as they are there.
    """
    rows = docs.withColumn("host", F.col(f"`{host}`").cast("string")) if host in docs.columns else docs.withColumn("host", F.lit(None).cast("string"))
    rows = only(rows, doc_id="long", host="string", text="string")
    found = rows.mapInArrow(_features, "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    found = cut(found.withColumn("base_failed", F.expr(f"({RULES['few_words']}) or ({RULES['repeats']})")), "rules")
    verdict = host_verdicts(found).withColumnRenamed("host", "_host").drop("documents")
    joined = found.join(small_side(cut(verdict, "verdict")), F.col("host").eqNullSafe(F.col("_host")), "left")
    kept = ~F.col("base_failed") & (F.col("host_failed") == "")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_lines", *(f"rate_{rule}" for rule in RULES), "host_failed")
