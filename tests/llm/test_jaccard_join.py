import random
import re

import pytest

from cuelake.llm.common import with_package_path
from cuelake.llm.jaccard_join import keep_first_of_component, similarity_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(rows, num=75, den=100):
    """[(doc_id, shingles, smallest doc_id reachable, links)] row by row; rows with a doc_id only."""
    sets = [(i, shingles(t)) for i, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            both = len(s & t)
            if s and t and den * both >= num * (len(s) + len(t) - both):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(i, least.get(find(a), i))
    return sorted((i, len(s), least[find(a)], links[a]) for a, (i, s) in enumerate(sets))


def found(spark, rows):
    got = similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got)


def corpus(seed, families=12):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "日本", "\x00x", "İ"]
    passage = [r.choice(vocab) for _ in range(40)]
    rows = []
    for _ in range(families):
        base = [r.choice(vocab) for _ in range(r.choice([3, 6, 30, 80, 300]))]
        if r.random() < 0.5:
            base = passage + base
        for _ in range(r.choice([1, 2, 8, 25])):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4, 8])):
                w[r.randrange(len(w))] = r.choice(vocab)
            if r.random() < 0.2:
                w = w[: max(1, int(len(w) * 0.8))]
            rows.append(" ".join(x.upper() if r.random() < 0.1 else x for x in w))
    rows += ["", None, "  \n\t", "one", "One", "a b c d", "A  B\nC D", "x " * 5000, "x " * 9, "same line\n" * 3]
    r.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_brute_force(spark, seed):
    with_package_path(spark)
    rows = corpus(seed)
    assert found(spark, rows) == brute(rows)


def small_parts(monkeypatch):
    import cuelake.llm.common as c
    import cuelake.llm.jaccard_join as j

    # nothing is small enough for a broadcast, and three rows of one key are many
    monkeypatch.setattr(c, "small_side", lambda df: df)
    monkeypatch.setattr(j, "small_side", lambda df: df)
    monkeypatch.setattr(j, "salted_join", lambda many, few, key: c.salted_join(many, few, key, 3))
    for name, value in {"CLUSTER_SETS": 3, "PAIR_SETS": 2, "PAIR_TOKENS": 100, "LIST_PART": 4, "LIST_BLOCK": 3, "BLOCK_TOKENS": 500, "RANGE_TOKENS": 300, "TASK_TOKENS": 2_000}.items():
        monkeypatch.setattr(j, name, value)


def test_many_clusters_of_one_group(spark, monkeypatch):
    """Groups, index lists and pairs cut in small parts give the same components and links."""
    with_package_path(spark)
    small_parts(monkeypatch)
    rows = corpus(7, 8)
    assert found(spark, rows) == brute(rows)


def test_one_doc_id_with_different_texts(spark):
    """A row is told by doc_id and text: no text is lost because another row has its doc_id."""
    r = random.Random(3)
    a, b, c = (" ".join(r.choice("abcdefghij") + str(r.randrange(900)) for _ in range(60)) for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (9, b + " more"), (9, c), (9, c), (12, c + " end"), (5, "x y"), (7, "x y")]
    assert found(spark, rows) == brute(rows)
    kept = keep_first_of_component(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == sorted([(1, a), (5, b), (9, c), (5, "x y")])


@pytest.mark.parametrize("share", [0.7, 0.8, 0.86])
def test_templates_about_the_threshold(spark, monkeypatch, share):
    """All texts share most of their words; below, at and above what links them.  Index lists are as long as the table."""
    small_parts(monkeypatch)
    r = random.Random(int(share * 100))
    common = [f"c{i}" for i in range(int(100 * share))]
    rows = [(i, " ".join(common + [f"v{r.randrange(40)}_{k}" for k in range(100 - len(common))])) for i in range(60)]
    rows += [(100 + i, " ".join(rows[i][1].split()[:-2] + ["z", str(i)])) for i in range(30)]
    assert found(spark, rows) == brute(rows)


def test_nulls_repeats_empty_and_extra_columns(spark):
    rows = [(5, "a b c d e f", 1), (5, "a b c d e f", 1), (None, "a b c d e f", 2), (None, None, 3), (2, "A B C D E F", 4), (9, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles int").selectExpr("*", "1 as component_id", "2 as leader")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in similarity_components(df).collect())
    assert got == sorted([(5, 2, 2), (5, 2, 2), (-1, 2, 2), (-1, 0, None), (2, 2, 2), (9, 0, 9)], key=lambda x: (x[0], x[1]))
    kept = keep_first_of_component(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 2, 9]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert similarity_components(empty).count() == 0
    assert keep_first_of_component(empty).count() == 0
