import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from test_corpus_operators import plain_targets
from test_jaccard_join import shingles

from cuelake.llm.token_file import tokenizer_path as token_path

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages_keep_columns_and_agree_with_operators(spark):
    import corpus_pipeline as P
    from cuelake.llm.common import cut
    from cuelake.llm.decontaminate import contamination
    from cuelake.llm.jaccard_join import similarity_components
    from cuelake.llm.mixing import mix

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(P.STAGES)
    one = cut(stages["toxicity"](spark, docs, SF))
    two = cut(stages["ngram_jaccard_join"](spark, one, SF))
    three = cut(stages["benchmark_decontamination"](spark, two, SF))
    four = cut(stages["source_mixing"](spark, three, SF))
    assert one.columns == two.columns == three.columns == four.columns == docs.columns
    ids = lambda d: sorted(r.doc_id for r in d.collect())
    assert ids(two) == ids(similarity_components(one).where("doc_id = component_id"))
    assert ids(three) == ids(contamination(two, spark.read.parquet(f"{SF}/benchmark.parquet")).where("not contaminated"))
    assert ids(four) == sorted(r.doc_id for r in mix(three).collect() for _ in range(r.copies))
    last = stages["token_file"](spark, four, SF)
    assert ids(last) == ids(four)


def hard_rows():
    """Nulls, an empty and a very long text, repeated rows, one doc_id with two texts, near copies, a contaminated row without a doc_id."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    passage = " ".join(f"benchword{i}" for i in range(30))
    rows = []
    for i in range(120):
        w = [word() for _ in range(r.choice([15, 40, 90]))]
        if i % 6 == 0:
            w[3:6] = ["zorgle", "blarkun", "zorgle"]  # toxic by its labels
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 1))
    near = rows[1][1].split()
    rows += [(200, " ".join(near[:-1] + ["other"]), "en", "s0", 1), (201, rows[1][1], "en", None, 1), (1, rows[1][1], "en", "s1", 1), (1, "another text of id one " + word(), None, "s1", 1)]
    rows += [(None, passage, "en", "s0", 1), (300, passage + " tail", "en", "s2", 1), (None, None, None, None, None), (301, None, "en", "s0", 0), (302, "", "en", "s0", 0), (302, "", "en", "s0", 0), (303, " ".join(word() for _ in range(30_000)), "en", "s1", 9)]
    return rows, passage


def test_stages_on_hard_rows(spark, tmp_path):
    """Each stage's decisions, worked out here in plain Python from its input."""
    import corpus_pipeline as P
    from cuelake.llm.common import cut

    rows, passage = hard_rows()
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    folder = str(tmp_path)
    spark.createDataFrame([(i, 1, int("zorgle" in t)) for i, t, *_ in rows[:120]], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("b", passage)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    extra = [f"{k} as {c}" for k, c in enumerate(("node", "row", "copies", "score", "size", "key", "_away", "_hash", "_text_hash", "windows", "tie", "group", "n_words"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *extra)
    stages = dict(P.STAGES)
    plain = lambda d: [(r.doc_id, r.text, r.source) for r in d.collect()]
    one = cut(stages["toxicity"](spark, docs, folder))
    kept = plain(one)
    assert one.columns == docs.columns and not any(t and "zorgle" in t for _, t, _ in kept) and len(kept) > 105
    two = cut(stages["ngram_jaccard_join"](spark, one, folder))
    sets = [(i, t, s, shingles(t)) for i, t, s in kept]
    assert two.columns == docs.columns and Counter(plain(two)) == Counter(first_of_groups(sets))
    three = cut(stages["benchmark_decontamination"](spark, two, folder))
    clean = [x for x in plain(two) if not (x[1] and "benchword7" in x[1])]
    assert three.columns == docs.columns and Counter(plain(three)) == Counter(clean) and len(clean) < len(plain(two))
    four = cut(stages["source_mixing"](spark, three, folder))
    words = lambda t: len((t or "").split())
    taken, size = Counter(), Counter()
    for i, t, s in plain(four):
        taken[s] += words(t)
    for i, t, s in clean:
        size[s] += words(t)
    assert four.columns == docs.columns and set(plain(four)) <= set(clean)
    # s1 holds a text that is longer than what is wanted of it
    target = plain_targets(size)
    assert all(abs(taken[s] - target[s]) <= 0.06 * target[s] + 1 for s in ("s0", "s2")) and max(taken[s] - 2 * size[s] for s in size) <= 0
    last = stages["token_file"](spark, four, folder)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_path())
    want = Counter((i, len(tok.encode(t or "").ids) + 1, zlib.crc32(np.array(tok.encode(t or "").ids + [0], "<u4").tobytes())) for i, t, _ in plain(four))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in last.collect()) == want and names[0] in last.columns


def first_of_groups(sets):
    """Rows that stay: one of each group of linked rows, by smallest doc_id; rows without a shingle or doc_id all."""
    stay = [(i, t, s) for i, t, s, own in sets if i is None or not own]
    rows = [x for x in sets if x[0] is not None and x[3]]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][3], rows[b][3]
            if 100 * len(x & y) >= 75 * len(x | y):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    for g in set(group):
        i, t, s, _ = min((rows[k] for k in range(len(rows)) if group[k] == g), key=lambda r: r[0])
        stay.append((i, t, s))
    return stay


def test_empty_tables(spark):
    import corpus_pipeline as P

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    if os.path.isdir(SF):
        for name, stage in P.STAGES:
            assert stage(spark, docs, SF).count() == 0
