"""The models' answers against plain versions that take one document, node, byte or neighbour at a time."""

import random

import numpy as np
import pyarrow as pa

from cuelake.llm import language_id, quality_knn, toxicity
from cuelake.llm import textkernel as tk
from cuelake.llm.common import fitted, give_back, labelled_rows, labelled_sample, with_package_path


def texts(n, seed):
    r = random.Random(seed)
    vocab = ["river", "stone", "Light", "house##", "über", "x1", "the", "$$$", "end."]
    return [" ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 12, 90]))) for _ in range(n)]


def slices(found):
    return tk.text_slices(pa.array(found))


def test_votes_by_brute_force():
    """Each text's nearest labelled vectors, found by sorting all cosines."""
    rows = [(t, int("$$$" not in t)) for t in texts(120, 1)]
    model = quality_knn.Model(rows, {0: 300, 1: 900})
    asked = texts(70, 2)
    got = np.concatenate([model.score(d, o, block=16) for _, _, d, o in slices(asked)])
    for t, score in zip(asked, got):
        ((_, _, d, o),) = slices([t])
        v = (quality_knn.term_counts(d, o)[0] * model.idf) @ model.basis
        v = v / max(np.linalg.norm(v), 1e-12)
        cosine = sorted(((float(v @ model.vectors[:, j]), j) for j in range(len(rows))), reverse=True)
        border = cosine[quality_knn.NEIGHBOURS - 1][0]
        if not t or abs(border - cosine[quality_knn.NEIGHBOURS][0]) < 1e-6:
            continue  # an empty text has a fixed score; ties at the border may be broken either way
        vote = [(max(c, 1e-6) ** quality_knn.POWER * model.weight[j], rows[j][1]) for c, j in cosine[: quality_knn.NEIGHBOURS]]
        assert abs(score - sum(w * y for w, y in vote) / sum(w for w, _ in vote)) < 1e-3


def test_terms_hold_words_and_repeats():
    (one, two), = [quality_knn.term_counts(d, o) for _, _, d, o in slices(["alpha beta", "gamma alpha"])]
    words = slice(quality_knn.TERMS - quality_knn.WORD_TERMS, None)
    assert np.allclose(one[words] ** 2 @ two[words] ** 2, 0.25) and (one[words] > 0).sum() == 2


def test_trees_by_plain_descent():
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 4)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] ** 2 > 0.7).astype(float)
    model = toxicity.Boosted(x, y, np.ones(300), trees=12)
    for row, raw in zip(x[:40], model.raw(x[:40])):
        total = model.base
        for feature, at, value in model.trees:
            node = 0
            for _ in range(model.depth):
                j = feature[node]
                node = 2 * node + 1 + (sum(c <= row[j] for c in model.cuts[j]) > at[node])
            total += value[node - (2**model.depth - 1)]
        assert abs(total - raw) < 1e-9


def test_lexicon_by_counting():
    rows = [("bad words here", 1)] * 6 + [("good words here", 0)] * 20 + [("bad bad", 1)] * 2 + [("Bad luck", 0)]
    found = toxicity.Occurrences(rows, least=2)
    use = np.arange(len(rows)) % 3 != 0
    lexicon = toxicity.Lexicon(found, use, odds=0.5)
    h = tk.words(np.frombuffer(b"bad good", np.uint8), np.array([0, 8]), tk.ALNUM, tk.LOWER_ASCII)[0]
    n1, n0 = sum(y for (_, y), u in zip(rows, use) if u), sum(1 - y for (_, y), u in zip(rows, use) if u)
    one = sum(u for (t, y), u in zip(rows, use) if y and "bad" in t.lower())
    zero = sum(u for (t, y), u in zip(rows, use) if not y and "bad" in t.lower())
    want = np.log(((one + 0.5) / (n1 + 1)) / ((zero + 0.5) / (n0 + 1)))
    assert toxicity.Lexicon.weights(lexicon.word, h).tolist() == [want, 0.0]


def test_states_and_pooling_by_plain_recurrence():
    """Every byte of a text, one after the other, in windows with the same context."""
    rows = [("the river and the stone " * 8, "en"), ("über den fluß und ünter ", "de")] * 10
    model = language_id.Model(rows, steps=5)
    text = ("the river " * 70 + "über den fluß ").encode()
    total = np.zeros(2)
    gate = lambda v: 0.5 + 0.5 * v / (1 + np.abs(v))

    def states(d, data):
        h, k, out = np.zeros(len(d.cand)), len(d.cand), []
        for b in data:
            e = d.byte[b]
            g = gate(h @ d.gates + e[: 2 * k])
            v = (g[k:] * h) @ d.cand + e[2 * k :]
            h = h + g[:k] * (v / (1 + np.abs(v)) - h)
            out.append(h)
        return np.array(out)

    pad = b" " * language_id.CONTEXT
    for s in range(0, len(text), language_id.WINDOW):
        e = min(len(text), s + language_id.WINDOW)
        lead, tail = max(0, s - language_id.CONTEXT), min(len(text), e + language_id.CONTEXT)
        # a window that is shorter than its neighbours in a batch is followed by blanks
        own = pad[: language_id.CONTEXT - (s - lead)] + text[lead:tail]
        own += b" " * (language_id.WINDOW + 2 * language_id.CONTEXT - len(own))
        both = np.concatenate([states(model.net.forward, own), states(model.net.backward, own[::-1])[::-1]], 1)
        z = both @ model.net.out + model.net.bias
        p = z - z.max(1, keepdims=True)
        p -= np.log(np.exp(p).sum(1, keepdims=True))
        total += p[language_id.CONTEXT : language_id.CONTEXT + e - s].sum(0)
    z = total / len(text) * min(len(text), 64) / 8
    want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    best, score = model.predict(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert best[0] == want.argmax() and abs(score[0] - want.max()) < 1e-3


def test_samples_are_bounded_by_documents(spark):
    """Repeated doc_ids give one text each, however many rows have them; fitting texts are whole."""
    with_package_path(spark)
    rows = [(i % 5 * 4 + 1, f"text {i}", "en") for i in range(200)] + [(77, "w " * 5000, "de"), (77, "w " * 5000, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    got, counts = labelled_sample(docs, labels, "quality", 1, 1, 50)
    assert len(got) == 6 and sum(counts.values()) == 100
    found = language_id.training_rows(docs)
    assert [len(t) for t, lang in found if lang == "de"] == [10000]


def test_toxicity_is_fitted_outside_the_driver(spark, monkeypatch):
    """The driver gets the fitted model, not the sample's texts; its answers are those of a model fitted on the sample in the driver."""
    with_package_path(spark)
    r, marked = random.Random(9), []
    for i in range(400):
        words = [f"w{r.randrange(500)}" for _ in range(30)]
        for mark in ("wretch", "vile") if i % 4 == 0 else ():
            words.insert(r.randrange(30), mark)
        marked.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in marked], "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, y) for i, _, y in marked], "doc_id long, toxic int")
    plain = toxicity.Model(*labelled_sample(docs, labels, "toxic", 4, 2, 100))
    want = {i for i, t, _ in marked for _, _, d, o in slices([t]) if plain.score(d, o)[0] < toxicity.PREDICT_AT}

    def refuse(*_):
        raise AssertionError("fitted in the driver")

    monkeypatch.setattr(toxicity.Model, "__init__", refuse)
    monkeypatch.setattr(type(docs), "toArrow", refuse)
    assert {r.doc_id for r in toxicity.drop_toxic(docs, labels, each=100).collect()} == want and 0 < len(want) < 400
    assert {r.doc_id for r in toxicity.toxicity(docs, labels, each=100).collect() if not r.predicted} == want


def test_fitted_without_labelled_rows(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert fitted(*labelled_rows(docs, none, "toxic", 4, 2, 10), lambda rows, counts: (rows, counts)) == ([], {})


def test_freed_native_memory_is_given_back(spark):
    version = spark._jvm.java.lang.Runtime.version()
    if version.feature() == 17 and version.update() >= 9:
        assert give_back(spark)
