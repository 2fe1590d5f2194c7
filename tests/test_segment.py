import pytest

from cuelake.config import CueParams
from cuelake.functions import similarity as S
from cuelake.operators import segment as G
from cuelake.operators.consensus import Votes, anchor, vote

P = CueParams(similarity=0.85, least_duration=0.0, merge_gap=0.5)


def frames(*rows, conf=0.9):
    return [G.Frame(r[0], r[1], r[2] if len(r) > 2 else conf) for r in rows]


def cue(text, a, b, conf=0.9, n=5):
    return G.Cue(text, a, b, conf * n, n)


def test_same_text_is_one_cue():
    out = G.build(frames((0, "River bank"), (0.1, "River bank"), (0.2, "River bank")), P)
    assert [(c.text, c.frames) for c in out] == [("River bank", 3)]


def test_gap_and_text_split():
    assert len(G.build(frames((0, "Line A"), (0.1, "Line A"), (5.0, "Line A")), P.with_(merge_gap=0.2))) == 2
    assert len(G.build(frames((0, "first sentence"), (0.1, "wholly other words here")), P.with_(merge_gap=10))) == 2


def test_low_confidence_frames_go():
    out = G.build(frames((0, "noise", 0.3), (0.5, "valid", 0.95)), P.with_(least_confidence=0.7))
    assert [c.text for c in out] == ["valid"]


@pytest.mark.parametrize("conf, n", [(0.5, 0), (0.95, 1)])
def test_short_cue(conf, n):
    p = P.with_(least_duration=1.0)
    out = G.absorb_flickers([cue("important", 0, 0.001, conf, 1)], p)
    assert len(out) == n and all(c.length >= 1.0 for c in out)


def test_path():
    p = P.with_(open_cost=10)
    assert G.path_labels(frames((0, "River"), (5, "River")), p) == [0, 1]
    assert G.path_labels(frames((0, "River"), (0.1, "River"), (0.2, "River")), P.with_(open_cost=1.0)) == [0, 0, 0]
    assert G.path_labels([], P) == [] and G.path_labels(frames((0, "x")), P) == [0]


def test_path_is_cheapest_by_brute_force():
    texts = ["abcd", "abce", "abcd", "xyzw", "xyzw", "abcd"]
    fs = frames(*((i * 0.1, t, 0.5 + 0.05 * i) for i, t in enumerate(texts)))
    labels = G.path_labels(fs, P)
    assert labels == sorted(labels) and len(set(labels)) == 3


def flick(p, *cues):
    return G.absorb_flickers(list(cues), p)


def test_flickers():
    p = P.with_(least_duration=0.5, flicker_similarity=0.7, merge_gap=0.6)
    out = flick(p, cue("River", 0, 1), cue("Rivr", 1.0, 1.1), cue("Stone", 1.6, 2.6))
    assert len(out) == 2 and out[0].end == 1.1
    q = p.with_(least_duration=0.3)
    assert len(flick(q, cue("River", 0, 1), cue("QQZ", 5, 5.04, 0.5), cue("Stone", 10, 11))) == 2
    assert len(flick(q, cue("了", 1, 1, 0.5), cue("River", 2, 3))) == 1
    out = flick(p, cue("River", 0, 1), cue("QQZ", 5, 5.12), cue("Stone", 10, 11))
    assert len(out) == 3 and out[1].length >= 0.5
    out = flick(p.with_(least_duration=1.0, flicker_similarity=0.95, merge_gap=0.1), cue("QQZ", 5, 5.4), cue("Stone", 5.7, 6.6))
    assert out[0].end < 5.7
    assert len(flick(p.with_(least_duration=0), cue("a", 0, 0.01))) == 1


def test_overlapping_regions():
    out = G.drop_overlapping([cue("same", 0, 2, 0.7), cue("same", 0.1, 2, 0.9)])
    assert len(out) == 1 and out[0].conf == pytest.approx(0.9)


def test_variants_split():
    member = [(i * 0.1, "舒服吗") for i in range(8)] + [(0.8 + i * 0.1, "舒服") for i in range(8)]
    out = G.split_variants([G.Cue("舒服吗", 0, 1.5, 14, 16, member)])
    assert [c.text for c in out] == ["舒服吗", "舒服"]
    member = [(i * 0.1, "好的AB") for i in range(8)] + [(0.8 + i * 0.1, "好的") for i in range(8)]
    assert len(G.split_variants([G.Cue("好的", 0, 1.5, 14, 16, member)])) == 1


def test_echoes():
    strong, weak = cue("吩咐下去", 0, 1, 0.9, 10), cue("小分下去", 1.1, 1.2, 0.5, 2)
    assert len(G.absorb_echoes([strong, weak], P)) == 1
    assert len(G.drop_echoes([cue("Rivers", 0, 1, 0.95), cue("River", 1.1, 1.15, 0.8, 1)], P)) == 1


def test_repeats_and_timeline():
    out = G.merge_repeats([cue("abc def", 0, 1), cue("abc def", 1.2, 2)], P)
    assert len(out) == 1 and out[0].end == 2
    out = G.fix_timeline([cue("a", 0, 1.1), cue("b", 1.0, 2.0)])
    assert out[0].end == pytest.approx(1.049) and out[1].start == pytest.approx(1.051)
    assert len(G.merge_similar([cue("hello there", 0, 1), cue("hello ther", 1.1, 2), cue("zzz", 9, 10)])) == 2


def test_padding():
    out = G.to_cues([cue("a", 0, 1), cue("b", 1.05, 2)], P.with_(padding=0.2))
    assert out[0].end == pytest.approx(1.049) and out[1].end == pytest.approx(2.2)


def test_consensus():
    assert vote([("hello world", 0.9), ("hello world", 0.8), ("hallo world", 0.7)]) == "hello world"
    assert vote([("helo world", 0.9), ("hello wrld", 0.9), ("hallo world", 0.9)]) in {"hello world", "helo world", "hallo world"}
    assert vote([]) == "" and vote([(" ", 1.0)]) == ""
    assert anchor([("abc", 0.9), ("abc", 0.9), ("abcdefgh", 0.95)]) == "abc"


PAIRS = ["", "a", "Hello", "Helo", "你好", "您好", "École à", "ecole a", "了", "😀b", "abcdefghij", "abc", "River bank"]


@pytest.mark.parametrize("f", [S.indel_ratio, S.jaro_winkler, S.builder_similarity, S.path_similarity, S.token_set_ratio, S.partial_ratio])
def test_symmetry_and_bounds(f):
    top = 100.0 if f in (S.token_set_ratio, S.partial_ratio) else 1.0
    for a in PAIRS:
        for b in PAIRS:
            assert f(a, b) == pytest.approx(f(b, a)), (a, b)
            assert 0 <= f(a, b) <= top
        if a:
            assert f(a, a) == top and f(a, "") == 0


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_lcs_and_edits_by_brute_force():
    import random

    r = random.Random(1)
    for _ in range(500):
        a, b = ("".join(r.choice("abc你é") for _ in range(r.randrange(9))) for _ in range(2))
        assert S.lcs_length(a, b) == lcs(a, b)
        chars, ops = list(a), S.edit_operations(a, b)
        for kind, i, j in reversed(ops):
            if kind == "replace":
                chars[i] = b[j]
            elif kind == "delete":
                del chars[i]
            else:
                chars.insert(i, b[j])
        assert "".join(chars) == b
    assert S.indel_ratio("Hello", "Helo") == pytest.approx(8 / 9)
    assert S.builder_similarity("你好", "再好") < 0.6


def test_frames_to_cues_is_independent_of_partitions(spark):
    rows = [(f"v{v}", i * 0.1 + (6.0 if i > 20 else 0), f"line {i // 7} of text" if i % 5 else f"line {i // 7} of txt", 0.9, 10.0) for v in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, G.FRAME)
    a = sorted(map(tuple, G.build_cues(df).collect()))
    b = sorted(map(tuple, G.build_cues(df.repartition(7)).collect()))
    assert a == b and len(a) > 3
    whole = G.build([G.Frame(*r[1:]) for r in rows if r[0] == "v0"], CueParams())
    assert [(c.text, c.start, c.end) for c in whole] == [(r[2], r[3], r[4]) for r in a if r[0] == "v0"]


def test_votes_one_by_one():
    """The same text after each reading as from all readings so far."""
    import random

    r = random.Random(5)
    texts = ["你好", "好", "一你好", "你一好", "你好吗", "abc", "abcd", " abc", "ab c", "", " "]
    for _ in range(500):
        readings = [(r.choice(texts[: r.randint(1, len(texts))]), r.choice([0.5, 0.86, 0.93])) for _ in range(r.randrange(12))]
        votes = Votes()
        for n, reading in enumerate(readings, 1):
            votes.add(*reading)
            assert votes.text() == vote(readings[:n])


def test_dropped_frames_beside_groups():
    dropped = [0.84, 0.91, 0.95, 1.5, 2.04, 2.1, 2.16]
    out = G.extend_into_dropped([cue("a", 1.0, 2.0), cue("b", 9.0, 9.5)], dropped, P)
    assert [(c.start, c.end) for c in out] == [(0.91, 2.1), (9.0, 9.5)]


def test_many_pieces_are_one_pass(spark):
    """Thousands of short pieces cost no group of their own, and one may go on over several Arrow batches."""
    rows = [(f"v{v}", 20.0 * k + 0.1 * i, f"line {k % 3} of text", 0.9, 0.0) for v in range(40) for k in range(25) for i in range(1 + (v + k) % 4)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        df = G.build_cues(spark.createDataFrame(rows, G.FRAME))
        assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.video_id, r.idx, r.text, r.start_sec, r.end_sec, r.frame_count) for r in df.collect())
    finally:
        spark.conf.set(key, before)
    want = []
    for v in range(40):
        cues = G.build([G.Frame(*r[1:]) for r in rows if r[0] == f"v{v}"], CueParams())
        want += [(f"v{v}", i, c.text, c.start, c.end, c.frames) for i, c in enumerate(cues, 1)]
    assert got == sorted(want) and len(got) == 1000
