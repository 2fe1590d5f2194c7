import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.operators import aggregates as A
from cuelake.operators import editor as ED
from cuelake.operators import filters as FL
from cuelake.operators import joins as J
from cuelake.operators import matching as M
from cuelake.operators import sets as S
from cuelake.operators import spatial as SP
from cuelake.operators import speech as SPEECH
from cuelake.operators import topk as K
from cuelake.operators import translation as TR
from cuelake.operators import windows as N


def one(spark, expr, value="x"):
    return spark.createDataFrame([(value,)], "v string").select(expr).first()[0]


@pytest.mark.parametrize(
    "f, value, want",
    [
        (T.cjk_count, "a你b好", 2), (T.effective_length, "你 a", 3), (T.cjk_ratio, " ", 0.0), (T.syllables, "你好 two words", 4), (T.soften_capitals, "HELLO THERE", "Hello there"), (T.strip_markup, "<i>a</i>{\\an8}b", "ab"),
        (T.drop_spans, "(x) hi [y] ♪la♪ there", "hi there"), (T.is_sound_effect, "[door]", True), (T.parse_time, "1:02:03,5", 3723.5), (T.parse_time, "02:03.25", 123.25), (T.parse_time, "x", None), (T.untranslatable, "John 42", True), (T.untranslatable, "he runs", False),
        (T.natural_key, "a10", "a" + "10".rjust(20, "0")), (T.repair_newlines, "a\\nb", "a\nb"), (T.trim_cjk_punctuation, "，你好。", "你好"), (T.series_key, "/m/My Show S01E02.mkv", "my show"),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, f("v"), value) == want


def test_times_and_scores(spark):
    df = spark.createDataFrame([(3661.0015,)], "t double")
    assert df.select(T.srt_time("t"), T.ass_time("t"), T.display_time("t")).first() == ("01:01:01,002", "1:01:01.00", "01:01:01.001")
    pairs = spark.createDataFrame([("金丹后期", "一金丹后期"), ("好 啊！", "好啊"), ("", "x"), ("", "")], "a string, b string")
    assert [r[0] for r in pairs.select(T.cer("a", "b")).collect()] == [0.25, 0.0, 1.0, 0.0]
    g = spark.createDataFrame([("a=b",), ("x -> y",), ("# no",), ("none",)], "v string").select(T.glossary_entry("v").alias("g")).collect()
    assert [tuple(r.g) if r.g else None for r in g] == [("a", "b"), ("x", "y"), None, None]


def test_hallucinations(spark):
    df = spark.createDataFrame([("aaaa",), ("Thanks for watching!",), ("hello",)], "v string")
    assert [r[0] for r in df.select(T.hallucinated("v", ["thanks for watching"])).collect()] == [True, True, False]


def test_interval_join_equals_brute_force(spark):
    r = np.random.default_rng(3)
    mk = lambda n, p: [(int(k % 2), i, float(s), float(s + w)) for i, (k, s, w) in enumerate(zip(r.integers(0, 2, n), r.uniform(0, 100, n).round(1), r.uniform(0, 30, n).round(1)))]
    a, b = mk(60, "a"), mk(60, "b")
    A_, B_ = spark.createDataFrame(a, "k int, i int, a0 double, a1 double"), spark.createDataFrame(b, "k int, j int, b0 double, b1 double")
    got = sorted((x.i, x.j) for x in J.interval_join(A_, B_, ["k"], ("a0", "a1"), ("b0", "b1"), 7.0).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
    got = sorted((x.i, x.j) for x in J.interval_join(A_, B_, ["k"], ("a0", "a1"), ("b0", "b1"), 7.0, closed=True, reach=2.0).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] <= y[3] + 2 and y[2] - 2 <= x[3])


def test_asof_and_snap(spark):
    ev = spark.createDataFrame([("v", 0.0, 1.0), ("v", 2.0, 3.0)], "v string, s double, e double")
    pts = spark.createDataFrame([("v", 0.5), ("v", 1.5), ("v", 3.0), ("v", -1.0)], "v string, t double")
    found = {r.t: (r.asof_s if r.asof_e is not None and r.t <= r.asof_e else None) for r in J.asof_join(pts, ev, ["v"], "t", "s", ["e"]).collect()}
    assert found == {0.5: 0.0, 1.5: None, 3.0: 2.0, -1.0: None}
    edges = ev.select("v", F.explode(F.array("s", "e")).alias("edge"))
    snapped = {r.t: r.snapped for r in J.nearest_edge(pts, edges, ["v"], "t", "edge", 0.5).collect()}
    assert snapped == {0.5: 0.0, 1.5: 1.0, 3.0: 3.0, -1.0: None}


def test_merge_intervals(spark):
    df = spark.createDataFrame([("v", 0.0, 1.0), ("v", 1.8, 3.0), ("v", 5.0, 6.0)], "v string, s double, e double")
    assert sorted((r.s, r.e, r.n) for r in N.merge_intervals(df, ["v"], "s", "e", 1.0).collect()) == [(0.0, 3.0, 2), (5.0, 6.0, 1)]


def test_by_line_and_bilingual(spark):
    lines = spark.createDataFrame([("j", 1, "a"), ("j", 2, "b"), ("j", 3, "c")], "j string, n int, text string")
    ans = spark.createDataFrame([("j", 1, "A"), ("j", 9, "B"), ("j", 3, " ")], "j string, n int, text string")
    assert sorted(r.text for r in J.merge_by_line(lines, ans, ["j"], "n", "text").collect()) == ["A", "B", "c"]
    assert sorted(r.text for r in J.bilingual(ans, lines, ["j", "n"], "text").where("n <> 3").collect()) == ["A\na", "B"]


def test_glossary_and_flags(spark):
    lines = spark.createDataFrame([("The sword fell", "La spada cadde"), ("a Sword", "una lama")], "s string, t string")
    g = spark.createDataFrame([("sword", "spada")], "source_term string, target_term string")
    assert [r.s for r in J.glossary_violations(lines, g, "s", "t").collect()] == ["a Sword"]
    pairs = spark.createDataFrame([("j", 1, "this is all the same", "this is all the same"), ("j", 2, "text", "   "), ("j", 3, "x" * 100, "abcd"), ("j", 4, "one two three four five", "abcd")], "j string, n int, s string, t string")
    got = {r.n: (r.identical, r.empty, r.odd_length, r.repeats_previous) for r in A.quality_flags(pairs, ["j"], ["n"], "s", "t").collect()}
    assert got == {1: (True, False, False, False), 2: (False, True, False, False), 3: (False, False, True, False), 4: (False, False, True, True)}


def test_under_translation(spark):
    rows = [("j", i, "x" * 20, "y" * 58) for i in range(12)] + [("j", 99, "x" * 20, "yyyyy")]
    df = spark.createDataFrame(rows, "j string, n int, s string, t string")
    assert [r.n for r in A.under_translated(df, ["j"], "s", "t").collect()] == [99]
    assert A.under_translated(df.limit(1), ["j"], "s", "t").count() == 0


def test_score_and_reports(spark):
    truth = spark.createDataFrame([("v", 0, "你好", 0.0, 1.0), ("v", 1, "再见", 2.0, 3.0)], "v string, t int, tt string, t_start double, t_end double")
    built = spark.createDataFrame([("v", 0, "你好", 0.0, 1.0), ("v", 1, "再見", 2.0, 3.0), ("v", 2, "多余", 5.0, 6.0)], "v string, b int, bt string, b_start double, b_end double")
    m = J.best_overlap(truth, built, ["v"], 5, 0.05, "t", "b").withColumns({"hit": F.col("b").isNotNull(), "err": T.cer("tt", "bt")}).withColumn("same", F.col("err") == 0)
    counts = built.groupBy("v").count().withColumnRenamed("count", "built").join(m.groupBy("v").agg(F.countDistinct("b").alias("used")), "v")
    s = A.subtitle_score(m, counts, ["v"], "same", "err", "hit").first()
    assert (s.matched, s.exact, s.spurious, s.mean_cer) == (2, 1, 1, 0.25)
    f1 = A.boundary_f1(truth.selectExpr("v", "t_start as start_sec"), built.selectExpr("v", "b_start as start_sec"), ["v"], 0.1).first()
    assert (f1.recall, round(f1.precision, 3)) == (1.0, 0.667)
    q = A.quality_report(spark.createDataFrame([("v", 0.0, False, 0.9), ("v", 0.5, True, 0.5), ("v", None, False, 0.8)], "v string, best_cer double, garbage boolean, confidence double"), ["v"]).first()
    assert (round(q.recall, 3), q.p90_cer, q.p25_confidence) == (0.667, 0.5, 0.5)
    c = A.ceiling(spark.createDataFrame([("v", True, True), ("v", False, True), ("v", False, False)], "v string, built_right boolean, frame_right boolean"), ["v"]).first()
    assert (c.achieved, c.recoverable, c.input_limited) == (1, 1, 1)


def test_greedy_match_and_overlaps(spark):
    r = spark.createDataFrame([("v", 0, "a", 0.0, 2.0), ("v", 1, "b", 1.0, 3.0)], "v string, r_idx int, r_text string, r_start double, r_end double")
    f = spark.createDataFrame([("v", 0, "a", 0.0, 2.2), ("v", 1, "b", 50.0, 51.0)], "v string, f_idx int, f_text string, f_start double, f_end double")
    assert [(x.r_idx, x.f_idx) for x in M.greedy_match(r, f, ["v"]).collect()] == [(0, 0)]
    d = spark.createDataFrame([("v", 0, 0.0, 2.0, 0.7), ("v", 1, 0.1, 2.0, 0.9), ("v", 2, 5.0, 6.0, 0.1)], "v string, k int, s double, e double, w double")
    assert sorted(x.k for x in M.overlapping_duplicates(d, ["v"], "k", "s", "e", "w").collect()) == [1, 2]


def test_box_filters(spark):
    box = "struct<text:string,confidence:double,polygon:array<struct<x:int,y:int>>>"
    rows = [("v", 0, 0.0, [("...", 0.9, []), ("hello", 0.9, [])]), ("v", 1, 0.1, [("7", 0.5, [])]), ("v", 2, 0.2, [("你好吗", 0.9, []), ("BOR", 0.9, []), ("OK", 0.9, [])])]
    df = spark.createDataFrame(rows, f"video_id string, frame_index int, timestamp_sec double, boxes array<{box}>")
    got = {r.frame_index: [b.text for b in r.boxes] for r in FL.clean_boxes(df).collect()}
    assert got == {0: ["hello"], 2: ["你好吗", "OK"]}
    assert sorted(r.frame_index for r in FL.confident_frames(df, 0.8).collect()) == [0, 2]


def test_y_outliers(spark):
    df = spark.createDataFrame([("v", i, 100.0) for i in range(7)] + [("v", 7, 900.0)], "video_id string, frame_index int, y double")
    assert FL.y_outliers(df).count() == 7
    assert FL.y_outliers(df.limit(3)).count() == 3


def test_cue_filters(spark):
    df = spark.createDataFrame([("v", 1, "你好世界", 0.0, 1.0, 0.9, 9), ("v", 2, "7", 1.1, 1.2, 0.9, 2), ("v", 3, "你好世", 1.3, 1.4, 0.9, 2), ("v", 4, "BORX", 3.0, 4.0, 0.9, 9), ("v", 5, "再见", 5.0, 6.0, 0.9, 9), ("v", 6, "吃", 7.0, 7.1, 0.5, 1)], "video_id string, idx int, text string, start_sec double, end_sec double, confidence double, frame_count int")
    assert sorted(r.idx for r in FL.flash_fragments(df).collect()) == [1, 4, 5]
    assert 4 not in {r.idx for r in FL.pure_latin_marks(df, 0.6).collect()}
    assert 6 not in {r.idx for r in FL.short_texts(df).collect()}


def test_plans(spark):
    df = spark.createDataFrame([("v", 100.0), ("w", 10.0)], "v string, dur double")
    got = sorted((r.v, r.chunk, r.start_sec, r.end_sec) for r in FL.chunk_plan(df, "dur", 40.0).collect())
    assert got[0][:3] == ("v", 0, 0.0) and got[2][3] == 100.0 and got[3] == ("w", 0, 0.0, 10.0)
    p = FL.probe_window(df, "dur", 30.0).collect()
    assert [(r.start_sec, r.end_sec) for r in p] == [(35.0, 65.0), (0.0, 10.0)]
    b = spark.createDataFrame([("a", 1920, 1080, False, (10, 10, 100, 50)), ("b", 960, 540, False, (10, 10, 100, 50)), ("c", 960, 540, True, (1, 1, 1, 1)), ("d", None, None, False, None)], "v string, video_width int, video_height int, done boolean, roi struct<x:int,y:int,w:int,h:int>")
    got = {r.v: (r.status, tuple(r.roi) if r.roi else None) for r in FL.batch_status(b, 1920, 1080).collect()}
    assert got["a"] == ("READY", (10, 10, 100, 50)) and got["b"] == ("ROI_SCALED", (5, 5, 50, 25)) and got["c"][0] == "SKIPPED" and got["d"] == ("INVALID", None)
    issues = FL.preflight(spark.createDataFrame([("a", None, 0.0, 1.0, 0.5)], "video_id string, roi string, duration_sec double, sample_step_sec double, min_confidence double"))
    assert {r.issue for r in issues.collect()} == {"no_region", "no_duration", "coarse_step"}
    r = FL.empty_result_reason(spark.createDataFrame([("a", 5, 3, 0, 0, 0)], "video_id string, frames int, with_text int, confident int, grouped int, kept int")).first()
    assert r.reason == "nothing_left_at_confident"


def boxes(spark):
    rows = [("v", f, f * 0.1, 100.0 + dx, y, 300.0 + dx, y + 20, 0.95, "t") for f in range(10) for dx, y in ((0, 500.0), (5, 530.0))] + [("v", 3, 0.3, 0.0, 0.0, 4.0, 4.0, 0.9, "x")]
    return spark.createDataFrame(rows, "video_id string, frame_idx int, timestamp_sec double, x_min double, y_min double, x_max double, y_max double, confidence double, text string")


def test_spatial(spark):
    b = boxes(spark)
    assert FL.box_anomalies(b, 640).count() == 20 and FL.size_outliers(b).count() == 20 and FL.off_margin(b, 640, 600).count() == 21
    band = SP.dominant_band(b, 600.0).first()
    assert band.y_low >= 500 and band.y_high <= 560
    c = SP.heat_clusters(b)
    assert [(r.cx0 < 101, r.cx1 > 299) for r in c.collect()] == [(True, True)]
    lab = SP.density_clusters(b, 50.0, 40.0).groupBy("cluster").count().collect()
    assert {(r.cluster, r["count"]) for r in lab} == {(0, 20), (-1, 1)}
    st = SP.cluster_stats(SP.density_clusters(b, 50.0, 40.0).where("cluster >= 0")).first()
    assert (st.orientation, st.frames) == ("HORIZONTAL", 10)
    assert SP.best_region(SP.cluster_stats(SP.density_clusters(b, 50.0, 40.0)), 600.0).first().cluster == 0
    m = SP.merge_clusters(spark.createDataFrame([("v", 0, 0.0, 0.0, 10.0, 10.0), ("v", 1, 12.0, 0.0, 20.0, 10.0), ("v", 2, 100.0, 100.0, 110.0, 110.0)], "video_id string, cluster int, cx0 double, cy0 double, cx1 double, cy1 double"), 5.0)
    assert sorted((r.cx0, r.cx1, r.merged) for r in m.collect()) == [(0.0, 20.0, 2), (100.0, 110.0, 1)]
    p = {r.y: r.cover for r in SP.density_profile(b).collect()}
    assert p[500] == 10 and p[520] == 0 and p[550] == 0
    rb = SP.refined_band(b).first()
    assert rb.peak > 0
    rank = SP.reading_order(b.where("frame_idx = 3"), ["video_id"], 12.0).orderBy("rank").collect()
    assert [r.y_min for r in rank] == [0.0, 500.0, 530.0]
    hit = SP.density_cluster(b, spark.createDataFrame([("v", 0, 0.0, 490.0, 640.0, 600.0)], "video_id string, cluster int, cx0 double, cy0 double, cx1 double, cy1 double"))
    assert hit.where("cluster = 0").count() == 20
    q = SP.region_quality(b, spark.createDataFrame([("v", 490.0, 560.0)], "video_id string, y_low double, y_high double")).first()
    assert 0 < q.score < 1


def test_lines():
    b = [(100, 0, 150, 10, "b"), (0, 1, 50, 11, "a"), (0, 40, 50, 50, "你"), (60, 41, 90, 51, "好")]
    assert [[b[i][4] for i in line] for line in SP.lines_of(b)] == [["a", "b"], ["你", "好"]]
    assert SP.smart_join(["你", "好"]) == "你好" and SP.smart_join(["a", "", "b"]) == "a b"


def test_density_scan_by_brute_force():
    r = np.random.default_rng(0)
    pts = np.concatenate([r.normal(0, 1, (40, 2)), r.normal(20, 1, (40, 2)), [[100, 100]]])
    lab = SP.density_scan(pts, (2.0, 2.0), 4)
    assert len(set(lab[:40])) <= 2 and lab[80] == -1 and set(lab[:40]).isdisjoint(set(lab[40:80]) - {-1})


def test_speech(spark):
    rows = [("v", 1, 0.0, 1.0, 1.5), ("v", 2, 1.1, 2.0, 0.5), ("v", 3, 5.0, 6.0, 0.9)]
    out = SPEECH.schedule(spark.createDataFrame(rows, "video_id string, idx int, start_sec double, end_sec double, spoken_sec double")).orderBy("idx").collect()
    assert out[1].out_start >= out[0].out_end and out[2].drift == 0 and all(SPEECH.SLOWEST <= r.speed <= SPEECH.FASTEST for r in out)
    words = [("Hello", 0.0, 0.4), ("there.", 0.4, 0.8), ("How", 1.0, 1.2), ("are", 1.2, 1.4), ("you", 1.4, 1.6)]
    assert [s[0] for s in SPEECH.split_words(words)] == ["Hello there.", "How are you"]
    many = SPEECH.split_words([(f"word{i}", i * 0.3, i * 0.3 + 0.25) for i in range(60)])
    assert all(len(t) <= 50 and e - s <= 4.5 for t, s, e in many) and sum(len(t.split()) for t, _, _ in many) == 60
    df = spark.createDataFrame([("v", 0, "a", None, 0.5), ("v", 1, "b.", None, None), ("v", 2, "c", 2.0, None)], "v string, pos int, word string, start double, end double")
    assert [r.text for r in SPEECH.sentences(df, ["v"]).orderBy("idx").collect()] == ["a b.", "c"]


CUES = "video_id string, idx int, text string, start_sec double, end_sec double, confidence double, frame_count int, uid string"


def test_editor(spark):
    c = spark.createDataFrame([("v", 1, "one, two", 0.0, 2.0, 0.8, 4, "a"), ("v", 2, "three", 3.0, 4.0, 0.6, 2, "b")], CUES)
    key = lambda *u: spark.createDataFrame([("v", x) for x in u], "video_id string, uid string")
    assert ED.delete(c, key("a")).first().idx == 1
    s = ED.split_cues(c, key("a")).orderBy("idx").collect()
    assert [r.text for r in s] == ["one,", "two", "three"] and [r.idx for r in s] == [1, 2, 3]
    m = ED.merge_cues(c, spark.createDataFrame([("v", "a", "b")], "video_id string, first_uid string, second_uid string")).collect()
    assert [(r.text, r.start_sec, r.end_sec, r.confidence) for r in m] == [("one, two three", 0.0, 4.0, 0.7)]
    assert ED.shift(c, 1.0).first().start_sec == 1.0
    with pytest.raises(Exception, match="before 0"):
        ED.shift(c, -1.0).collect()
    i = ED.insert_after(c, "v", "a", "new").orderBy("idx").collect()
    assert i[1].text == "new" and i[1].start_sec == pytest.approx(2.05) and i[1].end_sec == pytest.approx(2.95)
    r = ED.retime(c, spark.createDataFrame([("v", "b", 0.0, 0.5)], "video_id string, uid string, new_start double, new_end double")).orderBy("idx").collect()
    assert r[0].uid in ("a", "b") and r[0].start_sec == 0.0
    assert ED.replace_text(spark.createDataFrame([("<two>TWO",)], "text string"), "two", "2").first().text == "<two>2"
    u = ED.update_texts(c, spark.createDataFrame([("v", "a", "x")], "video_id string, uid string, new_text string"))
    h = ED.History(c)
    h.do(lambda _: u)
    assert h.undo() is c and h.redo() is u and u.where("uid = 'a'").first().text == "x"
    new = spark.createDataFrame([("v", 9, "n", 1.5, 3.5, 1.0, 1, "n")], CUES)
    got = sorted((x.uid, x.start_sec, x.end_sec) for x in J.replace_cues(c, new, key("zz")).collect())
    assert got == [("a", 0.0, 1.5), ("b", 3.5, 4.0), ("n", 1.5, 3.5)]


def test_sets_and_topk(spark):
    r = spark.createDataFrame([("s", 1, ["Ann", "A"]), ("s", 2, ["a", "Bo"]), ("s", 3, ["Bo"])], "s string, k int, names array<string>")
    assert sorted(x.k for x in S.merge_rosters(r, ["s"], ["k"], "names").collect()) == [1, 3]
    sent = spark.createDataFrame([("b", i) for i in range(1, 11)], "b string, n int")
    assert S.batch_verdict(sent, sent.where("n <> 3"), ["b"], "n").first().verdict == "patch"
    assert S.batch_verdict(sent, sent.where("n > 5"), ["b"], "n").first().verdict == "retry"
    assert S.merge_fields(spark.createDataFrame([("a", 1, "x"), ("a", 2, " ")], "k string, t int, o string"), ["k"], ["t"], ["o"]).first().o == "x"
    e = K.evenly_spaced(spark.createDataFrame([("v", i) for i in range(10)], "v string, i int"), ["v"], ["i"], 4)
    assert sorted(x.i for x in e.collect()) == [0, 3, 6, 9]
    lines = spark.createDataFrame([("j", 1, "red car stops"), ("j", 2, "zzz")], "job string, idx int, source string")
    mem = spark.createDataFrame([("red car", "rot"), ("blue sky", "blau")], "source_text string, target_text string")
    assert [x.source_text for x in K.job_references(lines, mem, ["job"]).collect()] == ["red car"]
    plan = spark.createDataFrame([("s", 0), ("s", 1)], "signature string, chunk int")
    assert S.cached_plan(plan, "s", 2, "chunk").count() == 2 and S.cached_plan(plan, "s", 3, "chunk").count() == 0


def test_translation(spark):
    lines = spark.createDataFrame([("j", 1, "你好"), ("j", 2, "..."), ("j", 3, "再见")], "j string, n int, text string")
    kept = TR.without_noise(lines, ["j"], "n", "text", True)
    ans = spark.createDataFrame([("j", 1, "hello"), ("j", 2, "bye")], "j string, dense_no int, text string")
    assert [r.text for r in TR.put_back(lines, kept, ans, ["j"], "n", "text").orderBy("n").collect()] == ["hello", "...", "bye"]
    w = TR.patch_windows(spark.createDataFrame([("j", 3, 20), ("j", 5, 20), ("j", 15, 20)], "j string, n int, last int"), ["j"], "n", 1, "last")
    assert sorted((r.first_line, r.last_line) for r in w.collect()) == [(2, 6), (14, 16)]
    names = spark.createDataFrame([("bob", "Robert"), ("al", "Albert")], "alias string, name string")
    got = TR.canonical_names(spark.createDataFrame([("Bob & Al",), ("Zed",)], "speaker string"), names).collect()
    assert {r.speaker for r in got} == {"Robert & Albert", "Zed"}
    h = spark.range(1).select(TR.stage_hashes(F.lit("a"), [F.lit("x"), F.lit("y")]).alias("h"), TR.stage_hashes(F.lit("a"), [F.lit("z"), F.lit("y")]).alias("g")).first()
    assert h.h[1] != h.g[1]


def test_margin_marks_and_samples(spark):
    df = spark.createDataFrame([("BOR TV\n你好世界",), ("你好世界\nCIACA",), ("你好 ABC",), ("ONLY LATIN\nhere",), ("你好",)], "v string")
    assert [r[0] for r in df.select(T.strip_margin_marks("v")).collect()] == ["你好世界", "你好世界", "你好", "ONLY LATIN\nhere", "你好"]
    s = spark.createDataFrame([("v", t) for t in (0.0, 0.4, 1.1, 1.9, 2.2)], "v string, t double")
    assert sorted(r.t for r in N.drifting_sample(s, ["v"], "t", 1.0).collect()) == [0.0, 1.1, 2.2]
    assert sorted(r.b for r in N.step_sample(s.withColumn("b", F.col("t")), ["v"], "t", 1.0, "b").collect()) == [0.0, 1.1, 2.2]
    c = spark.createDataFrame([(0.0, 5.0), (6.0, 7.0), (9.0, 9.5)], "start_sec double, end_sec double")
    assert J.visible(c, 4.0, 6.5).count() == 2


def test_latin_gibberish_and_alignment(spark):
    df = spark.createDataFrame([("xkqz", 0.7, 1), ("River", 0.9, 9), ("TV", 0.5, 1), ("aBCd", 0.6, 1), ("你好", 0.2, 1)], "t string, c double, n int")
    assert [r[0] for r in df.select(FL.latin_gibberish(F.col("t"), F.col("c"), F.col("n"))).collect()] == [True, False, False, True, False]
    lines = spark.createDataFrame([(400.0, 600.0, "middle text", 0.95), (0.0, 120.0, "left text", 0.95), (0.0, 1100.0, "too wide", 0.95), (350.0, 560.0, "a", 0.95)], "x0 double, x1 double, text string, confidence double")
    assert [r.text for r in FL.aligned_lines(lines, 0.0, 1000.0).collect()] == ["middle text"]
    assert [r.text for r in FL.aligned_lines(lines, 0.0, 1000.0, "LEFT").collect()] == ["left text"]


def test_rescued_stacks(spark):
    rows = [("v", f, 100, 500, 300, 520, True) for f in range(5)] + [("v", 9, 100, 480, 300, 500, False), ("v", 9, 110, 505, 290, 525, False), ("v", 9, 0, 10, 20, 20, False)]
    b = spark.createDataFrame(rows, "video_id string, frame_index int, x0 int, y0 int, x1 int, y1 int, kept boolean")
    assert sorted(r.y0 for r in FL.rescue_stacks(b, 60.0).collect()) == [480, 505]


def test_joined_text_and_coordinates(spark):
    poly = lambda x, y: [(x, y), (x + 40, y), (x + 40, y + 10), (x, y + 10)]
    df = spark.createDataFrame([("v", [("world", 0.9, poly(60, 1)), ("Hello", 0.9, poly(0, 0)), ("next", 0.9, poly(0, 40))]), ("w", [])], "video_id string, boxes array<struct<text:string,confidence:double,polygon:array<struct<x:int,y:int>>>>")
    assert {r.video_id: r.text for r in SP.joined_text(df).collect()} == {"v": "Hello world\nnext", "w": ""}
    moved = SP.to_frame_coordinates(df, 10.0, 2.0, 5, 7).where("video_id = 'v'").first().boxes[0].polygon[0]
    assert (moved.x, moved.y) == (30, 3)


def test_mixed_similarity_and_cosine(spark):
    df = spark.createDataFrame([(0.95, 0.1, False), (0.5, 1.0, True), (0.5, 1.0, False), (0.5, None, False), (0.1, 1.0, True)], "x double, s double, c boolean")
    assert [round(r[0], 6) for r in df.select(T.hybrid_similarity("x", "s", F.col("c"))).collect()] == [0.95, 0.8, 0.65, 0.5, 0.1]
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in v.select(T.cosine("a", "b")).collect()] == [0.707107, 0.0, 0.0]


def test_watermark_round_trip(spark):
    rows = [("v", i, f"line {i}\nSTATION") for i in range(8)] + [("v", 8, "STATION\n"), ("v", 9, "alone")]
    c = spark.createDataFrame(rows, "video_id string, idx int, text string")
    marks = A.watermark_lines(c, ["video_id"], "idx", "text")
    assert [r.line for r in marks.collect()] == ["STATION"]
    assert sorted(r.text for r in A.without_lines(c, marks, ["video_id"], "text").collect()) == ["alone", *(f"line {i}" for i in range(8))]


def test_tukey_needs_six(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 5, 100)] + [("b", 1.0), ("b", 500.0)], "k string, v double")
    assert sorted((r.k, r.v) for r in A.tukey_keep(df, ["k"], "v").collect())[-1] == ("b", 500.0) and A.tukey_keep(df, ["k"], "v").count() == 7


def test_merge_context(spark):
    t = "array<struct<source:string,target:string>>"
    df = spark.createDataFrame([("s", 1, "old", [("Sword", "a")]), ("s", 2, " ", [("sword", "b"), ("Bow", "c")])], f"s string, t int, overview string, terms {t}")
    r = TR.merge_context(df, ["s"], ["t"]).first()
    assert r.overview == "old" and [(x.source, x.target) for x in r.terms] == [("Sword", "a"), ("Bow", "c")]
