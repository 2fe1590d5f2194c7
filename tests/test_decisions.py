"""Decision rules, quotas, levels and settings, held against plain versions or worked cases."""

import math
import random

import pytest

from cuelake.functions.similarity import partial_ratio
from cuelake.functions import text as T
from cuelake.operators import aggregates as A
from cuelake.operators import filters as FL
from cuelake.operators.consensus import restore_dropped
from cuelake.plans.search import RECOGNISER, recogniser_space
from cuelake.sources import stores
from cuelake.streaming import stateful as S


@pytest.mark.parametrize(
    "text, readings, want",
    [
        ("举两得", [("一举两得", 0.95)], "一举两得"),  # one strong reading is enough for the thin stroke
        ("举两得", [("一举两得", 0.9)], "举两得"),
        ("举两得", [("一举两得", 0.9), ("一举两得", 0.86)], "一举两得"),
        ("师姐", [("二师姐", 0.95)], "师姐"),  # other characters need more
        ("师姐", [("二师姐", 0.95), ("二师姐", 0.93)], "二师姐"),
        ("师姐", [("二师姐", 0.9)] * 4, "二师姐"),
        ("走吧", [("走吧了", 0.95)] * 2, "走吧了"),
        ("统", [("统一", 0.99)], "统一"),
        ("看看", [("看一看", 0.95)], "看一看"),
        ("不惜一切", [("不惜一一切", 0.99)], "不惜一切"),  # no longer run than before
        ("来来来", [("来来来来", 0.99)] * 3, "来来来"),
        ("师姐", [("x师姐", 0.99)] * 5, "师姐"),  # CJK only
        ("师姐", [("二师姐", 0.95)] * 2 + [("师姐了", 0.95)] * 3, "师姐了"),  # most evidence
        ("师姐", [("二师姐", 0.5)] * 9, "师姐"),
        ("", [("一", 0.99)], ""),
        ("师姐", [], "师姐"),
    ],
)
def test_dropped_characters(text, readings, want):
    assert restore_dropped(text, readings) == want


def plain_short_texts(cues):
    """Kept idx, one cue after the other; the gibberish test is taken from the column form."""
    rows, out = sorted(cues, key=lambda r: (r["start_sec"], r["idx"])), []
    for i, cue in enumerate(rows):
        t = (cue["text"] or "").strip(" ")
        w = "".join(c for c in t if c.isalnum())
        conf, n_frames = cue["confidence"], cue["frame_count"]
        k = sum("一" <= c <= "鿿" for c in w)
        r = len(w) - k
        bare = t.replace(" ", "")

        def part():
            for j, before in ((i - 1, True), (i + 1, False)):
                if 0 <= j < len(rows):
                    other = rows[j]["text"].strip(" ").replace(" ", "")
                    gap = cue["start_sec"] - rows[j]["end_sec"] if before else rows[j]["start_sec"] - cue["end_sec"]
                    if gap <= 0.40 and other and (bare in other or partial_ratio(bare, other) >= 80):
                        return True
            return False

        if not w:
            continue
        if k:
            after = rows[i + 1] if i + 1 < len(rows) else None
            begins = after is not None and 0 <= after["start_sec"] - cue["end_sec"] <= 0.5 and len(after["text"].strip(" ")) >= 3 and after["text"].strip(" ")[0] == w[0] and conf >= 0.60
            if k >= 25 and conf < 0.80 and n_frames <= 15:
                continue
            if k <= 2 and r >= k and r >= 2 and conf < 0.85:
                continue
            if k <= 3 and r >= 1 and n_frames <= 2 and conf < 0.75:
                continue
            if k == 1 and r == 0 and not begins and (n_frames <= 2 or conf < (0.72 if n_frames >= 5 else 0.75)):
                continue
            if k == 2 and r == 0 and (n_frames <= 1 or conf < 0.65):
                continue
            if r == 0 and 3 <= k <= 24 and n_frames <= 2 and conf < 0.78 and not part():
                continue
            if k >= 3 and r >= 1 and n_frames <= 2 and conf < 0.82:
                continue
            if r == 0 and 4 <= k <= 24 and 3 <= n_frames <= 15 and conf < 0.76 and cue["end_sec"] - cue["start_sec"] < 0.80 and not part():
                continue
        elif n_frames <= 2 and (len(w) <= 2 and conf < 0.90 or conf < 0.80 and len(w) <= 10 and w.upper() not in FL.LATIN_KEPT):
            continue
        out.append((cue["idx"], t))
    return out


def test_short_texts_by_plain_rules(spark):
    r = random.Random(5)
    parts = ["你", "好", "世", "界", "你好", "你好世界", "天气很好", "a", "Hello there", "7", "OK", "！", " ", "三千就三千"]
    rows, at = [], 0.0
    for i in range(1500):
        n = r.choice([1, 1, 2, 2, 3, 8])
        length = r.choice([0.1, 0.3, 1.0])
        rows.append(("v", i, "".join(r.choice(parts) for _ in range(n)), at, at + length, r.choice([0.5, 0.62, 0.7, 0.74, 0.77, 0.79, 0.83, 0.86, 0.95]), r.choice([1, 2, 3, 5, 12, 20])))
        at += length + r.choice([0.0, 0.2, 0.45, 0.6, 3.0])
    names = ["video_id", "idx", "text", "start_sec", "end_sec", "confidence", "frame_count"]
    df = spark.createDataFrame(rows, "video_id string, idx int, text string, start_sec double, end_sec double, confidence double, frame_count int").selectExpr("*", "1 as _k1")
    got = FL.short_texts(df)
    assert got.columns == df.columns
    gibberish = {x.idx for x in df.where(~T.cjk_count("text").cast("boolean")).where(FL.latin_gibberish(FL.F.regexp_replace("text", r"[^\p{L}\p{N}]", ""), FL.F.col("confidence"), FL.F.col("frame_count"))).collect()}
    want = [(i, t) for i, t in plain_short_texts([dict(zip(names, x)) for x in rows]) if i not in gibberish]
    assert sorted((x.idx, x.text) for x in got.collect()) == want and 300 < len(want) < 1400


def test_short_texts_of_nulls_and_none(spark):
    schema = "video_id string, idx int, text string, start_sec double, end_sec double, confidence double, frame_count int"
    df = spark.createDataFrame([("v", 1, None, 0.0, 1.0, 0.9, 9), ("v", 2, "你好世界", 2.0, 3.0, None, None), (None, 3, " 你好世界 ", 2.0, 3.0, 0.9, 9), ("v", 4, "Hi", 2.0, 3.0, 0.95, 9)], schema)
    assert [(r.idx, r.text) for r in FL.short_texts(df).collect()] == [(3, "你好世界"), (4, "Hi")] or sorted(r.idx for r in FL.short_texts(df).collect()) == [3, 4]
    assert [r.idx for r in FL.short_texts(df, 3).collect()] == [3]
    assert FL.short_texts(df.limit(0)).count() == 0


def asked(events, limits):
    state, out = None, []
    for e in events:
        state, answer = S.quota_step(state, e, limits)
        out.append(answer)
    return out


def test_quota_windows_and_days():
    got = asked([(100.0 + i, str(i), "acquire", 10) for i in range(4)] + [(161.0, "x", "acquire", 10)], (3, 1000, 100))
    assert [g[0] for g in got] == ["granted"] * 3 + ["requests", "granted"] and got[3][1] == 57.0
    got = asked([(0.0, "a", "acquire", 60), (1.0, "b", "acquire", 50), (2.0, "c", "acquire", 5000)], (9, 100, 100))
    assert [g[0] for g in got] == ["granted", "tokens", "tokens"] and got[1][1] == 59.0
    assert asked([(0.0, "a", "acquire", 5000)], (9, 100, 100))[0][0] == "granted"  # alone, even a large one goes
    got = asked([(float(i), str(i), "acquire", 1) for i in range(4)], (99, 10_000, 3))
    assert [g[0] for g in got] == ["granted"] * 3 + ["exhausted"]
    midnight = 1_700_035_200.0  # 2023-11-15 00:00 in the quota's zone
    assert S.quota_day(midnight - 1) != S.quota_day(midnight)
    assert [g[0] for g in asked([(midnight - 100, "a", "acquire", 1), (midnight - 1, "b", "acquire", 1), (midnight, "c", "acquire", 1)], (9, 99, 1))] == ["granted", "exhausted", "granted"]


def test_quota_reconcile_release_cooldown():
    got = asked([(0.0, "a", "acquire", 100), (1.0, "a", "reconcile", 5000)], (9, 9000, 9))
    assert got[0][3] == 100 and got[1][3] == 5000
    got = asked([(0.0, "a", "acquire", 100), (1.0, "a", "release", None)], (1, 9000, 1))
    assert got[1][2:] == (0, 0, 1)
    got = asked([(0.0, None, "limited", 30), (1.0, None, "limited", 5), (2.0, "a", "acquire", 1), (30.0, "a", "acquire", 1)], (9, 99, 9))
    assert (got[2][0], got[2][1]) == ("cooldown", 28.0) and got[3][0] == "granted"
    got = asked([(0.0, None, "day_out", None), (1.0, "a", "acquire", 1)], (9, 99, 9))
    assert got[1][0] == "exhausted" and got[1][4] == 0


def test_quota_stream_equals_batch(spark, tmp_path):
    schema = "key string, ts double, id string, kind string, amount double"
    r = random.Random(2)
    rows = [(r.choice("ab"), i * 7.0, str(i), r.choice(["acquire", "acquire", "release", "reconcile", "limited"]), r.choice([None, 5.0, 40.0])) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = S.quota(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in")), (3, 100, 20))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = S.quota_batch(spark.createDataFrame(rows, schema), (3, 100, 20)).collect()
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, want)) and len({w.outcome for w in want}) >= 4
    assert S.quota_batch(spark.createDataFrame([], schema), (3, 100, 20)).count() == 0


def test_gated_loudness_leaves_silence_out(spark):
    loud = lambda x: -0.691 + 10 * math.log10(x * x)
    rows = [("speech", i, 0.2 if i < 400 else 0.0) for i in range(1200)] + [("short", i, 0.1) for i in range(7)] + [("silent", i, 0.0) for i in range(100)]
    rows += [("quiet", i, 0.2 if i < 400 else 0.001) for i in range(800)] + [("rest", i, 0.2) for i in range(405)] + [("null", 0, None)]
    got = {r.k: r.loudness for r in A.gated_loudness(spark.createDataFrame(rows, "k string, i long, x double"), ["k"], "i", "x", 100.0).collect()}
    assert got["speech"] == got["quiet"] == got["rest"] == pytest.approx(loud(0.2)) and got["short"] == pytest.approx(loud(0.1)) and got["silent"] is None and "null" not in got


def test_settings():
    n = {k: recogniser_space(k) for k in ("minimal", "standard", "exhaustive", "single")}
    assert {k: len(v) for k, v in n.items()} == {"minimal": 8, "standard": 31, "exhaustive": 3456, "single": 19}
    assert n["single"][0] == RECOGNISER and all(sum(c[k] != RECOGNISER[k] for k in c) == 1 for c in n["single"][1:-1])
    assert all(set(c) == set(RECOGNISER) for v in n.values() for c in v)


def test_batches_and_frame_cache(spark):
    assert S.tuned_size(16, 0.5, 0) == 16 and S.tuned_size(16, 0.5, 1) == 48 and S.tuned_size(16, 1e-9, 1) == 256 and S.tuned_size(16, 999.0, 1) == 1 and S.tuned_size(16, 0.0, 1) == 16
    rows = [("a", i, 0.5) for i in range(4)] + [("b", 0, 1.0), ("b", 1, None), ("b", 2, 1.0)]
    got = [(r.k, r.i, r.batch_size) for r in S.tuned_batches(spark.createDataFrame(rows, "k string, i int, sec double"), ["k"], ["i"], "sec").orderBy("k", "i").collect()]
    assert got == [("a", 0, 16), ("a", 1, 16), ("a", 2, 48), ("a", 3, 48), ("b", 0, 16), ("b", 1, 16), ("b", 2, 16)]
    cache = S.FrameCache(3)
    key = cache.signature("v.mp4", step=0.1, roi=(1, 2, 3, 4))
    assert key != cache.signature("v.mp4", step=0.2, roi=(1, 2, 3, 4))
    assert cache.put(key, spark.range(3)) and cache.get(key).count() == 3 and cache.get("other") is None
    assert not cache.put("long", spark.range(4)) and cache.get("long") is None and cache.get(key) is not None
    cache.clear()
    assert cache.get(key) is None


def test_reset_of_all_tables(spark, tmp_path):
    for name in ("projects", "memory"):
        stores.Store(spark, f"{tmp_path}/{name}", "k long, v string", ["k"]).put(spark.createDataFrame([(1, "a")], "k long, v string"))
    assert stores.tables_of(spark, str(tmp_path)) == ["memory", "projects"] == stores.reset_all(spark, str(tmp_path))
    found = spark.read.parquet(f"{tmp_path}/memory")
    assert found.count() == 0 and found.columns == ["k", "v"] and stores.reset_all(spark, f"{tmp_path}/none") == []


def test_absorbed_runs_equal_the_fold(spark):
    from cuelake.operators.segment import absorb_noise_runs, runs_of
    from cuelake.operators.windows import absorbed_runs

    r = random.Random(7)
    rows = [(k, i, r.choice(["a", "b ", " b", "c"]) if r.random() < 0.5 else "a") for k in range(6) for i in range(80)] + [(9, 0, None), (9, 1, "a")]
    df = spark.createDataFrame(rows, "k int, t int, v string")
    for noise in (0, 1, 2, 5):
        got = sorted((x.k, x.run_no, x.v or "", x.start_t, x.end_t, x.n) for x in absorbed_runs(df, ["k"], "v", ["t"], "t", noise).collect())
        want = [(k, n + 1, run[1], run[2], run[3], run[4]) for k in (*range(6), 9) for n, run in enumerate(absorb_noise_runs(runs_of([(t, v or "") for q, t, v in rows if q == k]), noise))]
        assert got == want


def test_quantiles_equal_the_aggregate(spark):
    r = random.Random(1)
    rows = [(k, r.choice([None, float(r.randrange(6)), r.random()])) for k in range(5) for _ in range(r.choice([1, 2, 9, 40]))] + [(9, None), (10, 4.0)]
    df = spark.createDataFrame(rows, "k int, x double")
    got = {x.k: (x.a, x.b, x.c) for x in A.quantiles(df, ["k"], "x", a=0.5, b=0.25, c=0.9).collect()}
    want = {x.k: (x.a, x.b, x.c) for x in df.groupBy("k").agg(FL.F.median("x").alias("a"), FL.F.percentile("x", 0.25).alias("b"), FL.F.percentile("x", 0.9).alias("c")).collect()}
    assert 9 not in got and want.pop(9) == (None, None, None)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in got)
    assert A.quantiles(df.limit(0), ["k"], "x", a=0.5).count() == 0
