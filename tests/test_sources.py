import gzip
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuelake.plans import search as OP
from cuelake.sources import json_files as JF
from cuelake.sources import naming as NM
from cuelake.sources import stores as ST
from cuelake.sources import subtitles as SUB
from cuelake.streaming import stateful as STR

SRT = "﻿1\r\n00:00:01,5 --> 00:00:02.000\r\nHello\r\nthere\r\n2\r\n00:00:03,000 - -> 00:00:04,000\r\n\r\n3\r\n00:00:05,000 -> 00:00:06,250\r\n<i>42</i> left\r\n7\r\n"
ASS = "[Script Info]\nTitle: x\n\n[Events]\nFormat: Layer, Start, End, Style, Text\nDialogue: 0,0:00:01.50,0:00:02.00,Main,{\\an8}Hi, you\\Nthere \\{x\\}\nComment: 0,0:00:01.50,0:00:02.00,Main,no\n\n[Fonts]\nDialogue: bad\n"


def test_srt(spark):
    rows = SUB.parse_srt(spark.createDataFrame([("a.srt", SRT)], "path string, content string")).orderBy("idx").collect()
    assert [(r.idx, r.start_sec, r.end_sec, r.text) for r in rows] == [(1, 1.5, 2.0, "Hello\nthere"), (2, 5.0, 6.25, "<i>42</i> left\n7")]


def test_ass(spark):
    r = SUB.parse_ass(spark.createDataFrame([("a.ass", ASS)], "path string, content string")).collect()
    assert [(x.start_sec, x.end_sec, x.text, x.style) for x in r] == [(1.5, 2.0, "Hi, you\nthere {x}", "Main")]


def test_round_trips(spark, tmp_path):
    cues = spark.createDataFrame([("v", 1, "one\ntwo", 0.5, 1.25), ("v", 2, "<b>three</b>", 2.0, 3.001)], "video_id string, idx int, text string, start_sec double, end_sec double")
    body = SUB.srt_body(cues)
    back = SUB.parse_srt(body.select(F.col("video_id").alias("path"), F.col("body").alias("content"))).orderBy("idx").collect()
    assert [(r.start_sec, r.end_sec, r.text) for r in back] == [(0.5, 1.25, "one\ntwo"), (2.0, 3.001, "<b>three</b>")]
    back = SUB.parse_ass(SUB.ass_body(cues).select(F.col("video_id").alias("path"), F.col("body").alias("content"))).orderBy("idx").collect()
    assert [(r.start_sec, r.end_sec, r.text) for r in back] == [(0.5, 1.25, "one\ntwo"), (2.0, 3.0, "three")]
    SUB.write_bodies(body, str(tmp_path / "out"))
    f = next((tmp_path / "out").glob("video_id=v/*.txt"))
    assert f.read_bytes().startswith("﻿1\n00:00:00,500 --> ".encode())


@pytest.mark.parametrize("text, codec", [("héllo", "utf-8"), ("你好，世界。他说：很好", "gb18030"), ("héllo", "utf-16-le")])
def test_encodings(spark, tmp_path, text, codec):
    raw = (b"\xff\xfe" if codec == "utf-16-le" else b"") + text.encode(codec)
    assert SUB.decode_text(raw) == (text, codec)
    (tmp_path / "x.srt").write_bytes(raw)
    assert SUB.decode_files(SUB.read_files(spark, str(tmp_path))).first().content == text


def test_sidecars_and_names(spark):
    v = spark.createDataFrame([("/d/Film.mkv",), ("/d/Other.mkv",)], "video_path string")
    f = spark.createDataFrame([("/d/film.en.srt",), ("/d/film.ass",), ("/d/Film.ssa",), ("/d/filmx.srt",), ("/e/film.srt",)], "path string")
    assert [(r.video_path, r.path) for r in SUB.detect_language_sidecars(v, f).collect()] == [("/d/Film.mkv", "/d/film.ass")]
    s = spark.createDataFrame([("/d/film.zh-CN.srt",), ("/d/none.srt",)], "path string")
    assert [(r.path, r.video_path) for r in NM.sibling_videos(s, v).collect()] == [("/d/film.zh-CN.srt", "/d/Film.mkv")]
    o = spark.createDataFrame([("/d/e10.mp4",), ("/d/e2.mp4",), ("/d/note.txt",)], "path string")
    assert [r.path for r in NM.folder_order(o).orderBy("rank").collect()] == ["/d/e2.mp4", "/d/e10.mp4"]
    c = spark.createDataFrame([("zh-Hant",), ("eng",), ("xx",)], "c string").select(NM.recogniser_language("c")).collect()
    assert [r[0] for r in c] == ["chinese_cht", "en", "ch"]
    assert NM.content_hash(b"abc") == NM.content_hash(b"abc") != NM.content_hash(b"abd") and len(NM.content_hash(b"x" * 5_000_000)) == 16


def test_ocr_files(spark, tmp_path):
    doc = {"version": "1.7", "extra": 1, "meta": {"video_name": "v", "frame_count": 1}, "frames": [{"fi": 3, "ts": 0.3, "boxes": [{"t": "hi", "c": 0.9, "p": [[0, 1], [2, 3]]}]}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(json.dumps(doc | {"version": "1.0"}).encode()))
    (tmp_path / "c.json").write_text(json.dumps(doc | {"version": "2.0"}))
    (tmp_path / "d.json").write_text(json.dumps(doc | {"version": ""}))
    rows = JF.read_ocr(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and rows[0].boxes[0].text == "hi" and rows[0].boxes[0].polygon[1].y == 3
    frames = JF.read_ocr(spark, str(tmp_path / "a.json")).withColumn("video_id", F.lit("v"))
    JF.write_ocr(frames, str(tmp_path / "out"), gzip=True)
    again = JF.read_ocr(spark, str(tmp_path / "out" / "video_id=v")).first()
    assert (again.frame_index, again.boxes) == (3, rows[0].boxes)


def test_speech_files(spark, tmp_path):
    doc = {"version": "1.0", "meta": {"segment_count": 1}, "segments": [{"start": 0.0, "end": 1.0, "text": "hi", "speaker": None, "words": [{"word": "hi", "start": 0.0, "end": 1.0, "score": 0.5}]}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    s = JF.read_speech(spark, str(tmp_path)).withColumn("video_id", F.lit("v"))
    JF.write_speech(s, str(tmp_path / "out"))
    assert JF.read_speech(spark, str(tmp_path / "out" / "video_id=v")).first().words[0].word == "hi"


def test_results_salvage_and_cues(spark):
    good = spark.createDataFrame([("k", ["a"], [1.5], [[[0.6, 1.0]]])], "key string, texts array<string>, scores array<double>, polygons array<array<array<double>>>")
    b = JF.parse_results(good).first().boxes[0]
    assert (b.text, b.confidence, b.polygon[0].x) == ("a", 1.0, 1)
    with pytest.raises(Exception, match="differ in size"):
        JF.parse_results(good.withColumn("scores", F.array(F.lit(1.0), F.lit(2.0)))).collect()
    assert json.loads(JF.salvage_json('x [{"a": 1}, {"a": 2}, {"a"')) == [{"a": 1}, {"a": 2}]
    assert JF.salvage_json("none") == "" and JF.salvage_json('{"a": [1]} tail') == '{"a": [1]}'
    c = spark.createDataFrame([(("Ann", " ", "room"),)], "cue struct<speaker:string,addressee:string,scene:string>").select(JF.cue_json().alias("j")).withColumn("back", JF.cue_from_json("j")).first()
    assert json.loads(c.j) == {"s": "Ann", "c": "room"} and tuple(c.back) == ("Ann", "", "room")
    d = JF.diagnostics(spark.createDataFrame([("v", 1, "a", True), ("v", 2, "b", False)], "video_id string, idx int, text string, empty boolean"), ["empty"]).first()
    assert json.loads(d.report) == {"counts": {"cues": 2, "empty": 1}, "flagged": [{"idx": 1, "text": "a", "empty": True}]}


def test_stores(spark, tmp_path):
    m = ST.Store(spark, str(tmp_path / "tm"), "series_key string, source_text string, target_text string, updated_at timestamp", ["series_key", "source_text"], "series_key")
    row = lambda s, a, b, t: spark.sql(f"select '{s}' series_key, '{a}' source_text, '{b}' target_text, timestamp '2024-01-{t:02d}' updated_at")
    assert m.read().count() == 0
    m.put(row("s", "a", "x", 1).union(row("s", "b", "y", 2)))
    m.put(row("s", "a", "z", 3).union(row("s", "a", "old", 1)).union(row("t", "c", "w", 1)), "updated_at")
    assert {(r.source_text, r.target_text) for r in m.read().collect()} == {("a", "z"), ("b", "y"), ("c", "w")}
    assert [r.target_text for r in m.newest("updated_at", 1).collect()] == ["z"]
    assert [(r.series_key, r["count"]) for r in m.counts("series_key").collect()] == [("s", 2), ("t", 1)]
    m.delete(series_key="s", source_text="a")
    assert m.get(series_key="s").count() == 1
    line = lambda i, t: spark.createDataFrame([(i, t)], "idx int, text string")
    ST.accumulate(m, line(1, "src"), line(1, "tgt"), ["idx"], "s", F.current_timestamp())
    assert m.get(source_text="src").first().target_text == "tgt"
    m.reset()
    assert m.read().count() == 0
    c = ST.Store(spark, str(tmp_path / "cp"), "request string, stage string, idx int", ["request", "stage", "idx"])
    c.put(spark.createDataFrame([("r", "s", 1), ("r", "s", 2)], c.schema))
    assert ST.resume(c, "r", "s", 2).count() == 2 and ST.resume(c, "r", "s", 3) is None
    s = spark.sql("select array(named_struct('name', 'a', 'lines', array('x')), named_struct('name', 'b', 'lines', array('y'))) stages")
    assert [x.name for x in ST.replace_stage(s, "a", F.array(F.lit("z"))).first().stages] == ["b", "a"]
    ST.write_summary(spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string"), str(tmp_path / "csv"), ["k"])
    assert next((tmp_path / "csv").glob("*.csv")).read_text().split() == ["k,v", "1,a", "2,b"]


def test_search(tmp_path):
    axes = [OP.Axis("x", 0, 10, 5), OP.Axis("n", 0, 9, 4, whole=True), OP.Axis("f", 0, 1, flag=True)]
    calls = []

    def scores(cands):
        calls.append(len(cands))
        return [-((c["x"] - 3.3) ** 2) - (c["n"] - 4) ** 2 + c["f"] for c in cands]

    best, top, tried = OP.descend(axes, {"x": 9.0, "n": 0.0, "f": 0.0}, scores, 5, 3)
    assert abs(best["x"] - 3.3) < 0.3 and best["n"] == 4 and best["f"] == 1 and sum(calls) == tried
    assert len(OP.grid(axes)) == 5 * 4 * 2 and len(OP.one_at_a_time(axes, best)) <= 1 + 5 + 4 + 2
    OP.save_state(str(tmp_path / "s.json"), best, top)
    assert OP.load_state(str(tmp_path / "s.json")) == (best, top) and OP.load_state(str(tmp_path / "none")) is None


def stream(spark, tmp_path, pdf, schema, run, name):
    """Runs a streaming operator over a table cut in two files, and returns its rows."""
    src = str(tmp_path / f"{name}-in")
    half = len(pdf) // 2
    for part in (pdf[:half], pdf[half:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = run(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(src)).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_changed_frames_stream_equals_batch(spark, tmp_path):
    schema = "key string, ts double, phash long, difference double, text string"
    pdf = pd.DataFrame([("v", float(i), h, d, f"t{i}") for i, (h, d) in enumerate([(0, 0.0), (1, 0.0), (255, 0.0), (255, 0.5), (254, 0.0), (-1, 0.0)])], columns=["key", "ts", "phash", "difference", "text"])
    batch = sorted(map(tuple, STR.changed_frames_batch(spark.createDataFrame(pdf, schema)).collect()))
    assert [r[4] for r in batch] == ["t0", "t2", "t3", "t5"]
    assert sorted(map(tuple, stream(spark, tmp_path, pdf, schema, STR.changed_frames, "changed").collect())) == batch


def test_adaptive_limits_stream_equals_batch(spark, tmp_path):
    schema = "key string, ts double, ok boolean"
    pdf = pd.DataFrame([("k", float(i), i not in (3, 4)) for i in range(24)], columns=["key", "ts", "ok"])
    batch = sorted(map(tuple, STR.adaptive_limits_batch(spark.createDataFrame(pdf, schema)).collect()))
    assert [r[2] for r in batch][:4] == [8, 8, 8, 4]
    assert sorted(map(tuple, stream(spark, tmp_path, pdf, schema, STR.adaptive_limits, "limits").collect())) == batch


def test_carry_and_sessions(spark, tmp_path):
    assert STR.carry(None, [(0, "new", "a"), (1, "duplicate", ""), (2, "error", ""), (3, "duplicate", "")])[0] == [(0, "new", "a"), (1, "duplicate", "a"), (2, "error", None), (3, "duplicate", None)]
    pdf = pd.DataFrame({"key": ["v"] * 4, "ts": pd.to_datetime(["2024-01-01 00:00", "2024-01-01 00:01", "2024-01-01 03:00", "2024-01-02 00:00"])})
    rows = stream(spark, tmp_path, pdf, "key string, ts timestamp", lambda s: STR.session_windows(s, "key", "ts", "10 minutes", "1 minute"), "sess").collect()
    assert sorted(r.n for r in rows) == [1, 2]
