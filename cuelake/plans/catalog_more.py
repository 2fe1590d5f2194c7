"""More driver queries: boxes made of events, reports, set and text operators, and plain SQL extensions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import filters as FL
from ..operators import joins as J
from ..operators import sets as S
from ..operators import spatial as SP
from ..operators import topk as K
from ..operators import translation as TR
from ..operators import windows as N
from .catalog import C, E, HOUR, SEC, cues, frames, query, read, sessions, sessions_sql

#: events as boxes: a deterministic rectangle for each event.
B = """(select event_type video_id, user_id frame_idx, event_id id, (event_id * 37 % 500)::double x_min, (event_id * 53 % 300)::double y_min, (event_id * 37 % 500 + 20 + event_id % 90)::double x_max, (event_id * 53 % 300 + 8 + event_id % 17)::double y_max, 0.8 + (event_id % 20) / 100.0::double confidence from events)"""


def boxes(spark, d):
    e, i = read(spark, d, "events"), F.col("event_id")
    x, y = (i * 37) % 500, (i * 53) % 300
    return e.select(
        F.col("event_type").alias("video_id"), F.col("user_id").alias("frame_idx"), i.alias("id"), x.cast("double").alias("x_min"), y.cast("double").alias("y_min"),
        (x + 20 + i % 90).cast("double").alias("x_max"), (y + 8 + i % 17).cast("double").alias("y_max"), (F.lit(0.8) + (i % 20) / 100.0).alias("confidence"),
    )


@query(f"select video_id, min(x_min) x0, min(y_min) y0, max(x_max) x1, max(y_max) y1 from {B} group by 1")
def box_union(spark, d):
    b = boxes(spark, d).select("video_id", F.col("x_min").alias("x0"), F.col("y_min").alias("y0"), F.col("x_max").alias("x1"), F.col("y_max").alias("y1"))
    return A.box_union(b, ["video_id"])


@query(f"select video_id, frame_idx, ((x_min + x_max) / 2)::int - case when (x_min + x_max) % 2 = 1 and ((x_min + x_max) / 2)::int > (x_min + x_max) / 2 then 1 else 0 end x, floor((y_min + y_max) / 2)::int y from (select *, row_number() over (partition by video_id, frame_idx order by (x_max - x_min) * (y_max - y_min) desc, id) r from {B}) where r = 1")
def largest_box_centre(spark, d):
    b = boxes(spark, d).select("video_id", "frame_idx", "id", F.col("x_min").alias("x0"), F.col("y_min").alias("y0"), F.col("x_max").alias("x1"), F.col("y_max").alias("y1"))
    return A.largest_box_centre(b, ["video_id", "frame_idx"], "id").select("video_id", "frame_idx", "centre.x", "centre.y")


@query(f"""with b as (select video_id, least(59, floor((y_min + y_max) / 2 / (330 / 60.0::double))::int) bin from {B}), c as (select video_id, bin, count(*) n from b group by 1, 2), m as (select video_id, max(n) most from c group by 1),
  s as (select video_id, max(bin) seed from c join m using (video_id) where n >= .8 * most group by 1), g as (select c.*, bin - row_number() over (partition by video_id order by bin) i from c join m using (video_id) where n >= .3 * most),
  k as (select g.video_id, i from g join s on g.video_id = s.video_id and bin = seed) select video_id, round(min(bin) * (330 / 60.0::double), 6) y_low, round((max(bin) + 1) * (330 / 60.0::double), 6) y_high, sum(n)::bigint boxes from g join k using (video_id, i) group by 1""")
def dominant_band(spark, d):
    return SP.dominant_band(boxes(spark, d), 330.0).select("video_id", F.round("y_low", 6).alias("y_low"), F.round("y_high", 6).alias("y_high"), "boxes")


@query(f"""with e as (select video_id, floor(y_min)::bigint y, 1 d from {B} union all select video_id, floor(y_max)::bigint, -1 from {B}), s as (select video_id, y, sum(d) d from e group by 1, 2),
  c as (select video_id, y, sum(d) over (partition by video_id order by y)::bigint cover from s) select video_id, y, cover, round(avg(cover) over (partition by video_id order by y rows between 2 preceding and 2 following), 6) smooth from c""")
def density_profile(spark, d):
    return SP.density_profile(boxes(spark, d)).select("video_id", "y", "cover", F.round("smooth", 6).alias("smooth"))


@query(f"""select video_id, id % 4 as "cluster", min(x_min) cx0, max(y_max) cy1, count(*) boxes, count(distinct frame_idx) frames, round(sum((x_min + x_max) / 2 * confidence) / sum(confidence), 6) mass_x, round(median((x_max - x_min) / greatest(y_max - y_min, 1e-9)), 6) aspect from {B} group by 1, 2""")
def cluster_stats(spark, d):
    s = SP.cluster_stats(boxes(spark, d).withColumn("cluster", F.col("id") % 4))
    return s.select("video_id", "cluster", "cx0", "cy1", "boxes", "frames", F.round("mass_x", 6).alias("mass_x"), F.round("aspect", 6).alias("aspect"))


@query(f"""select id, (select min(k) from (values (0, 0, 0, 200, 100), (1, 100, 50, 400, 250), (2, 0, 0, 600, 330)) r(k, a, b, c, d) where k < 2 and (x_min + x_max) / 2 between a and c and (y_min + y_max) / 2 between b and d) "cluster" from {B}""")
def box_membership(spark, d):
    names = ("view", "signup", "click", "error", "purchase")
    r = spark.createDataFrame([(v, k, *map(float, c)) for v in names for k, c in ((0, (0, 0, 200, 100)), (1, (100, 50, 400, 250)))], "video_id string, cluster int, cx0 double, cy0 double, cx1 double, cy1 double")
    return SP.density_cluster(boxes(spark, d), r).select("id", "cluster")


@query(f"""with n as (select *, case when y_min - lag(y_min) over (partition by video_id, frame_idx order by y_min, x_min, id) <= 12 then 0 else 1 end nw from {B}), r as (select *, sum(nw) over (partition by video_id, frame_idx order by y_min, x_min, id rows unbounded preceding) ln from n)
  select id, row_number() over (partition by video_id, frame_idx order by ln, x_min, y_min, id) rank from r""")
def reading_order(spark, d):
    return SP.reading_order(boxes(spark, d), ["video_id", "frame_idx"], 12.0, ["id"]).select("id", F.col("rank").cast("long").alias("rank"))


@query(f"""with m as (select video_id, median(confidence) c, median(least(x_max - x_min, y_max - y_min)) t from {B} group by 1), j as (select b.*, x_max - x_min w, y_max - y_min h, least(case when c >= .95 then greatest(.85, c - .05) else .85 end, .90) need, t from {B} b join m using (video_id))
  select id from j where confidence >= need and w >= 6 and h >= 6 and w * h >= 40 and (confidence >= .90 or (least(w, h) <= 5 * t and w / h between .05 and 50 and w <= .95 * 100 and not (w / h between .67 and 1.5 and least(w, h) > 3 * t)))""")
def box_anomalies(spark, d):
    return FL.box_anomalies(boxes(spark, d), 100.0).select("id")


@query(f"""with q as (select video_id, quantile_cont(x_max - x_min, .25) a, quantile_cont(x_max - x_min, .75) b, count(*) n from {B} group by 1), k as (select b.* from {B} b join q using (video_id) where n < 4 or x_max - x_min between a - .1 * (q.b - a) and q.b + .1 * (q.b - a)),
  r as (select video_id, quantile_cont(y_max - y_min, .25) a, quantile_cont(y_max - y_min, .75) b, count(*) n from k group by 1) select id from k join r using (video_id) where n < 4 or y_max - y_min between a - .1 * (r.b - a) and r.b + .1 * (r.b - a)""")
def size_outliers(spark, d):
    return FL.size_outliers(boxes(spark, d), 0.1).select("id")


@query(f"select id from {B} where confidence >= .90 or ((x_min + x_max) / 2 between 30 and 570 and (y_min + y_max) / 2 between 16.5 and 313.5)")
def edge_margin_filter(spark, d):
    return FL.off_margin(boxes(spark, d), 600.0, 330.0).select("id")


@query(f"""with x as (select *, unnest(range(floor(x_min / 50)::bigint, floor(x_max / 50)::bigint + 1)) gx from {B}), y as (select *, unnest(range(floor(y_min / 50)::bigint, floor(y_max / 50)::bigint + 1)) gy from x),
  f as (select video_id, frame_idx, gx, gy, max(pow(confidence, 1.5)) w from y group by 1, 2, 3, 4) select video_id, gx, gy, round(sum(w), 6) heat from f group by 1, 2, 3""")
def box_heat(spark, d):
    return SP.grid_heat(boxes(spark, d), 50.0).withColumn("heat", F.round("heat", 6))


@query()
def heat_clusters(spark, d):
    return SP.heat_clusters(boxes(spark, d), 50.0)


@query()
def density_scan(spark, d):
    return SP.density_clusters(boxes(spark, d).select("video_id", "id", "x_min", "y_min", "x_max", "y_max"), 12.0, 8.0).select("video_id", "id", "cluster")


def _starts(spark, d):
    f = frames(spark, d)
    return tuple(sessions(f, g).select("user_id", F.col("start_us").alias("start_sec")) for g in (6 * HOUR, 3 * HOUR))


@query(f"""with t as (select user_id, start_us s from {sessions_sql(6 * HOUR)}), b as (select user_id, start_us s from {sessions_sql(3 * HOUR)}),
  x as (select user_id, count(*) n, count(*) filter (exists (select 1 from b where b.user_id = t.user_id and abs(b.s - t.s) <= {HOUR})) k from t group by 1), y as (select user_id, count(*) n, count(*) filter (exists (select 1 from t where b.user_id = t.user_id and abs(b.s - t.s) <= {HOUR})) k from b group by 1)
  select user_id, round(y.k / y.n, 6) "precision", round(x.k / x.n, 6) recall, round(2 * (y.k / y.n) * (x.k / x.n) / (y.k / y.n + x.k / x.n), 6) f1 from x join y using (user_id)""")
def boundary_f1(spark, d):
    t, b = _starts(spark, d)
    return A.boundary_f1(t, b, ["user_id"], HOUR).select("user_id", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


_CER = "(select source, case when doc_id % 11 = 0 then null else (doc_id % 7) / 10.0::double end best_cer, n_chars < 60 garbage, (doc_id % 100) / 100.0::double confidence, doc_id from documents)"


@query(f"""with s as (select source, count(*) n, list(best_cer order by best_cer) filter (best_cer is not null) c, list(confidence order by confidence) f, avg(best_cer) mean_cer, median(best_cer) median_cer, avg(case when garbage then 1.0 else 0 end) garbage,
  avg(case when best_cer is not null then 1.0 else 0 end) recall, avg(case when best_cer = 0 then 1.0 else 0 end) exact from {_CER} group by 1)
  select source, round(recall, 6) recall, round(exact, 6) exact, round(mean_cer, 6) mean_cer, round(median_cer, 6) median_cer, c[least(floor(len(c) * .9::double)::int, len(c) - 1) + 1] p90_cer, round(garbage, 6) garbage, f[least(floor(n * .25)::int, n - 1) + 1] p25_confidence from s""")
def ocr_quality_report(spark, d):
    i = F.col("doc_id")
    c = read(spark, d, "documents").select("source", F.when(i % 11 != 0, (i % 7) / 10.0).alias("best_cer"), (F.col("n_chars") < 60).alias("garbage"), ((i % 100) / 100.0).alias("confidence"))
    return A.quality_report(c, ["source"]).select("source", *(F.round(x, 6).alias(x) for x in ("recall", "exact", "mean_cer", "median_cer")), "p90_cer", F.round("garbage", 6).alias("garbage"), "p25_confidence")


@query("select source, sum(case when doc_id % 3 = 0 then 1 else 0 end)::bigint achieved, sum(case when doc_id % 3 <> 0 and doc_id % 2 = 0 then 1 else 0 end)::bigint recoverable, sum(case when doc_id % 3 <> 0 and doc_id % 2 <> 0 then 1 else 0 end)::bigint input_limited from documents group by 1")
def ceiling_breakdown(spark, d):
    t = read(spark, d, "documents").select("source", (F.col("doc_id") % 3 == 0).alias("built_right"), (F.col("doc_id") % 2 == 0).alias("frame_right"))
    return A.ceiling(t, ["source"])


@query("""with w as (select conv_id, list_distinct(list(role)) roles, list_distinct(list(substr(text, 1, 2))) heads from conversations group by 1)
  select a.conv_id, round(case when least(len(a.heads), len(b.heads)) > 0 then len(list_intersect(a.heads, b.heads)) / least(len(a.heads), len(b.heads)) else 0 end, 6) overlap from w a join w b on b.conv_id = a.conv_id + 1""")
def roster_overlap(spark, d):
    w = read(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set(F.substring("text", 1, 2)).alias("a"))
    return w.join(w.select((F.col("conv_id") - 1).alias("conv_id"), F.col("a").alias("b")), "conv_id").select("conv_id", F.round(A.roster_overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


@query("select source series_key, count(*) n from documents group by 1")
def memory_series_counts(spark, d):
    return read(spark, d, "documents").groupBy(F.col("source").alias("series_key")).agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey, o_custkey from orders order by o_orderdate desc, o_orderkey limit 20")
def newest_first(spark, d):
    return read(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey", "o_custkey")


@query("""with r as (select user_id, greatest(1, k - 1) a, least(n, k + 1) b from (select user_id, row_number() over (partition by user_id order by event_id) k, count(*) over (partition by user_id) n, event_type from events) where event_type = 'error'),
  m as (select *, case when a > reach + 1 or reach is null then 1 else 0 end nw from (select *, max(b) over (partition by user_id order by a, b rows between unbounded preceding and 1 preceding) reach from r)), g as (select *, sum(nw) over (partition by user_id order by a, b rows unbounded preceding)::bigint island from m)
  select user_id, island, min(a) first_line, max(b) last_line, count(*) n from g group by 1, 2""")
def patch_windows(spark, d):
    user = W.partitionBy("user_id")
    e = read(spark, d, "events").withColumns({"k": F.row_number().over(user.orderBy("event_id")).cast("long"), "last": F.count(F.lit(1)).over(user)}).where("event_type = 'error'")
    return TR.patch_windows(e.select("user_id", "k", "last"), ["user_id"], "k", 1, "last")


@query("""with r as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 k, count(*) over (partition by user_id) n from events)
  select user_id, event_id from r where n <= 5 or k in (round_even(0 * (n - 1) / 4, 0), round_even(1 * (n - 1) / 4, 0), round_even(2 * (n - 1) / 4, 0), round_even(3 * (n - 1) / 4, 0), round_even(4 * (n - 1) / 4, 0))""")
def evenly_spaced_sample(spark, d):
    return K.evenly_spaced(read(spark, d, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], 5)


@query("""with f as (select *, row_number() over (partition by source, lang order by doc_id) r from documents), k as (select *, row_number() over (partition by source order by doc_id) q from f where r = 1) select source, lang, doc_id from k where q <= 3""")
def reference_block(spark, d):
    return K.references(read(spark, d, "documents").select("source", "lang", "doc_id"), ["source"], ["doc_id"], "lang", 3)


@query("""select conv_id, (select text from conversations x where x.conv_id = c.conv_id and role = 'user' and trim(text) <> '' order by turn desc limit 1) overview from (select distinct conv_id from conversations) c""")
def context_merge(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).otherwise("").alias("overview"))
    return S.merge_fields(c, ["conv_id"], ["turn"], ["overview"])


@query("select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) r from events) where r = 1")
def last_cue_wins(spark, d):
    return S.last_by(read(spark, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("""with s as (select conv_id, turn from conversations), g as (select conv_id, turn, 1 n from conversations where role <> 'system' union all select conv_id, 99, 1 from conversations where turn = 0 and conv_id % 5 = 0), k as (select conv_id, turn, count(*) n from g group by 1, 2),
  j as (select coalesce(s.conv_id, k.conv_id) conv_id, s.turn st, n from s full join k on s.conv_id = k.conv_id and s.turn = k.turn), a as (select conv_id, count(st) sent, count(*) filter (n is null) missing, count(*) filter (st is null) extra, count(*) filter (n > 1) repeated from j group by 1)
  select *, case when missing = 0 and repeated = 0 and extra = 0 then 'ok' when repeated = 0 and extra = 0 and missing <= .15 * sent then 'patch' else 'retry' end verdict from a""")
def batch_validation(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", "role")
    got = c.where("role <> 'system'").select("conv_id", "turn").unionByName(c.where("turn = 0 and conv_id % 5 = 0").select("conv_id", F.lit(99).cast("long").alias("turn")))
    return S.batch_verdict(c, got, ["conv_id"], "turn")


@query("""select s_suppkey, trim(split_part(line, '=', 1)) source, trim(split_part(line, '=', 2)) target from (select s_suppkey, s_name || ' = ' || s_nationkey line from supplier)""")
def glossary_parse(spark, d):
    line = F.concat("s_name", F.lit(" = "), F.col("s_nationkey").cast("string"))
    return read(spark, d, "supplier").select("s_suppkey", T.glossary_entry(line).alias("g")).select("s_suppkey", "g.source", "g.target")


@query("""select event_id, printf('%02d:%02d:%02d,%03d', r // 3600000, r // 60000 % 60, r // 1000 % 60, r % 1000) srt, printf('%d:%02d:%02d.%02d', c // 360000, c // 6000 % 60, c // 100 % 60, c % 100) ass, round(r / 1000.0::double, 3) parsed
  from (select event_id, (event_id * 1234567 // 1000)::bigint r, (event_id * 1234567 // 10000)::bigint c from events)""")
def time_formats(spark, d):
    e = read(spark, d, "events").select("event_id", (F.floor(F.col("event_id") * 1234567 / 1000) / 1000.0).alias("t"))
    return e.select("event_id", T.srt_time("t").alias("srt"), T.ass_time("t").alias("ass"), F.round(T.parse_time(T.srt_time("t")), 3).alias("parsed"))


@query(f"select conv_id, turn from {C} where start_sec <= 10.5 and end_sec >= 7.25")
def visible_range(spark, d):
    return J.visible(cues(spark, d), 7.25, 10.5).select("conv_id", "turn")


@query(f"""with c as (select conv_id, turn, start_sec, end_sec from {C} where turn <> 1), n as (select conv_id, start_sec s, end_sec e from {C} where turn = 1),
  k as (select c.conv_id, turn, case when s is null or end_sec <= s or start_sec >= e or start_sec < s then start_sec else e end start_sec, case when s is null or end_sec <= s or start_sec >= e or start_sec >= s then end_sec else s end end_sec from c left join n using (conv_id))
  select conv_id, turn, round(start_sec, 6) start_sec, round(end_sec, 6) end_sec from k where end_sec - start_sec >= .05 union all select conv_id, turn, round(start_sec, 6), round(end_sec, 6) from {C} where turn = 1""")
def replace_and_clip(spark, d):
    c = cues(spark, d).select(F.col("conv_id").alias("video_id"), F.col("turn").alias("uid"), "start_sec", "end_sec")
    one = c.where("uid = 1")
    return J.replace_cues(c, one, one).select(F.col("video_id").alias("conv_id"), F.col("uid").alias("turn"), F.round("start_sec", 6).alias("start_sec"), F.round("end_sec", 6).alias("end_sec"))


@query("""with l as (select conv_id, turn, text from conversations where role = 'user'), a as (select conv_id, turn - 1 as turn, text from conversations where role = 'assistant'), d as (select l.*, a.text nw from l left join a using (conv_id, turn)),
  f as (select *, row_number() over (partition by conv_id order by turn) k from d where nw is null), r as (select a.conv_id, a.text late, row_number() over (partition by a.conv_id order by a.turn) k from a where not exists (select 1 from l where l.conv_id = a.conv_id and l.turn = a.turn))
  select conv_id, turn, nw as text from d where nw is not null union all select f.conv_id, turn, coalesce(late, text) from f left join r using (conv_id, k)""")
def answer_merge(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return J.merge_by_line(c.where("role = 'user'").select("conv_id", "turn", "text"), c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), "text"), ["conv_id"], "turn", "text")


@query("""with k as (select *, row_number() over (partition by source order by doc_id) n from documents where regexp_matches(text, '\\p{L}')) select k.source, k.doc_id, coalesce('#' || n, k.text) as text from k
  union all select source, doc_id, text from documents where not coalesce(regexp_matches(text, '\\p{L}'), false)""")
def noise_round_trip(spark, d):
    lines = read(spark, d, "documents").select("source", "doc_id", "text")
    kept = TR.without_noise(lines, ["source"], "doc_id", "text", False)
    answers = kept.select("source", "dense_no", F.concat(F.lit("#"), F.col("dense_no").cast("string")).alias("text"))
    return TR.put_back(lines, kept, answers, ["source"], "doc_id", "text")


@query(f"select conv_id, round(greatest(0, least(dur * .5 - least(6, dur) / 2, dur - least(6, dur))), 6) start_sec, round(greatest(0, least(dur * .5 - least(6, dur) / 2, dur - least(6, dur))) + least(6, dur), 6) end_sec from (select conv_id, max(end_sec) dur from {C} group by 1)")
def probe_window(spark, d):
    v = cues(spark, d).groupBy("conv_id").agg(F.max("end_sec").alias("dur"))
    return FL.probe_window(v, "dur", 6.0).select("conv_id", F.round("start_sec", 6).alias("start_sec"), F.round("end_sec", 6).alias("end_sec"))


@query(r"""select p_partkey, trim(regexp_replace(regexp_replace(t, '\([^)]*\)', ' ', 'g'), '\s+', ' ', 'g')) as text, regexp_matches(trim(t), '^\([^)]*\)$') effect from (select p_partkey, case when p_partkey % 3 = 0 then '(' || p_name || ')' else p_brand || ' (' || p_type || ') ' || p_name end t from part)""")
def speech_text_filters(spark, d):
    t = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("("), "p_name", F.lit(")"))).otherwise(F.concat("p_brand", F.lit(" ("), "p_type", F.lit(") "), "p_name"))
    return read(spark, d, "part").select("p_partkey", T.drop_spans(t).alias("text"), T.is_sound_effect(t).alias("effect"))


@query("""select doc_id, regexp_matches(lower(text), 'the of') or (length(trim(text)) >= 4 and len(list_distinct(string_split(regexp_replace(trim(text), '\\s', '', 'g'), ''))) = 1) noise from documents""")
def hallucination_filter(spark, d):
    return read(spark, d, "documents").select("doc_id", T.hallucinated("text", ["the of"]).alias("noise"))


@query(f"select conv_id, turn, round(least(1.6, greatest(.85, length(text) / 15.0::double / greatest(end_sec - start_sec, 1e-6))), 6) speed, greatest(6, floor(floor((end_sec - start_sec) * 4.5) * 4.2))::int most_chars from {C}")
def speech_budget(spark, d):
    from ..operators.speech import length_hint, speed_ratio

    c = cues(spark, d)
    window = F.col("end_sec") - F.col("start_sec")
    return c.select("conv_id", "turn", F.round(speed_ratio(F.length("text") / 15.0, window), 6).alias("speed"), length_hint(window).alias("most_chars"))


@query("select event_id, bit_count(xor(event_id * 2654435761, user_id * 40503))::int bits from events")
def hash_distance(spark, d):
    return read(spark, d, "events").select("event_id", T.hamming(F.col("event_id") * 2654435761, F.col("user_id") * 40503).alias("bits"))


@query(f"""with f as (select * from {E} where value > 5), m as (select user_id, avg(value) m from f group by 1) select user_id, round(avg(value), 6) level from f join m using (user_id) where value > m - 10 group by 1""")
def gated_level(spark, d):
    """Sums go by event_id, the order in which the SQL meets the rows on one thread; on more its answer changes from run to run."""
    level = A.gated_level(frames(spark, d), ["user_id"], "value", 5.0, 10.0, ["event_id"])
    return level.withColumn("level", F.round(F.col("level") * 1e6) / 1e6)


@query("""with s as (select user_id, row_number() over (partition by user_id order by event_id) - 1 i, value / 500 x from events), b as (select user_id, i // 4 b, avg(x * x) p, count(*) n from s where x is not null group by 1, 2),
  w as (select user_id, sum(p * n) / sum(n) p, count(*) filter (n = 4) full_blocks from b group by 1), l as (select user_id, p, -0.691 + 10 * log10(p) l from b where n = 4 and p > 1e-12), f as (select user_id, avg(p) p from l where l > -70 group by 1),
  g as (select user_id, avg(l.p) p from l join f using (user_id) where l.l > -70 and l.l > -0.691 + 10 * log10(f.p) - 2 group by 1)
  select user_id, round(-0.691 + 10 * log10(case when full_blocks = 0 then w.p else coalesce(g.p, f.p) end), 6) loudness from w left join f using (user_id) left join g using (user_id)""")
def gated_loudness(spark, d):
    place = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    samples = read(spark, d, "events").select("user_id", place.alias("i"), (F.col("value") / 500).alias("x"))
    return A.gated_loudness(samples, ["user_id"], "i", "x", 10.0, relative=-2.0).withColumn("loudness", F.round("loudness", 6))


@query("""with r as (select *, row_number() over (partition by user_id order by event_id) i from events), s as (select *, max(case when i = 2 then value / 100 end) over (partition by user_id) e from r)
  select user_id, event_id, (case when i <= 2 or e is null or e <= 0 then 16 else greatest(1, least(256, floor(24 / e))) end)::bigint batch_size from s""")
def tuned_batches(spark, d):
    from ..streaming.stateful import tuned_batches as tune

    e = read(spark, d, "events").select("user_id", "event_id", (F.col("value") / 100).alias("sec"))
    return tune(e, ["user_id"], ["event_id"], "sec").drop("sec")


@query()
def quota_outcomes(spark, d):
    """Every event asks for a request; purchases tell what they really used, errors give theirs back, and a user's day has ten."""
    from ..streaming.stateful import quota_batch

    e = read(spark, d, "events")
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    ask = e.select(F.col("user_id").cast("string").alias("key"), ts.alias("ts"), F.col("event_id").cast("string").alias("id"), F.lit("acquire").alias("kind"), F.col("value").cast("double").alias("amount"))
    more = e.where("event_type in ('purchase', 'error')").select(F.col("user_id").cast("string").alias("key"), (ts + 0.001).alias("ts"), F.col("event_id").cast("string").alias("id"), F.when(F.col("event_type") == "error", "release").otherwise("reconcile").alias("kind"), (F.col("value") / 2).cast("double").alias("amount"))
    return quota_batch(ask.unionByName(more), (2, 600, 10))


@query(f"""with s as (select user_id, session_no, start_us t_start, end_us t_end from {sessions_sql(6 * HOUR)}), c as (select user_id, session_no c_no, start_us c_start, end_us c_end from {sessions_sql(24 * HOUR)}) select user_id, session_no, c_no from s join c using (user_id) where c_start < t_end and c_end > t_start""")
def chunk_coverage(spark, d):
    f = frames(spark, d)
    s = sessions(f, 6 * HOUR).select("user_id", "session_no", F.col("start_us").alias("t_start"), F.col("end_us").alias("t_end"))
    c = sessions(f, 24 * HOUR).select("user_id", F.col("session_no").alias("c_no"), F.col("start_us").alias("c_start"), F.col("end_us").alias("c_end"))
    return J.interval_join(s, c, ["user_id"], ("t_start", "t_end"), ("c_start", "c_end"), 24 * HOUR).select("user_id", "session_no", "c_no")


@query("""select p_partkey, min(f) filter (r = 1) as subtitle from (select v.p_partkey, f, row_number() over (partition by v.p_partkey order by x) r from part v
  join (select p_partkey k, '/m/' || p_partkey || e f, x from part, (values ('.srt', 1), ('.ass', 2), ('.en.srt', 3)) z(e, x) where (p_partkey % 4 = 0 and x = 1) or (p_partkey % 6 = 0 and x = 2) or x = 3) on k = v.p_partkey) group by 1""")
def sidecar_lookup(spark, d):
    from ..sources.subtitles import detect_language_sidecars

    p = read(spark, d, "part").select("p_partkey")
    stem = F.concat(F.lit("/m/"), F.col("p_partkey").cast("string"))
    files = p.withColumn("e", F.explode(F.array(F.when(F.col("p_partkey") % 4 == 0, ".srt"), F.when(F.col("p_partkey") % 6 == 0, ".ass"), F.lit(".en.srt")))).where("e is not null").select(F.concat(stem, "e").alias("path"))
    found = detect_language_sidecars(p.select(F.concat(stem, F.lit(".mkv")).alias("video_path")), files)
    return found.select(F.regexp_extract("video_path", r"(\d+)\.mkv", 1).cast("long").alias("p_partkey"), F.col("path").alias("subtitle"))


@query("select c_custkey, coalesce(n_name, c_mktsegment) speaker from customer left join nation on n_nationkey = c_nationkey and n_nationkey < 10")
def name_localisation(spark, d):
    n = read(spark, d, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").cast("string").alias("line"), F.col("n_name").alias("speaker"))
    lines = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("line"), F.col("c_mktsegment").alias("speaker"))
    return J.enrich(lines, n, ["line"], ["speaker"]).select("c_custkey", "speaker")


@query("select source, sha256('{\"model\":\"m\",\"n\":3}' || '::' || string_agg(lang, chr(10) order by doc_id)) digest from documents group by 1")
def request_key(spark, d):
    texts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "lang"))), lambda s: s["lang"])
    return read(spark, d, "documents").groupBy("source").agg(TR.request_key(texts, n=3, model="m").alias("digest"))


@query("select source, count(*) jobs, sum(ceil(n_chars / 50.0))::bigint requests from documents group by 1")
def request_estimate(spark, d):
    return TR.request_estimate(read(spark, d, "documents"), ["source"], "n_chars", 50)


@query("select conv_id, turn, 'a' part from conversations where role = 'user' union all select conv_id, turn, 'b' from conversations where role = 'assistant'")
def union_regions(spark, d):
    c = read(spark, d, "conversations")
    one = lambda role, p: c.where(F.col("role") == role).select("conv_id", "turn", F.lit(p).alias("part"))
    return one("user", "a").unionByName(one("assistant", "b"))


# Extensions beyond cue tables: what any SQL user of the engine expects, straight from Spark.


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) qty, count(*) n from lineitem group by rollup (l_returnflag, l_linestatus)")
def extension_rollup(spark, d):
    return read(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.count(F.lit(1)).alias("n"))


@query("select l_returnflag, l_linestatus, count(*) n, grouping(l_returnflag)::int g from lineitem group by cube (l_returnflag, l_linestatus)")
def extension_cube(spark, d):
    return read(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping("l_returnflag").cast("int").alias("g"))


@query("select c_custkey, rank() over w rk, dense_rank() over w drk, ntile(4) over w nt, round(percent_rank() over w, 6) pr, round(cume_dist() over w, 6) cd from customer window w as (partition by c_nationkey order by c_acctbal, c_custkey)")
def extension_ranks(spark, d):
    w = W.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    return read(spark, d, "customer").select("c_custkey", F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("drk"), F.ntile(4).over(w).alias("nt"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"))


@query("select coalesce(c_custkey, o_custkey) k, count(o_orderkey) n from customer full join orders on c_custkey = o_custkey group by 1")
def extension_full_outer(spark, d):
    o = read(spark, d, "orders")
    c = read(spark, d, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "full").groupBy(F.coalesce("c_custkey", "o_custkey").alias("k")).agg(F.count("o_orderkey").alias("n"))


@query("select c_custkey k from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000) except select l_suppkey from lineitem where l_quantity > 49")
def extension_semi_except(spark, d):
    o = read(spark, d, "orders").where("o_totalprice > 300000")
    c = read(spark, d, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select(F.col("c_custkey").alias("k")).subtract(read(spark, d, "lineitem").where("l_quantity > 49").select("l_suppkey"))


@query("""select n_name, o_orderpriority, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2""")
def extension_star_join(spark, d):
    l, o, c, n = (read(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name", "o_orderpriority").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("select event_type, epoch_us(time_bucket(interval 6 hour, ts)) bucket_us, count(*) n from events group by 1, 2")
def extension_tumbling(spark, d):
    e = read(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("event_type", F.window("t", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.unix_micros("w.start").alias("bucket_us"), "n")
