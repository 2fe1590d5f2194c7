"""Driver queries on the test tables, and for each that SQL can express the DuckDB SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import sets as S
from ..operators import topk as K
from ..operators import windows as N

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SEC = 1_000_000
HOUR = 3600 * SEC


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark, sf_dir) -> DataFrame:
    """events as a frame stream: user_id, event_id, us (epoch microseconds), event_type, value, conf."""
    e = read(spark, sf_dir, "events")
    return e.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type", "value", F.least(F.lit(1.0), F.col("value") / 500).alias("conf"))


def cues(spark, sf_dir) -> DataFrame:
    """conversations as cues of four seconds each: conv_id, turn, role, text, start_sec, end_sec."""
    c = read(spark, sf_dir, "conversations")
    start = F.col("turn") * 4.0
    return c.select("conv_id", "turn", "role", "text", start.alias("start_sec"), (start + F.greatest(F.lit(0.5), F.length("text") / 12.0)).alias("end_sec"))


E = "(select user_id, event_id, epoch_us(ts) us, event_type, value, least(1.0, value/500) conf from events)"
C = "(select conv_id, turn, role, text, turn*4.0::double start_sec, turn*4.0::double + greatest(0.5::double, length(text)/12.0::double) end_sec from conversations)"


def sessions(df: DataFrame, gap: int) -> DataFrame:
    s = N.sessionize(df, ["user_id"], "us", gap, ["event_id"])
    return s.groupBy("user_id", "session_no").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n"))


def sessions_sql(gap: int) -> str:
    return f"""(select user_id, session_no, min(us) start_us, max(us) end_us, count(*) n from (
      select *, sum(case when p is null or us-p > {gap} then 1 else 0 end) over (partition by user_id order by us, event_id)::bigint session_no
      from (select *, lag(us) over (partition by user_id order by us, event_id) p from {E})) group by 1, 2)"""


@query(f"""
with s as (select *, sum(case when p is null or us-p > {6 * HOUR} then 1 else 0 end) over (partition by user_id order by us, event_id)::bigint session_no
  from (select *, lag(us) over (partition by user_id order by us, event_id) p from {E})),
m as (select user_id, session_no, event_type, row_number() over (partition by user_id, session_no order by count(*) desc, min(us), event_type) r from s group by 1, 2, 3)
select s.user_id, s.session_no, min(us) start_us, max(us) end_us, count(*) frame_count, round(avg(conf), 6) mean_conf, any_value(m.event_type) modal_type
from s join m on s.user_id = m.user_id and s.session_no = m.session_no and r = 1 group by 1, 2""")
def sessionize_gap(spark, d):
    s = N.sessionize(frames(spark, d), ["user_id"], "us", 6 * HOUR, ["event_id"])
    by = ["user_id", "session_no"]
    stats = s.groupBy(*by).agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("frame_count"), F.round(F.avg("conf"), 6).alias("mean_conf"))
    return stats.join(A.mode_vote(s, by, "event_type", "us").select(*by, F.col("winner").alias("modal_type")), by)


@query(f"""select user_id, run_no, event_type, min(us) start_us, max(us) end_us, count(*) n from (
  select *, sum(case when event_type is distinct from p or r = 1 then 1 else 0 end) over (partition by user_id order by us, event_id)::bigint run_no from (
  select *, lag(event_type) over w p, row_number() over w r from {E} window w as (partition by user_id order by us, event_id))) group by 1, 2, 3""")
def run_length_segments(spark, d):
    r = N.run_lengths(frames(spark, d), ["user_id"], "event_type", ["us", "event_id"])
    return r.groupBy("user_id", "run_no", "event_type").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n"))


@query(f"""with i as (select user_id, event_id, us s, us + cast(floor(value*60)*{SEC} as bigint) e from events join (select event_id eid, epoch_us(ts) us from events) on eid = event_id),
m as (select *, case when reach is null or s > reach + {SEC} then 1 else 0 end nw from (select *, max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) reach from i)),
g as (select *, sum(nw) over (partition by user_id order by s, e rows unbounded preceding)::bigint island from m)
select user_id, island, min(s) start_us, max(e) end_us, count(*) n from g group by 1, 2""")
def interval_merge(spark, d):
    i = frames(spark, d).select("user_id", F.col("us").alias("start_us"), (F.col("us") + (F.floor(F.col("value") * 60) * SEC)).alias("end_us"))
    return N.merge_intervals(i, ["user_id"], "start_us", "end_us", SEC)


@query(f"""select user_id, bucket, event_id, us from (select *, row_number() over (partition by user_id, bucket order by us, event_id) r from (
  select *, cast(floor(us / {6.0 * HOUR}) as bigint) bucket from {E})) where r = 1""")
def step_sample(spark, d):
    return N.step_sample(frames(spark, d), ["user_id"], "us", 6 * HOUR, "event_id").select("user_id", "bucket", "event_id", "us")


@query(f"""select event_id, user_id, last_value(strong ignore nulls) over (partition by user_id, part order by us, event_id rows between unbounded preceding and current row) carried from (
  select *, sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by us, event_id) part, case when value > 20 and event_type <> 'error' then event_type end strong from {E})""")
def carry_forward(spark, d):
    f = frames(spark, d).withColumn("strong", F.when((F.col("value") > 20) & (F.col("event_type") != "error"), F.col("event_type")))
    return N.carry_forward(f, ["user_id"], ["us", "event_id"], "strong", F.col("event_type") == "error").select("event_id", "user_id", "carried")


@query(f"select event_type, cast(floor(us / {1.0 * HOUR}) as bigint) bucket, max(abs(value)) peak from {E} group by 1, 2")
def envelope_downsample(spark, d):
    return A.envelope(frames(spark, d), ["event_type"], "us", "value", HOUR)


@query(f"""select event_id, count(*) over w n_recent, round(sum(value) over w, 6) sum_recent from {E}
  window w as (partition by user_id order by us range between {HOUR - 1} preceding and current row)""")
def rate_window_60s(spark, d):
    return N.trailing_rates(frames(spark, d), ["user_id"], "us", HOUR, "value").select("event_id", "n_recent", F.round("sum_recent", 6).alias("sum_recent"))


@query(f"select user_id, event_type, cast(floor((us - {8 * HOUR}) / {24.0 * HOUR}) as bigint) as day, count(*) requests, round(sum(value), 6) tokens from {E} group by 1, 2, 3")
def daily_quota_snapshot(spark, d):
    day = F.floor((F.col("us") - 8 * HOUR) / (24 * HOUR)).alias("day")
    return frames(spark, d).groupBy("user_id", "event_type", day).agg(F.count(F.lit(1)).alias("requests"), F.round(F.sum("value"), 6).alias("tokens"))


@query(f"""select p.event_id, p.user_id, p.us, v.us as asof_view_us, v.event_id as asof_view_id from (select * from {E} where event_type = 'purchase') p
  asof left join (select * from {E} where event_type = 'view') v on p.user_id = v.user_id and p.us >= v.us""")
def asof_event_at_time(spark, d):
    f = frames(spark, d)
    views = f.where("event_type = 'view'").select("user_id", F.col("us").alias("view_us"), F.col("event_id").alias("view_id"))
    return J.asof_join(f.where("event_type = 'purchase'").select("event_id", "user_id", "us"), views, ["user_id"], "us", "view_us", ["view_id"])


@query(f"""select p.event_id, (select v.us from {E} v where v.event_type = 'view' and v.user_id = p.user_id and abs(v.us - p.us) <= {2 * HOUR} order by abs(v.us - p.us), v.us limit 1) snapped
  from {E} p where event_type = 'purchase'""")
def nearest_edge_snap(spark, d):
    f = frames(spark, d)
    views = f.where("event_type = 'view'").select("user_id", F.col("us").alias("edge"))
    return J.nearest_edge(f.where("event_type = 'purchase'").select("event_id", "user_id", "us"), views, ["user_id"], "us", "edge", 2 * HOUR).select("event_id", "snapped")


@query(f"""select s.user_id, s.session_no, count(*) points from {sessions_sql(6 * HOUR)} s join {E} p
  on s.user_id = p.user_id and p.us between s.start_us - 1000000 and s.end_us + 1000000 and p.event_type = 'error' group by 1, 2""")
def point_in_interval_count(spark, d):
    f = frames(spark, d)
    points = f.where("event_type = 'error'").select("user_id", "us")
    return J.points_in_intervals(points, sessions(f, 6 * HOUR), ["user_id"], "us", ("start_us", "end_us"), 24 * HOUR, SEC).groupBy("user_id", "session_no").agg(F.count(F.lit(1)).alias("points"))


def _matched(spark, d):
    f = frames(spark, d)
    truth = sessions(f, 6 * HOUR).select("user_id", F.col("session_no").alias("t_no"), F.col("start_us").alias("t_start"), F.col("end_us").alias("t_end"), F.col("n").alias("t_n"))
    built = sessions(f, 3 * HOUR).select("user_id", F.col("session_no").alias("b_no"), F.col("start_us").alias("b_start"), F.col("end_us").alias("b_end"), F.col("n").alias("b_n"))
    return truth, built, J.best_overlap(truth, built, ["user_id"], 12 * HOUR, 60 * SEC, "t_no", "b_no")


_MATCHED = f"""(with t as (select user_id, session_no t_no, start_us t_start, end_us t_end, n t_n from {sessions_sql(6 * HOUR)}),
  b as (select user_id, session_no b_no, start_us b_start, end_us b_end, n b_n from {sessions_sql(3 * HOUR)}),
  p as (select t.user_id, t_no, b_no, b_n, least(t_end, b_end) - greatest(t_start, b_start) overlap from t join b on t.user_id = b.user_id and t_start < b_end and b_start < t_end),
  r as (select *, row_number() over (partition by user_id, t_no order by overlap desc, b_no) r from p where overlap > {60 * SEC})
  select t.user_id, t.t_no, t_n, b_no, b_n, overlap from t left join r on r = 1 and t.user_id = r.user_id and t.t_no = r.t_no)"""


@query(f"select * from {_MATCHED}")
def best_overlap_match(spark, d):
    return _matched(spark, d)[2].select("user_id", "t_no", "t_n", "b_no", "b_n", "overlap")


@query(f"""with m as (select user_id, count(*) truth, count(b_no) matched, sum(case when b_n = t_n then 1 else 0 end)::bigint exact, avg(case when b_no is not null then abs(b_n - t_n)::double / t_n end) mean_cer, count(distinct b_no) used from {_MATCHED} group by 1),
  b as (select user_id, count(*) built from {sessions_sql(3 * HOUR)} group by 1),
  s as (select m.user_id, truth, matched, exact, coalesce(mean_cer, 1) mean_cer, built, built - used spurious from m join b on m.user_id = b.user_id)
  select user_id, truth, matched, exact, built, spurious, round(mean_cer, 6) mean_cer, round(matched / truth::double, 6) recall, round(least(1, 2.0 * matched / (truth + built)), 6) f1,
  round(greatest(0, least(1, 0.5 * exact / truth::double + 0.25 * (1 - least(1, mean_cer)) + 0.2 * matched / truth::double - 0.1 * spurious / built::double)), 6) quality from s""")
def score_summary(spark, d):
    _, built, m = _matched(spark, d)
    m = m.withColumns({"hit": F.col("b_no").isNotNull(), "same": F.coalesce(F.col("b_n") == F.col("t_n"), F.lit(False)), "error": F.abs(F.col("b_n") - F.col("t_n")) / F.col("t_n")})
    counts = built.groupBy("user_id").agg(F.count(F.lit(1)).alias("built")).join(m.groupBy("user_id").agg(F.countDistinct("b_no").alias("used")), "user_id")
    s = A.subtitle_score(m, counts, ["user_id"], "same", "error", "hit")
    return s.select("user_id", "truth", "matched", "exact", "built", "spurious", *(F.round(c, 6).alias(c) for c in ("mean_cer", "recall", "f1", "quality")))


@query(f"""with m as (select user_id, median(value) med from {E} group by 1), v as (select e.*, abs(value - med) dev from {E} e join m using (user_id)), a as (select user_id, median(dev) mad from v group by 1)
  select event_id, round(dev / (1.4826 * greatest(mad, 1e-6)), 6) mad_z from v join a using (user_id)""")
def mad_outliers(spark, d):
    return A.mad_score(frames(spark, d).select("user_id", "event_id", "value"), ["user_id"], "value").select("event_id", F.round("mad_z", 6).alias("mad_z"))


@query(f"""select event_type, count(value) n, round(quantile_cont(value, .25) - 2 * (quantile_cont(value, .75) - quantile_cont(value, .25)), 6) low,
  round(quantile_cont(value, .75) + 2 * (quantile_cont(value, .75) - quantile_cont(value, .25)), 6) high from {E} group by 1""")
def tukey_outliers(spark, d):
    return A.tukey_bounds(frames(spark, d), ["event_type"], "value").select("event_type", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"""with b as (select event_id, event_type, cast(floor(value / 5.0) as bigint) bin from {E}), c as (select event_type, bin, count(*) n from b group by 1, 2), t as (select event_type, sum(n) total from c group by 1),
  dense as (select c.event_type, c.bin from c join t using (event_type) where n >= greatest(30, floor(total / 100)))
  select event_id, event_type, bin from b where exists (select 1 from dense where dense.event_type = b.event_type and abs(dense.bin - b.bin) <= 2) or not exists (select 1 from dense where dense.event_type = b.event_type)""")
def density_bins_filter(spark, d):
    return A.dense_bins(frames(spark, d).select("event_id", "event_type", "value"), ["event_type"], "value", 5.0, 30).select("event_id", "event_type", "bin")


@query("""with b as (select source, doc_id, cast(floor(n_chars / 500.0) as bigint) bin from documents), p as (select source, bin, count(distinct doc_id) members from b group by 1, 2), t as (select source, count(distinct doc_id) total from b group by 1),
  k as (select p.*, bin - row_number() over (partition by p.source order by bin) i from p join t using (source) where members >= 0.05 * total)
  select source, min(bin) first_bin, max(bin) last_bin, max(members) peak from k group by source, i""")
def band_presence(spark, d):
    return A.band_presence(read(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], "n_chars", 500.0, "doc_id", 0.05)


@query(f"select event_id, conf from {E} where conf >= 0.0375::double")
def confidence_filter(spark, d):
    return frames(spark, d).where(F.col("conf") >= 0.0375).select("event_id", "conf")


@query(f"select user_id, event_type, round(sum(conf * (1 + event_id % 5)) / sum(1 + event_id % 5), 6) confidence, sum(1 + event_id % 5)::bigint frame_count from {E} group by 1, 2")
def weighted_conf_merge(spark, d):
    f = frames(spark, d).select("user_id", "event_type", F.col("conf").alias("confidence"), (1 + F.col("event_id") % 5).alias("frame_count"))
    return A.weighted_confidence(f, ["user_id", "event_type"]).withColumn("confidence", F.round("confidence", 6))


@query(f"""with c as (select user_id, cast(floor(us / {24.0 * HOUR}) as bigint) as day, event_type, count(*) votes, min(us) f from {E} group by 1, 2, 3),
  r as (select *, sum(votes) over (partition by user_id, day)::bigint total, row_number() over (partition by user_id, day order by votes desc, f, event_type) r from c)
  select user_id, day, case when votes / total::double >= 0.45 then event_type end winner, votes, total, round(votes / total::double, 6) share from r where r = 1""")
def mode_vote(spark, d):
    f = frames(spark, d).withColumn("day", F.floor(F.col("us") / (24 * HOUR)))
    return A.mode_vote(f, ["user_id", "day"], "event_type", "us", 0.45).withColumn("share", F.round("share", 6))


@query(f"""select conv_id, turn, start_sec, round(case when nx is not null and end_sec > nx - .001 and nx - .001 > start_sec then nx - .001 else end_sec end, 6) end_sec,
  round(end_sec - start_sec + case when nx is null then 2 else least(greatest(0, nx - end_sec - .1), 2) end, 6) window_sec, round(greatest(start_sec + .1, least(end_sec, coalesce(nx - .04, end_sec))), 6) speech_end
  from (select *, lead(start_sec) over (partition by conv_id order by turn) nx from {C})""")
def event_timing_pad(spark, d):
    by, order = ["conv_id"], ["turn"]
    c = N.speech_window(cues(spark, d), by, order)
    c = N.retime_for_speech(c.withColumn("_e", F.col("end_sec")), by, order).withColumn("speech_end", F.round("end_sec", 6)).withColumn("end_sec", F.col("_e"))
    return N.close_overlaps(c, by, order, gap=0.001).select("conv_id", "turn", "start_sec", F.round("end_sec", 6).alias("end_sec"), F.round("window_sec", 6).alias("window_sec"), "speech_end")


@query(f"""select conv_id, turn, length(regexp_replace(text, '\\s+', '', 'g')) visible, round(length(regexp_replace(text, '\\s+', '', 'g')) / (end_sec - start_sec), 6) cps, end_sec - start_sec < .5 too_short,
  length(regexp_replace(text, '\\s+', '', 'g')) / (end_sec - start_sec) > 20 too_fast, round(greatest(.3, length(regexp_replace(text, '\\s+', '', 'g')) / 12.0::double), 6) reading_sec from {C}""")
def reading_speed_flags(spark, d):
    c = cues(spark, d)
    rate = T.cps("text", "start_sec", "end_sec")
    return c.select("conv_id", "turn", T.visible_length("text").cast("long").alias("visible"), F.round(rate, 6).alias("cps"), (F.col("end_sec") - F.col("start_sec") < T.TOO_SHORT_SEC).alias("too_short"), (rate > T.TOO_FAST_CPS).alias("too_fast"), F.round(T.reading_seconds("text"), 6).alias("reading_sec"))


@query("select conv_id, turn, row_number() over (partition by conv_id order by turn) idx from conversations where role <> 'system'")
def reindex_events(spark, d):
    return N.reindex(cues(spark, d).where("role <> 'system'"), ["conv_id"], ["turn"]).select("conv_id", "turn", F.col("idx").cast("long").alias("idx"))


@query("""select conv_id, turn, cast(floor((row_number() over (partition by conv_id order by turn) - 1) / 3.0) as bigint) batch_no,
  coalesce(string_agg(text, '|') over (partition by conv_id order by turn rows between 2 preceding and 1 preceding), '') before,
  coalesce(string_agg(text, '|') over (partition by conv_id order by turn rows between 1 following and 2 following), '') "after" from conversations""")
def context_windows(spark, d):
    b = N.batches_with_context(cues(spark, d), ["conv_id"], ["turn"], "text", 3, 2)
    return b.select("conv_id", "turn", "batch_no", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"))


@query("""with m as (select conv_id, turn, role, text like '%?%' fx from conversations), p as (select *, sum(case when fx then 1 else 0 end) over (partition by conv_id order by turn) part, case when not fx then role end named from m)
  select conv_id, turn, case when named is distinct from last then named end tag from (select *, last_value(named ignore nulls) over (partition by conv_id, part order by turn rows between unbounded preceding and 1 preceding) last from p)""")
def speaker_change_tags(spark, d):
    return N.speaker_tags(cues(spark, d), ["conv_id"], ["turn"], "role", F.col("text").like("%?%")).select("conv_id", "turn", "tag")


def _pairs(spark, d):
    c = read(spark, d, "conversations").withColumn("pair", F.floor(F.col("turn") / 2))
    one = lambda role: c.where(F.col("role") == role).groupBy("conv_id", "pair").agg(F.min_by("text", "turn").alias("text"))
    return one("user"), one("assistant")


def _pair_sql(role: str) -> str:
    return f"(select conv_id, turn // 2 as pair, arg_min(text, turn) as text from conversations where role = '{role}' group by 1, 2)"


@query(f"select a.conv_id, a.pair, case when u.text is null or trim(u.text) = trim(a.text) or trim(u.text) = '' then a.text else a.text || chr(10) || u.text end as text from {_pair_sql('assistant')} a left join {_pair_sql('user')} u on a.conv_id = u.conv_id and a.pair = u.pair")
def bilingual_merge(spark, d):
    user, assistant = _pairs(spark, d)
    return J.bilingual(assistant, user, ["conv_id", "pair"], "text")


@query("""select c.conv_id, c.turn, coalesce(nullif(trim(d.source), ''), c.role) speaker from conversations c left join (select doc_id, source from documents) d on d.doc_id = c.conv_id * 10 + c.turn""")
def cue_enrich(spark, d):
    lines = read(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"), (F.col("conv_id") * 10 + F.col("turn")).alias("line"))
    found = read(spark, d, "documents").select(F.col("doc_id").alias("line"), F.trim("source").alias("speaker"))
    return J.enrich(lines, found, ["line"], ["speaker"]).select("conv_id", "turn", "speaker")


_PAIR_FLAGS = f"(select a.conv_id, a.pair, u.text src, a.text tgt from {_pair_sql('assistant')} a join {_pair_sql('user')} u on a.conv_id = u.conv_id and a.pair = u.pair)"


@query(f"""select conv_id, pair, trim(src) = trim(tgt) and trim(src) <> '' identical, trim(tgt) = '' and trim(src) <> '' as empty, coalesce(n >= 12 and trim(tgt) <> '' and (m / n < .35 or m / n > 2.5), false) odd_length from (
  select *, length(regexp_replace(trim(src), '\\s+', '', 'g'))::double n, length(regexp_replace(trim(tgt), '\\s+', '', 'g'))::double m from {_PAIR_FLAGS})""")
def quality_flags(spark, d):
    user, assistant = _pairs(spark, d)
    p = user.withColumnRenamed("text", "src").join(assistant.withColumnRenamed("text", "tgt"), ["conv_id", "pair"])
    return A.quality_flags(p, ["conv_id"], ["pair"], "src", "tgt").select("conv_id", "pair", "identical", "empty", "odd_length")


@query("""select doc_id, coalesce(trim(lag(lang) over w) = trim(lang) and trim(lang) <> '' and trim(lag(text) over w) <> trim(text), false) repeats_previous from documents window w as (partition by source order by doc_id)""")
def adjacent_duplicates(spark, d):
    return N.adjacent_duplicates(read(spark, d, "documents").select("doc_id", "source", "lang", "text"), ["source"], ["doc_id"], "text", "lang").select("doc_id", "repeats_previous")


_NORM = "trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'))"
_UNDER = """(with u as (select doc_id, lang, length(trim(t)) / length(trim(s))::double ratio from (select doc_id, lang, text s, %s t from documents) where length(trim(s)) >= 4 and length(trim(t)) > 0),
  m as (select lang, median(ratio) med, count(*) n from u group by 1) select doc_id, lang, round(ratio / med, 6) severity from u join m using (lang) where n >= 12 and ratio < med * %s)"""


_SHORT = f"case when doc_id - 7 * (doc_id // 7) = 0 then substr({_NORM}, 1, 10) else {_NORM} end"


def _normalised(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "lang", "text")
    norm = F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " "))
    return docs.withColumns({"norm": norm, "short": F.when(F.col("doc_id") % 7 == 0, F.substring(norm, 1, 10)).otherwise(norm)})


@query(f"select * from {_UNDER % (_NORM, '0.9')}")
def under_translation(spark, d):
    return A.under_translated(_normalised(spark, d), ["lang"], "text", "norm", 0.9, 0.9).select("doc_id", "lang", F.round("severity", 6).alias("severity"))


@query(f"select doc_id, lang, severity from {_UNDER % (_SHORT, '0.5')} a where not exists (select 1 from {_UNDER % (_NORM, '0.5')} b where a.doc_id = b.doc_id)")
def stage_regressions(spark, d):
    n = _normalised(spark, d)
    after, before = (A.under_translated(n, ["lang"], "text", c, 0.5, 0.5).select("doc_id", "lang", F.round("severity", 6).alias("severity")) for c in ("short", "norm"))
    return S.difference(after, before, ["doc_id"])


@query("""select lang, sum(case when trim(text) = trim(other) then 1 else 0 end)::bigint unchanged, count(*) comparable, round(avg(case when trim(text) = trim(other) then 1.0 else 0.0 end), 6) ratio
  from (select lang, text, replace(text, '***', '') as other from documents) where trim(text) <> '' and trim(other) <> '' group by 1""")
def passthrough_ratio(spark, d):
    docs = read(spark, d, "documents").select("lang", "text")
    pairs = docs.withColumn("other", F.replace("text", F.lit("***"), F.lit("")))
    return A.passthrough(pairs, ["lang"], "text", "other").withColumn("ratio", F.round("ratio", 6))


_TERMS = (("the", "der"), ("und", "and"), ("que", "qué"), ("est", "ist"))


@query(f"""select doc_id, source_term from documents join (values {', '.join(f"('{a}', '{b}')" for a, b in _TERMS)}) g(source_term, target_term)
  on contains(lower(text), source_term) and not contains(lower(text), target_term)""")
def glossary_violations(spark, d):
    g = spark.createDataFrame(list(_TERMS), "source_term string, target_term string")
    docs = read(spark, d, "documents").select("doc_id", "text").withColumn("target", F.col("text"))
    return J.glossary_violations(docs, g, "text", "target").select("doc_id", "source_term")


@query("""with m as (select source, doc_id, string_split(text, chr(10)) l from documents where contains(text, chr(10))), t as (select source, count(*) cues from m group by 1),
  e as (select distinct source, doc_id, trim(line) line from (select source, doc_id, unnest(l) line from m) where trim(line) <> ''), c as (select source, line, count(*) n from e group by 1, 2)
  select c.source, line, n, cues from c join t using (source) where n >= 2 and n >= .01 * cues and length(regexp_replace(line, '[^A-Za-z]', '', 'g')) / length(line)::double > .5""")
def watermark_lines(spark, d):
    docs = read(spark, d, "documents").select("source", "doc_id", "text").where("text is not null")
    return A.watermark_lines(docs, ["source"], "doc_id", "text", 2, 0.01).select("source", "line", "n", "cues")


@query("select page_id, regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '\\{[^}]*\\}', '', 'g') as text from pages")
def strip_tags(spark, d):
    return read(spark, d, "pages").select("page_id", T.strip_markup("html").alias("text"))


@query("select doc_id, trim(regexp_replace(replace(replace(text, '***', ''), '&&&', '+'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) as text from documents")
def normalise_text(spark, d):
    return read(spark, d, "documents").select("doc_id", T.squeeze(T.fix_typos("text", {"***": "", "&&&": "+"})).alias("text"))


@query("select doc_id, regexp_replace(text, '^[^a-zA-Z0-9!?.]+|[^a-zA-Z0-9!?.]+$', '', 'g') as text from documents")
def edge_noise_trim(spark, d):
    return read(spark, d, "documents").select("doc_id", T.trim_edges("text", "a-zA-Z0-9", "!?.").alias("text"))


_GRAMS = "(select distinct {k}, unnest(list_transform(range(1, greatest(1, length(t) - 1)), lambda i: substr(t, i, 3))) g from (select {k}, lower(regexp_replace({c}, '[^A-Za-z]', '', 'g')) t from {f}))"


@query(f"""with a as {_GRAMS.format(k='item_id', c='text', f='benchmark')}, b as {_GRAMS.format(k='doc_id', c='text', f='documents')},
  n as (select item_id, count(*) n from a where length(g) = 3 group by 1), p as (select item_id, doc_id, count(*) common from a join b using (g) where length(g) = 3 group by 1, 2),
  r as (select p.*, n.n, row_number() over (partition by item_id order by common desc, doc_id) r from p join n using (item_id))
  select x.item_id, x.doc_id, x.common, round(x.common / x.n::double, 6) share, coalesce(y.common, 0) runner_up, x.common / x.n::double >= .4 and x.common >= 2 * coalesce(y.common, 0) confident from r x left join r y on x.item_id = y.item_id and y.r = 2 where x.r = 1""")
def char_ngrams_overlap(spark, d):
    fold = F.lower(F.regexp_replace("text", "[^A-Za-z]", "")).alias("letters")
    r = K.gram_overlaps(read(spark, d, "benchmark").select("item_id", fold), read(spark, d, "documents").select("doc_id", fold), "item_id", "doc_id", "letters")
    share = F.col("common") / F.col("n")
    return r.select("item_id", "doc_id", "common", F.round(share, 6).alias("share"), "runner_up", ((share >= 0.4) & (F.col("common") >= 2 * F.col("runner_up"))).alias("confident"))


@query("select conv_id, sha256(string_agg(text, chr(10) order by turn) || chr(10)) digest from conversations group by 1")
def hash_chain(spark, d):
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"])
    return read(spark, d, "conversations").groupBy("conv_id").agg(T.chained_hash(texts).alias("digest"))


@query("""select doc_id, coalesce(l.quality, -1) quality, coalesce(l.toxic, -1) toxic from (select doc_id from documents) d left join labels l using (doc_id)
  union all select doc_id, quality, toxic from labels where doc_id not in (select doc_id from documents)""")
def upsert_latest(spark, d):
    base = read(spark, d, "documents").select("doc_id", F.lit(-1).alias("quality"), F.lit(-1).alias("toxic"))
    return S.upsert(base, read(spark, d, "labels").select("doc_id", "quality", "toxic"), ["doc_id"])


@query("select source, doc_id, part from (select *, row_number() over (partition by lower(source) order by part, doc_id) r from (select source, doc_id, 0 part from documents where lang = 'de' union all select source, doc_id, 1 part from documents)) where r = 1")
def ordered_distinct_merge(spark, d):
    docs = read(spark, d, "documents").select("source", "doc_id", "lang")
    part = lambda x, i: x.select("source", "doc_id", F.lit(i).alias("part"))
    return S.ordered_distinct([part(docs.where("lang = 'de'"), 0), part(docs, 1)], F.lower("source"), ["doc_id"])


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def set_difference(spark, d):
    return S.difference(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels"), ["doc_id"])


@query("""select conv_id, turn from (select conv_id, unnest(generate_series(min(turn), max(turn))) turn from conversations where role <> 'user' group by 1)
  where (conv_id, turn) not in (select (conv_id, turn) from conversations where role <> 'user')""")
def missing_line_numbers(spark, d):
    return S.missing_numbers(read(spark, d, "conversations").where("role <> 'user'").select("conv_id", "turn"), ["conv_id"], "turn")


_COS = "round(list_dot_product(q.embedding::double[], v.embedding::double[]) / (sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(v.embedding::double[], v.embedding::double[]))), 6)"


@query(f"""select query_id, vec_id, score, rank from (select q.vec_id query_id, v.vec_id, greatest(0, least(1, {_COS})) score, row_number() over (partition by q.vec_id order by greatest(0, least(1, {_COS})) desc, v.vec_id) rank
  from embeddings q, embeddings v where q.vec_id % 50 = 0 and q.vec_id <> v.vec_id) where rank <= 3""")
def topk_retrieval_semantic(spark, d):
    """Queries are the rows whose id is divisible by 50, against all rows."""
    v = read(spark, d, "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    pairs = K.cosine_candidates(q, v, "query_id", "vec_id", "embedding", 3, 6).withColumn("score", F.round("score", 6))
    return K.top_k(pairs, ["query_id"], "score", ["vec_id"], 3)


@query()
def topk_retrieval_fuzzy(spark, d):
    q = read(spark, d, "benchmark").select("item_id", F.col("text").alias("query_text"))
    memory = read(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("memory_text"))
    return K.fuzzy_top_k(q, memory, "query_text", "memory_text", ["item_id"], ["conv_id", "turn"], 3, 30.0).select("item_id", "conv_id", "turn", "rank", F.round("score", 6).alias("score"))


@query("select a.p_name a, b.p_name b, round(jaro_winkler_similarity(a.p_name, b.p_name), 6) score from (select distinct p_name from part) a join (select distinct p_name from part) b on a.p_name < b.p_name")
def jaro_winkler_pairs(spark, d):
    from ..functions.similarity import jaro_winkler_udf

    names = read(spark, d, "part").select("p_name").distinct()
    pairs = names.withColumnRenamed("p_name", "a").join(names.withColumnRenamed("p_name", "b"), F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.round(jaro_winkler_udf("a", "b"), 6).alias("score"))


@query("""with n as (select distinct p_name, p_type from part) select a.p_name a, b.p_name b, a.p_type, round(levenshtein(replace(a.p_name, ' ', ''), replace(b.p_name, ' ', '')) / length(replace(a.p_name, ' ', ''))::double, 6) cer
  from n a join n b on a.p_type = b.p_type and a.p_name <> b.p_name""")
def cer_pairs(spark, d):
    n = read(spark, d, "part").select("p_type", "p_name").distinct()
    pairs = n.withColumnRenamed("p_name", "a").join(n.withColumnRenamed("p_name", "b"), "p_type").where("a <> b")
    return pairs.select("a", "b", "p_type", F.round(T.cer("a", "b"), 6).alias("cer"))


@query("""with f as (select doc_id, n_chars size, 1000000 - doc_id // 10 age, source = 'src0' exempt from documents), l as (select *, age > 1000000 - 5 and not exempt old from f),
  s as (select *, sum(case when old then 0 else size end) over (order by age, doc_id) run from l) select doc_id, old or (not exempt and run > 200000) evict from s""")
def cache_eviction_plan(spark, d):
    f = read(spark, d, "documents").select("doc_id", F.col("n_chars").alias("size"), (1_000_000 - F.floor(F.col("doc_id") / 10)).alias("age"), (F.col("source") == "src0").alias("exempt"))
    return N.eviction_plan(f, "size", "age", "doc_id", 1_000_000 - 5, 200_000, F.col("exempt")).select("doc_id", "evict")


@query("""select status, count(*) docs, sum(ceil(n_chars / 1000.0))::bigint requests from (select n_chars, case when text is null or n_chars = 0 then 'INVALID' when quality is null then 'READY' when quality = 0 then 'SKIPPED' else 'DONE' end status
  from documents left join labels using (doc_id)) group by 1""")
def plan_status_rollup(spark, d):
    j = read(spark, d, "documents").select("doc_id", "text", "n_chars").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    status = F.when(F.col("text").isNull() | (F.col("n_chars") == 0), "INVALID").when(F.col("quality").isNull(), "READY").when(F.col("quality") == 0, "SKIPPED").otherwise("DONE")
    return j.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.ceil(F.col("n_chars") / 1000)).alias("requests"))


@query(f"""with v as (select conv_id, max(end_sec) dur from {C} group by 1), n as (select *, case when dur <= 30 then 1 else ceil(dur / 30.0)::bigint end n from v)
  select conv_id, i chunk, round(i * dur / n, 6) start_sec, round(case when i = n - 1 then dur else (i + 1) * dur / n end, 6) end_sec from (select *, unnest(range(n)) i from n)""")
def chunk_plan(spark, d):
    from ..operators.filters import chunk_plan as plan

    v = cues(spark, d).groupBy("conv_id").agg(F.max("end_sec").alias("dur"))
    return plan(v, "dur", 30.0).select("conv_id", F.col("chunk").cast("long").alias("chunk"), F.round("start_sec", 6).alias("start_sec"), F.round("end_sec", 6).alias("end_sec"))


@query(f"""select conv_id, turn, round(end_sec - start_sec, 6) duration_sec, round(case when abs(gap) < .001 then 0 else gap end, 6) gap_sec, end_sec - start_sec < .5 too_short, length(regexp_replace(text, '\\s+', '', 'g')) / (end_sec - start_sec) > 20 too_fast
  from (select *, lead(start_sec) over (partition by conv_id order by turn) - end_sec gap from {C})""")
def cue_review(spark, d):
    r = N.cue_review(cues(spark, d), ["conv_id"], ["turn"], "text", "start_sec", "end_sec")
    return r.select("conv_id", "turn", F.round("duration_sec", 6).alias("duration_sec"), F.round("gap_sec", 6).alias("gap_sec"), "too_short", "too_fast")


@query("""select conv_id, turn // 2 as pair, arg_min(text, turn) filter (role = 'system') "system", arg_min(text, turn) filter (role = 'user') "user", arg_min(text, turn) filter (role = 'assistant') assistant from conversations group by 1, 2""")
def stage_pivot(spark, d):
    c = read(spark, d, "conversations").withColumn("pair", F.floor(F.col("turn") / 2))
    one = c.groupBy("conv_id", "pair", "role").agg(F.min_by("text", "turn").alias("text"))
    return S.stage_pivot(one, ["conv_id", "pair"], "role", ["system", "user", "assistant"], "text")


@query("""with u as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) k from conversations where role = 'user'), a as (select conv_id, text, row_number() over (partition by conv_id order by turn) k from conversations where role = 'assistant')
  select conv_id, turn, coalesce(case when trim(a.text) <> '' then a.text end, u.text) as text from u left join a using (conv_id, k) union all select conv_id, turn, text from conversations where role <> 'user'""")
def positional_overlay(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return J.positional_overlay(c, c.where("role = 'assistant'"), ["conv_id"], ["turn"], ["turn"], F.col("role") == "user", "text").select("conv_id", "turn", "text")


@query("select s_name, row_number() over (order by k, s_suppkey) rank from (select s_suppkey, 's' || s_suppkey % 13 || '-' || s_suppkey s_name, lpad((s_suppkey % 13)::varchar, 3, '0') || lpad(s_suppkey::varchar, 20, '0') k from supplier)")
def natural_sort_rank(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("s"), (F.col("s_suppkey") % 13).cast("string"), F.lit("-"), F.col("s_suppkey").cast("string")).alias("s_name"))
    ranked = s.withColumn("rank", F.row_number().over(W.orderBy(T.natural_key("s_name"), "s_suppkey")))
    return ranked.select("s_name", F.col("rank").cast("long").alias("rank"))


@query(f"""with t as (select *, cast(round_even(start_sec * 1000, 0) as bigint) a, cast(round_even(end_sec * 1000, 0) as bigint) b, row_number() over (partition by conv_id order by turn) i from {C})
  select conv_id, string_agg(i || chr(10) || printf('%02d:%02d:%02d,%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) || chr(10) || text || chr(10), chr(10) order by i) body from t group by 1""")
def srt_export(spark, d):
    from ..sources.subtitles import srt_body

    c = cues(spark, d).select(F.col("conv_id").alias("video_id"), F.col("turn").alias("idx"), "text", "start_sec", "end_sec")
    return srt_body(c).select(F.col("video_id").alias("conv_id"), "body")


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) k from events")
def json_props_extract(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("\nunion all ".join(f"select {g} gap_hours, count(*) sessions, round(avg(n), 6) mean_n, round(1.0 / (1 + abs(avg(n) - 4)), 6) score from {sessions_sql(g * HOUR)}" for g in (1, 3, 6, 12, 24)))
def grid_search_gap(spark, d):
    """All gaps in one pass: the distance to the forerunner is found once, and each gap counts the rows that open a session."""
    f = frames(spark, d)
    prev = f.withColumn("p", F.lag("us").over(W.partitionBy("user_id").orderBy("us", "event_id")))
    gaps = (1, 3, 6, 12, 24)
    counts = prev.agg(F.count(F.lit(1)).alias("rows"), *(F.sum((F.col("p").isNull() | (F.col("us") - F.col("p") > g * HOUR)).cast("long")).alias(f"g{g}") for g in gaps))
    long = counts.select("rows", F.explode(F.array(*(F.struct(F.lit(g).alias("gap_hours"), F.col(f"g{g}").alias("sessions")) for g in gaps))).alias("s")).select("rows", "s.*")
    mean = F.col("rows") / F.col("sessions")
    return long.select("gap_hours", "sessions", F.round(mean, 6).alias("mean_n"), F.round(1 / (1 + F.abs(mean - 4)), 6).alias("score"))


@query(f"""with i as (select user_id, event_type, min(us) s, max(us) e from (select *, cast(floor(us / {24.0 * HOUR}) as bigint) as day from {E}) group by 1, 2, day),
  m as (select *, case when reach is null or s > reach then 1 else 0 end nw from (select *, max(e) over (partition by user_id order by s, e, event_type rows between unbounded preceding and 1 preceding) reach from i)),
  g as (select *, sum(nw) over (partition by user_id order by s, e, event_type rows unbounded preceding) c from m)
  select user_id, min(s) start_us, max(e) end_us, count(*) members from g group by user_id, c""")
def components_overlap(spark, d):
    """Components of overlapping intervals: on a line they are the islands of the merged intervals, no iteration needed."""
    f = frames(spark, d).withColumn("day", F.floor(F.col("us") / (24 * HOUR)))
    i = f.groupBy("user_id", "event_type", "day").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"))
    return N.merge_intervals(i, ["user_id"], "start_us", "end_us").select("user_id", "start_us", "end_us", F.col("n").alias("members"))


@query(f"""with m as (select *, sum(case when event_type is distinct from p then 1 else 0 end) over (partition by user_id order by us, event_id) r from (select *, lag(event_type) over (partition by user_id order by us, event_id) p from {E})),
  u as (select user_id, r, min(event_type) event_type, min(us) a, max(us) b, count(*) n from m group by 1, 2), s as (select *, case when n > 1 or r = 1 then event_type end strong from u),
  l as (select *, last_value(strong ignore nulls) over (partition by user_id order by r rows between unbounded preceding and 1 preceding) before from s),
  o as (select *, sum(case when strong is not null and strong is distinct from before then 1 else 0 end) over (partition by user_id order by r) run_no from l)
  select user_id, run_no::int run_no, arg_min(event_type, r) event_type, min(a) start_us, max(b) end_us, sum(n)::bigint n from o group by 1, 2""")
def run_length_absorb_noise(spark, d):
    """Runs of event types, where runs of one row belong to what stands before them."""
    f = frames(spark, d).select("user_id", "us", "event_id", "event_type")
    return N.absorbed_runs(f, ["user_id"], "event_type", ["us", "event_id"], "us", 1)


@query(f"""with recursive e as (select user_id, event_id, us s, us + (floor(value * 60) * {10 * SEC})::bigint e, conf from {E}), q as (select *, row_number() over (partition by user_id order by s, e, event_id) k, count(*) over (partition by user_id) n from e),
  g as (select user_id, k, n, [{{'id': event_id, 's': s, 'e': e, 'w': conf}}] kept from q where k = 1 union all
    select user_id, k, n, case when hit is null or hit = 0 then list_append(kept, me) when me.w > kept[hit].w then list_concat(list_append(kept[1:hit - 1], me), kept[hit + 1:]) else kept end
    from (select q.user_id, q.k, q.n, g.kept, {{'id': q.event_id, 's': q.s, 'e': q.e, 'w': q.conf}} me,
      list_position(list_transform(g.kept, lambda x: least(x.e, q.e) > greatest(x.s, q.s) and least(x.e - x.s, q.e - q.s) > 0 and (least(x.e, q.e) - greatest(x.s, q.s)) / least(x.e - x.s, q.e - q.s) >= 0.80), true) hit from g join q on q.user_id = g.user_id and q.k = g.k + 1))
  select user_id, u.id event_id, u.s start_us, u.e end_us, u.w conf from (select user_id, unnest(kept) u from g where k = n)""")
def dedup_overlap_intervals(spark, d):
    from ..operators.matching import overlapping_duplicates

    e = frames(spark, d)
    spans = e.select("user_id", "event_id", F.col("us").alias("start_us"), (F.col("us") + F.floor(F.col("value") * 60) * SEC * 10).alias("end_us"), "conf")
    return overlapping_duplicates(spans, ["user_id"], "event_id", "start_us", "end_us", "conf")


@query(f"""with recursive r as (select user_id, session_no i, start_us / 1e6 a, end_us / 1e6 b from {sessions_sql(6 * HOUR)}), f as (select user_id, session_no j, start_us / 1e6 a, end_us / 1e6 b from {sessions_sql(3 * HOUR)}),
  p as (select user_id, i, j, r.a, f.a fa, case when greatest(r.b, f.b) > least(r.a, f.a) then greatest(0, least(r.b, f.b) - greatest(r.a, f.a)) / (greatest(r.b, f.b) - least(r.a, f.a)) else 0 end iou from r join f using (user_id) where r.a <= f.b + 10800 and f.a - 10800 <= r.b),
  q as (select *, row_number() over (partition by user_id order by a, i, iou desc, fa, j) k from p where iou >= 0.30),
  g as (select user_id, 1 k, i, j, iou, true kept, [i] used_i, [j] used_j from q where k = 1 union all
    select q.user_id, q.k, q.i, q.j, q.iou, free, case when free then list_append(used_i, q.i) else used_i end, case when free then list_append(used_j, q.j) else used_j end
    from (select q.*, g.used_i, g.used_j, not list_contains(g.used_i, q.i) and not list_contains(g.used_j, q.j) free from g join q on q.user_id = g.user_id and q.k = g.k + 1) q)
  select user_id, i r_idx, j f_idx, round(iou, 9) iou, 0.0::double similarity from g where kept""")
def greedy_iou_match(spark, d):
    from ..operators.matching import greedy_match

    f = frames(spark, d)
    side = lambda gap, p: sessions(f, gap).select("user_id", F.col("session_no").alias(f"{p}_idx"), F.lit("").alias(f"{p}_text"), (F.col("start_us") / SEC).alias(f"{p}_start"), (F.col("end_us") / SEC).alias(f"{p}_end"))
    return greedy_match(side(6 * HOUR, "r"), side(3 * HOUR, "f"), ["user_id"], 3600.0 * 3, fuzzy=False).withColumn("iou", F.round("iou", 9))


@query()
def rover_consensus(spark, d):
    """One text for each role of a conversation, voted from its turns."""
    import pandas as pd

    from ..operators.consensus import vote

    c = read(spark, d, "conversations").select("conv_id", "role", "turn", "text", F.least(F.lit(1.0), F.length("text") / 400).alias("conf"))

    def fold(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn")
        return pd.DataFrame({"conv_id": [key[0]], "role": [key[1]], "text": [vote(list(zip(pdf["text"], pdf["conf"])))], "readings": [len(pdf)]})

    return c.groupBy("conv_id", "role").applyInPandas(fold, "conv_id long, role string, text string, readings long")


@query()
def coordinate_descent(spark, d):
    """Session gap (hours) whose mean session size is nearest to four; all gaps of a sweep are one aggregate."""
    from .search import Axis, descend

    f = frames(spark, d)
    gaps = f.select((F.col("us") - F.lag("us").over(W.partitionBy("user_id").orderBy("us", "event_id"))).alias("gap")).cache()

    def scores(cands):
        row = gaps.agg(F.count(F.lit(1)).alias("n"), *(F.sum((F.col("gap").isNull() | (F.col("gap") > c["gap"] * HOUR)).cast("long")).alias(f"s{i}") for i, c in enumerate(cands))).first()
        return [1 / (1 + abs(row["n"] / row[f"s{i}"] - 4)) for i in range(len(cands))]

    best, top, tried = descend([Axis("gap", 0.5, 48.0, 7)], {"gap": 6.0}, scores)
    gaps.unpersist()
    return spark.createDataFrame([(best["gap"], round(top, 6), tried)], "gap_hours double, score double, candidates int")


@query()
def build_cues_from_events(spark, d):
    """The whole cue building on the event stream, one second for a quarter of an hour."""
    from ..config import CueParams
    from ..operators.segment import build_cues

    f = frames(spark, d).select(F.col("user_id").cast("string").alias("video_id"), (F.col("us") / (900.0 * SEC)).alias("timestamp_sec"), F.col("event_type").alias("text"), F.greatest(F.lit(0.6), F.col("conf")).alias("confidence"), F.lit(0.0).alias("y"))
    return build_cues(f, CueParams(least_confidence=0.0, least_duration=0.0, merge_gap=20.0, step=8.0))


@query()
def sentence_split(spark, d):
    """Words of assistant turns, timed by their length, cut into sentences."""
    from ..operators.speech import sentences

    c = read(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("pos", "word"))
    before = F.coalesce(F.sum(F.length("word")).over(W.partitionBy("conv_id", "turn").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    timed = c.withColumn("start", before / 14.0 + F.col("pos") * 0.05).withColumn("end", F.col("start") + F.length("word") / 14.0)
    return sentences(timed, ["conv_id", "turn"])


@query()
def dub_schedule(spark, d):
    from ..operators.speech import schedule

    c = cues(spark, d).select(F.col("conv_id").cast("string").alias("video_id"), F.col("turn").cast("int").alias("idx"), "start_sec", "end_sec", (F.length("text") / 15.0).alias("spoken_sec"))
    return schedule(c)


@query()
def flicker_cleanup(spark, d):
    """Flicker, repeat and echo steps over conversation cues."""
    from ..config import LIBRARY
    from ..operators import segment as G

    c = cues(spark, d).select(F.col("conv_id").cast("string").alias("video_id"), F.col("turn").cast("int").alias("idx"), "text", "start_sec", F.least(F.col("end_sec"), F.col("start_sec") + 3.9).alias("end_sec"), F.lit(0.9).alias("confidence"), F.lit(5).alias("frame_count"))
    return G.fold_cues(c, lambda own, p: G.drop_echoes(G.merge_repeats(G.absorb_flickers(own, p), p), p), LIBRARY)
