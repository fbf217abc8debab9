"""Segments, turns and transcripts."""

from pyspark.sql import Window, functions as F

from lectern.functions.times import hms, mmss
from lectern.operators import intervals, islands, sampling, transcripts as t
from lectern.sources.tables import seconds, segments, spoken, table, turns

_SEG = "seg as (select user_id rec_id, event_id seq, epoch_us(ts) / 1e6 s, epoch_us(ts) / 1e6 + 1800 e from events where event_type = 'view')"
_TURN = "turn as (select user_id rec_id, event_id idx, epoch_us(ts) / 1e6 s, epoch_us(ts) / 1e6 + 1800 e, (event_id % 5)::int speaker, case when event_id % 7 = 0 then 0.0 else value / 100 end conf from events where event_type = 'purchase')"
_SPOKEN = """spoken as (
  select user_id rec_id, event_id seq, epoch_us(ts) / 1e6 s, epoch_us(ts) / 1e6 + 1 + event_id % 90 e,
    case event_type when 'click' then -1 when 'view' then 0 when 'signup' then 1 when 'purchase' then 2 else 3 end speaker,
    case when event_type = 'error' then '(此段轉錄異常' || event_id || ')' else event_type || event_id || ' ' end as text,
    event_type = 'error' marker from events)"""

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""with {_SEG}, {_TURN},
ov as (select seg.rec_id, seq, turn.speaker, row_number() over (partition by seg.rec_id, seq order by least(seg.e, turn.e) - greatest(seg.s, turn.s) desc, idx) n
  from seg join turn on seg.rec_id = turn.rec_id and seg.s < turn.e and turn.s < seg.e where least(seg.e, turn.e) - greatest(seg.s, turn.s) > 0),
lone as (select rec_id, seq, (s + e) / 2 mid from seg where not exists (select 1 from ov where ov.rec_id = seg.rec_id and ov.seq = seg.seq)),
cand as (
  select * from (select l.rec_id, seq, mid - t.e d, idx, speaker, row_number() over (partition by l.rec_id, seq order by t.e desc, idx) n from lone l join turn t on l.rec_id = t.rec_id and t.s < mid) where n = 1
  union all
  select * from (select l.rec_id, seq, t.s - mid d, idx, speaker, row_number() over (partition by l.rec_id, seq order by t.s, idx) n from lone l join turn t on l.rec_id = t.rec_id and t.s >= mid) where n = 1),
near as (select rec_id, seq, speaker, row_number() over (partition by rec_id, seq order by d, idx) n from cand)
select seg.rec_id, seg.seq, coalesce(ov.speaker, near.speaker, 0)::int speaker from seg
left join ov on ov.rec_id = seg.rec_id and ov.seq = seg.seq and ov.n = 1 left join near on near.rec_id = seg.rec_id and near.seq = seg.seq and near.n = 1""")
def assign_turns(spark, sf_dir):
    return intervals.assign_speakers(segments(spark, sf_dir), turns(spark, sf_dir)).select("rec_id", "seq", "speaker")


@query(f"""with {_SEG}, {_TURN},
m as (select seg.rec_id, seq, sum((least(seg.e, turn.e) - greatest(seg.s, turn.s)) * conf) / sum(least(seg.e, turn.e) - greatest(seg.s, turn.s)) c
  from seg join turn on seg.rec_id = turn.rec_id and seg.s < turn.e and turn.s < seg.e where conf <> 0 group by all)
select seg.rec_id, seg.seq, round(coalesce(c, 0), 6) cohesion from seg left join m using (rec_id, seq)""")
def cohesion_weighted(spark, sf_dir):
    return intervals.cohesion(segments(spark, sf_dir), turns(spark, sf_dir)).select("rec_id", "seq", F.round("cohesion", 6).alias("cohesion"))


@query("select conv_id rec_id, turn seq, (turn * 12.5)::double as start, coalesce(lead(turn * 12.5) over (partition by conv_id order by turn), turn * 12.5 + 30)::double as \"end\" from conversations")
def block_bounds(spark, sf_dir):
    x = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("rec_id"), F.col("turn").alias("seq"), (F.col("turn") * 12.5).alias("start"))
    return intervals.block_bounds(x)


@query(f"""with {_SEG}, {_TURN},
b as (select rec_id, seq, s, coalesce(lead(s) over (partition by rec_id order by s, seq), s + 30) e from seg),
sums as (select b.rec_id, b.seq, speaker, sum(turn.e - turn.s) n, min(idx) i from b join turn on b.rec_id = turn.rec_id and (turn.s + turn.e) / 2 >= b.s and (turn.s + turn.e) / 2 < b.e group by all),
own as (select * from (select *, row_number() over (partition by rec_id, seq order by n desc, i) r from sums) where r = 1)
select b.rec_id, b.seq, coalesce(last_value(own.speaker ignore nulls) over (partition by b.rec_id order by b.s, b.seq rows unbounded preceding), 0)::int as label from b left join own on own.rec_id = b.rec_id and own.seq = b.seq""")
def label_blocks_ffill(spark, sf_dir):
    blocks = intervals.block_bounds(segments(spark, sf_dir).select("rec_id", "seq", "start"))
    return intervals.label_blocks(blocks, turns(spark, sf_dir)).select("rec_id", "seq", F.col("label").cast("int").alias("label"))


_BLOCKS = f"""{_SPOKEN},
flag as (select *, case when lag(speaker) over w = speaker and not marker and not lag(marker) over w then 0 else 1 end new from spoken window w as (partition by rec_id order by seq)),
isl as (select *, sum(new) over (partition by rec_id order by seq rows unbounded preceding)::bigint block from flag),
blocks as (select rec_id, block, min(speaker)::int speaker, arg_min(s, seq) as start, arg_max(e, seq) as "end", string_agg(text, '' order by seq) as text, bool_or(marker) is_marker, count(*)::int segments from isl group by rec_id, block)"""


@query(f'with {_BLOCKS} select rec_id, block, speaker, round(start, 6) as start, round("end", 6) as "end", text, is_marker, segments from blocks')
def speech_blocks(spark, sf_dir):
    return islands.speech_blocks(spoken(spark, sf_dir), F.floor(F.col("start") / 604800)).withColumns({"start": F.round("start", 6), "end": F.round("end", 6)})


@query("""with f as (select user_id rec_id, event_type, min(event_id) i from events group by all)
select e.user_id rec_id, e.event_id seq, n.number::int as number from events e join (select *, row_number() over (partition by rec_id order by i) - 1 as number from f) n on n.rec_id = e.user_id and n.event_type = e.event_type""")
def first_appearance(spark, sf_dir):
    x = table(spark, sf_dir, "events").select(F.col("user_id").alias("rec_id"), F.col("event_id").alias("seq"), "event_type")
    return islands.first_appearance(x, ["rec_id"], F.col("seq"), "event_type").select("rec_id", "seq", "number")


@query("""with d as (select event_id, ts::date as day, (epoch_us(ts) - epoch_us(date_trunc('day', ts)))/1e6 mid from events)
select event_id, least(1 + ceil((86400.0 - 21600) / 20400) - 1, greatest(0, floor((mid - 600) / 20400)))::int as chunk from d""")
def chunk_ownership(spark, sf_dir):
    mid = seconds() % 86400
    return table(spark, sf_dir, "events").select("event_id", islands.chunk_number(mid, F.lit(86400.0), 21600.0, 1200.0).alias("chunk"))


@query("""with g as (select user_id, event_id, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by event_id) <= 1800000000 then 0 else 1 end n from events)
select user_id, event_id, sum(n) over (partition by user_id order by event_id rows unbounded preceding)::bigint as session from g""")
def session_gap(spark, sf_dir):
    return islands.sessions(table(spark, sf_dir, "events"), ["user_id"], seconds(), ["event_id"], 1800.0, part=F.floor(seconds() / 604800)).select("user_id", "event_id", "session")


@query(f"""with {_SPOKEN},
k as (select *, case when marker then 0 when e - s <= 60 then 2 else 1 end tier, case when marker then 0 else length(text) end size from spoken)
select rec_id, speaker::int speaker, count(*) segments, arg_max(text, (tier * 1000 + size) * 1000000000::bigint - seq) as text from k group by rec_id, speaker""")
def speaker_hints(spark, sf_dir):
    return t.speaker_hints(spoken(spark, sf_dir)).select("rec_id", "speaker", "segments", "text")


@query("""select user_id rec_id, (event_id % 5)::int speaker, count(*) segments, count(*) * 1800.0::double as seconds, round(avg(case when event_id % 7 = 0 then 0.0 else value / 100 end), 6) cohesion from events where event_type = 'purchase' group by all""")
def speaker_stats(spark, sf_dir):
    return t.speaker_quality(turns(spark, sf_dir)).select("rec_id", "speaker", "segments", F.round("seconds", 3).alias("seconds"), F.round("cohesion", 6).alias("cohesion"))


@query(f"""with {_SPOKEN} select rec_id, count(*) segments, round(sum(e - s), 3) as "seconds", round(list_sort(list(e - s))[count(*) // 2 + 1], 3) as upper_median from spoken where speaker = -1 group by rec_id""")
def unknown_stats(spark, sf_dir):
    return t.unknown_stats(spoken(spark, sf_dir)).select("rec_id", "segments", F.round("seconds", 3).alias("seconds"), F.round("upper_median", 3).alias("upper_median"))


@query("""with q as (select user_id rec_id, (event_id % 5)::int speaker, avg(case when event_id % 7 = 0 then 0.0 else value / 100 end) c from events where event_type = 'purchase' group by all),
m as (select rec_id, list_sort(list(c))[count(*) // 2 + 1] mid from q group by rec_id having count(*) >= 3),
r as (select q.rec_id, speaker, c, row_number() over (partition by q.rec_id order by c, speaker) n from q join m using (rec_id) where c <= mid - 0.10)
select rec_id, n::int place, speaker, round(c, 6) cohesion from r where n <= 3""")
def check_first(spark, sf_dir):
    return t.check_first(t.speaker_quality(turns(spark, sf_dir))).withColumn("cohesion", F.round("cohesion", 6))


_TALK = """talk as (select conv_id rec_id, turn seq, turn * 75.0 s, turn * 75.0 + 70 e, case role when 'user' then 0 when 'assistant' then 1 else -1 end speaker, text from conversations)"""


def _talk(spark, sf_dir):
    speaker = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(-1)
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("rec_id"), F.col("turn").alias("seq"), (F.col("turn") * 75.0).alias("start"), (F.col("turn") * 75.0 + 70).alias("end"), speaker.alias("speaker"), "text")


_MD = f"""{_TALK},
flag as (select *, case when lag(speaker) over (partition by rec_id order by seq) = speaker then 0 else 1 end new from talk),
isl as (select *, sum(new) over (partition by rec_id order by seq rows unbounded preceding) block from flag),
b as (select rec_id, block, min(speaker) speaker, min(s) s, string_agg(text, '' order by seq) as text from isl group by rec_id, block),
md as (select rec_id, '## 會議逐字稿 — ' || rec_id || chr(10) || chr(10) || string_agg('**' || case when speaker = -1 then '未知' else '講者 ' || (speaker + 1)::int end || '** (' || lpad((s::int // 3600)::varchar, 2, '0') || ':' || lpad((s::int % 3600 // 60)::varchar, 2, '0') || ':' || lpad((s::int % 60)::varchar, 2, '0') || ')' || chr(10) || text || chr(10), chr(10) order by block) as md from b group by rec_id)"""


@query(f"with {_MD} select * from md")
def md_render_transcript(spark, sf_dir):
    return t.render_transcript(_talk(spark, sf_dir), F.col("rec_id").cast("string"))


@query(f"""with {_MD}, l as (select rec_id, unnest(string_split(md, chr(10))) line, generate_subscripts(string_split(md, chr(10)), 1) as p from md),
n as (select *, sum(case when regexp_matches(line, '^\\*\\*.+?\\*\\* \\(\\d+:[0-5]\\d:[0-5]\\d\\)\\s*$') then 1 else 0 end) over (partition by rec_id order by p rows unbounded preceding)::bigint seq, regexp_matches(line, '^\\*\\*.+?\\*\\* \\(\\d+:[0-5]\\d:[0-5]\\d\\)\\s*$') own from l)
select rec_id, seq, max(case when own then regexp_extract(line, '^\\*\\*(.+?)\\*\\*', 1) end) as name,
 max(case when own then regexp_extract(line, '\\((\\d+):', 1)::int * 3600 + regexp_extract(line, ':(\\d+):', 1)::int * 60 + regexp_extract(line, ':(\\d+)\\)', 1)::int end)::double as start,
 coalesce(string_agg(trim(line), ' ' order by p) filter (where not own and trim(line) <> ''), '') as text from n where seq > 0 group by rec_id, seq""")
def md_parse_transcript(spark, sf_dir):
    return t.parse_transcripts(t.render_transcript(_talk(spark, sf_dir), F.col("rec_id").cast("string")))


@query(f"with {_MD} select rec_id, replace(replace(replace(md, '**講者 1** (', '**#** ('), '**講者 2** (', '**講者 1** ('), '**#** (', '**講者 2** (') as md from md")
def md_rename_swap(spark, sf_dir):
    return t.rename_speakers(t.render_transcript(_talk(spark, sf_dir), F.col("rec_id").cast("string")), {"講者 1": "講者 2", "講者 2": "講者 1"})


@query("""with w as (select user_id, time_bucket(interval '1 hour', ts) h, sqrt(avg(value * value)) rms from events group by all),
r as (select *, row_number() over (partition by user_id order by rms, h) n from w)
select user_id, h as window_start, round(rms, 6) rms from r where n = 1""")
def rms_quietest(spark, sf_dir):
    x = islands.quietest(table(spark, sf_dir, "events").select("user_id", "ts", "value"), ["user_id"], "1 hour")
    return x.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.round("rms", 6).alias("rms"))


@query("""with c as (select user_id, event_id, epoch_us(ts) / 1e6 t, row_number() over (partition by user_id order by event_id) / 200.0 done from events),
a as (select user_id, arg_min(t, t) t0, arg_min(done, t) d0, arg_max(t, t) t1, arg_max(done, t) d1 from c group by user_id)
select user_id, case when d1 >= 0.1 and t1 - t0 >= 30 and d1 > d0 then round((1 - d1) / ((d1 - d0) / (t1 - t0)), 3) end as "left" from a""")
def eta_window(spark, sf_dir):
    done = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) / 200.0
    x = table(spark, sf_dir, "events").select("user_id", "event_id", seconds().alias("t")).withColumn("done", done)
    return islands.eta(x, ["user_id"]).select("user_id", F.round("left", 3).alias("left"))


@query("select user_id, list_sort(list(value))[least(count(*) - 1, floor(count(*) * 0.95))::int + 1] p95, list_sort(list(value))[count(*) // 2 + 1] upper_median from events group by user_id")
def pct_floor(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "value")
    return islands.floor_percentile(e, ["user_id"], "value", 0.95, "p95").join(islands.upper_median(e, ["user_id"], "value"), "user_id")


@query("select user_id, event_id, last_value(case when event_type = 'signup' then props end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) title from events")
def asof_title(spark, sf_dir):
    x = intervals.as_of(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], F.when(F.col("event_type") == "signup", F.col("props")), "title")
    return x.select("user_id", "event_id", "title")


@query("select event_id, row_number() over (partition by user_id, event_type order by event_id)::int nth from events")
def nth_occurrence(spark, sf_dir):
    return islands.nth_occurrence(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["event_id"]).select("event_id", "nth")


@query("""with s as (select event_id, (epoch_us(ts) // 1000000) % 100000 s from events)
select event_id, lpad((s // 3600)::varchar, 2, '0') || ':' || lpad((s % 3600 // 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') hms,
 case when s >= 3600 then (s // 3600)::varchar || ':' || lpad((s % 3600 // 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') else lpad((s // 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') end mmss from s""")
def clock_texts(spark, sf_dir):
    s = F.floor(seconds()) % 100000
    return table(spark, sf_dir, "events").select("event_id", hms(s).alias("hms"), mmss(s).alias("mmss"))


@query("""with b as (select user_id rec_id, event_id seq, 1 + event_id % 90 d, row_number() over (partition by user_id order by 1 + event_id % 90 desc, event_id) r, count(*) over (partition by user_id) n from events where event_type = 'view'),
k as (select *, n > 12 as cut, row_number() over (partition by rec_id, r <= 6 order by seq) - 1 i, n - 6 m from b),
p as (select *, case when not cut then true when r <= 6 then true else exists (select 1 from range(0, 6) t(j) where least(floor(t.j * m / 6), m - 1) = i) end pick from k)
select rec_id, seq from p where pick""")
def audit_plan_rows(spark, sf_dir):
    x = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("rec_id"), F.col("event_id").alias("seq"), (1 + F.col("event_id") % 90).alias("seconds"))
    return sampling.plan_rows(x, 12).select("rec_id", "seq")


@query(f"""with a as (select user_id rec_id, event_type track, event_id, epoch_us(ts) s, (event_id % 3)::int speaker from events where event_type in ('view', 'click')),
f as (select rec_id, track, speaker, min((s, event_id)) k from a group by all),
n as (select rec_id, track, speaker, row_number() over (partition by rec_id order by k) - 1 number from f)
select event_id, n.number::int as number from a join n using (rec_id, track, speaker)""")
def combine_tracks(spark, sf_dir):
    s = seconds()
    x = table(spark, sf_dir, "events").where("event_type in ('view', 'click')").select(F.col("user_id").alias("rec_id"), F.col("event_type").alias("track"), s.alias("start"), F.col("event_id").cast("double").alias("end"), (F.col("event_id") % 3).cast("int").alias("speaker"), "event_id")
    return t.combine_tracks(x).select("event_id", "number")
