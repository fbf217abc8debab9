"""Streams: the table of events as files that arrive, run until all of it is read."""

from pyspark.sql import DataFrame, functions as F

from lectern.sources.shared import shared_path
from lectern.sources.tables import table
from lectern.streaming import live, progress, tracks

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _events(spark, sf_dir) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parq*")


def _documents(spark, sf_dir) -> DataFrame:
    """Numbers and sizes of the documents, which come by number, as a recording's windows or a job's marks would."""
    return spark.readStream.schema(table(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parq*").select("doc_id", "n_chars")


def _drained(stream: DataFrame, name: str) -> DataFrame:
    """What the stream gives when everything there is has been read."""
    spark, path = stream.sparkSession, shared_path(stream.sparkSession, name)
    live.drain(stream, path, shared_path(spark, f"{name}-state"))
    return spark.read.schema(stream.schema).parquet(path)


@query("""with w as (select user_id % 5 as track, time_bucket(interval '1 hour', ts) as "start", value from events), m as (select max(ts) - interval '2 seconds' as t from events)
select track, "start", count(*) pulls, max(value) longest, list_sort(list(value))[least(count(*) - 1, floor(count(*) * 0.95))::int + 1] p95, count(*) filter (value >= 40) stalls from w, m where "start" + interval '1 hour' <= t group by all""")
def live_diagnostics(spark, sf_dir):
    """Pulls of five tracks in windows of an hour that the watermark has passed."""
    pulls = _events(spark, sf_dir).select((F.col("user_id") % 5).alias("track"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("ms"))
    d = _drained(live.capture_diagnostics(pulls, "1 hour"), "diagnostics")
    return d.select("track", F.col("window.start").cast("timestamp_ntz").alias("start"), "pulls", "longest", "p95", "stalls")


_CUTS = """with recursive lv as (select event_id % 20 as track, (event_id // 20) * 0.5::double as "at", 200 + value * 10 as rms from events),
c as (select distinct track, 0.0::double as "start", 0.0::double as "end" from lv
 union all
 select track, done, case when n < 2 then "at" + 0.5 else best + 0.25 end from (
  select *, row_number() over (partition by track order by "at") nth from (
   select c.track, c."end" as done, l."at", l."at" + 0.5 - c."end" as gone, case when c."end" = 0 then 60 else 300 end as least, count(*) over w n, min(rms) over w low, arg_min(l."at", rms) over w best, median(rms) over w mid
   from c join lv l on l.track = c.track and l."at" >= c."end" + case when c."end" = 0 then 30 else 270 end
   window w as (partition by c.track order by l."at" rows unbounded preceding))
  where gone >= least and (gone >= least + 300 or n >= 2 and low <= greatest(300, 0.3 * mid))) where nth = 1)
select track, "start", "end" from c where "end" > 0"""


@query(_CUTS)
def live_cuts(spark, sf_dir):
    """Spans to transcribe of twenty tracks whose levels come each half second."""
    levels = _events(spark, sf_dir).select((F.col("event_id") % 20).cast("string").alias("track"), (F.floor(F.col("event_id") / 20) * 0.5).alias("at"), (200 + F.col("value") * 10).alias("rms"))
    return _drained(live.cuts(levels), "cuts").select(F.col("track").cast("long").alias("track"), "start", "end")


@query("select user_id % 5 as job, event_type as stage, max(value) as done from events group by all")
def live_progress(spark, sf_dir):
    """The furthest of each stage."""
    p = live.progress(_events(spark, sf_dir).select((F.col("user_id") % 5).alias("job"), F.col("event_type").alias("stage"), F.col("value").alias("done")))
    path = shared_path(spark, "progress")
    live.latest(p, path, shared_path(spark, "progress-state"))
    return spark.read.schema(p.schema).parquet(path)


#: Windows of half a second in a track.
_TRACK = 1000
_LEVELS = f"""lv as (select doc_id // {_TRACK} as track, (doc_id % {_TRACK}) * 0.5::double as "at", (200 + n_chars % 4000)::double as rms from documents), ln as (select track, max("at") + 0.5 as whole from lv group by track)"""


@query(f"""with recursive {_LEVELS},
c as (select track, 0::bigint as step, 0.0::double as "start", 0.0::double as "end", false as flush from ln
 union all
 select track, step + 1, done, case when n < 2 then "at" + 0.5 else best + 0.25 end, false from (
  select *, row_number() over (partition by track order by "at") nth from (
   select *, min("at") over (partition by track) as tried from (
    select c.track, c.step, c."end" as done, l."at", l."at" + 0.5 - c."end" as gone, case when c."end" = 0 then 60 else 300 end as least, count(*) over w n, min(rms) over w low, arg_min(l."at", rms) over w best, median(rms) over w mid
    from c join lv l on l.track = c.track and l."at" >= c."end" + case when c."end" = 0 then 30 else 270 end
    window w as (partition by c.track order by l."at" rows unbounded preceding))
   where gone >= least and (gone >= least + 300 or n >= 2 and low <= greatest(300, 0.3 * mid)))
  where floor(done)::bigint % 2 = 0 or "at" >= tried + 60) where nth = 1),
last as (select c.track, max(step) step, max("end") "end", any_value(whole) whole from c join ln using (track) group by c.track),
f as (select track, step, "end" as "start", "end", whole from last
 union all
 select track, step + 1, "end", case when whole - cut > 1 and quiet is not null then quiet + 0.25 else cut end, whole from (
  select f.*, least(f."end" + 300, whole) as cut, (select case when count(*) >= 2 then arg_min(l."at", rms) end from lv l where l.track = f.track and l."at" >= greatest(f."end", least(f."end" + 300, whole) - 30) and l."at" + 0.5 <= least(f."end" + 300, whole)) as quiet
  from f where f."end" < whole - 0.05))
select track, step - 1 as step, "start" as span_start, "end" as span_end, 'from ' || floor("start")::bigint as text from (select track, step, "start", "end" from c where step > 0 union all select track, step, "start", "end" from f where "end" > "start")""")
def live_segments(spark, sf_dir):
    """Spans of tracks as an engine would get them that fails at first wherever a span begins at an odd second."""
    last = table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0]
    e = F.col("doc_id")
    x = _documents(spark, sf_dir).select(F.floor(e / _TRACK).cast("string").alias("track"), F.timestamp_millis((e + 1) * 500).alias("ts"), ((e % _TRACK) * 0.5).alias("at"), (200 + F.col("n_chars") % 4000).cast("double").alias("rms"), ((e % _TRACK == _TRACK - 1) | (e == F.lit(last))).alias("ends"))
    # the last level of a track is followed by the row that ends it
    rows = F.when(F.col("ends"), F.array(F.struct("at", "rms"), F.struct((F.col("at") + live.WINDOW).alias("at"), F.lit(None).cast("double").alias("rms")))).otherwise(F.array(F.struct("at", "rms")))
    levels = x.select("track", "ts", F.explode(rows).alias("r")).select("track", "ts", "r.at", "r.rms")

    def engine(track: str, start: float, end: float, attempt: int):
        if int(start) % 2 and not attempt:
            raise TimeoutError
        return [(0.0, end - start, f"from {int(start)}")]

    with tracks.state_in_rocksdb(spark):
        found = _drained(tracks.transcribed(levels, engine), "live-segments")
    return found.select(F.col("track").cast("long").alias("track"), "step", "span_start", "span_end", "text")


@query(f"""with {_LEVELS}, k as (select track, whole, greatest(1, ceil((whole - 30) / 270.0))::bigint n, greatest(0, floor((whole - 300) / 270.0) + 1)::bigint filled from ln),
d as (select *, case when track % 3 = 1 then least(filled, 2) else filled end as alive from k),
c as (select track, whole, n, alive, unnest(range(0, greatest(n, alive + (whole > alive * 270 + 15)::int))) as chunk from d)
select track, chunk, chunk * 270.0::double as "start", least(chunk * 270.0 + 300, whole)::double as "end", (case when chunk = 0 then 0 else chunk * 270 + 15 end)::double as own_from, (case when chunk >= greatest(n - 1, alive) then whole else chunk * 270 + 285 end)::double as own_to, chunk < alive as live from c""")
def live_chunks(spark, sf_dir):
    """Chunks of tracks that are analysed while the tracks run; a third of the tracks fail at the third chunk and wait for the end."""
    last = table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0]
    e = F.col("doc_id")
    lengths = _documents(spark, sf_dir).select(F.floor(e / _TRACK).cast("string").alias("track"), ((e % _TRACK + 1) * 0.5).alias("seconds"), ((e % _TRACK == _TRACK - 1) | (e == F.lit(last))).alias("ended"))

    def analyse(track: str, chunk: int) -> None:
        if int(track) % 3 == 1 and chunk == 2:
            raise MemoryError

    with tracks.state_in_rocksdb(spark):
        found = _drained(tracks.chunked(lengths, analyse), "live-chunks")
    return found.withColumn("track", F.col("track").cast("long"))


@query("""with recursive e as (select doc_id // 1000 as job, doc_id % 1000 as i, (doc_id % 1000) * 3.0::double + (doc_id * 7 % 5) * 0.4::double as t, case when doc_id % 1000 < 400 then (doc_id % 1000) / 500.0::double else (doc_id % 1000 - 400) / 600.0::double end as done from documents),
r as (select job, i, t, done, t as t0, [{'t': t, 'd': done}] as s from e where i = 0
 union all
 select job, i, t, done, t0, list_filter(s, lambda x: x.t >= coalesce(list_max(list_transform(list_filter(s, lambda y: y.t <= past), lambda y: y.t)), -1e9)) from (
  select e.job, e.i, e.t, e.done, r.t0, e.t - least(greatest((e.t - r.t0) * 0.25, 120), 300) as past,
   case when e.done < r.s[-1].d then [{'t': e.t, 'd': e.done}] when e.t - r.s[-1].t >= 5 then list_append(r.s, {'t': e.t, 'd': e.done}) else r.s end as s
  from r join e on e.job = r.job and e.i = r.i + 1))
select job, i, done, case when done >= 0.1 and done < 1 and t - s[1].t >= 30 and done > s[1].d then round((1 - done) * (t - s[1].t) / (done - s[1].d), 6) end as "left" from r""")
def progress_left(spark, sf_dir):
    """Jobs of a thousand marks that fall back once, with what is left at each."""
    e = F.col("doc_id")
    i = e % 1000
    done = F.when(i < 400, i / 500).otherwise((i - 400) / 600)
    marks = _documents(spark, sf_dir).select(F.floor(e / 1000).cast("string").alias("job"), (i * F.lit(3.0) + (e * 7 % 5) * F.lit(0.4)).alias("t"), done.alias("done"))
    with tracks.state_in_rocksdb(spark):
        found = _drained(progress.remaining(marks), "progress-left")
    return found.select(F.col("job").cast("long").alias("job"), F.round(F.col("t") / 3 - 0.2).cast("long").alias("i"), "done", F.round("left", 6).alias("left"))
