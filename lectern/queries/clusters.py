"""Clustering, packing and page geometry; their steps depend on each other, which SQL has in recursive form for all but the merging of clusters."""

from pyspark.sql import functions as F

from lectern.operators import cluster, packing, sampling
from lectern.sources.tables import segments, table, voices


def _spans(spark, sf_dir):
    """Embeddings as speech spans: a recording for every 50, a span each 4 seconds, of 0 to 8 seconds; the shortest have no vector."""
    d = (F.col("seq") * 7 % 9).cast("double")
    at = (F.col("seq") % 50) * 4.0
    v = voices(spark, sf_dir)
    return v.select(F.floor(F.col("seq") / 50).alias("rec_id"), F.col("seq").alias("span_idx"), at.alias("start"), (at + d).alias("end"), F.when(d >= 0.5, F.col("vec")).alias("vec"))


def hac_cluster(spark, sf_dir):
    """Speakers of all recordings, four in each."""
    return cluster.diarise(_spans(spark, sf_dir), 4).select("rec_id", "span_idx", "speaker", F.round("conf", 6).alias("conf"))


def hac_auto(spark, sf_dir):
    """Speakers with the number left open."""
    return cluster.diarise(_spans(spark, sf_dir)).select("rec_id", "span_idx", "speaker", F.round("conf", 6).alias("conf"))


def speech_blocks_vec(spark, sf_dir):
    """Spans in blocks of one voice."""
    return cluster.speech_groups_of(_spans(spark, sf_dir), same=0.2)


def pack_speech(spark, sf_dir):
    """Views of a user as speech, packed into chunks."""
    s = segments(spark, sf_dir, "view", 9.0)
    base = s.groupBy("rec_id").agg(F.min("start").alias("t0"), F.max("end").alias("t1"))
    x = s.join(base, "rec_id").select("rec_id", ((F.col("start") - F.col("t0")) / 2000).alias("start"), ((F.col("end") - F.col("t0")) / 2000 + 3).alias("end"))
    total = base.select("rec_id", ((F.col("t1") - F.col("t0")) / 2000 + 3).alias("total"))
    return packing.pack_speech(x, total).select("rec_id", "chunk", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


def audit_plan_budget(spark, sf_dir):
    """Blocks to listen to within three minutes for each user."""
    x = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("rec_id"), F.col("event_id").alias("seq"), (F.lit(1.0) + F.col("event_id") % 40).alias("seconds"))
    return sampling.plan_seconds(x, ["rec_id"])


def ocr_lines(spark, sf_dir):
    """Order lines as boxes on a page."""
    l = table(spark, sf_dir, "lineitem")
    x = F.col("l_partkey") % 500
    y = F.col("l_linenumber") * 10.0 + F.col("l_quantity") % 4
    return cluster.ocr_lines(l.select((F.col("l_orderkey") % 500).alias("page"), F.col("l_linestatus").alias("text"), x.cast("double").alias("x0"), y.alias("y0"), (x + 8).cast("double").alias("x1"), (y + 9).alias("y1")))


def near_boxes(spark, sf_dir):
    """Groups of parts as boxes on a page for each brand."""
    p = table(spark, sf_dir, "part")
    x, y = (F.col("p_partkey") * 37 % 600).cast("double"), (F.col("p_partkey") * 91 % 800).cast("double")
    page = F.concat_ws("/", "p_brand", "p_type")
    return cluster.near_boxes(p.select(page.alias("page"), x.alias("x0"), y.alias("y0"), (x + F.col("p_size")).alias("x1"), (y + F.col("p_size")).alias("y1")))


QUERIES = {f.__name__: f for f in (hac_cluster, hac_auto, speech_blocks_vec, pack_speech, audit_plan_budget, ocr_lines, near_boxes)}
ORACLES: dict[str, str] = {
    "speech_blocks_vec": """with recursive v as (select vec_id // 50 rec_id, vec_id span_idx, (vec_id % 50) * 4.0::double s, (vec_id * 7 % 9)::double d, embedding::double[] v from embeddings),
o as (select *, row_number() over (partition by rec_id order by s, span_idx) k from v where d >= 0.5),
g as (select rec_id, span_idx, k, s + d as "until", 0 as block, list_transform(v, lambda x: x * d) c from o where k = 1
 union all
 select o.rec_id, o.span_idx, o.k, o.s + o.d, case when joins then g.block else g.block + 1 end,
  case when joins then list_transform(list_zip(g.c, o.v), lambda x: x[1] + o.d * x[2]) else list_transform(o.v, lambda x: x * o.d) end
 from (select g.*, o.span_idx span2, o.s - g."until" <= 5 and list_cosine_similarity(g.c, o.v) >= 0.2 as joins from g join o on o.rec_id = g.rec_id and o.k = g.k + 1) g join o on o.rec_id = g.rec_id and o.span_idx = g.span2)
select rec_id, span_idx, block from g""",
    "pack_speech": """with recursive x as (select user_id rec_id, event_id, epoch_us(ts) / 1e6 s from events where event_type = 'view'), b as (select rec_id, min(s) t0, max(s) + 9 t1 from x group by rec_id),
p as (select rec_id, greatest(0, (s - t0) / 2000 - 0.2::double) a, least((t1 - t0) / 2000 + 3, (s + 9 - t0) / 2000 + 3 + 0.2::double) z, row_number() over (partition by rec_id order by s, event_id) k from x join b using (rec_id)),
m as (select rec_id, k, 0 as chunk, a, z from p where k = 1
 union all
 select p.rec_id, p.k, case when p.a - m.z <= 3 and p.z - m.a <= 28 then m.chunk else m.chunk + 1 end, case when p.a - m.z <= 3 and p.z - m.a <= 28 then m.a else p.a end, case when p.a - m.z <= 3 and p.z - m.a <= 28 then greatest(m.z, p.z) else p.z end
 from m join p on p.rec_id = m.rec_id and p.k = m.k + 1)
select rec_id, chunk, round(max(a), 6) as "start", round(max(z), 6) as "end" from m group by all""",
    "audit_plan_budget": """with recursive b as (select user_id rec_id, event_id seq, 1.0::double + event_id % 40 + 0.95::double as cost, 1.0::double + event_id % 40 as sec from events where event_type = 'view'),
t as (select rec_id, sum(cost) total from b group by rec_id), o as (select *, row_number() over (partition by rec_id order by sec desc, seq) k from b),
l as (select rec_id, seq, k, case when cost <= 90 then cost else 0 end used, cost <= 90 as taken from o where k = 1
 union all select o.rec_id, o.seq, o.k, l.used + case when l.used + o.cost <= 90 then o.cost else 0 end, l.used + o.cost <= 90 from l join o on o.rec_id = l.rec_id and o.k = l.k + 1),
u as (select rec_id, max(used) used from l group by rec_id),
r as (select b.*, row_number() over (partition by rec_id order by b.seq) - 1 i, count(*) over (partition by rec_id) m, avg(cost) over (partition by rec_id) mean from b join l using (rec_id, seq) where not l.taken),
w as (select distinct rec_id, m, greatest(1, floor((180 - used) / greatest(mean, 0.1)))::int want from r join u using (rec_id)),
q as (select distinct rec_id, least(k * m // want, m - 1) i from (select *, unnest(range(0, want)) k from w)),
s as (select r.*, row_number() over (partition by rec_id order by r.seq) k from r join q using (rec_id, i)),
f as (select s.rec_id, s.seq, s.k, u.used + case when u.used + s.cost <= 180 then s.cost else 0 end used, u.used + s.cost <= 180 as taken from s join u using (rec_id) where s.k = 1
 union all select s.rec_id, s.seq, s.k, f.used + case when f.used + s.cost <= 180 then s.cost else 0 end, f.used + s.cost <= 180 from f join s on s.rec_id = f.rec_id and s.k = f.k + 1)
select rec_id, seq from b join t using (rec_id) where total <= 180
union all select rec_id, seq from l join t using (rec_id) where taken and total > 180
union all select rec_id, seq from f join t using (rec_id) where taken and total > 180""",
    "ocr_lines": """with recursive b as (select l_orderkey % 500 page, l_linestatus as "text", (l_partkey % 500)::double x0, l_linenumber * 10.0::double + l_quantity::double % 4 + 4.5 as mid from lineitem),
o as (select *, row_number() over (partition by page order by mid, x0, "text") k from b),
g as (select page, k, 0 as line, mid, 1 as n from o where k = 1
 union all
 select o.page, o.k, case when abs(o.mid - g.mid) <= 0.6::double * 9 then g.line else g.line + 1 end, case when abs(o.mid - g.mid) <= 0.6::double * 9 then (g.mid * g.n + o.mid) / (g.n + 1) else o.mid end, case when abs(o.mid - g.mid) <= 0.6::double * 9 then g.n + 1 else 1 end
 from g join o on o.page = g.page and o.k = g.k + 1)
select page, line, string_agg("text", ' ' order by x0, k) as "text" from g join o using (page, k) group by page, line""",
    "near_boxes": """with recursive p as (select p_brand || '/' || p_type as page, p_partkey k, (p_partkey * 37 % 600)::double x0, (p_partkey * 91 % 800)::double y0, p_size::double w from part),
g as (select page, k, x0, y0, x0 + w x1, y0 + w y1, 0 step from p
 union all
 select a.page, a.k, min(b.x0), min(b.y0), max(b.x1), max(b.y1), max(a.step) + 1 from g a join g b on a.page = b.page and a.x0 - 3 <= b.x1 and b.x0 - 3 <= a.x1 and a.y0 - 3 <= b.y1 and b.y0 - 3 <= a.y1 where a.step < 40 group by a.page, a.k)
select page, (row_number() over (partition by page order by y0, x0) - 1)::int as box, x0, y0, x1, y1 from (select distinct page, x0, y0, x1, y1 from g where step = 40)""",
}
