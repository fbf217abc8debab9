"""More of transcripts, names and small texts; inputs are made from the tables, SQL has the rows."""

from pyspark.sql import functions as F

from lectern.functions import labels, text as x
from lectern.functions.times import between_anchors, exif_date, gps_decimal, hms
from lectern.functions.vectors import normalized, rounded
from lectern.operators import audit, batches, cluster, identity, intervals, layout, packing, rosters, transcripts
from lectern.plans.documents import batch_report
from lectern.sources import archives, audio, html
from lectern.sources.tables import spread, table, voices
from lectern.streaming import live

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""with recursive l as (select c_custkey r, "at", (("at" * 2 * 37 + c_custkey) % 101)::double rms from customer, (select unnest(range(0, 600)) * 0.5::double as "at")),
p as (select c_custkey r, 0 part, 0.0::double a, (20 + c_custkey % 190)::double z, null::double cut from customer
 union all
 select p.r, p.part + 1, k.cut, p.z, null from p join lateral (select coalesce(arg_min("at", rms * 1000 + "at"), p.a + 28) cut from l where l.r = p.r and "at" >= p.a + 18 and "at" <= p.a + 28) k on true where p.z - p.a > 28)
select r as rec_id, 0 as chunk, part, a as "start", coalesce(lead(a) over (partition by r order by part), z) as "end" from p""")
def long_chunks(spark, sf_dir):
    """Chunks of 20 to 209 seconds cut at the quietest place before each limit."""
    # a small file is one task, its levels are 600 times as many
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rec_id")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "rec_id")
    chunks = c.select("rec_id", F.lit(0).alias("chunk"), F.lit(0.0).alias("start"), (20 + F.col("rec_id") % 190).cast("double").alias("end"))
    levels = c.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(599)))).select("rec_id", (F.col("k") / 2).alias("at"), ((F.col("k") * 37 + F.col("rec_id")) % 101).cast("double").alias("rms"))
    return cluster.split_long(chunks, levels)


@query("""with recursive s as (select doc_id // 2000 as r, doc_id % 2000 as i, (doc_id * 7919 % 2001 + n_chars % 100) // (1 + doc_id // 37 % 5) as v from documents),
c as (select r, i, coalesce(sum(v * v) over (partition by r order by i rows between unbounded preceding and 1 preceding), 0) c from s), e as (select x.r, x.i, y.c - x.c as e from c x join c y on y.r = x.r and y.i = x.i + 4),
n as (select r, count(*) n from s group by r),
p as (select r, n, 0 as part, 0.37::double a, n / 20.0::double - 0.61::double z from n
 union all
 select p.r, p.n, p.part + 1, coalesce(p.a + 28.0::double - 10.0::double + (q.i - floor((p.a + 28.0::double - 10.0::double) * 20)::bigint + 2.0::double) / 20.0::double, (p.a + 28.0::double - 10.0::double + p.a + 28.0::double) / 2), p.z
 from p left join lateral (select arg_min(e.i, e.e * 100000 + e.i) i from e where e.r = p.r and e.i >= floor((p.a + 28.0::double - 10.0::double) * 20)
  and e.i + 4 < least(floor((p.a + 28.0::double) * 20), p.n)) q on true where p.z - p.a > 28)
select r as rec_id, part, round(a, 9) as "start", round(coalesce(lead(a) over (partition by r order by part), z), 9) as "end" from p""")
def quiet_cuts(spark, sf_dir):
    """Recordings of twenty samples a second, each one long chunk, cut where the samples are quietest."""
    e = F.col("doc_id")
    v = F.floor((e * 7919 % 2001 + F.col("n_chars") % 100) / (1 + F.floor(e / 37) % 5))
    x = table(spark, sf_dir, "documents").select(F.floor(e / 2000).alias("rec_id"), (e % 2000).alias("i"), v.cast("smallint").alias("v"))
    pcm = x.groupBy("rec_id", (F.floor(F.col("i") / 20) * 20).alias("first")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("pcm"))
    chunks = x.groupBy("rec_id").agg((F.count("*") / 20 - 0.61).alias("end")).select("rec_id", F.lit(0).alias("chunk"), F.lit(0.37).alias("start"), "end")
    return packing.split_long(chunks, pcm, rate=20).select("rec_id", "part", F.round("start", 9).alias("start"), F.round("end", 9).alias("end"))


_NAMES = "n as (select n_nationkey pos, 'n' || n_nationkey % 7 as name, n_regionkey from nation)"


@query(f"""with {_NAMES}, r as (select name, min(pos) pos from n where name <> 'n3' group by name), e as (select distinct 'n' || label as name from embeddings),
a as (select name, min(label) as k from (select 'n' || label as name, label from embeddings) where name not in (select name from r) group by name)
select pos::bigint as pos, name from r union all select (select max(pos) from r) + row_number() over (order by k), name from a""")
def roster_edits(spark, sf_dir):
    """A roster without one name, and with the names of samples that it lacks."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pos"), F.concat(F.lit("n"), (F.col("n_nationkey") % 7).cast("string")).alias("name"))
    new = table(spark, sf_dir, "embeddings").select(F.col("label").alias("pos"), F.concat(F.lit(" n"), F.col("label").cast("string"), F.lit(" ")).alias("name"))
    return rosters.add(rosters.remove(rosters.first_kept(n), "n3"), new).select(F.col("pos").cast("long").alias("pos"), "name")


@query("select 'n3' as old, 'm3' as new from region where r_regionkey = 0")
def roster_renamed(spark, sf_dir):
    """One name went and one came."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"))
    return batches.renamed(n, n.withColumn("name", F.when(F.col("name") == "n3", "m3").otherwise(F.col("name"))))


@query("""with l as (select 'n' || label as name from embeddings), o as (select distinct name from l where name not in (select 'n' || n_nationkey from nation where n_nationkey < 7))
select (select count(*) from l) samples, (select count(distinct name) from l) as names, (select count(*) from o) orphans, (select string_agg(name, ',' order by name) from (select name from o order by name limit 3)) as preview""")
def library_summary(spark, sf_dir):
    names = table(spark, sf_dir, "nation").where("n_nationkey < 7").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"))
    return rosters.library_summary(voices(spark, sf_dir), names).withColumn("preview", F.array_join("preview", ","))


@query("""with s as (select distinct l_suppkey % 50 as speaker from lineitem), f as (select s.speaker, 0 i, 0 pos, 'n' || s.speaker % 5 as name from s union all select speaker, 1, 0, 'n' || speaker % 3 from s union all select speaker, 2, n_nationkey, 'n' || n_nationkey % 6 from s, nation),
m as (select speaker, name, min(i * 1000 + pos) k from f group by all)
select speaker, (row_number() over (partition by speaker order by k) - 1)::int as place, name from m""")
def name_choices(spark, sf_dir):
    """Names to choose from: filled in, rival, then all others."""
    s = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("speaker")).distinct()
    named = lambda m: s.select("speaker", F.lit(0).alias("pos"), F.concat(F.lit("n"), (F.col("speaker") % m).cast("string")).alias("name"))
    others = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pos"), F.concat(F.lit("n"), (F.col("n_nationkey") % 6).cast("string")).alias("name"))
    return rosters.choices(named(5), named(3), others)


@query("""with l as (select vec_id, 'n' || label as name, embedding::double[] v from embeddings), e as (select *, row_number() over (partition by label order by vec_id desc) n from embeddings where vec_id % 7 <> 0),
k as (select 'n' || label as name, embedding::double[] v from e where n <= 8)
select l.vec_id as query, l.name, round(max(list_inner_product(l.v, k.v)), 6) as score from l join k using (name) where l.vec_id % 7 = 0 group by all having max(list_inner_product(l.v, k.v)) < 0.2""")
def inconsistent_samples(spark, sf_dir):
    """New samples that are unlike the samples that their name keeps."""
    v = voices(spark, sf_dir)
    new = v.where("seq % 7 = 0").select(F.col("seq").alias("query"), "name", "vec")
    return identity.inconsistent(v.where("seq % 7 <> 0"), new, 0.2).withColumn("score", F.round("score", 6))


@query("""with v as (select vec_id seq, 'n' || label as name, embedding::double[] v from embeddings), x as (select seq, name from v union all select seq + 1000000000, 'm' || seq % 5 from v where seq % 10 = 0)
select seq, name from (select *, row_number() over (partition by name order by seq desc) n from x) where n <= 8""")
def enrolled_samples(spark, sf_dir):
    """Samples of new names behind the library; blank names are rejected, eight of each name stay."""
    v = voices(spark, sf_dir)
    new = v.where("seq % 5 = 0").select((F.col("seq") + 1_000_000_000).alias("seq"), F.when(F.col("seq") % 10 == 0, F.concat(F.lit("m"), (F.col("seq") % 5).cast("string"))).otherwise(" ").alias("name"), "vec")
    return identity.enroll(v, new).select("seq", "name")


@query("""with recursive v as (select vec_id seq, 'n' || label as name, embedding::double[] v from embeddings), e as (select a.seq a, b.seq b from v a join v b on a.name = b.name and (a.seq = b.seq or list_inner_product(a.v, b.v) >= 0.3)),
g as (select seq, seq as r, 0 step from v union all select e.a, min(g.r), max(g.step) + 1 from g join e on g.seq = e.b where g.step < 25 group by e.a)
select seq, name, r as "group" from g join v using (seq) where step = 25""")
def similar_samples(spark, sf_dir):
    """Samples of a name joined while they are alike; the group is its oldest sample."""
    return cluster.similar_groups(voices(spark, sf_dir), 0.3)


_DIMS = "d as (select vec_id // 50 rec_id, (vec_id % 50) * 4.0::double + (vec_id * 7 % 9) / 2.0 as mid, greatest(vec_id * 7 % 9, 0.01)::double w, generate_subscripts(embedding, 1) i, unnest(embedding)::double x from embeddings)"


@query(f"""with {_DIMS}, b as (select rec_id, k, k * 25.0::double a from (select distinct vec_id // 50 rec_id from embeddings), range(0, 8) t(k)),
s as (select b.rec_id, k, i, sum(w * x) x from b join d on d.rec_id = b.rec_id and mid >= a and mid < a + 25 group by all), z as (select rec_id, k, greatest(sqrt(sum(x * x)), 1e-12) n from s group by all),
v as (select rec_id, k, list(round(x / n, 5) order by i) as "vector" from s join z using (rec_id, k) group by all)
select b.rec_id, b.k::bigint as seq, "vector" from b left join v using (rec_id, k)""")
def block_vectors(spark, sf_dir):
    """Vectors of blocks of 25 seconds from the spans in them."""
    v = voices(spark, sf_dir)
    at, d = (F.col("seq") % 50) * 4.0, (F.col("seq") * 7 % 9).cast("double")
    spans = v.select(F.floor(F.col("seq") / 50).alias("rec_id"), at.alias("start"), (at + d).alias("end"), "vec")
    blocks = spans.select("rec_id").distinct().withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    blocks = blocks.withColumns({"start": F.col("seq") * 25.0, "end": F.col("seq") * 25.0 + 25.0})
    return intervals.block_vectors(spans, blocks).select("rec_id", "seq", rounded(F.col("vector"), 5).alias("vector"))


_TALK = "t as (select conv_id rec_id, turn, role, (turn * 10)::double s from conversations), u as (select o_custkey % 100 rec_id, o_orderkey idx, (o_orderkey % 60)::double a, (o_orderkey % 60 + 4)::double z, (o_orderkey % 4)::int speaker from orders)"


@query(f"""with {_TALK}, b as (select rec_id, turn, role, s, coalesce(lead(s) over (partition by rec_id order by s, turn), s + 30) e from t),
n as (select b.rec_id, turn, speaker, sum(z - a) n, min(idx) i from b join u on u.rec_id = b.rec_id and (a + z) / 2 >= s and (a + z) / 2 < e group by all),
o as (select rec_id, turn, speaker from (select *, row_number() over (partition by rec_id, turn order by n desc, i) k from n) where k = 1),
l as (select b.rec_id, b.turn, role, coalesce(last_value(o.speaker ignore nulls) over (partition by b.rec_id order by b.turn rows unbounded preceding), 0) as label from b left join o on o.rec_id = b.rec_id and o.turn = b.turn),
f as (select rec_id, label, row_number() over (partition by rec_id order by min(turn)) - 1 as k from l group by rec_id, label)
select l.rec_id, l.turn as seq, role as name, k::int as speaker, count(distinct k) over (partition by l.rec_id) as speakers from l join f on f.rec_id = l.rec_id and f.label = l.label""")
def relabelled_blocks(spark, sf_dir):
    """Blocks of a transcript with the speakers of new turns, numbered by first appearance, and how many there are."""
    parsed = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("rec_id"), F.col("turn").alias("seq"), F.col("role").alias("name"), (F.col("turn") * 10.0).alias("start"), F.lit("").alias("text"))
    k = F.col("o_orderkey") % 60
    turns = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("rec_id"), F.col("o_orderkey").alias("idx"), k.cast("double").alias("start"), (k + 4).cast("double").alias("end"), (F.col("o_orderkey") % 4).cast("int").alias("speaker"))
    r = transcripts.relabel_blocks(parsed, turns).select("rec_id", "seq", "name", F.col("speaker").cast("int").alias("speaker"))
    return r.join(transcripts.speakers_after(parsed, turns), "rec_id")


_CLOCK = lambda c: f"printf('%02d:%02d:%02d', ({c} // 3600)::int, ({c} % 3600 // 60)::int, ({c} % 60)::int)"


@query(f"""with {_TALK}, b as (select rec_id, turn, role, s, coalesce(lead(s) over (partition by rec_id order by s, turn), s + 30) e from t),
n as (select b.rec_id, turn, speaker, sum(z - a) n, min(idx) i from b join u on u.rec_id = b.rec_id and (a + z) / 2 >= s and (a + z) / 2 < e group by all),
o as (select rec_id, turn, speaker from (select *, row_number() over (partition by rec_id, turn order by n desc, i) k from n) where k = 1),
l as (select b.rec_id, b.turn, coalesce(last_value(o.speaker ignore nulls) over (partition by b.rec_id order by b.turn rows unbounded preceding), 0) as label from b left join o on o.rec_id = b.rec_id and o.turn = b.turn),
f as (select rec_id, label, row_number() over (partition by rec_id order by min(turn)) as k from l group by rec_id, label),
x as (select l.rec_id, l.turn, l.label, k, k is distinct from lag(k) over (partition by l.rec_id order by l.turn) as starts from l join f on f.rec_id = l.rec_id and f.label = l.label),
q as (select rec_id, speaker as label, sum(z - a)::bigint sec from u group by all),
d as (select q.rec_id, string_agg('| 講者 ' || k || ' | ' || (select count(*) from x where x.rec_id = q.rec_id and x.k = f.k and starts) || ' | ' || {_CLOCK("sec")} || ' | 0.75 |' || chr(10), '' order by k) as rows from q join f using (rec_id, label) group by q.rec_id),
m as (select rec_id, '# talk' || chr(10) || chr(10) || string_agg('**講者 ' || k || '** (' || {_CLOCK("turn * 10")} || ')' || chr(10) || '**講者 9** says ' || turn, chr(10) || chr(10) order by turn) as body from x group by rec_id)
select rec_id, body || case when rows is null then chr(10) else chr(10) || chr(10) || '## 講者辨識診斷' || chr(10) || chr(10) || '> ⚠️ **這份逐字稿人工改掛過**,所以下面的數字與排序是**機器分群當下**的結果,與內文已經對不上:' || chr(10) || '> - 「講者 1」、「b」的 3 段已改掛給「Zoe」' || chr(10) || '> - 這一群的 1 段已改掛給「Ann」' || chr(10) || chr(10) || '| 講者 | 發言輪次 | 總時長 | 群內一致性 |' || chr(10) || '| --- | ---: | ---: | ---: |' || chr(10) || rows end as md from m left join d using (rec_id)""")
def reclustered(spark, sf_dir):
    """Transcripts with the speakers of new turns and new notes, in which what was moved by hand is entered twice."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("rec_id"), "turn", "role")
    line = F.concat(F.lit("**"), "role", F.lit("** ("), hms(F.col("turn") * 10), F.lit(")  \n**講者 9** says "), F.col("turn").cast("string"))
    md = c.groupBy("rec_id").agg(F.concat(F.lit("# talk\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda s: s["l"]), "\n\n"), F.lit("\n\n## 講者辨識診斷\n\n| old | notes |\n")).alias("md"))
    k = F.col("o_orderkey") % 60
    turns = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("rec_id"), F.col("o_orderkey").alias("idx"), k.cast("double").alias("start"), (k + 4).cast("double").alias("end"), (F.col("o_orderkey") % 4).cast("int").alias("speaker"), F.lit(0.75).alias("conf"))
    new = transcripts.recluster(md, turns, transcripts.speaker_quality(turns))
    once = transcripts.note_reassigned(F.col("md"), F.array(F.lit("講者 1"), F.lit("b")), F.lit("Zoe"), F.lit(3))
    return new.withColumn("md", once).withColumn("md", transcripts.note_reassigned(F.col("md"), F.array().cast("array<string>"), F.lit("Ann"), F.lit(1)))


@query("""select conv_id rec_id, string_agg('**' || case when role = 'user' and n = 1 then 'Zoe' else role end || '** (00:00:0' || turn % 10 || ')' || chr(10) || turn, chr(10) || chr(10) order by turn) as md, sum(case when role = 'user' and n = 1 then 1 else 0 end)::bigint moved
from (select *, row_number() over (partition by conv_id, role order by turn) n from conversations) group by conv_id""")
def reassigned_lines(spark, sf_dir):
    """The first line of one speaker in each transcript goes to another."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("rec_id"), "turn", "role")
    line = F.concat(F.lit("**"), "role", F.lit("** (00:00:0"), (F.col("turn") % 10).cast("string"), F.lit(")\n"), F.col("turn").cast("string"))
    md = c.groupBy("rec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda s: s["l"]), "\n\n").alias("md"))
    wanted = c.where("role = 'user'").groupBy("rec_id").agg(F.min("turn").alias("t")).select("rec_id", F.lit("user").alias("name"), (F.col("t") % 10).cast("double").alias("start"), F.lit(1).alias("times"))
    return transcripts.reassign(md, wanted, "Zoe")


@query("select o_orderkey, case when o_orderkey % 5 = 0 then '未知' else '講者 ' || o_orderkey % 5 end as label, '(此段轉錄異常 ' || printf('%02d:%02d', (o_orderkey % 3000 // 60)::int, (o_orderkey % 60)::int) || '–' || printf('%02d:%02d', ((o_orderkey % 3000 + 30) // 60)::int, ((o_orderkey % 3000 + 30) % 60)::int) || case when o_orderkey % 2 = 0 then ',重複「' || o_orderstatus || '」' else '' end || ')' as note, '[註' || o_orderkey % 9 || ']' as mark from orders")
def labels_and_notes(spark, sf_dir):
    """Speakers' labels, notes on broken segments, marks of footnotes."""
    k = F.col("o_orderkey")
    start = k % 3000
    return table(spark, sf_dir, "orders").select("o_orderkey", x.speaker_label(k % 5 - 1).alias("label"), x.degenerate_note(start, start + 30, F.when(k % 2 == 0, F.col("o_orderstatus"))).alias("note"), x.note_marker(F.lit(labels.FOOTNOTE), k % 9).alias("mark"))


@query("select p_partkey, p_name || chr(10) || chr(10) || p_brand || chr(10) || p_type as pairs, p_name || chr(10) || p_brand as cells, p_type as body, '20' || lpad((p_size % 30)::varchar, 2, '0') || '-01-02 03:04:05' as taken, round((p_size + 30 / 60.0 + 36 / 3600.0) * case when p_partkey % 2 = 0 then -1 else 1 end, 9)::double as degrees, floor(least(greatest(2000 + (p_size - 8) * 2000 / 24.0, 2000), 4000))::int as room, case when p_size = 0 then 0 else p_size * 870 + 15 end::double as settled from part")
def small_texts(spark, sf_dir):
    """Line ends, leading headings, dates and places of pictures, room for memory, settled seconds."""
    p = table(spark, sf_dir, "part")
    n = F.col("p_size")
    room = between_anchors(n, (8.0, 2000.0), (32.0, 4000.0))
    return p.select(
        "p_partkey",
        x.one_newline_pair(F.concat("p_name", F.lit("\n\n\n\n"), "p_brand", F.lit("\n"), "p_type")).alias("pairs"),
        x.clean_cell_breaks(F.concat("p_name", F.lit(" \t\u000b"), "p_brand", F.lit("  "))).alias("cells"),
        x.drop_leading_heading(F.concat(F.lit("## Old title\n\n"), "p_type")).alias("body"),
        exif_date(F.concat(F.lit("20"), F.lpad((n % 30).cast("string"), 2, "0"), F.lit(":01:02 03:04:05"))).alias("taken"),
        F.round(gps_decimal(n, F.lit(30), F.lit(36), F.when(F.col("p_partkey") % 2 == 0, "s").otherwise("N")), 9).alias("degrees"),
        room.alias("room"),
        live.done_seconds(n, 870.0).alias("settled"),
    )


@query("select s_suppkey, s_suppkey % 3 <> 2 as old, s_suppkey % 3 = 1 as encrypted from supplier")
def old_office_files(spark, sf_dir):
    """Files that begin as old office files do, and those of them that are encrypted."""
    k = F.col("s_suppkey") % 3
    head = F.unhex(F.when(k == 2, "504B0304").otherwise(archives.OLE_MAGIC))
    body = F.when(k == 1, F.encode(F.lit("EncryptionInfo"), "UTF-16LE")).otherwise(F.encode("s_name", "UTF-16LE"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(head, body).alias("content"))
    return s.select("s_suppkey", archives.is_old_office(F.col("content")).alias("old"), archives.is_encrypted(F.col("content")).alias("encrypted"))


@query("select case when page_id % 3 = 0 then 'failed' when page_id % 3 = 1 then 'skipped' else 'converted' end as state, count(*) as files, string_agg(page_id::varchar, ',' order by page_id::varchar) filter (n <= 20) as names from (select *, row_number() over (partition by page_id % 3 order by page_id::varchar) n from pages) group by page_id % 3")
def batch_states(spark, sf_dir):
    """How a batch went, with the first names of each state."""
    k = F.col("page_id") % 3
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.when(k == 0, "broken").alias("error"), F.when(k <= 1, "there").alias("skipped"))
    return batch_report(p).withColumn("names", F.array_join("names", ","))


@query("select n_nationkey as ord, 'n' || n_nationkey as old, n_name as new, n_nationkey % 4 <> 0 as rule from nation")
def parsed_rules(spark, sf_dir):
    """Lines of two words are rules; lines of one are reported, comments and blank lines are not."""
    n = table(spark, sf_dir, "nation")
    old = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    lines = n.select(F.col("n_nationkey").alias("ord"), F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("  "), old)).otherwise(F.concat(old, F.lit("\t "), F.replace("n_name", F.lit(" "), F.lit("_")), F.lit(" rest"))).alias("line"))
    noise = n.select((F.col("n_nationkey") + 1000).alias("ord"), F.when(F.col("n_nationkey") % 2 == 0, "# no rule here").otherwise("  ").alias("line"))
    good, bad = batches.parse_rules(lines.unionByName(noise))
    names = n.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("given"))
    found = good.join(names, "ord").where(F.col("new") == F.replace("given", F.lit(" "), F.lit("_"))).select("ord", "old", F.col("given").alias("new"), F.lit(True).alias("rule"))
    return found.unionByName(bad.join(names, "ord").select("ord", F.trim("line").alias("old"), F.col("given").alias("new"), F.lit(False).alias("rule")))


@query("select s_name || '.assets' as name from supplier where s_suppkey % 3 = 0")
def removable_folders(spark, sf_dir):
    """Folders of assets whose Markdown file is gone."""
    s = table(spark, sf_dir, "supplier")
    return batches.removable_assets(s.select(F.concat("s_name", F.lit(".assets")).alias("name")), s.where("s_suppkey % 3 <> 0").select(F.col("s_name").alias("stem")))


@query("select conv_id doc_id, count(*) missing, string_agg(case when n <= 3 then substr('gone ' || turn || ' of ' || role, 1, 20) end, '|' order by turn) as examples from (select *, row_number() over (partition by conv_id order by turn) n from conversations where turn % 2 = 1) group by conv_id")
def gap_notes(spark, sf_dir):
    """What of a document's texts is missing in its blocks, with the first examples."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.concat(F.lit("gone "), F.col("turn").cast("string"), F.lit(" of "), "role").alias("fragment"))
    blocks = c.where("turn % 2 = 0").select("doc_id", F.col("turn").alias("pos"), F.lit("para").alias("kind"), F.col("fragment").alias("text"), F.lit(None).cast("array<array<string>>").alias("rows"), F.lit(None).cast("string").alias("caption"))
    blocks = blocks.unionByName(c.select("doc_id").distinct().select("doc_id", F.lit(-1).cast("long").alias("pos"), F.lit("para").alias("kind"), F.lit("x").alias("text"), F.lit(None).cast("array<array<string>>").alias("rows"), F.lit(None).cast("string").alias("caption")))
    gaps = audit.missing(c.select("doc_id", F.col("turn").alias("at"), "fragment"), blocks)
    return audit.gap_notes(gaps).withColumn("examples", F.array_join("examples", "|"))


@query("select p_partkey, p_size % 7 >= 5 and p_size * 10 >= 300 as backdrop, row_number() over (partition by p_brand order by round(p_retailprice % 100, 1), round((p_partkey % 50)::double, 1), p_partkey) - 1 as place from part")
def page_places(spark, sf_dir):
    """Places in reading order, and pictures behind a page's text."""
    p = table(spark, sf_dir, "part").withColumns({"y0": F.col("p_retailprice") % 100, "x0": (F.col("p_partkey") % 50).cast("double") + F.col("p_partkey") * 1e-9})
    share, chars = F.when(F.col("p_size") % 7 >= 5, 0.95).otherwise(0.9), F.when(F.col("p_size") * 10 >= 300, 400).otherwise(399)
    return layout.reading_order(p, ["p_brand"], ("p_partkey",)).select("p_partkey", layout.is_backdrop(share, chars).alias("backdrop"), "place")


@query("""with c as (select 's' || l_suppkey % 10 as sheet, l_orderkey::int * 8 + l_linenumber as r, (l_partkey % 5)::int col, l_returnflag = 'R' as title, l_orderkey || '-' || l_linenumber v from lineitem),
u as (select sheet, r, col, null as t, 1 as k from c where not title union all select distinct sheet, r, unnest([col, col + 1]), v, 0 from c where title),
w as (select *, last_value(t ignore nulls) over (partition by sheet, col order by r, k rows unbounded preceding) as own from u)
select sheet, (select count(distinct v) from c where title and c.sheet = w.sheet) as titles, count(distinct own) as filled, round(avg(case when own is null then 1.0 else 0 end), 9)::double as orphans, count(distinct own) >= (select count(distinct v) from c where title and c.sheet = w.sheet) * 0.5 and avg(case when own is null then 1.0 else 0 end) <= 0.2 as accepted from w where k = 1 group by sheet""")
def side_by_side(spark, sf_dir):
    """Whether a sheet of order lines, returned ones as titles over two columns, is tables side by side."""
    c = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), (F.col("l_suppkey") % 10).cast("string")).alias("sheet"), (F.col("l_orderkey").cast("int") * 8 + F.col("l_linenumber")).alias("row"), (F.col("l_partkey") % 5).cast("int").alias("col"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("value"), "l_returnflag")
    titles = c.where("l_returnflag = 'R'").select("sheet", "row", F.col("col").alias("lo"), (F.col("col") + 1).alias("hi"), F.col("value").alias("title"))
    return layout.side_by_side(layout.titled_cells(c.where("l_returnflag <> 'R'").drop("l_returnflag"), titles), titles).withColumn("orphans", F.round("orphans", 9))


@query("select page_id, 'a' || chr(8220) || page_id || '”…<é&' as text, case when page_id % 2 = 0 then 'big5' else 'utf-8' end as charset from pages")
def decoded_references(spark, sf_dir):
    """Character references, those of Windows characters too, and the charset that a page names."""
    n = F.col("page_id").cast("string")
    head = F.when(F.col("page_id") % 2 == 0, '<html><META http-equiv="Content-Type" content="text/html; charset=Big5">').otherwise("<meta charset='UTF-8'/>")
    return table(spark, sf_dir, "pages").select("page_id", html.unescaped(F.concat(F.lit("a&#147;"), n, F.lit("&#x94;&hellip;&lt;&eacute;&amp;"))).alias("text"), html.declared_charset(F.encode(head, "UTF-8")).alias("charset"))


@query("""select n_nationkey::bigint doc_id, (a.pos - 1)::int as pos, a.kind, a.level, a.text, a.rel_path from (select n_nationkey, n_name, n_nationkey as k, unnest([
 {'pos': 1, 'kind': 'heading', 'level': 2, 'text': n_name, 'rel_path': null}, {'pos': 2, 'kind': 'para', 'level': null, 'text': '**' || n_name || '** and *more* in [a link](http://x/' || n_nationkey || ') here', 'rel_path': null},
 {'pos': 3, 'kind': 'image', 'level': null, 'text': 'Alt', 'rel_path': 'i/' || n_nationkey || '.png'}, {'pos': 4, 'kind': 'para', 'level': null, 'text': '- one', 'rel_path': null}, {'pos': 5, 'kind': 'para', 'level': null, 'text': '- two', 'rel_path': null}, {'pos': 6, 'kind': 'para', 'level': null, 'text': 'nested text', 'rel_path': null}]) a from nation)""")
def html_inline(spark, sf_dir):
    """Headings, marks, links, images, lists and nested containers of made pages."""
    n = F.col("n_nationkey").cast("string")
    page = F.concat(F.lit("<head><title>no</title></head><h2> "), "n_name", F.lit("\n</h2><p><b>"), "n_name", F.lit('</b> and <em>more</em> in <a href="http://x/'), n, F.lit('">a  link</a> here<a href="#top"></a></p><script>no()</script><img alt=Alt src="i/'), n, F.lit('.png"><img src="http://far/x.png"><ul><li>one<li>two</ul><div><div>nested text</div></div>'))
    return html.html_blocks(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), page.alias("html"))).select("doc_id", "pos", "kind", "level", "text", "rel_path")


@query("select p_partkey, 3::int as pairs, (p_size * 2 + 5)::bigint as left_sum, p_size::bigint as right_sum, round(p_size / 32768.0, 9)::double as first, (16000 * 0.45)::int + 4 as joined from part")
def audio_clips(spark, sf_dir):
    """Two tracks of a recording side by side, samples as fractions, and clips with silence between them."""
    n = F.col("p_size").cast("smallint")
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", F.array(n, n, F.lit(5).cast("smallint")).alias("l"), F.array(n).alias("r"))
    both = audio.merge_stereo(F.col("l"), F.col("r"))
    total = lambda a, c: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v[c])
    one = lambda a, b: F.struct(F.lit(a / audio.RATE).alias("start"), F.lit(b / audio.RATE).alias("end"))
    clips = audio.cut_and_join(F.col("l"), F.array(one(0.5, 2.5), one(1.5, 9.5)), pad=0.0)
    return p.select("p_partkey", F.size(both).alias("pairs"), total(both, "left").alias("left_sum"), total(both, "right").alias("right_sum"), F.round(F.get(audio.to_float(F.col("l")), F.lit(0)), 9).alias("first"), F.size(clips).alias("joined"))


@query("""select o_custkey doc_id, o_orderkey as "row" from orders where o_orderkey % 3 = 0""")
def unrecalculated_cells(spark, sf_dir):
    """Cells with a formula but no stored value, in workbooks of customers' orders."""
    o = table(spark, sf_dir, "orders")
    r = F.col("o_orderkey").cast("string")
    cell = F.concat(F.lit('<c r="A'), (F.col("o_orderkey") + 1).cast("string"), F.lit('"><f>B'), r, F.lit("</f>"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("<v>"), r, F.lit("</v>"))).otherwise(""), F.lit("</c>"))
    sheets = o.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.concat(F.lit("<sheetData>"), F.array_join(F.sort_array(F.collect_list(cell)), ""), F.lit("</sheetData>")).alias("content"))
    files = archives.packed(sheets.select("doc_id", F.lit("xl/worksheets/sheet1.xml").alias("part"), "content"))
    return archives.unrecalculated(archives.xlsx_cells(files)).select("doc_id", F.col("row").cast("long").alias("row"))


@query()
def spoken_words(spark, sf_dir):
    """Texts without punctuation, then with tokens put together again; SQL's expressions cannot look behind."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", x.strip_punctuation(F.col("text")).alias("plain"), x.reglue(F.regexp_replace("text", r"([.\-:/])", " $1 ")).alias("glued"))
