"""Paths, names, sheets and rectangles."""

from pyspark.sql import Window, functions as F

from lectern.functions import text as x
from lectern.operators import batches, islands, layout, rosters
from lectern.sources import archives
from lectern.sources.tables import seconds, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _paths(spark, sf_dir):
    """Page addresses without scheme and query as paths."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", r"^[a-z]+:/", ""), r"[?#].*$", "").alias("path"))


_PATHS = "p as (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+:/', ''), '[?#].*$', '') path from pages)"


@query(f"with {_PATHS} select page_id, path from p where path like '%.html' and not regexp_matches(path, '(^|/)\\.[^/.][^/]*/')")
def scan_paths(spark, sf_dir):
    return batches.scan(_paths(spark, sf_dir), [".html"])


@query(f"""with {_PATHS}, f as (select *, row_number() over (partition by lower(path) order by page_id) n from p)
select page_id, case when reason is null and row_number() over (partition by reason is null order by page_id) > 150 then 'too many' else reason end reason from
(select page_id, case when n > 1 then 'repeated' when page_id % 13 = 0 then 'missing' when path not like '%.html' then 'unsupported' end reason from f)""")
def validate_batch(spark, sf_dir):
    p = _paths(spark, sf_dir).select(F.col("page_id").alias("ord"), "path", (F.col("page_id") % 13 != 0).alias("exists"))
    return batches.validate(p, [".html"], 150).select(F.col("ord").alias("page_id"), "reason")


@query(f"""with {_PATHS}, d as (select distinct regexp_replace(path, '/[^/]*$', '') path from p union select distinct regexp_replace(path, '^(/[^/]*).*$', '\\1') from p where page_id % 2 = 0)
select path from d where not exists (select 1 from d u where u.path <> d.path and starts_with(d.path, u.path || '/'))""")
def top_level_dirs(spark, sf_dir):
    p = _paths(spark, sf_dir)
    d = p.select(F.regexp_replace("path", r"/[^/]*$", "").alias("path")).union(p.where("page_id % 2 = 0").select(F.regexp_replace("path", r"^(/[^/]*).*$", "$1")))
    return batches.top_level(d)


@query("""with f as (select doc_id, lang || '.md' as name, row_number() over (partition by source, lower(lang || '.md') order by doc_id) n from documents)
select doc_id, case when n = 1 then name else replace(name, '.md', '-' || n || '.md') end as "unique" from f where name is not null""")
def unique_names(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", "source", F.concat("lang", F.lit(".md")).alias("name"))
    return batches.unique_names(d, ["source"], ["doc_id"]).select("doc_id", "unique")


@query("""with n as (select distinct 'n' || label as name from embeddings), r as (select 'n' || (n_nationkey % 7) as name, min(n_nationkey) pos from nation group by all)
select (row_number() over (order by r.pos nulls last, n.name) - 1)::int as place, n.name from n left join r using (name)""")
def roster_order(spark, sf_dir):
    names = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("n"), F.col("label").cast("string")).alias("name"))
    roster = rosters.first_kept(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pos"), F.concat(F.lit("n"), (F.col("n_nationkey") % 7).cast("string")).alias("name")))
    return rosters.in_roster_order(names, roster)


@query("""with r as (select case n_name when (select n_name from nation where n_nationkey = 3) then (select n_name from nation where n_nationkey = 1) else n_name end as name, n_nationkey from nation)
select min(n_nationkey) pos, name from r group by name""")
def roster_rename(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    old, new = (n.where(F.col("n_nationkey") == k).first()["n_name"] for k in (3, 1))
    return rosters.rename(n.select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("name")), old, new)


@query("""with l as (select doc_id * 100000 + generate_subscripts(string_split(text, chr(10)), 1) - 1 as ord, trim(unnest(string_split(text, chr(10)))) word from documents)
select min(ord) as ord, word from l where word <> '' and not starts_with(word, '#') group by word""")
def word_list(spark, sf_dir):
    l = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(x.lines(F.col("text"))).alias("at", "line"))
    return batches.word_list(l.select((F.col("doc_id") * 100000 + F.col("at")).alias("ord"), "line"))


@query("""select page_id, case when regexp_full_match(url, '[0-9A-Za-z_.\\-/\\\\ ]+') then url else '"' || replace(replace(url, '\\', '\\\\'), '"', '\\"') || '"' end as scalar,
 case when regexp_matches(url, '[\\s()]') then '[page](<' || url || '>)' else '[page](' || url || ')' end as link from pages where url is not null""")
def yaml_and_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages").where("url is not null")
    return p.select("page_id", x.yaml_scalar(F.col("url")).alias("scalar"), x.markdown_link(F.lit("page"), F.col("url")).alias("link"))


_BOXES = "b as (select p_partkey k, p_size page, (p_partkey * 37 % 200)::double x0, (p_partkey * 91 % 200)::double y0 from part)"


@query(f"""with {_BOXES}, t as (select page, x0 - 5 x0, y0 - 5 y0 from b where k % 10 = 0)
select page, k::bigint as at from b where k % 10 <> 0 and not exists (select 1 from t where t.page = b.page and greatest(0, least(b.x0 + 20, t.x0 + 40) - greatest(b.x0, t.x0)) * greatest(0, least(b.y0 + 20, t.y0 + 40) - greatest(b.y0, t.y0)) / 400 > 0.5)""")
def outside_tables(spark, sf_dir):
    """Boxes of parts on a page for each size; each tenth is a table."""
    k = F.col("p_partkey")
    b = table(spark, sf_dir, "part").select(F.col("p_size").alias("page"), k.alias("at"), (k * 37 % 200).cast("double").alias("x0"), (k * 91 % 200).cast("double").alias("y0"))
    text = b.where("at % 10 <> 0").withColumns({"x1": F.col("x0") + 20, "y1": F.col("y0") + 20})
    tables = b.where("at % 10 = 0").select("page", (F.col("x0") - 5).alias("x0"), (F.col("y0") - 5).alias("y0"), (F.col("x0") + 35).alias("x1"), (F.col("y0") + 35).alias("y1"))
    return layout.outside_tables(text, tables).select("page", "at")


@query("""with c as (select 's' || l_suppkey % 10 as sheet, l_orderkey::int * 8 + l_linenumber as "row", (l_partkey % 5)::int col, l_orderkey || '-' || l_linenumber as v, l_returnflag = 'R' as title from lineitem),
u as (select sheet, "row", col, v, null as t, 1 as k from c where not title union all select distinct sheet, "row", unnest([col, col + 1]), null, v, 0 from c where title),
w as (select *, last_value(t ignore nulls) over (partition by sheet, col order by "row", k rows unbounded preceding) as title from u)
select sheet, "row", col, v as "value", title from w where k = 1""")
def titled_cells(spark, sf_dir):
    """Order lines as cells; returned ones are titles over two columns."""
    c = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), (F.col("l_suppkey") % 10).cast("string")).alias("sheet"), (F.col("l_orderkey").cast("int") * 8 + F.col("l_linenumber")).alias("row"), (F.col("l_partkey") % 5).cast("int").alias("col"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("value"), "l_returnflag")
    titles = c.where("l_returnflag = 'R'").select("sheet", "row", F.col("col").alias("lo"), (F.col("col") + 1).alias("hi"), F.col("value").alias("title"))
    return layout.titled_cells(c.where("l_returnflag <> 'R'").drop("l_returnflag"), titles)


@query("""select n_nationkey::bigint doc_id, r.r::int as "row", c.c::int as col from nation, range(0, 25) r(r), range(0, 25) c(c) where r.r between n_regionkey and n_nationkey and c.c between 0 and n_regionkey""")
def merged_cells(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.lit("s").alias("sheet"), F.col("n_regionkey").alias("row0"), F.lit(0).alias("col0"), F.col("n_nationkey").alias("row1"), F.col("n_regionkey").alias("col1"))
    return archives.merged_cells(n.where("row1 >= row0")).select("doc_id", "row", "col")


@query("""with d as (select user_id rec_id, (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 1e6 s from events), c as (select rec_id, least(4, greatest(0, floor((s + 5 - 600) / 20400)))::int chunk from d)
select rec_id, chunk, count(*) events, count(*) * 10.0::double as "seconds" from c group by all""")
def owned_counts(spark, sf_dir):
    from lectern.streaming.live import owned_counts as owned

    s = seconds() % 86400
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("rec_id"), s.alias("start"), (s + 10).alias("end"))
    return owned(e, F.lit(86410.0), 21600.0, 1200.0).withColumn("seconds", F.round("seconds", 3))


@query("""with e as (select user_id rec_id, event_id i, event_type in ('view', 'click') zero from events),
f as (select *, row_number() over (partition by rec_id order by i) - row_number() over (partition by rec_id, zero order by i) g from e),
r as (select rec_id, g, count(*) n, min(i) "first" from f where zero group by all having count(*) > 1),
t as (select *, greatest(0, least(n - 1, 10 - sum(n - 1) over (partition by rec_id order by n desc, "first" rows unbounded preceding) + n - 1)) cut from r),
k as (select f.*, t.n, t.cut, row_number() over (partition by f.rec_id, f.zero, f.g order by i) nth from f left join t on f.zero and f.rec_id = t.rec_id and f.g = t.g)
select rec_id, i, case when zero then 0 else 1 end as "sample" from k where not zero or cut is null or nth <= n - cut""")
def trim_silence(spark, sf_dir):
    """Views and clicks as silence, of which ten samples are cut for each user; the longest runs give first."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("rec_id"), F.row_number().over(w).cast("long").alias("i"), "event_id", F.when(F.col("event_type").isin("view", "click"), 0).otherwise(1).alias("sample"))
    kept = islands.trim_zero_runs(e.drop("event_id"), e.select("rec_id").distinct().withColumn("want", F.lit(10)), keep=1)
    return kept.join(e.select("rec_id", "i", "event_id"), ["rec_id", "i"]).select("rec_id", F.col("event_id").alias("i"), "sample")


@query("""with recursive c as (select conv_id mail_id, turn, length(text)::bigint size, row_number() over (partition by conv_id order by turn) k from conversations),
s as (select mail_id, turn, size, k, 0::bigint n, 0::bigint used, false admitted, 0::bigint k2 from c where k = 1
 union all
 select c.mail_id, c.turn, c.size, c.k, s.n + case when s.n < 4 and s.size <= 1500 and s.used + s.size <= 2000 then 1 else 0 end, s.used + case when s.n < 4 and s.size <= 1500 and s.used + s.size <= 2000 then s.size else 0 end, false, c.k from s join c on c.mail_id = s.mail_id and c.k = s.k + 1)
select mail_id, turn as ord, size, n < 4 and size <= 1500 and used + size <= 2000 as admitted from s""")
def mail_budget(spark, sf_dir):
    """Turns as attachments of a conversation; admission depends on what was admitted before."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("mail_id"), F.col("turn").alias("ord"), F.length("text").cast("long").alias("size"))
    return batches.mail_budget(c, 4, 2000, 1500)
