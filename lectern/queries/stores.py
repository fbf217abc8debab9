"""Files in shared folders: recordings that grow while they are read, files written by a job, folders as a batch finds them."""

import base64
import struct

from pyspark.sql import Column, DataFrame, functions as F

from lectern.sources import audio, folders, images, recordings, writers
from lectern.sources.shared import shared_path
from lectern.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: A header whose length was last written when the file was empty, as that of a recording that goes on.
_HEADER = b"RIFF" + struct.pack("<I", 36) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, audio.RATE, 2 * audio.RATE, 2, 16) + b"data" + struct.pack("<I", 0)


def _recorded(docs: DataFrame, tail: str) -> DataFrame:
    """(path, content): a file for each hundred documents, a sample for each of them by id, and bytes behind them."""
    v = F.pmod((F.col("doc_id") + F.col("n_chars")) % 60000 - 30000, F.lit(65536))
    sample = F.concat(F.lpad(F.hex(v % 256), 2, "0"), F.lpad(F.hex(F.floor(v / 256)), 2, "0"))
    pcm = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", sample.alias("s")))), lambda x: x["s"]), "")
    track = F.floor(F.col("doc_id") / 100).cast("string")
    files = docs.groupBy(track.alias("track")).agg(pcm.alias("pcm"))
    header = F.unbase64(F.lit(base64.b64encode(_HEADER).decode()))
    return files.select(F.concat("track", F.lit(".wav")).alias("path"), F.concat(header, F.unhex("pcm"), F.unhex(F.lit(tail))).alias("content"))


@query("""with o as (select doc_id // 100 as track, (doc_id + n_chars) % 60000 - 30000 as s, doc_id % 100 k from documents)
select track, count(*) samples, sum(s)::bigint total, (count(*) / 16000.0)::double as seconds, count(*) filter (k < 40 + track % 7) as early from o group by track""")
def growing_samples(spark, sf_dir):
    """Recordings that are read while they grow: once with their first forty samples or a few more and one byte of the next, again when all is there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    folder, out, state = (shared_path(spark, n) for n in ("recordings", "samples", "samples-state"))

    def read_on() -> None:
        stream = recordings.read_stream(spark, folder, 1 << 16)
        stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()

    early = docs.where(F.col("doc_id") % 100 < 40 + F.floor(F.col("doc_id") / 100) % 7)
    writers.write_files(_recorded(early, "7F"), folder, foreign=writers.REPLACE)
    read_on()
    first = spark.read.schema(recordings.SCHEMA).parquet(out).groupBy("path").agg(F.sum(F.size("pcm")).alias("early"))
    first = first.select(_track().alias("track"), "early").collect()  # a row for each file, as many as the stream's offset has
    writers.write_files(_recorded(docs, ""), folder, foreign=writers.REPLACE)
    read_on()
    read_on()  # nothing new
    total = F.aggregate("pcm", F.lit(0).cast("long"), lambda s, x: s + x)
    got = spark.read.schema(recordings.SCHEMA).parquet(out).groupBy(_track().alias("track")).agg(F.sum(F.size("pcm")).alias("samples"), F.sum(total).alias("total"), F.max(F.col("first") + F.size("pcm")).alias("last"))
    known = spark.createDataFrame(first, "track long, early long")
    # a repeated or lost sample would tear samples and last apart
    return got.where("samples = last").join(known, "track", "left").select("track", "samples", "total", (F.col("samples") / audio.RATE).alias("seconds"), F.coalesce("early", F.lit(0)).cast("long").alias("early"))


def _track() -> Column:
    return F.regexp_extract("path", r"([0-9]+)\.wav$", 1).cast("long")


MARKER = "converter: lectern"
_FOREIGN = "k % 9 = 4"


@query("""select k % 50 || '/p' || k || '.md' as path, case when k % 9 = 4 then 'a note' else '---' || chr(10) || 'converter: lectern' || chr(10) || '---' || chr(10) || urls || chr(10) end as content from (select page_id // 5 as k, string_agg(url, chr(10) order by page_id) as urls from pages group by page_id // 5)""")
def written_files(spark, sf_dir):
    """A Markdown file for each five pages, written twice over each other; notes that stand at some of the names stay."""
    urls = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "url"))), lambda s: s["url"]), "\n")
    p = table(spark, sf_dir, "pages").groupBy(F.floor(F.col("page_id") / 5).alias("k")).agg(urls.alias("urls"))
    path = F.concat((F.col("k") % 50).cast("string"), F.lit("/p"), F.col("k").cast("string"), F.lit(".md"))
    folder = shared_path(spark, "written")
    writers.write_files(p.where(_FOREIGN).select(path.alias("path"), F.lit("a note").alias("content")), folder)
    for _ in range(2):
        writers.write_files(p.select(path.alias("path"), F.concat(F.lit(f"---\n{MARKER}\n---\n"), "urls", F.lit("\n")).alias("content")), folder, MARKER)
    return folders.contents(spark, folder, [".md"]).select("path", F.decode("content", "UTF-8").alias("content"))


@query("""with f as (select distinct page_id // 5 as k from pages), g as (select k, case k % 8 when 0 then '.git/' when 1 then 'a/b.ASSETS/' when 2 then 'd' || k % 30 || '/x y/' else 'd' || k % 30 || '/' end as folder, case when k % 11 = 5 then '~$' else '' end as lock, k % 3 as kind from f)
select folder || lock || 'f' || k || case kind when 0 then '.HTML' when 1 then '.png' else '.txt' end as path, case kind when 1 then 3 when 2 then length(k::varchar) else length('<img src=' || chr(34) || './f' || k + 1 || '.png' || chr(34) || '>') end as bytes from g
where k % 8 not in (0, 1) and k % 11 <> 5 and not (kind = 1 and exists (select 1 from g h where h.k = g.k - 1 and h.kind = 0 and h.k % 8 not in (0, 1) and h.k % 11 <> 5 and h.folder = g.folder and g.lock = ''))""")
def folder_files(spark, sf_dir):
    """What a batch takes from a folder: no hidden or asset folders, no lock files, no images that a page beside them shows."""
    k = F.col("k")
    text = k.cast("string")
    own = F.concat(F.lit("d"), (k % 30).cast("string"), F.lit("/"))
    place = F.when(k % 8 == 0, ".git/").when(k % 8 == 1, "a/b.ASSETS/").when(k % 8 == 2, F.concat(own, F.lit("x y/"))).otherwise(own)
    name = F.concat(F.when(k % 11 == 5, "~$").otherwise(""), F.lit("f"), text, F.when(k % 3 == 0, ".HTML").when(k % 3 == 1, ".png").otherwise(".txt"))
    content = F.when(k % 3 == 0, F.concat(F.lit('<img src="./f'), (k + 1).cast("string"), F.lit('.png">'))).when(k % 3 == 1, "png").otherwise(text)
    folder = shared_path(spark, "folder")
    made = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 5).alias("k")).distinct()
    writers.write_files(made.select(F.concat(place, name).alias("path"), content.alias("content")), folder)
    return folders.expanded(spark, folder, [".html", ".png", ".txt"]).select("path", "bytes")


@query("""with p as (select page_id d, page_id % 5 k, url from pages), i as (
 select d, 0 as nth, 'a&b ' || d as alt, 'data' as kind, 'png ' || k as content, '.svg' as suffix from p
 union all select d, 1, '圖片', 'data', 'x y+z' || k, '.gif' from p
 union all select d, 2, 'c', 'resource', 'part ' || k, '.png' from p
 union all select d, 3, 'd', case when k = 4 then 'missing' else 'local' end, case when k <> 4 then 'file ' || k end, '.jpg' from p
 union all select d, 4, 'e', 'remote', null, '.png' from p
 union all select d, 5, 'f', 'data', 'png ' || k, '.png' from p
 union all select d, 6, '圖片', 'data', null, '.png' from p),
n as (select *, dense_rank() over (partition by d order by first) n from (select *, min(nth) over (partition by d, content) as first from i where content is not null))
select i.d as doc_id, i.nth, i.kind, i.content, i.suffix, case when i.content is not null then '![' || i.alt || '](p%20' || i.d || '.assets/img-' || lpad(n.n::varchar, 4, '0') || (select suffix from i j where j.d = i.d and j.nth = n.first) || ')' end as md from i left join n on n.d = i.d and n.nth = i.nth""")
def page_pictures(spark, sf_dir):
    """Images of pages from data URIs, parts of an archive and files beside the page, with links to the files that they become."""
    k = F.col("page_id") % 5
    n = k.cast("string")
    d = F.col("page_id").cast("string")
    html = F.concat(
        F.lit('<!-- <img src="no.png"> --><script>"<img src=no.png>"</script><IMG class="a > b" data-src="x" SRC="data:image/svg+xml;base64,'), F.base64(F.concat(F.lit("png "), n).cast("binary")), F.lit('" alt="a&amp;b '), d,
        F.lit("\"><img src='data:image/gif,x%20y+z"), n, F.lit("' alt=''><img alt=c src=cid:part"), n, F.lit('><svg><image xlink:href="img/%66'), n, F.lit('.jpg?v=1" alt="d"/></svg>'),
        F.lit('<img alt="e" src=" http://example.org/e.png "><img src="data:;base64,'), F.base64(F.concat(F.lit("png "), n).cast("binary")), F.lit('" alt="f"><img src="data:;base64,A"><img alt="none">'),
    )
    p = table(spark, sf_dir, "pages")
    pages = p.select(F.col("page_id").alias("doc_id"), F.lit("site/a/index.html").alias("path"), html.alias("html"))
    parts = p.select(F.col("page_id").alias("doc_id"), F.concat(F.lit("cid:part"), n).alias("name"), F.concat(F.lit("part "), n).cast("binary").alias("content"))
    beside = spark.range(4).select(F.concat(F.lit("site/a/img/f"), F.col("id").cast("string"), F.lit(".jpg")).alias("path"), F.concat(F.lit("file "), F.col("id").cast("string")).cast("binary").alias("content"))
    found = images.page_images(pages, parts, beside)
    blocks, _ = images.image_blocks(found, F.concat(F.lit("p "), F.col("doc_id").cast("string"), F.lit(".assets")))
    return found.join(blocks, ["doc_id", "nth"], "left").select("doc_id", "nth", "kind", F.decode("content", "UTF-8").alias("content"), "suffix", "md")
