"""From files to Markdown: a reader for each ending, then one way for all blocks."""

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from lectern.functions.labels import ATTACHMENT, ATTACHMENT_NOTES
from lectern.functions.markdown import render
from lectern.functions.text import asset_link, sanitize_name, stem_of, suffix_of
from lectern.sources import archives, html, mail, texts
from lectern.sources.shared import stored

COLUMNS = {"doc_id": "bigint", "pos": "int", "kind": "string", "level": "int", "text": "string", "rows": "array<array<string>>", "has_header": "boolean", "caption": "string", "note_kind": "string", "lossy": "boolean", "rel_path": "string"}


def _pages(files: DataFrame) -> DataFrame:
    return html.html_blocks(texts.decoded(files).select("doc_id", F.col("text").alias("html")))


def _book(files: DataFrame) -> DataFrame:
    chapters = archives.epub_chapters(files)
    blocks = html.html_blocks(chapters.select(F.struct("doc_id", "pos").alias("doc_id"), "html"))
    place = F.row_number().over(Window.partitionBy("doc_id.doc_id").orderBy("doc_id.pos", "pos")) - 1
    return blocks.withColumn("_place", place).drop("pos").withColumn("doc_id", F.col("doc_id.doc_id")).withColumnRenamed("_place", "pos")


def _message(files: DataFrame) -> DataFrame:
    """Header and body of mails."""
    return _letter(mail.mail_parts(files))


def _letter(p: DataFrame) -> DataFrame:
    body = F.when(F.col("is_html"), F.array_join(html.visible_texts(F.col("body")), "\n\n")).otherwise(F.col("body"))
    return texts.text_blocks(p.select("doc_id", F.concat(mail.header_lines(F.col("headers")), F.lit("\n\n"), body).alias("text")))


def _mail(files: DataFrame, folder: str = "assets", most: int | None = 200) -> DataFrame:
    """Header and body of mails, then each attachment: a heading, a link, and what its reader gives, two headings lower.

    Attached mails are read like that too, within the depth and the budget of mail.attachments; what was not taken, or has
    no reader, leaves a note. Mails are opened once, and so are attachments: both are stored for their several uses.
    """
    opened = stored(mail.opened(files), "mails")
    body = _shaped(_letter(opened))
    if opened.isEmpty():
        return body
    key = F.xxhash64("mail_id", "path")
    order = F.array_join(F.transform("path", lambda i: F.lpad(i.cast("string"), 6, "0")), ".")
    # stored with their names, which are made in Python
    a = stored(mail.attachments(opened, most=most).select("mail_id", "reason", "depth", "data", key.alias("key"), order.alias("ord"), sanitize_name(F.col("name"), ATTACHMENT).alias("name")), "attachments")
    taken = a.where("reason is null").withColumn("_suffix", suffix_of(F.col("name")))
    inner = _read(taken.select(F.col("key").alias("doc_id"), "_suffix", F.col("data").alias("content")), {**ROUTES, ".eml": _message})
    inner = stored(inner, "inner").withColumnRenamed("doc_id", "key").join(a.select("key", "mail_id", "depth", "ord"), "key")
    inner = inner.withColumn("level", F.when(F.col("kind") == "heading", F.col("level") + 2 * F.col("depth")).otherwise(F.col("level")))
    places = ["_ord", "_step"]
    own = lambda source, step, columns: source.select(*[F.col("mail_id").alias("doc_id"), F.col("ord").alias("_ord"), F.lit(step).alias("_step"), *[(columns[c] if c in columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items() if c != "doc_id"]])
    heads = own(taken, 0, {"pos": F.lit(0), "kind": F.lit("heading"), "level": 2 * F.col("depth"), "text": F.concat(F.lit(f"{ATTACHMENT}:"), "name")})
    shown = own(taken, 1, {"pos": F.lit(0), "kind": F.lit("para"), "text": F.concat(F.lit("["), "name", F.lit("]("), asset_link(F.lit(folder), F.col("name")), F.lit(")"))})
    what = own(inner, 2, {c: F.col(c) for c in COLUMNS if c != "doc_id"})
    note = lambda kind: F.replace(F.lit(ATTACHMENT_NOTES[kind]), F.lit("{}"), F.col("name"))
    left = a.join(inner.select("key").distinct(), "key", "left_anti").where("reason is null or reason in ('cycle', 'budget')")
    said = F.when(F.col("reason") == "cycle", note("cycle")).when(F.col("reason") == "budget", note("budget")).otherwise(note("other"))
    notes = own(left, 3, {"pos": F.lit(0), "kind": F.lit("note"), "text": said, "note_kind": F.coalesce("reason", F.lit("attachment")), "lossy": F.lit(True)})
    first = body.withColumns({"_ord": F.lit(""), "_step": F.lit(0)})
    x = reduce(DataFrame.unionByName, [first, heads, shown, what, notes])
    return x.withColumn("pos", (F.row_number().over(Window.partitionBy("doc_id").orderBy(*places, "pos")) - 1).cast("int")).drop(*places)


def _web_archive(files: DataFrame) -> DataFrame:
    return html.html_blocks(mail.web_archives(files).select("doc_id", "html"))


#: Readers by ending: (doc_id, content) to blocks.
ROUTES = {
    ".txt": lambda f: texts.text_blocks(texts.decoded(f)),
    ".csv": lambda f: texts.delimited_blocks(texts.decoded(f)),
    ".tsv": lambda f: texts.delimited_blocks(texts.decoded(f)),
    ".md": lambda f: texts.markdown_blocks(texts.decoded(f)),
    ".rtf": texts.rtf_blocks,
    ".html": _pages,
    ".htm": _pages,
    ".docx": archives.docx_blocks,
    ".docm": archives.docx_blocks,
    ".pptx": archives.pptx_blocks,
    ".pptm": archives.pptx_blocks,
    ".xlsx": lambda f: archives.sheet_blocks(archives.xlsx_cells(f)),
    ".xlsm": lambda f: archives.sheet_blocks(archives.xlsx_cells(f)),
    ".epub": _book,
    ".eml": _mail,
    ".mht": _web_archive,
    ".mhtml": _web_archive,
}


def _shaped(blocks: DataFrame) -> DataFrame:
    """All block columns, null where a reader has none."""
    have = set(blocks.columns)
    return blocks.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])


def _read(files: DataFrame, routes: dict) -> DataFrame:
    """Blocks of files (doc_id, _suffix, content) by the readers of the endings that are there."""
    there = {r["_suffix"] for r in files.where(F.col("_suffix").isin(*routes)).select("_suffix").distinct().collect()}  # no more than routes
    parts = [_shaped(reader(files.where(F.col("_suffix") == s).select("doc_id", "content"))) for s, reader in routes.items() if s in there]
    none = files.select("doc_id").where(F.lit(False))
    return reduce(DataFrame.unionByName, parts) if parts else _shaped(none)


def read_blocks(files: DataFrame) -> DataFrame:
    """Blocks of files (doc_id, path, content); endings without a reader give none."""
    return _read(files.withColumn("_suffix", suffix_of(F.col("path"))), ROUTES)


def to_markdown(files: DataFrame, converted_at: str, convert=None) -> DataFrame:
    """(doc_id, md) of files (doc_id, path, content); convert is applied to texts (see convert_text)."""
    from lectern.functions.markdown import convert_text

    blocks = read_blocks(files)
    blocks = convert_text(blocks, convert) if convert else blocks
    meta = files.select("doc_id", stem_of(F.col("path")).alias("title"), F.regexp_replace("path", r"^.*[/\\]", "").alias("source_file"), F.substring(suffix_of(F.col("path")), 2, 9).alias("source_type"), F.lit(converted_at).alias("converted_at"), F.lit(False).alias("ocr_used"))
    return render(blocks, meta)


def batch_report(results: DataFrame, most: int = 20) -> DataFrame:
    """(state, files, names) of results (path, error, skipped): failed, skipped and converted ones, with the first `most` different paths of each."""
    state = F.when(F.col("error").isNotNull(), "failed").when(F.col("skipped").isNotNull(), "skipped").otherwise("converted")
    x = results.select("path", state.alias("state"))
    # tasks keep the first of their own before the shuffle
    first = x.where("path is not null").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("state").orderBy("path"))).where(F.col("nth") <= most)
    names = first.groupBy("state").agg(F.sort_array(F.collect_list("path")).alias("names"))
    return x.groupBy("state").agg(F.count("*").alias("files")).join(names, "state", "left").select("state", "files", F.coalesce("names", F.array().cast("array<string>")).alias("names"))
