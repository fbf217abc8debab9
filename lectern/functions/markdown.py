"""Blocks of a document as Markdown.

A block is a row (doc_id, pos, kind, level, text, rows, has_header, caption, note_kind,
lossy, rel_path); which columns count depends on kind: heading, para, table, records,
image, note, raw.
"""

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions.labels import COLUMN, IMAGE_ALT, NOTE_CLOSE, NOTE_OPEN, RECORD, RECORDS_OF
from lectern.functions.text import cell, drop_blank_rows, squash, yaml_scalar

BLOCK_SCHEMA = "doc_id long, pos int, kind string, level int, text string, rows array<array<string>>, has_header boolean, caption string, note_kind string, lossy boolean, rel_path string"
#: A table with more columns (and more than one row) is written record by record.
WIDE = 12


def width_of(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))


def _row(cells: Column, width: Column) -> Column:
    padded = F.concat(F.transform(cells, cell), F.array_repeat(F.lit(""), F.greatest(F.lit(0), width - F.size(cells))))
    return F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))


def table_markdown(rows: Column, has_header: Column, caption: Column) -> Column:
    """A Markdown table; ragged rows are padded, and without a header an empty one is put first. Empty without rows."""
    width = width_of(rows)
    body = F.transform(rows, lambda r: _row(r, width))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    blank = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit(""), width), " | "), F.lit(" |"))
    lines = F.when(has_header, F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, 2, 1 << 30))).otherwise(F.concat(F.array(blank, rule), body))
    title = F.when(F.coalesce(caption, F.lit("")) != "", F.concat(F.lit("**"), caption, F.lit("**\n\n"))).otherwise("")
    return F.when(F.size(rows) > 0, F.concat(title, F.array_join(lines, "\n"))).otherwise("")


def _once(value: Column, body) -> Column:
    """body(value), with value worked out once: within a lambda an expression from outside would be worked out for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def records_markdown(header: Column, rows: Column, context: Column) -> Column:
    """A heading and a list of name:value for each row that has content; blank cells are left out."""
    prefix = F.when(F.coalesce(context, F.lit("")) != "", F.concat(context, F.lit(" · "))).otherwise("")
    before, after = RECORD.split("{}")
    of, behind = RECORDS_OF.split("{}")
    unnamed = lambda j: F.concat(F.lit("- " + COLUMN), (j + 1).cast("string"), F.lit(":"))
    named = lambda name, j: F.when(F.trim(F.coalesce(name, F.lit(""))) != "", F.concat(F.lit("- "), F.trim(name), F.lit(":"))).otherwise(unnamed(j))

    def records(kept: Column, names: Column, title: Column) -> Column:
        # a null item is left out by array_join
        item = lambda value, j: F.when(F.trim(value) != "", F.concat(F.coalesce(F.get(names, j), unnamed(j)), F.trim(value)))
        end = lambda: F.concat(F.lit(after + of), F.size(kept).cast("string"), F.lit(behind + "\n\n"))
        record = lambda row, i: F.concat(title, (i + 1).cast("string"), end(), F.array_join(F.transform(row, item), "\n"))
        return F.array_join(F.transform(kept, record), "\n\n")

    title = F.concat(F.lit("### "), prefix, F.lit(before))
    text = _once(drop_blank_rows(rows), lambda kept: _once(F.transform(header, named), lambda names: _once(title, lambda t: records(kept, names, t))))
    # null rows or a null header leave no records or no names
    return F.coalesce(text, F.lit(""))


def block_markdown(blank: str = r"\s") -> Column:
    """Text of a block; empty if there is nothing to write. Characters of `blank` (a class of a regular expression) at the ends of texts go."""
    text, kind = F.coalesce(F.col("text"), F.lit("")), F.col("kind")
    stripped = F.regexp_replace(text, rf"(?U)^{blank}+|{blank}+\z", "")
    rows = F.col("rows")
    wide = (width_of(rows) > WIDE) & (F.size(rows) > 1)
    head = F.when(F.col("has_header"), F.get(rows, F.lit(0))).otherwise(F.array().cast("array<string>"))
    body = F.when(F.col("has_header"), F.slice(rows, 2, 1 << 30)).otherwise(rows)
    caption = F.coalesce(F.col("caption"), F.lit(""))
    level = F.least(F.greatest(F.coalesce(F.col("level"), F.lit(1)), F.lit(1)) + 1, F.lit(6))
    return (
        F.when(kind == "heading", F.when(stripped != "", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), stripped)).otherwise(""))
        .when(kind == "para", stripped)
        .when(kind == "table", F.when(wide, records_markdown(head, body, caption)).otherwise(table_markdown(rows, F.col("has_header"), caption)))
        .when(kind == "records", records_markdown(F.get(rows, F.lit(0)), F.slice(rows, 2, 1 << 30), caption))
        .when(kind == "image", F.concat(F.lit("!["), F.when(text != "", text).otherwise(IMAGE_ALT), F.lit("]("), F.coalesce("rel_path", F.lit("")), F.lit(")")))
        .when(kind == "note", F.concat(F.lit(NOTE_OPEN), text, F.lit(NOTE_CLOSE)))
        .when(kind == "raw", F.when(stripped != "", F.regexp_replace(text, rf"(?U){blank}+\z", "")).otherwise(""))
        .otherwise("")
    )


def front_matter(blocks: DataFrame) -> DataFrame:
    """(doc_id, lossy, lossy_kinds): how many notes say that something was lost, and their kinds in order of appearance."""
    lossy = (F.col("kind") == "note") & F.coalesce(F.col("lossy"), F.lit(False))
    first = blocks.where(lossy & (F.coalesce("note_kind", F.lit("")) != "")).groupBy("doc_id", "note_kind").agg(F.min("pos").alias("at"))
    kinds = first.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "note_kind"))), lambda s: s["note_kind"]).alias("lossy_kinds"))
    counts = blocks.groupBy("doc_id").agg(F.count_if(lossy).alias("lossy"))
    return counts.join(kinds, "doc_id", "left").select("doc_id", "lossy", F.coalesce("lossy_kinds", F.array().cast("array<string>")).alias("lossy_kinds"))


def render(blocks: DataFrame, meta: DataFrame, blank: str = r"\s") -> DataFrame:
    """(doc_id, md): front matter, one title, the blocks in order of pos, and one line end at the end.

    meta: doc_id, title, source_file, source_type, converted_at, ocr_used. Headings are one level below the title, 6 at
    most. A document without blocks has front matter and title only. What `blank` matches goes from the ends of texts and
    of the document, all white space unless told otherwise.
    """
    parts = blocks.withColumn("_md", block_markdown(blank)).where("_md <> ''").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_md"))), lambda s: s["_md"]).alias("parts"))
    x = meta.join(front_matter(blocks), "doc_id", "left").join(parts, "doc_id", "left")
    kinds = F.array_join(F.coalesce("lossy_kinds", F.array().cast("array<string>")), ", ")
    head = F.concat_ws(
        "\n",
        F.lit("---"),
        F.concat(F.lit("source_file: "), yaml_scalar(F.col("source_file"))),
        F.concat(F.lit("source_type: "), yaml_scalar(F.col("source_type"))),
        F.concat(F.lit("converted_at: "), yaml_scalar(F.col("converted_at"))),
        F.concat(F.lit("lossy: "), F.coalesce("lossy", F.lit(0)).cast("string")),
        F.concat(F.lit("lossy_kinds: ["), kinds, F.lit("]")),
        F.concat(F.lit("ocr_used: "), F.coalesce("ocr_used", F.lit(False)).cast("string")),
        F.lit("---"),
    )
    body = F.array_join(F.concat(F.array(F.concat(F.lit("# "), F.coalesce("title", F.lit("")))), F.coalesce("parts", F.array().cast("array<string>"))), "\n\n")
    return x.select("doc_id", F.concat(head, F.lit("\n\n"), F.regexp_replace(body, rf"(?U){blank}+\z", ""), F.lit("\n")).alias("md"))


def block_text() -> Column:
    """All text of a block: its own, its cells and its caption."""
    cells = F.transform(F.coalesce("rows", F.array().cast("array<array<string>>")), lambda r: F.array_join(r, " "))
    return F.concat_ws("\n", F.coalesce("text", F.lit("")), F.array_join(cells, "\n"), F.coalesce("caption", F.lit("")))


def haystacks(blocks: DataFrame) -> DataFrame:
    """(doc_id, haystack): squashed text of each document's blocks."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", block_text().alias("t")))), lambda s: s["t"])
    return blocks.groupBy("doc_id").agg(squash(F.array_join(parts, "\n")).alias("haystack"))


def shift_headings(blocks: DataFrame, by: int) -> DataFrame:
    return blocks.withColumn("level", F.when(F.col("kind") == "heading", F.col("level") + by).otherwise(F.col("level")))


def convert_text(blocks: DataFrame, convert) -> DataFrame:
    """blocks with convert (column to column) applied to texts, cells and captions, but not to raw blocks and paths."""
    kind = F.col("kind") != "raw"
    return blocks.withColumns({
        "text": F.when(kind, convert(F.col("text"))).otherwise(F.col("text")),
        "caption": F.when(kind, convert(F.col("caption"))).otherwise(F.col("caption")),
        "rows": F.when(kind, F.transform("rows", lambda r: F.transform(r, convert))).otherwise(F.col("rows")),
    })
