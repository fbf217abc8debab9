"""Office files and e-books: their parts as rows, then their text by functions on the parts."""

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions.labels import CHART_NOTE
from lectern.functions.text import has_content

OLE_MAGIC = "D0CF11E0A1B11AE1"
#: A member that unpacks to more is taken for a bomb.
HUGE_PART = 512 << 20
#: A shorter member is stored as it is.
SHORT_PART = 1024


def in_batches(rows, schema: pa.Schema, most_bytes: int = 4 << 20):
    """Batches of (row, bytes): each ends when its rows have so many bytes or are a thousand."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n
        if size >= most_bytes or len(held) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def parts(files: DataFrame, wanted: str = r"\.(xml|rels|xhtml|html?|opf|ncx)$", most_bytes: int = HUGE_PART) -> DataFrame:
    """(doc_id, part, content, error) of zip files (doc_id, content): a row for each member; content where its name matches.

    A file that is no zip, a broken member and a member above most_bytes give a row with an error.
    """
    import re

    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("content", pa.string()), ("error", pa.string())])
    match = re.compile(wanted, re.I)

    def members(batch):
        for doc_id, content in zip(batch.column("doc_id").to_pylist(), batch.column("content")):
            try:
                with zipfile.ZipFile(io.BytesIO(content.as_py() or b"")) as z:
                    for info in z.infolist():
                        if not match.search(info.filename):
                            yield (doc_id, info.filename, None, None), 0
                        elif info.file_size > most_bytes:
                            yield (doc_id, info.filename, None, "too large"), 0
                        else:
                            try:
                                text, error = z.read(info).decode("utf-8-sig", "replace"), None
                            except Exception as e:  # a broken member leaves the others
                                text, error = None, str(e)
                            yield (doc_id, info.filename, text, error), len(text or "")
            except zipfile.BadZipFile as e:
                yield (doc_id, None, None, str(e)), 0

    def run(batches):
        for batch in batches:
            yield from in_batches(members(batch), schema)

    return files.select(F.col("doc_id").cast("long"), "content").mapInArrow(run, "doc_id long, part string, content string, error string")


def xml_text(x: Column) -> Column:
    """The five named references decoded."""
    decoded = x
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        decoded = F.replace(decoded, F.lit(a), F.lit(b))
    return F.when(F.contains(x, F.lit("&")), decoded).otherwise(x)


def _texts(xml: Column, tag: str, breaks: str = "") -> Column:
    """Joined contents of an element; elements in `breaks` are line ends."""
    marked = F.regexp_replace(xml, rf"<(?:{breaks})\b[^>]*/>", f"<{tag}>\n</{tag}>") if breaks else xml
    return xml_text(F.array_join(F.regexp_extract_all(marked, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1)), ""))


def is_old_office(content: Column) -> Column:
    """Whether a file starts like a compound file, whatever its name says."""
    return F.hex(F.substring(content, 1, 8)) == OLE_MAGIC


def has_macros(names: Column) -> Column:
    return F.exists(names, lambda n: F.contains(F.lower(n), F.lit("vbaproject")))


def docx_blocks(files: DataFrame) -> DataFrame:
    """(doc_id, pos, kind, level, text, rows, has_header) of Word files: paragraphs, headings by style name, tables; then notes.

    The body is cut at its tables; a table within a cell counts as that cell's text.
    """
    p = parts(files, r"^word/(document|footnotes|endnotes)\.xml$").where("content is not null")
    body = p.where("part = 'word/document.xml'").select("doc_id", F.posexplode(F.split(F.regexp_replace("content", r"(?s)(<w:tbl>.*?</w:tbl>(?!(?:(?!<w:tbl>).)*</w:tbl>))", "\ue000$1\ue000"), "\ue000")).alias("cut", "xml"))
    tables = body.where(F.col("xml").startswith("<w:tbl>"))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?s)<w:tc>(.*?)</w:tc>"), F.lit(1)), lambda c: F.trim(_texts(F.regexp_replace(c, "</w:p>", "<w:t> </w:t>"), "w:t", "w:br|w:tab")))
    rows = F.filter(F.transform(F.regexp_extract_all("xml", F.lit(r"(?s)<w:tr[ >].*?</w:tr>"), F.lit(0)), cells), has_content)
    tables = tables.select("doc_id", F.struct(F.lit(0).alias("a"), F.col("cut").alias("b"), F.lit(0).alias("c")).alias("at"), F.lit("table").alias("kind"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("text"), rows.alias("rows"), F.lit(True).alias("has_header"))
    paras = body.where(~F.col("xml").startswith("<w:tbl>")).select("doc_id", "cut", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<w:p[ >].*?</w:p>"), F.lit(0))).alias("at", "xml"))
    style = F.regexp_extract("xml", r'<w:pStyle w:val="(?:Heading|heading|標題|标题)\s?(\d)', 1)
    level = F.when(style != "", F.least(style.cast("int"), F.lit(6)))
    none_rows, none_flag = F.lit(None).cast("array<array<string>>").alias("rows"), F.lit(None).cast("boolean").alias("has_header")
    paras = paras.select("doc_id", F.struct(F.lit(0).alias("a"), F.col("cut").alias("b"), F.col("at").alias("c")).alias("at"), F.when(level.isNotNull(), "heading").otherwise("para").alias("kind"), level.alias("level"), F.trim(_texts(F.col("xml"), "w:t", "w:br|w:tab|w:cr")).alias("text"), none_rows, none_flag).where("text <> ''")
    notes = p.where("part <> 'word/document.xml'").select("doc_id", "part", F.explode(F.regexp_extract_all("content", F.lit(r"(?s)<w:(?:foot|end)note [^>]*>.*?</w:(?:foot|end)note>"), F.lit(0))).alias("xml"))
    number = F.regexp_extract("xml", r'w:id="(-?\d+)"', 1).cast("int")
    notes = notes.where(~F.regexp_extract("xml", r"^<[^>]*>", 0).contains("w:type="))
    mark = F.when(F.contains("part", F.lit("footnotes")), "註").otherwise("附註")
    notes = notes.select("doc_id", F.struct(F.lit(1).alias("a"), F.when(F.contains("part", F.lit("footnotes")), 0).otherwise(1).alias("b"), number.alias("c")).alias("at"), F.lit("para").alias("kind"), F.lit(None).cast("int").alias("level"), F.concat(F.lit("["), mark, number.cast("string"), F.lit("] "), F.trim(_texts(F.col("xml"), "w:t"))).alias("text"), none_rows, none_flag)
    x = paras.unionByName(tables).unionByName(notes)
    return x.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1).alias("pos"), "kind", "level", "text", "rows", "has_header")


_TABLE = r"(?s)(<a:tbl>.*?</a:tbl>)"
_PARA = r"(?s)<a:p>.*?</a:p>|<a:p [^>]*>.*?</a:p>"


def bullet_kind(paragraph: Column, inherits: Column) -> Column:
    """num or bullet of a slide's paragraph (its markup), null without one: its own mark, then its depth, then what it inherits."""
    own = F.regexp_extract(paragraph, r"(?s)<a:pPr\b(?:[^>]*/>|.*?</a:pPr>)", 0)
    deep = F.regexp_extract(own, r'^<a:pPr\b[^>]*?\blvl="(\d+)"', 1)
    return F.when(F.contains(own, F.lit("<a:buNone")), None).when(F.contains(own, F.lit("<a:buAutoNum")), "num").when(F.contains(own, F.lit("<a:buChar")) | ~deep.isin("", "0"), "bullet").when(inherits, "bullet")


#: The deepest level of a list.
DEEPEST = 8


def list_markdown(paragraphs: Column) -> Column:
    """Markdown of a frame's paragraphs (text, kind, level): list items nested by two spaces a level, the rest as it stands.

    Numbered items have their number within their level; a number starts anew behind an item of a lower level and behind a
    paragraph that is no item. Lists have an empty line before and behind. Later lines of an item are indented to its text.
    """
    zeros = F.array_repeat(F.lit(0), DEEPEST + 1)
    begin = F.struct(F.array().cast("array<string>").alias("lines"), zeros.alias("counts"), F.lit(False).alias("item"))

    def step(s, p):
        level = F.least(F.greatest(F.coalesce(p["level"], F.lit(0)), F.lit(0)), F.lit(DEEPEST))
        numbered = p["kind"] == "num"
        counts = F.transform(s["counts"], lambda n, i: F.when(i > level, F.lit(0)).when((i == level) & numbered, n + 1).otherwise(n))
        mark = F.when(numbered, F.concat(F.element_at(counts, level + 1).cast("string"), F.lit("."))).otherwise(F.lit("-"))
        prefix = F.concat(F.repeat(F.lit("  "), level), mark, F.lit(" "))
        item = F.concat(prefix, F.replace(p["text"], F.lit("\n"), F.concat(F.lit("\n"), F.repeat(F.lit(" "), F.length(prefix)))))
        gap = lambda on: F.when(on, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        plain = F.struct(F.concat(s["lines"], gap(s["item"]), F.array(p["text"])).alias("lines"), zeros.alias("counts"), F.lit(False).alias("item"))
        listed = F.struct(F.concat(s["lines"], gap(~s["item"] & (F.size(s["lines"]) > 0)), F.array(item)).alias("lines"), counts.alias("counts"), F.lit(True).alias("item"))
        return F.when(p["kind"].isNull(), plain).otherwise(listed)

    said = F.filter(paragraphs, lambda p: F.coalesce(p["text"], F.lit("")) != "")
    return F.btrim(F.array_join(F.aggregate(said, begin, step, lambda s: s["lines"]), "\n"), F.lit(" \n\t"))


def pptx_frames(files: DataFrame, master_bullets: bool = False) -> DataFrame:
    """(doc_id, slide, frame, text): the Markdown of each text frame of the slides, empty ones left out.

    A frame of two paragraphs or more hands its bullets down if its list style defines some, or if it is a body placeholder
    and the master's body has bullets.
    """
    p = parts(files, r"^ppt/slides/slide\d+\.xml$").where("content is not null")
    shapes = F.posexplode(F.regexp_extract_all("content", F.lit(r"(?s)<p:sp\b[^>]*>.*?</p:sp>"), F.lit(0))).alias("frame", "xml")
    x = p.select("doc_id", F.regexp_extract("part", r"(\d+)\.xml$", 1).cast("int").alias("slide"), shapes)
    style = F.regexp_extract("xml", r"(?s)<a:lstStyle\b.*?</a:lstStyle>", 0)
    holder = F.regexp_extract("xml", r"<p:ph\b[^>]*>", 0)
    body = (holder != "") & ~F.contains(F.lower(F.regexp_extract(holder, r'\btype="([^"]*)"', 1)), F.lit("title"))
    marks = F.regexp_extract_all("xml", F.lit(_PARA), F.lit(0))
    text = lambda m: F.btrim(_texts(m, "a:t", "a:br"), F.lit(" \n\t\r\x0b"))
    several = F.size(F.filter(marks, lambda m: text(m) != "")) >= 2
    inherits = several & (style.rlike("<a:bu(?:Char|AutoNum|Blip)") | (body & F.lit(master_bullets)))
    x = x.withColumns({"inherits": inherits, "marks": marks})
    own = lambda m: F.regexp_extract(m, r"(?s)<a:pPr\b(?:[^>]*/>|.*?</a:pPr>)", 0)
    deep = lambda m: F.coalesce(F.regexp_extract(own(m), r'^<a:pPr\b[^>]*?\blvl="(\d{1,2})"', 1).try_cast("int"), F.lit(0))
    paras = F.transform("marks", lambda m: F.struct(text(m).alias("text"), bullet_kind(m, F.col("inherits")).alias("kind"), deep(m).alias("level")))
    return x.select("doc_id", "slide", "frame", list_markdown(paras).alias("text")).where("text <> ''")


def pptx_blocks(files: DataFrame) -> DataFrame:
    """(doc_id, pos, kind, level, text, rows, has_header) of slides in number order: a heading for each, its paragraphs and tables, then its notes."""
    p = parts(files, r"^ppt/(slides/slide|notesSlides/notesSlide)\d+\.xml$").where("content is not null")
    p = p.withColumns({"slide": F.regexp_extract("part", r"(\d+)\.xml$", 1).cast("int"), "side": F.when(F.contains("part", F.lit("notesSlides")), 2).otherwise(1)})
    no_rows, no_flag = F.lit(None).cast("array<array<string>>").alias("rows"), F.lit(None).cast("boolean").alias("has_header")
    heads = p.where("side = 1").select("doc_id", "slide", F.lit(0).alias("side"), F.lit(0).alias("cut"), F.lit(0).alias("at"), F.lit("heading").alias("kind"), F.lit(1).alias("level"), F.concat(F.lit("第 "), F.col("slide").cast("string"), F.lit(" 頁")).alias("text"), no_rows, no_flag)
    cuts = p.select("doc_id", "slide", "side", F.posexplode(F.split(F.regexp_replace("content", _TABLE, "\ue000$1\ue000"), "\ue000")).alias("cut", "xml"))
    texts_of = lambda xml: F.trim(_texts(xml, "a:t", "a:br"))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?s)<a:tc\b[^>]*>(.*?)</a:tc>"), F.lit(1)), lambda c: texts_of(F.regexp_replace(c, r"</a:p>(?=.*<a:p\b)", "<a:t>\n</a:t>")))
    rows = F.transform(F.regexp_extract_all("xml", F.lit(r"(?s)<a:tr\b[^>]*>.*?</a:tr>"), F.lit(0)), cells)
    tables = cuts.where(F.col("xml").startswith("<a:tbl>")).select("doc_id", "slide", "side", "cut", F.lit(0).alias("at"), F.lit("table").alias("kind"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("text"), rows.alias("rows"), F.lit(True).alias("has_header"))
    paras = cuts.where(~F.col("xml").startswith("<a:tbl>")).select("doc_id", "slide", "side", "cut", F.posexplode(F.regexp_extract_all("xml", F.lit(_PARA), F.lit(0))).alias("at", "xml"))
    deep = F.coalesce(F.expr("try_cast(nullif(regexp_extract(xml, 'lvl=\"(\\\\d)\"', 1), '') as int)"), F.lit(0))
    body = texts_of(F.col("xml"))
    paras = paras.select("doc_id", "slide", "side", "cut", "at", F.lit("para").alias("kind"), F.lit(None).cast("int").alias("level"), F.when(body != "", F.concat(F.repeat(F.lit("  "), deep), body)).alias("text"), no_rows, no_flag).where("text is not null")
    x = heads.unionByName(paras).unionByName(tables)
    return x.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("slide", "side", "cut", "at")) - 1).alias("pos"), "kind", "level", "text", "rows", "has_header")


def lost_bullets(files: DataFrame) -> DataFrame:
    """(doc_id, bullets): paragraphs of slides that are list items within a table, where Markdown has no place for lists."""
    p = parts(files, r"^ppt/slides/slide\d+\.xml$").where("content is not null")
    tables = p.select("doc_id", F.explode_outer(F.regexp_extract_all("content", F.lit(_TABLE), F.lit(1))).alias("xml"))
    items = F.filter(F.regexp_extract_all("xml", F.lit(_PARA), F.lit(0)), lambda x: (F.trim(_texts(x, "a:t")) != "") & bullet_kind(x, F.lit(False)).isNotNull())
    return tables.groupBy("doc_id").agg(F.coalesce(F.sum(F.size(items)), F.lit(0)).alias("bullets"))


def numbered_paragraphs(files: DataFrame) -> DataFrame:
    """(doc_id, numbered): paragraphs of Word files that are numbered by themselves or by their style."""
    p = parts(files, r"^word/(document|styles)\.xml$").where("content is not null")
    styles = F.filter(F.regexp_extract_all("content", F.lit(r"(?s)<w:style\s.*?</w:style>"), F.lit(0)), lambda x: F.contains(x, F.lit("<w:numPr")))
    named = p.where("part = 'word/styles.xml'").select("doc_id", F.transform(styles, lambda x: F.regexp_extract(x, r'\bw:styleId="([^"]*)"', 1)).alias("styles"))
    body = p.where("part = 'word/document.xml'").select("doc_id", F.transform(F.regexp_extract_all("content", F.lit(r"(?s)<w:p[ >].*?</w:p>"), F.lit(0)), lambda x: F.regexp_extract(x, r"(?s)<w:pPr>.*?</w:pPr>", 0)).alias("own"))
    by_style = lambda x: F.coalesce(F.array_contains(F.coalesce("styles", F.array().cast("array<string>")), F.nullif(F.regexp_extract(x, r'<w:pStyle w:val="([^"]*)"', 1), F.lit(""))), F.lit(False))
    return body.join(named, "doc_id", "left").select("doc_id", F.size(F.filter("own", lambda x: F.contains(x, F.lit("<w:numPr")) | by_style(x))).alias("numbered"))


def chart_notes(files: DataFrame, most: int = 5) -> DataFrame:
    """(doc_id, part, text): a note for each chart of a workbook, with its title and the ranges that its series show."""
    p = parts(files, r"^xl/charts/chart\d+\.xml$").where("content is not null")
    title = xml_text(F.regexp_extract("content", r"(?s)<c:title>.*?<a:t>(.*?)</a:t>.*?</c:title>", 1))
    refs = F.transform(F.regexp_extract_all("content", F.lit(r"(?s)<c:val>\s*<c:numRef>\s*<c:f>(.*?)</c:f>"), F.lit(1)), xml_text)
    before, about, from_, between, after = CHART_NOTE
    shown = F.concat(F.lit(before), F.when(title != "", F.concat(F.lit(about), title)).otherwise(""), F.when(F.size(refs) > 0, F.concat(F.lit(from_), F.array_join(F.slice(refs, 1, most), between))).otherwise(""), F.lit(after))
    return p.select("doc_id", "part", shown.alias("text"))


def packed(members: DataFrame) -> DataFrame:
    """(doc_id, content): a zip file for each doc_id of members (doc_id, part, content string), in order of part; for tests and exports."""
    rows = members.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "content"))).alias("parts"))
    schema = pa.schema([("doc_id", pa.int64()), ("content", pa.binary())])

    def zipped(batch):
        for doc_id, found in zip(batch.column("doc_id").to_pylist(), batch.column("parts")):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                for x in found:
                    # a short member gains nothing by being deflated, which takes longer than all the rest
                    content = (x["content"].as_py() or "").encode()
                    z.writestr(x["part"].as_py(), content, zipfile.ZIP_STORED if len(content) < SHORT_PART else zipfile.ZIP_DEFLATED)
            yield (doc_id, buffer.getvalue()), buffer.tell()

    def run(batches):
        for batch in batches:
            yield from in_batches(zipped(batch), schema)

    return rows.select(F.col("doc_id").cast("long"), "parts").mapInArrow(run, "doc_id long, content binary")


def column_number(ref: Column) -> Column:
    """0 for A, 25 for Z, 26 for AA."""
    letters = F.split(F.regexp_extract(ref, r"^([A-Z]+)", 1), "")
    return F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64) - 1


def xlsx_cells(files: DataFrame) -> DataFrame:
    """(doc_id, sheet, row, col, value, formula) of the filled cells of workbooks; sheet is the part's number, row and col count from 0."""
    p = parts(files, r"^xl/(worksheets/sheet\d+|sharedStrings)\.xml$").where("content is not null")
    # files are read once: shared strings (without a sheet) and cells are rows of one table
    strings = F.col("part") == "xl/sharedStrings.xml"
    found = F.when(strings, F.regexp_extract_all("content", F.lit(r"(?s)<si>(.*?)</si>|<si/>"), F.lit(1))).otherwise(F.regexp_extract_all("content", F.lit(r"(?s)<c [^>]*?(?<!/)>.*?</c>"), F.lit(0)))
    x = p.select("doc_id", F.when(~strings, F.regexp_extract("part", r"(\d+)\.xml$", 1).cast("int")).alias("sheet"), F.posexplode(found).alias("at", "xml"))
    # each part of a cell is taken out once; it is decoded in a step of its own
    inner = lambda tag: F.regexp_extract("xml", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)
    x = x.select("doc_id", "sheet", "at", F.regexp_extract("xml", r'^<c [^>]*\br="([A-Z]+\d+)"', 1).alias("ref"), F.regexp_extract("xml", r'^<c [^>]*\bt="(\w+)"', 1).alias("kind"), inner("v").alias("raw"), inner("f").alias("formula"), F.when(F.contains("xml", F.lit("<t")), _texts(F.regexp_replace("xml", r"(?s)<rPh\b.*?</rPh>", ""), "t")).otherwise("").alias("text"))
    kind = F.col("kind")
    x = x.select("doc_id", "sheet", "at", (F.regexp_extract("ref", r"(\d+)$", 1).try_cast("int") - 1).alias("row"), column_number(F.col("ref")).alias("col"), "kind", xml_text(F.col("raw")).alias("raw"), "text", xml_text(F.col("formula")).alias("formula"))
    # a cell meets the string of its number; cells without one are dealt by their row
    number = F.when(F.col("sheet").isNull(), F.col("at")).when(kind == "s", F.expr("try_cast(raw as int)"))
    x = x.withColumn("i", F.coalesce(number, -1 - F.col("row")))
    strings_first = Window.partitionBy("doc_id", "i").orderBy(F.asc_nulls_first("sheet")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("shared", F.max(F.when(F.col("sheet").isNull(), F.col("text"))).over(strings_first)).where("sheet is not null")
    value = F.when(kind == "s", F.col("shared")).when(kind == "inlineStr", F.col("text")).when(kind == "b", F.when(F.col("raw") == "1", "TRUE").otherwise("FALSE")).otherwise(F.col("raw"))
    return x.select("doc_id", "sheet", "row", "col", value.alias("value"), "formula").where("coalesce(value, '') <> '' or formula <> ''")


def sheet_blocks(cells: DataFrame) -> DataFrame:
    """One table block (doc_id, pos, kind, rows, has_header) for each sheet of cells (doc_id, sheet, row, col, value); blank rows go."""
    filled = cells.where("trim(coalesce(value, '')) <> ''").repartition("doc_id", "sheet")
    line = filled.groupBy("doc_id", "sheet", "row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("c"), F.max("col").alias("last"))
    blank = lambda n: F.array_repeat(F.lit(""), n)

    def gaps(c):
        """Blank cells up to each cell, and the cell; of cells at one place the first."""
        before = lambda i: F.coalesce(F.get(c, i - 1)["col"], F.lit(-1))
        return F.flatten(F.transform(c, lambda s, i: F.when(s["col"] == before(i), blank(F.lit(0))).otherwise(F.concat(blank(s["col"] - before(i) - 1), F.array(s["value"])))))

    line = line.select("doc_id", "sheet", "row", "last", gaps(F.col("c")).alias("cells"))
    sheet = line.groupBy("doc_id", "sheet").agg(F.array_sort(F.collect_list(F.struct("row", "last", "cells"))).alias("r"), F.max("last").alias("most"))
    # the width goes along as an array, so that a sheet's rows need no second table
    pairs = F.arrays_zip("r", F.array_repeat("most", F.size("r")))
    rows = F.transform(pairs, lambda s: F.concat(s["r"]["cells"], blank(s["1"] - s["r"]["last"])))
    return sheet.select("doc_id", F.col("sheet").alias("pos"), F.lit("table").alias("kind"), rows.alias("rows"), F.lit(True).alias("has_header"))


def unrecalculated(cells: DataFrame) -> DataFrame:
    """Cells with a formula but no stored value."""
    return cells.where("formula <> '' and trim(coalesce(value, '')) = ''")


def merged_cells(ranges: DataFrame, most: int | None = None) -> DataFrame:
    """(doc_id, sheet, row, col, row0, col0) for each cell of merged ranges (doc_id, sheet, row0, col0, row1, col1); with `most`, of those of at most so many cells."""
    cells = (F.col("row1") - F.col("row0") + 1).cast("long") * (F.col("col1") - F.col("col0") + 1)
    x = ranges if most is None else ranges.where(cells <= most)
    x = x.withColumn("row", F.explode(F.sequence("row0", "row1")))
    return x.withColumn("col", F.explode(F.sequence("col0", "col1"))).select("doc_id", "sheet", "row", "col", "row0", "col0")


def epub_chapters(files: DataFrame) -> DataFrame:
    """(doc_id, pos, html, part) of e-books in the order of their spine; a missing chapter has a null html."""
    p = parts(files).where("content is not null")
    box = p.where("part = 'META-INF/container.xml'").select("doc_id", F.regexp_extract("content", r'full-path="([^"]+)"', 1).alias("part"))
    opf = p.join(box, ["doc_id", "part"]).select("doc_id", F.regexp_replace("part", r"[^/]*$", "").alias("folder"), "content")
    item = opf.select("doc_id", "folder", F.explode(F.regexp_extract_all("content", F.lit(r"<(?:opf:)?item\s[^>]*>"), F.lit(0))).alias("x"))
    item = item.select("doc_id", F.regexp_extract("x", r'\bid="([^"]+)"', 1).alias("id"), F.concat("folder", F.try_url_decode(F.regexp_extract("x", r'\bhref="([^"]+)"', 1))).alias("part"))
    spine = opf.select("doc_id", F.posexplode(F.regexp_extract_all("content", F.lit(r'<(?:opf:)?itemref\s[^>]*?\bidref="([^"]+)"'), F.lit(1))).alias("pos", "id"))
    chapters = p.select("doc_id", "part", F.col("content").alias("html"))
    return spine.join(item, ["doc_id", "id"]).join(chapters, ["doc_id", "part"], "left").select("doc_id", "pos", "html", "part")


def vba_outline(code: Column) -> Column:
    """Names of the procedures of a module, in order."""
    return F.regexp_extract_all(code, F.lit(r"(?im)^\s*(?:Public |Private |Friend |Static )*(?:Sub|Function|Property (?:Get|Let|Set))\s+(\w+)"), F.lit(1))


def is_encrypted(content: Column) -> Column:
    """Whether a compound file holds the stream names of an encrypted package (in UTF-16)."""
    names = [F.lit(n.encode("utf-16-le")) for n in ("EncryptedPackage", "EncryptionInfo")]
    return is_old_office(content) & (F.contains(content, names[0]) | F.contains(content, names[1]))


def relations(files: DataFrame, external: bool = True) -> DataFrame:
    """(doc_id, part, id, target) of the .rels parts; only those to the outside, or only those within."""
    p = parts(files, r"\.rels$").where("content is not null")
    x = p.select("doc_id", "part", F.explode(F.regexp_extract_all("content", F.lit(r"<Relationship\s[^>]*>"), F.lit(0))).alias("x"))
    out = F.contains("x", F.lit('TargetMode="External"'))
    return x.where(out if external else ~out).select("doc_id", "part", F.regexp_extract("x", r'\bId="([^"]+)"', 1).alias("id"), xml_text(F.regexp_extract("x", r'\bTarget="([^"]+)"', 1)).alias("target"))


def is_page_furniture(text: Column) -> Column:
    """Whether less than two characters are left without digits, page words and marks."""
    return F.length(F.regexp_replace(text, r"(?iU)page|第|頁|页|共|of|[\d\s\W_]", "")) < 2


def header_footer_blocks(files: DataFrame) -> DataFrame:
    """(doc_id, pos, kind, text) of Word headers, then footers, each text once and without page numbers."""
    p = parts(files, r"^word/(header|footer)\d*\.xml$").where("content is not null")
    x = p.select("doc_id", "part", F.posexplode(F.regexp_extract_all("content", F.lit(r"(?s)<w:p[ >].*?</w:p>"), F.lit(0))).alias("at", "xml"))
    x = x.select("doc_id", F.struct(F.contains("part", F.lit("footer")).alias("f"), "part", "at").alias("at"), F.trim(_texts(F.col("xml"), "w:t", "w:br|w:tab")).alias("text")).where(~is_page_furniture(F.col("text")))
    first = x.groupBy("doc_id", F.regexp_replace("text", r"(?U)\s+", "").alias("key")).agg(F.min(F.struct("at", "text")).alias("f"))
    return first.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("f.at")) - 1).alias("pos"), F.lit("para").alias("kind"), "f.text")


def diagram_texts(files: DataFrame) -> DataFrame:
    """(doc_id, part, texts): distinct texts of diagrams and drawings, in order."""
    p = parts(files, r"(diagrams/data\d+|drawings/drawing\d+)\.xml$").where("content is not null")
    paras = F.transform(F.regexp_extract_all("content", F.lit(r"(?s)<a:p[ >].*?</a:p>"), F.lit(0)), lambda x: F.trim(_texts(x, "a:t", "a:br")))
    return p.select("doc_id", "part", F.array_distinct(F.filter(paras, lambda t: t != "")).alias("texts"))


def image_ids(xml: Column) -> Column:
    """Distinct relation ids of images: drawings first, then those of older markup."""
    return F.array_distinct(F.concat(F.regexp_extract_all(xml, F.lit(r'<a:blip\b[^>]*?\br:embed="([^"]+)"'), F.lit(1)), F.regexp_extract_all(xml, F.lit(r'<v:imagedata\b[^>]*?\br:id="([^"]+)"'), F.lit(1))))


def paragraph_texts(files: DataFrame, wanted: str = r"^(word/document|ppt/slides/slide\d+)\.xml$") -> DataFrame:
    """(doc_id, at, fragment): texts of all paragraphs of the parts, straight from the markup, for audits of what a reader gave."""
    p = parts(files, wanted).where("content is not null")
    x = p.select("doc_id", F.posexplode(F.regexp_extract_all("content", F.lit(r"(?s)<([aw]):p[ >].*?</\1:p>"), F.lit(0))).alias("at", "xml"))
    return x.select("doc_id", "at", _texts(F.regexp_replace("xml", r"<(/?)[aw]:t\b", "<$1t"), "t").alias("fragment")).where("fragment <> ''")
