"""Files of all kinds: they are made from the tables within the query and read again, so that SQL on the tables has the rows."""

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import markdown, text as x
from lectern.operators import batches, transcripts
from lectern.sources import archives, audio, html, mail, texts
from lectern.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _xml(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _turns(spark, sf_dir) -> DataFrame:
    """(doc_id, turn, role, text): each conversation is a document."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def _joined(rows: DataFrame, value: Column, name: str = "xml") -> DataFrame:
    """(doc_id, xml): values of a document's turns, one after the other."""
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", value.alias("v")))), lambda s: s["v"]), "").alias(name))


def _part(rows: DataFrame, part, content) -> DataFrame:
    return rows.select("doc_id", (F.lit(part) if isinstance(part, str) else part).alias("part"), content.alias("content"))


def _flat(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, "|")), ";")


def _run(c: Column) -> Column:
    return F.concat(F.lit("<w:r><w:t>"), _xml(c), F.lit("</w:t></w:r>"))


def _docx(spark, sf_dir) -> DataFrame:
    """A heading and the lines of each turn, a table of turns and roles, a note for each turn."""
    t = _turns(spark, sf_dir)
    number = F.col("turn").cast("string")
    head = F.concat(F.lit('<w:p><w:pPr><w:pStyle w:val="Heading'), (F.col("turn") % 8 + 1).cast("string"), F.lit('"/></w:pPr>'), _run(F.concat("role", F.lit(" "), number)), F.lit("</w:p>"))
    paras = F.array_join(F.transform(x.lines(F.col("text")), lambda p: F.concat(F.lit("<w:p>"), _run(p), F.lit("</w:p>"))), "")
    row = F.concat(F.lit("<w:tr><w:tc><w:p>"), _run(number), F.lit("</w:p></w:tc><w:tc><w:p>"), _run(F.col("role")), F.lit("</w:p></w:tc></w:tr>"))
    note = F.concat(F.lit('<w:footnote w:id="'), number, F.lit('"><w:p>'), _run(F.col("role")), F.lit("</w:p></w:footnote>"))
    body = _joined(t, F.concat(head, paras), "b").join(_joined(t, row, "r"), "doc_id")
    body = _part(body, "word/document.xml", F.concat(F.lit("<w:document><w:body>"), "b", F.lit("<w:tbl>"), "r", F.lit("</w:tbl></w:body></w:document>")))
    notes = _joined(t, note)
    notes = _part(notes, "word/footnotes.xml", F.concat(F.lit('<w:footnotes><w:footnote w:type="separator" w:id="-1"><w:p/></w:footnote>'), "xml", F.lit("</w:footnotes>")))
    return archives.packed(body.unionByName(notes))


_LINES = """l as (select conv_id doc_id, turn, generate_subscripts(string_split(text, chr(10)), 1) as "at", trim(unnest(string_split(text, chr(10)))) t from conversations)"""


@query(f"""with {_LINES}, b as (
 select conv_id doc_id, 0 a, turn, 0::bigint as "at", 'heading' kind, least(turn % 8 + 1, 6)::int as level, role || ' ' || turn as text, null as cells from conversations
 union all select doc_id, 0, turn, "at", 'para', null, t, null from l where t <> ''
 union all select conv_id, 1, 0, 0, 'table', null, null, string_agg(turn || '|' || role, ';' order by turn) from conversations group by conv_id
 union all select conv_id, 2, turn, 0, 'para', null, '[註' || turn || '] ' || role, null from conversations)
select doc_id, (row_number() over (partition by doc_id order by a, turn, "at") - 1)::int as pos, kind, level, text, cells from b""")
def docx_blocks(spark, sf_dir):
    """Conversations as Word files."""
    return archives.docx_blocks(_docx(spark, sf_dir)).select("doc_id", "pos", "kind", "level", "text", _flat(F.col("rows")).alias("cells"))


@query(f"""with {_LINES} select doc_id, (row_number() over (partition by doc_id order by a, turn, "at") - 1)::int as "at", f as fragment from (
 select conv_id doc_id, 0 a, turn, 0::bigint as "at", role || ' ' || turn f from conversations union all select doc_id, 0, turn, "at", t from l
 union all select conv_id, 1, turn, 0, turn::varchar from conversations union all select conv_id, 1, turn, 1, role from conversations) where f <> ''""")
def docx_audit_texts(spark, sf_dir):
    """Texts of all paragraphs straight from the markup, for audits, in order."""
    from pyspark.sql import Window

    p = archives.paragraph_texts(_docx(spark, sf_dir)).withColumn("fragment", F.trim("fragment")).where("fragment <> ''")
    return p.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1).alias("at"), "fragment")


@query("select conv_id doc_id, count(*) filter (turn % 3 <> 1)::int numbered from conversations group by conv_id")
def docx_numbered(spark, sf_dir):
    """Turns as paragraphs: a third numbered by themselves, a third by style, a third not."""
    t = _turns(spark, sf_dir)
    k = F.col("turn") % 3
    own = F.when(k == 0, '<w:numPr><w:ilvl w:val="0"/></w:numPr>').when(k == 1, '<w:pStyle w:val="Plain"/>').otherwise('<w:pStyle w:val="ListNumber"/>')
    body = _joined(t, F.concat(F.lit("<w:p><w:pPr>"), own, F.lit("</w:pPr>"), _run(F.col("role")), F.lit("</w:p>")))
    styles = '<w:styles><w:style w:styleId="Plain"><w:pPr/></w:style><w:style w:type="paragraph" w:styleId="ListNumber"><w:pPr><w:numPr/></w:pPr></w:style></w:styles>'
    members = _part(body, "word/document.xml", F.col("xml")).unionByName(_part(body, "word/styles.xml", F.lit(styles)))
    return archives.numbered_paragraphs(archives.packed(members))


def _slide(inner: Column) -> Column:
    return F.concat(F.lit("<p:sld>"), inner, F.lit("</p:sld>"))


def _ap(c: Column, own: Column | None = None) -> Column:
    return F.concat(F.lit("<a:p>"), own if own is not None else F.lit(""), F.lit("<a:r><a:t>"), _xml(c), F.lit("</a:t></a:r></a:p>"))


def _pptx(spark, sf_dir) -> DataFrame:
    """A slide for each turn: its lines, a table of turn and role whose second cell is a list item, and notes."""
    t = _turns(spark, sf_dir)
    number = F.col("turn").cast("string")
    level = F.concat(F.lit('<a:pPr lvl="'), (F.col("turn") % 3).cast("string"), F.lit('"/>'))
    paras = F.array_join(F.transform(x.lines(F.col("text")), lambda p: _ap(p, level)), "")
    cell = lambda c, own: F.concat(F.lit("<a:tc><a:txBody>"), _ap(c, own), F.lit("</a:txBody></a:tc>"))
    mark = F.when(F.col("turn") % 2 == 0, '<a:pPr><a:buChar char="-"/></a:pPr>').otherwise('<a:pPr lvl="1"><a:buNone/></a:pPr>')
    grid = F.concat(F.lit("<a:tbl><a:tr h=\"1\">"), cell(F.lit("turn"), F.lit("")), cell(F.lit("role"), F.lit("")), F.lit("</a:tr><a:tr h=\"1\">"), cell(number, F.lit("")), cell(F.col("role"), mark), F.lit("</a:tr></a:tbl>"))
    n = (F.col("turn") + 1).cast("string")
    slides = _part(t, F.concat(F.lit("ppt/slides/slide"), n, F.lit(".xml")), _slide(F.concat(paras, grid)))
    notes = _part(t, F.concat(F.lit("ppt/notesSlides/notesSlide"), n, F.lit(".xml")), _slide(_ap(F.col("role"))))
    return archives.packed(slides.unionByName(notes))


@query(f"""with {_LINES}, b as (
 select conv_id doc_id, turn, 0 a, 0::bigint as "at", 'heading' kind, 1::int as level, '第 ' || (turn + 1) || ' 頁' as text, null as cells from conversations
 union all select doc_id, turn, 1, "at", 'para', null, repeat('  ', (turn % 3)::int) || t, null from l where t <> ''
 union all select conv_id, turn, 2, 0, 'table', null, null, 'turn|role;' || turn || '|' || role from conversations
 union all select conv_id, turn, 3, 0, 'para', null, role, null from conversations)
select doc_id, (row_number() over (partition by doc_id order by turn, a, "at") - 1)::int as pos, kind, level, text, cells from b""")
def pptx_blocks(spark, sf_dir):
    """Conversations as slides, with tables and notes."""
    return archives.pptx_blocks(_pptx(spark, sf_dir)).select("doc_id", "pos", "kind", "level", "text", _flat(F.col("rows")).alias("cells"))


@query("""with t as (select conv_id, turn, case when turn % 5 = 0 then null when turn % 5 in (1, 3) then 'num' else 'bullet' end as kind, case when turn % 5 = 0 then 0 else turn % 3 end as level, role || case when turn % 4 = 0 then chr(10) || 'more' else '' end as text from conversations),
g as (select *, sum((kind is null)::int) over (partition by conv_id order by turn) as run, lag(kind) over (partition by conv_id order by turn) is null as first, lag(turn) over (partition by conv_id order by turn) is not null as later from t),
n as (select *, (select count(*) from g h where h.conv_id = g.conv_id and h.run = g.run and h.turn <= g.turn and h.kind = 'num' and h.level = g.level and h.turn > coalesce((select max(b.turn) from g b where b.conv_id = g.conv_id and b.run = g.run and b.turn < g.turn and b.kind is not null and b.level < g.level), -1)) as number from g),
l as (select conv_id, turn, case when later and (kind is null) <> first then chr(10) else '' end || case when kind is null then text else repeat('  ', level::int) || p || replace(text, chr(10), chr(10) || repeat(' ', (2 * level + length(p))::int)) end as line from (select *, case when kind = 'num' then number || '. ' else '- ' end as p from n))
select conv_id doc_id, 1::int as slide, string_agg(line, chr(10) order by turn) as text from l group by conv_id""")
def slide_lists(spark, sf_dir):
    """Conversations as one frame each: plain paragraphs, numbers and bullets of three levels, some of two lines."""
    t = _turns(spark, sf_dir)
    kind = F.when(F.col("turn") % 5 == 0, F.lit("<a:pPr/>")).when((F.col("turn") % 5).isin(1, 3), F.concat(F.lit('<a:pPr marL="1" lvl="'), (F.col("turn") % 3).cast("string"), F.lit('"><a:buFont/><a:buAutoNum type="arabicPeriod"/></a:pPr>')))
    kind = kind.otherwise(F.concat(F.lit('<a:pPr lvl="'), (F.col("turn") % 3).cast("string"), F.lit('"><a:buChar char="&#8226;"/></a:pPr>')))
    second = F.when(F.col("turn") % 4 == 0, "<a:br/><a:r><a:t>more</a:t></a:r>").otherwise("")
    paras = _joined(t, F.concat(F.lit('<a:p>'), kind, F.lit('<a:r><a:rPr lang="en"/><a:t>'), _xml(F.col("role")), F.lit("</a:t></a:r>"), second, F.lit("</a:p>")))
    frame = F.concat(F.lit('<p:sp id="2"><p:nvSpPr><p:nvPr><p:ph type="body"/></p:nvPr></p:nvSpPr><p:txBody><a:bodyPr/><a:lstStyle/>'), "xml", F.lit("</p:txBody></p:sp>"))
    return archives.pptx_frames(archives.packed(_part(paras, "ppt/slides/slide1.xml", _slide(frame)))).select("doc_id", "slide", "text")


@query("select conv_id doc_id, count(*) filter (turn % 2 = 0)::bigint bullets from conversations group by conv_id")
def pptx_lost_bullets(spark, sf_dir):
    return archives.lost_bullets(_pptx(spark, sf_dir))


def _orders(spark, sf_dir) -> DataFrame:
    """(doc_id, r, key, status, total): each customer's orders are a workbook; r numbers its rows from 1."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.floor("o_totalprice").alias("total"))
    return o.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("key", "status", "total")))


_ORDERS = "o as (select o_custkey doc_id, o_orderkey k, o_orderstatus s, floor(o_totalprice)::bigint t, row_number() over (partition by o_custkey order by o_orderkey, o_orderstatus, floor(o_totalprice)) r from orders)"


def _xlsx(spark, sf_dir) -> DataFrame:
    """Columns: a number, a shared string, an inline string, a formula with its value; AA has a flag. Every fourth row is left blank."""
    o = _orders(spark, sf_dir)
    r = (F.col("r") + F.floor((F.col("r") - 1) / 3)).cast("string")
    cell = lambda col, inner, kind="": F.concat(F.lit(f'<c r="{col}'), r, F.lit(f'"{kind}>'), inner, F.lit("</c>"))
    number = lambda c: F.concat(F.lit("<v>"), c.cast("string"), F.lit("</v>"))
    shared = F.when(F.col("status") == "F", 0).when(F.col("status") == "O", 1).otherwise(2)
    cells = F.concat(cell("A", number(F.col("key"))), cell("B", number(shared), ' t="s"'), cell("C", F.concat(F.lit("<is><t>"), _xml(F.concat(F.lit("<"), "status", F.lit("&>"))), F.lit("</t></is>")), ' s="2" t="inlineStr"'), cell("D", F.concat(F.lit("<f>A"), r, F.lit("*2</f>"), number(F.col("key") * 2))), cell("AA", number(F.col("total") % 2), ' t="b"'))
    rows = o.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat(F.lit("<row>"), cells, F.lit("</row>")).alias("v")))), lambda s: s["v"]), "").alias("xml"))
    sheet = _part(rows, "xl/worksheets/sheet1.xml", F.concat(F.lit("<worksheet><sheetData>"), "xml", F.lit("</sheetData></worksheet>")))
    strings = _part(rows, "xl/sharedStrings.xml", F.lit("<sst><si><t>F</t></si><si><r><t>O</t></r><rPh><t>x</t></rPh></si><si><t>oth</t><t>er</t></si></sst>"))
    chart = F.concat(F.lit("<c:chart><c:title><c:tx><c:rich><a:p><a:r><a:t>"), F.col("doc_id").cast("string"), F.lit(" &amp; more</a:t></a:r></a:p></c:rich></c:tx></c:title><c:ser><c:val><c:numRef><c:f>'S'!$A$1</c:f></c:numRef></c:val></c:ser><c:ser><c:val><c:numRef><c:f>S!$B$2</c:f></c:numRef></c:val></c:ser></c:chart>"))
    return archives.packed(sheet.unionByName(strings).unionByName(_part(rows, "xl/charts/chart1.xml", chart)))


@query(f"""with {_ORDERS}, p as (select *, (r + (r - 1) // 3 - 1)::int as "row" from o)
select doc_id, "row", unnest([0, 1, 2, 3, 26])::int as col, unnest([k::varchar, case s when 'F' then 'F' when 'O' then 'O' else 'other' end, '<' || s || '&>', (k * 2)::varchar, case when t % 2 = 1 then 'TRUE' else 'FALSE' end]) as "value", unnest(['', '', '', 'A' || ("row" + 1) || '*2', '']) as formula from p""")
def xlsx_cells(spark, sf_dir):
    """Customers' orders as workbooks."""
    return archives.xlsx_cells(_xlsx(spark, sf_dir)).select("doc_id", "row", "col", "value", "formula")


@query(f"""with {_ORDERS} select doc_id, count(*)::int "rows", 27::int width, string_agg(k || '/' || case s when 'F' then 'F' when 'O' then 'O' else 'other' end, ';' order by r) as firsts from o group by doc_id""")
def xlsx_tables(spark, sf_dir):
    """Sheets as tables: blank rows go, blank columns stay."""
    t = archives.sheet_blocks(archives.xlsx_cells(_xlsx(spark, sf_dir)))
    return t.select("doc_id", F.size("rows").alias("rows"), F.size(F.get("rows", F.lit(0))).alias("width"), F.array_join(F.transform("rows", lambda r: F.concat_ws("/", r[0], r[1])), ";").alias("firsts"))


@query("select distinct o_custkey doc_id, '此處有圖表:' || o_custkey || ' & more,資料來源 ''S''!$A$1、S!$B$2,Markdown 無法呈現圖形' as text from orders")
def xlsx_chart_notes(spark, sf_dir):
    return archives.chart_notes(_xlsx(spark, sf_dir)).select("doc_id", "text")


@query("""select conv_id doc_id, (max(turn) over (partition by conv_id) - turn)::int as pos, 'OEBPS/text/c' || turn || '.xhtml' as part, role || chr(10) || turn as texts from conversations""")
def epub_chapters(spark, sf_dir):
    """Conversations as e-books whose spine goes backwards."""
    t = _turns(spark, sf_dir)
    n = F.col("turn").cast("string")
    chapter = _part(t, F.concat(F.lit("OEBPS/text/c"), n, F.lit(".xhtml")), F.concat(F.lit("<html><head><title>t</title></head><body><h1>"), _xml(F.col("role")), F.lit("</h1><p>"), n, F.lit("</p></body></html>")))
    items = _joined(t, F.concat(F.lit('<item id="i'), n, F.lit('" href="text/c'), n, F.lit('.xhtml" media-type="application/xhtml+xml"/>')), "items")
    spine = _joined(t.withColumn("turn", -F.col("turn")), F.concat(F.lit('<itemref linear="yes" idref="i'), (-F.col("turn")).cast("string"), F.lit('"/>')), "spine")
    book = items.join(spine, "doc_id")
    opf = _part(book, "OEBPS/content.opf", F.concat(F.lit("<package><manifest>"), "items", F.lit("</manifest><spine>"), "spine", F.lit("</spine></package>")))
    box = _part(book, "META-INF/container.xml", F.lit('<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>'))
    return archives.epub_chapters(archives.packed(chapter.unionByName(opf).unionByName(box))).select("doc_id", "pos", "part", F.array_join(html.visible_texts(F.col("html")), "\n").alias("texts"))


@query("""select s_suppkey doc_id, s_name || ' & co' as furniture, 'http://x/?a=' || s_suppkey || '&b' as target, s_name || ',' || s_nationkey as diagram, 'r2,r1' as images, 'First,Second_' || s_nationkey as procedures, s_nationkey % 2 = 0 as macros from supplier""")
def office_parts(spark, sf_dir):
    """Headers without page numbers, links to the outside, diagrams, images, procedures and macros of made files."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), "s_name", F.col("s_nationkey").cast("string").alias("n"))
    para = lambda c: F.concat(F.lit("<w:p>"), _run(c), F.lit("</w:p>"))
    body = F.lit('<w:p><w:pict><v:imagedata r:id="r1"/></w:pict><a:blip cstate="x" r:embed="r2"/><a:blip r:embed="r2"/></w:p>')
    members = [
        ("word/document.xml", body),
        ("word/header1.xml", F.concat(para(F.concat("s_name", F.lit(" & co"))), para(F.lit("Page 3 of 9")))),
        ("word/footer2.xml", F.concat(para(F.concat("s_name", F.lit(" &  co"))), para(F.concat(F.lit("第 "), "n", F.lit(" 頁"))))),
        ("word/_rels/document.xml.rels", F.concat(F.lit('<Relationships><Relationship Id="a" Target="http://x/?a='), F.col("doc_id").cast("string"), F.lit('&amp;b" TargetMode="External"/><Relationship Id="r1" Target="media/i.png"/></Relationships>'))),
        ("word/diagrams/data1.xml", F.concat(_ap(F.col("s_name")), _ap(F.col("n")), _ap(F.col("s_name")))),
    ]
    parts = [_part(s, name, content) for name, content in members]
    parts.append(_part(s.where("n % 2 = 0"), "word/vbaProject.bin", F.lit("x")))
    files = parts[0]
    for p in parts[1:]:
        files = files.unionByName(p)
    files = archives.packed(files)
    furniture = archives.header_footer_blocks(files).select("doc_id", F.col("text").alias("furniture"))
    target = archives.relations(files).select("doc_id", "target")
    diagram = archives.diagram_texts(files).select("doc_id", F.array_join("texts", ",").alias("diagram"))
    names = archives.parts(files).groupBy("doc_id").agg(archives.has_macros(F.collect_list("part")).alias("macros"), F.array_join(archives.image_ids(F.max(F.when(F.col("part") == "word/document.xml", F.col("content")))), ",").alias("images"))
    code = F.concat(F.lit("Option Explicit\nPublic Sub First()\nEnd Sub\n ' Sub no\nPrivate Function Second_"), "n", F.lit("(x)\nEnd Function\n"))
    outline = s.select("doc_id", F.array_join(archives.vba_outline(code), ",").alias("procedures"))
    return furniture.join(target, "doc_id").join(diagram, "doc_id").join(names, "doc_id").join(outline, "doc_id")


def _rtf(c: Column) -> Column:
    """A text in RTF: other characters than ASCII as numbers of 16 bits, line ends as paragraphs."""
    code = lambda ch: F.when(F.ascii(ch) > 32767, F.ascii(ch) - 65536).otherwise(F.ascii(ch)).cast("string")
    one = lambda ch: F.when(ch == "\n", "\\par ").when(ch.isin("\\", "{", "}"), F.concat(F.lit("\\"), ch)).when(F.ascii(ch) < 128, ch).otherwise(F.concat(F.lit("\\u"), code(ch), F.lit("?")))
    return F.concat(F.lit("{\\rtf1\\ansi\\ansicpg1252{\\fonttbl{\\f0 Arial;}}{\\*\\generator x;}"), F.array_join(F.transform(F.split(c, ""), one), ""), F.lit("}"))


@query("""with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as "at", regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g') t from documents)
select doc_id, (row_number() over (partition by doc_id order by "at") - 1)::int as pos, t as text from l where t <> ''""")
def rtf_paragraphs(spark, sf_dir):
    """Documents as RTF."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", _rtf(F.col("text")).cast("binary").alias("content"))
    return texts.rtf_blocks(d).select("doc_id", "pos", "text")


@query("""select doc_id, ['utf-8', 'utf-8-sig', 'utf-16', 'utf-16'][doc_id % 4 + 1] as encoding, true as sure, sha256(text) as digest from documents where text is not null and text <> ''""")
def decoded_texts(spark, sf_dir):
    """Documents in four encodings, three of them with a byte-order mark."""
    k = F.col("doc_id") % 4
    mark = lambda hex_, name: F.concat(F.unhex(F.lit(hex_)), F.encode("text", name))
    content = F.when(k == 0, F.encode("text", "UTF-8")).when(k == 1, mark("EFBBBF", "UTF-8")).when(k == 2, mark("FFFE", "UTF-16LE")).otherwise(mark("FEFF", "UTF-16BE"))
    d = table(spark, sf_dir, "documents").where("text is not null and text <> ''").select("doc_id", content.alias("content"))
    return texts.decoded(d).select("doc_id", "encoding", "sure", F.sha2("text", 256).alias("digest"))


def _mail(sender: Column, number: Column, body: Column, attached: Column) -> Column:
    """A message with parts attached: an array of (name, kind, base64 data)."""
    part = lambda a: F.concat(F.lit("--b\r\nContent-Type: "), a["kind"], F.lit('; name="'), a["name"], F.lit('"\r\nContent-Disposition: attachment; filename="'), a["name"], F.lit('"\r\nContent-Transfer-Encoding: base64\r\n\r\n'), a["data"], F.lit("\r\n"))
    return F.concat(F.lit("From: "), sender, F.lit("@x.org\r\nTo: all@x.org\r\nSubject: Talk "), number, F.lit('\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary="b"\r\n\r\n--b\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n'), F.base64(F.encode(body, "UTF-8")), F.lit("\r\n"), F.array_join(F.transform(attached, part), ""), F.lit("--b--\r\n"))


def _mails(spark, sf_dir) -> DataFrame:
    """(doc_id, content): conversations as mails; turns are attachments, the last attachment is a mail with one more."""
    t = _turns(spark, sf_dir)
    one = F.struct("turn", F.concat(F.lit("t"), F.col("turn").cast("string"), F.lit(".txt")).alias("name"), F.lit("text/plain").alias("kind"), F.base64(F.encode("text", "UTF-8")).alias("data"))
    m = t.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("a"), F.min_by("role", "turn").alias("role"))
    n = F.col("doc_id").cast("string")
    att = lambda name, kind, data: F.struct(name.alias("name"), F.lit(kind).alias("kind"), data.alias("data"))
    inner = _mail(F.lit("inner"), n, F.lit("inside"), F.array(att(F.lit("deep.txt"), "text/plain", F.base64(F.encode("role", "UTF-8")))))
    attached = F.concat(F.transform("a", lambda s: att(s["name"], "text/plain", s["data"])), F.array(att(F.lit("inner.eml"), "application/octet-stream", F.base64(F.encode(inner, "UTF-8")))))
    return m.select("doc_id", F.encode(_mail(F.col("role"), n, F.concat(F.lit("Body of "), "role"), attached), "UTF-8").alias("content"))


@query("""select conv_id doc_id, '- from:' || arg_min(role, turn) || '@x.org' || chr(10) || '- to:all@x.org' || chr(10) || '- subject:Talk ' || conv_id as heads, 'Body of ' || arg_min(role, turn) as body, false as is_html, count(*)::int + 1 as attached from conversations group by conv_id""")
def mail_parts(spark, sf_dir):
    p = mail.mail_parts(_mails(spark, sf_dir))
    return p.select("doc_id", mail.header_lines(F.col("headers")).alias("heads"), F.trim("body").alias("body"), "is_html", F.size("attachments").alias("attached"))


@query("""with a as (select conv_id mail_id, row_number() over (partition by conv_id order by turn) - 1 i, turn, text, role, count(*) over (partition by conv_id) n from conversations)
select mail_id, i::varchar as path, 1::int as depth, 't' || turn || '.txt' as name, sha256(coalesce(text, '')) as digest from a
union all select mail_id, n::varchar || '.0', 2, 'deep.txt', sha256(arg_min(role, turn)) from a group by mail_id, n""")
def mail_attachments(spark, sf_dir):
    """All attachments but the inner mails themselves, which the depth of what is in them shows."""
    a = mail.attachments(_mails(spark, sf_dir), most=None).where("reason is null and name <> 'inner.eml'")
    return a.select("mail_id", F.array_join(F.transform("path", lambda i: i.cast("string")), ".").alias("path"), "depth", "name", "digest")


@query("""with t as (select conv_id d, row_number() over (partition by conv_id order by turn) - 1 i, 't' || turn || '.txt' as n, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as text from conversations),
m as (select d, count(*) k, arg_min(role, i) r from t group by d),
b as (select d, -1 i, 0 s, 'para' kind, null::int as level, '- from:' || r || '@x.org' || chr(10) || '- to:all@x.org' || chr(10) || '- subject:Talk ' || d as text from m
 union all select d, -1, 1, 'para', null, 'Body of ' || r from m
 union all select d, i, 0, 'heading', 2, '附件:' || n from t union all select d, i, 1, 'para', null, '[' || n || '](assets/' || n || ')' from t
 union all select d, i, 2, case when text = '' then 'note' else 'para' end, null, case when text = '' then '附件「' || n || '」不是可轉換的格式,已原樣存放' else text end from t
 union all select d, k, unnest([0, 1, 2, 3, 4, 5, 6]), unnest(['heading', 'para', 'para', 'para', 'heading', 'para', 'para']), unnest([2, null, null, null, 4, null, null]),
  unnest(['附件:inner.eml', '[inner.eml](assets/inner.eml)', '- from:inner@x.org' || chr(10) || '- to:all@x.org' || chr(10) || '- subject:Talk ' || d, 'inside', '附件:deep.txt', '[deep.txt](assets/deep.txt)', r]) from m)
select d as doc_id, (row_number() over (partition by d order by i, s) - 1)::int as pos, kind, level, text from b""")
def mail_documents(spark, sf_dir):
    """Mails with their attachments read in place, an inner mail and its attachment too."""
    from lectern.plans.documents import ROUTES

    return ROUTES[".eml"](_mails(spark, sf_dir), most=None).select("doc_id", "pos", "kind", "level", "text")


@query("select page_id doc_id, sha256(html) as digest, 2::int as resources from pages where html is not null and html <> ''")
def web_archive_pages(spark, sf_dir):
    """Pages saved with an image by location and by content id."""
    p = table(spark, sf_dir, "pages").where("html is not null and html <> ''")
    head = F.lit('MIME-Version: 1.0\r\nContent-Type: multipart/related; boundary="b"\r\n\r\n--b\r\nContent-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n')
    image = F.lit("\r\n--b\r\nContent-Type: image/png\r\nContent-Location: http://x/i.png\r\nContent-ID: <i1>\r\nContent-Transfer-Encoding: base64\r\n\r\nQUI=\r\n--b--\r\n")
    files = p.select(F.col("page_id").alias("doc_id"), F.encode(F.concat(head, F.base64(F.encode("html", "UTF-8")), image), "UTF-8").alias("content"))
    return mail.web_archives(files).select("doc_id", F.sha2("html", 256).alias("digest"), F.size("resources").alias("resources"))


@query("""select c.n_regionkey::bigint doc_id, '名|國|國;' || string_agg('r' || c.n_regionkey || '|' || c.n_name || '|' || c.n_nationkey, ';' order by c.n_nationkey) as cells, true as has_header from nation c group by c.n_regionkey""")
def html_tables(spark, sf_dir):
    """Nations by region: the region's cell spans all rows, a header spans two columns, a blank row goes."""
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("doc_id"), F.col("n_nationkey").alias("turn"), "n_name")
    rows = _joined(n, F.concat(F.lit("\x01<td>"), "n_name", F.lit("</td><td> <b>"), F.col("turn").cast("string"), F.lit("</b></td>")))
    count = n.groupBy("doc_id").count()
    first = F.concat(F.lit("<td rowspan='"), F.col("count").cast("string"), F.lit("'>r"), F.col("doc_id").cast("string"), F.lit("</td>"))
    body = F.array_join(F.transform(F.slice(F.split("xml", "\x01"), 2, 1 << 30), lambda r, i: F.concat(F.lit("<tr>"), F.when(i == 0, first).otherwise(""), r, F.lit("</tr>"))), "")
    page = F.concat(F.lit("<p>x<table><tr><th>名</th><th colspan=2>國</th></tr>"), body, F.lit("<tr><td> </td></tr></table>"))
    b = html.html_blocks(rows.join(count, "doc_id").select("doc_id", page.alias("html")))
    return b.where("kind = 'table'").select("doc_id", _flat(F.col("rows")).alias("cells"), "has_header")


@query("""with o as (select o_custkey doc_id, o_orderkey k, (o_orderkey % 60000 - 30000)::int v, row_number() over (partition by o_custkey order by o_orderkey) r from orders)
select doc_id, count(*)::int samples, sum(v)::bigint total, round(count(*) / 16000.0, 9)::double as "seconds", round(sqrt(avg(v::double * v)), 3) as rms, sum(case when r > 1 and r <= 4 then v else 0 end)::bigint as middle from o group by doc_id""")
def wav_samples(spark, sf_dir):
    """Customers' orders as samples of a WAV file: its length, its level and a span of it."""
    v = F.col("o_orderkey") % 60000 - 30000
    bits = F.lpad(F.hex(F.pmod(v, F.lit(65536))), 4, "0")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("turn"), F.concat(F.substring(bits, 3, 2), F.substring(bits, 1, 2)).alias("bytes"))
    files = _joined(o, F.col("bytes"), "hex").select("doc_id", F.unhex(F.concat(F.repeat(F.lit("00"), F.lit(audio.HEADER)), "hex")).alias("content"))
    pcm = files.select("doc_id", audio.samples(F.col("content")).alias("pcm"), audio.available_seconds(F.length("content")).alias("seconds"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    rms = audio.tumbling_rms(pcm.select(F.col("doc_id").alias("rec_id"), "pcm")).select(F.col("rec_id").alias("doc_id"), F.round("rms", 3).alias("rms"))
    middle = audio.span(F.col("pcm"), F.lit(1.5 / audio.RATE), F.lit(4.5 / audio.RATE))
    return pcm.select("doc_id", F.size("pcm").alias("samples"), total(F.col("pcm")).alias("total"), F.round("seconds", 9).alias("seconds"), total(middle).alias("middle")).join(rms, "doc_id")


@query("""with f as (select page_id, '/s/p' || page_id % 40 || '/a.md' path from pages), i as (select k, '/s/p' || k % 40 || '/img/' || k || '.png' path from (select distinct page_id % 100 k from pages))
select k, path from i where not exists (select 1 from pages where page_id % 40 = i.k % 40 and page_id % 100 = i.k and page_id % 3 < 2 and page_id % 7 < 4) and not exists (select 1 from pages where page_id % 3 = 2 and page_id % 100 = i.k and page_id % 7 < 4)""")
def unreferenced_images(spark, sf_dir):
    """Images that no page's Markdown or HTML names: relative, through a folder above, or from the root."""
    k = F.col("page_id") % 100
    p = table(spark, sf_dir, "pages")
    own = (F.col("page_id") % 40).cast("string")
    name = F.concat(k.cast("string"), F.lit(".png"))
    ref = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("![a](./img/"), name, F.lit("?v=1)"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit('<img SRC="../p'), own, F.lit("/x/../img/"), name, F.lit('">'))).otherwise(F.concat(F.lit("`/s/p"), (k % 40).cast("string"), F.lit("/img/"), name, F.lit("`")))
    referrers = p.where("page_id % 7 < 4").select(F.concat(F.lit("/s/p"), own, F.lit("/a.md")).alias("path"), ref.alias("content"))
    images = p.select(k.alias("k")).distinct().select("k", F.concat(F.lit("/s/p"), (F.col("k") % 40).cast("string"), F.lit("/img/"), F.col("k").cast("string"), F.lit(".png")).alias("path"))
    return batches.referenced_images(images, referrers)


@query("""select page_id doc_id, 'a ![x](' || case when page_id % 2 = 0 then 'assets/' || page_id % 10 || '.png' else 'pic/' || page_id % 10 || '.png' end || ') b ![y](<http://h/z.png>) ![](' || 'gone.png)' as text, (1 + page_id % 2)::int as failed from pages""")
def copied_images(spark, sf_dir):
    """Relative images of a page get the link of their copy; every second folder has none."""
    p = table(spark, sf_dir, "pages")
    n = (F.col("page_id") % 10).cast("string")
    folder = F.concat(F.lit("/d"), (F.col("page_id") % 2).cast("string"))
    docs = p.select(F.col("page_id").alias("doc_id"), F.concat(folder, F.lit("/a.md")).alias("path"), F.concat(F.lit("a ![x](pic/"), n, F.lit(".png) b ![y](<http://h/z.png>) ![](gone.png)")).alias("text"))
    images = spark.range(10).select(F.concat(F.lit("/d0/PIC/"), F.col("id").cast("string"), F.lit(".png")).alias("path"), F.concat(F.lit("assets/"), F.col("id").cast("string"), F.lit(".png")).alias("link"))
    return batches.copied_images(docs, images).select("doc_id", "text", "failed")


@query("""select page_id, case when page_id % 6 = 0 then 'd/p' || page_id || '.wav' when page_id % 2 = 0 or page_id % 3 = 0 then 'd/p' || page_id || case when page_id % 2 = 0 then '.M4A' else '.npz.gz' end end as found from pages""")
def same_stem(spark, sf_dir):
    """The recording or features beside a page of the same stem; WAV before others."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("d/p"), F.col("page_id").cast("string")).alias("base"))
    of = lambda cond, ending: p.where(cond).select(F.concat("base", F.lit(ending)).alias("path"))
    others = of("page_id % 2 = 0", ".M4A").unionByName(of("page_id % 3 = 0", ".npz.gz")).unionByName(of("page_id % 6 = 0", ".wav"))
    return batches.same_stem(p.select("page_id", F.concat("base", F.lit(".md")).alias("path")), others, [".wav", ".m4a", ".npz.gz"]).select("page_id", "found")


@query("""with b as (select 0 f, page_id o, '/out/' || page_id % 50 || '.md' p from pages where page_id % 2 = 0 union all select 1, page_id, '/OUT/' || page_id % 60 || '.md' from pages where page_id % 2 = 1 and page_id % 5 <> 0 and page_id % 60 % 7 <> 3)
select f as "from", o as ord, p as path from (select *, row_number() over (partition by lower(p) order by f, o) n from b) where n = 1""")
def batch_outputs(spark, sf_dir):
    """Outputs of a batch, then those that were there before, without those of files that are not supported."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"))
    out = lambda root, m: F.concat(F.lit(root), (F.col("ord") % m).cast("string"), F.lit(".md"))
    converted = p.where("ord % 2 = 0").select("ord", out("/out/", 50).alias("out"))
    skipped = p.where("ord % 2 = 1").select("ord", F.when(F.col("ord") % 5 == 0, "x.zip").otherwise("x.docx").alias("src"), out("/OUT/", 60).alias("out"))
    existing = spark.range(60).where("id % 7 <> 3").select(F.concat(F.lit("/out/"), F.col("id").cast("string"), F.lit(".md")).alias("path"))
    return batches.batch_outputs(converted, skipped, existing, [".docx", ".txt"])


@query("select 'n' || n_nationkey as name, n_regionkey as region from nation where n_nationkey % 3 <> 0")
def missing_defaults(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_regionkey").alias("region"))
    return batches.missing_defaults(n, n.where("cast(substring(name, 2) as int) % 3 = 0"))


@query("""with f as (select conv_id rec_id, case when role = 'system' then '未知' else role end as name, min(turn) as "at" from conversations group by all)
select rec_id, case when name = '未知' then -1 else (row_number() over (partition by rec_id, name = '未知' order by "at"))::int end::int as number, name from f""")
def labels_in(spark, sf_dir):
    """Names in the transcripts that conversations make, by the number of their box."""
    t = _turns(spark, sf_dir)
    name = F.when(F.col("role") == "system", "未知").otherwise(F.col("role"))
    md = _joined(t, F.concat(F.lit("**"), name, F.lit("** (00:00:0"), (F.col("turn") % 10).cast("string"), F.lit(")\nx\n\n")), "md").withColumnRenamed("doc_id", "rec_id")
    return transcripts.labels_in(md)


@query("select conv_id, string_agg(turn || '=' || case role when 'user' then 'Ann' else role end, ',' order by turn) as names from conversations group by conv_id")
def renamed_drafts(spark, sf_dir):
    """Drafts of names by turn, with one name replaced."""
    t = _turns(spark, sf_dir).groupBy(F.col("doc_id").alias("conv_id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("turn", "role")))).alias("names"))
    new = transcripts.renamed_in(F.col("names"), " user ", "Ann")
    return t.select("conv_id", F.array_join(F.transform(F.array_sort(F.map_entries(new)), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])), ",").alias("names"))


@query("select vec_id, true as same, '{\"ok\":true,\"turns\":[[' || vec_id || ',' || vec_id + 1 || ',' || label || ',null]],\"vp\":[],\"quality\":[]}' as reply from embeddings where embedding is not null")
def worker_replies(spark, sf_dir):
    """A reply for each vector; its text is as many characters as the bytes of its elements need."""
    from lectern.functions import replies

    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    turn = F.array(F.struct(F.col("vec_id").alias("start"), (F.col("vec_id") + 1).alias("end"), F.col("label").alias("speaker"), F.lit(None).cast("double").alias("conf")))
    prints = F.array().cast("array<struct<speaker int, vector string>>")
    quality = F.array().cast("array<struct<speaker int, segments int, seconds double, cohesion double>>")
    text = replies.vector_text(F.col("embedding"))
    return e.select("vec_id", (F.length(F.unbase64(text)) == 4 * F.size("embedding")).alias("same"), replies.diarisation_reply(turn, prints, quality).alias("reply"))


@query("""select p_partkey, (generate_series - 1)::int as "at", case when generate_series = 1 then p_name else p_brand end as text, case when generate_series = 1 then p_size / 100.0::double else 0 end as score, case when generate_series = 1 then 2 else 0 end::int as corners from part, generate_series(1, 2)""")
def recognised_lines(spark, sf_dir):
    """Replies of a recogniser with fewer boxes and scores than texts."""
    from lectern.functions import replies

    reply = F.to_json(F.struct(F.array(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))).alias("boxes"), F.array("p_name", "p_brand").alias("txts"), F.array(F.col("p_size") / 100).alias("scores")))
    p = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(replies.recognised_lines(reply)).alias("at", "l"))
    return p.select("p_partkey", "at", "l.text", "l.score", F.size("l.box").alias("corners"))


@query("""select conv_id doc_id, '## ' || arg_min(role, turn) || chr(10) || '```' || chr(10) || '# not a heading' || chr(10) || '```' || chr(10) || '### End' || chr(10) || '###### Six' as text from conversations group by conv_id""")
def markdown_demoted(spark, sf_dir):
    """Headings go down a level, but not in fences and not below six."""
    d = _turns(spark, sf_dir).groupBy("doc_id").agg(F.min_by("role", "turn").alias("role"))
    md = F.concat(F.lit("# "), "role", F.lit("\n```\n# not a heading\n```\n## End\n###### Six"))
    return texts.markdown_blocks(d.select("doc_id", md.alias("text"))).select("doc_id", "text")


@query("""select o_orderkey, printf('%02d:%02d:%02d', (t // 3600)::int, (t % 3600 // 60)::int, (t % 60)::int) as hms, case when t >= 3600 then printf('%d:%02d:%02d', (t // 3600)::int, (t % 3600 // 60)::int, (t % 60)::int) else printf('%02d:%02d', (t // 60)::int, (t % 60)::int) end as mmss, strftime(o_orderdate, '%Y-%m-%d_%H%M%S') || '.log' as log
from (select o_orderkey, o_orderdate, floor(o_totalprice)::bigint % 9000 t from orders)""")
def clock_times(spark, sf_dir):
    """Seconds as times, and the names of logs."""
    from lectern.functions.times import hms, log_name, mmss

    t = F.floor("o_totalprice") % 9000 + 0.75
    return table(spark, sf_dir, "orders").select("o_orderkey", hms(t).alias("hms"), mmss(t).alias("mmss"), log_name(F.col("o_orderdate")).alias("log"))


@query("""select page_id, 'C:\\a\\' || page_id || '.txt;' || url || ';new' || page_id as paths, (3)::int as n from pages where url is not null""")
def path_lists(spark, sf_dir):
    """Pasted lines as paths: quotes and blank lines go, known paths are not added again whatever their case."""
    p = table(spark, sf_dir, "pages").where("url is not null")
    n = F.col("page_id").cast("string")
    current = x.clean_paths(F.concat(F.lit(' "C:\\a\\'), n, F.lit('.txt" \r\n\r\n'), "url"))
    added = x.clean_paths(F.concat(F.lit("'c:\\A\\"), n, F.lit(".TXT'\nnew"), n, F.lit("\nNEW"), n, F.lit("\n  \n")))
    paths = x.append_paths(current, added)
    return p.select("page_id", F.array_join(paths, ";").alias("paths"), F.size(paths).alias("n"))


@query("select p_partkey, 'a b.assets/' || replace(p_name, ' ', '%20') || '%2B%28' || p_size || '%29.png' as link from (select p_partkey, p_name, p_size from part)")
def asset_links(spark, sf_dir):
    """Links to assets are percent-encoded but for the slash."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.replace(x.asset_link(F.lit("a b.assets"), F.concat("p_name", F.lit("+("), F.col("p_size").cast("string"), F.lit(").png"))), F.lit("a%20b.assets"), F.lit("a b.assets")).alias("link"))


@query("select p_partkey, case p_partkey % 4 when 0 then '_nul.txt' when 1 then '檔案' when 2 then 'a_b_c_' || p_partkey || '.md' else repeat('x', 60) || '.pdf' end as name from part")
def safe_names(spark, sf_dir):
    """File names without folders, illegal characters, device names and overlong stems."""
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, "x\\y/nul.txt").when(k == 1, " ... ").when(k == 2, F.concat(F.lit('a<b?c"'), F.col("p_partkey").cast("string"), F.lit(".md"))).otherwise(F.concat(F.repeat(F.lit("x"), F.lit(99)), F.lit(".pdf")))
    return table(spark, sf_dir, "part").select("p_partkey", x.sanitize_name(name).alias("name"))


@query("""select doc_id, case when doc_id % 3 = 0 then 'doc/a' || doc_id || '.md' else null end as ours, '/out/a' || doc_id || '-' || substr(sha256(text), 1, 8) || '.md' as out, 'doc/a' || doc_id || '.md' as beside from documents where text is not null""")
def output_files(spark, sf_dir):
    """Where a document's Markdown goes, and whether a file is one of ours by its front matter."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    src = F.concat(F.lit("doc/a"), F.col("doc_id").cast("string"), F.lit(".docx"))
    md = F.when(F.col("doc_id") % 3 == 0, "---\nsource_file: x\nconverted_by: lectern\n---\n\n# x").when(F.col("doc_id") % 3 == 1, "---\nsource_file: x\n---\n\nconverted_by: lectern").otherwise("converted_by: lectern")
    beside = batches.output_path(src, F.col("text"))
    return d.select("doc_id", F.when(batches.is_ours(md, "converted_by: lectern"), beside).alias("ours"), batches.output_path(src, F.col("text"), "/out").alias("out"), beside.alias("beside"))


@query("""with b as (select item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) t from benchmark)
select item_id doc_id, '---' || chr(10) || 'source_file: b' || item_id || '.txt' || chr(10) || 'source_type: txt' || chr(10) || 'converted_at: "2024-01-01T00:00:00"' || chr(10) || 'lossy: 0' || chr(10) || 'lossy_kinds: []' || chr(10) || 'ocr_used: false' || chr(10) || '---' || chr(10) || chr(10) || '# b' || item_id || chr(10) || chr(10) || t || chr(10) || chr(10) || 'two' || chr(10) as md from b where item_id % 2 = 0
union all select item_id, '---' || chr(10) || 'source_file: b' || item_id || '.csv' || chr(10) || 'source_type: csv' || chr(10) || 'converted_at: "2024-01-01T00:00:00"' || chr(10) || 'lossy: 0' || chr(10) || 'lossy_kinds: []' || chr(10) || 'ocr_used: false' || chr(10) || '---' || chr(10) || chr(10) || '# b' || item_id || chr(10) || chr(10) || '| id | n |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || item_id || ' | ' || length(t) || ' |' || chr(10) from b where item_id % 2 = 1""")
def files_to_markdown(spark, sf_dir):
    """Benchmark items as text and delimited files, all the way to Markdown."""
    from lectern.plans.documents import to_markdown

    t = F.trim(F.regexp_replace("text", r"\s+", " "))
    n = F.col("item_id").cast("string")
    even = F.col("item_id") % 2 == 0
    content = F.when(even, F.concat(t, F.lit("\r\n \t\r\ntwo\n"))).otherwise(F.concat(F.lit("id;n\n"), n, F.lit(";"), F.length(t).cast("string"), F.lit("\n\n")))
    files = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.concat(F.lit("in/b"), n, F.when(even, ".txt").otherwise(".CSV")).alias("path"), F.encode(content, "UTF-8").alias("content"))
    md = to_markdown(files, "2024-01-01T00:00:00")
    return md.select("doc_id", F.replace("md", F.lit(".CSV"), F.lit(".csv")).alias("md"))


@query("""select doc_id, sum(pos) as places, string_agg('[' || pos || ' ' || role || ']', '' order by pos) as squashed from (select conv_id doc_id, turn pos, role from conversations) group by doc_id""")
def block_haystacks(spark, sf_dir):
    """Squashed texts of blocks, from their texts, cells and captions; headings two levels lower."""
    t = _turns(spark, sf_dir)
    b = t.select("doc_id", F.col("turn").cast("int").alias("pos"), F.when(F.col("turn") % 2 == 0, "table").otherwise("heading").alias("kind"), F.lit(1).alias("level"), F.when(F.col("turn") % 2 == 1, F.concat(F.lit("[ "), F.col("turn").cast("string"), F.lit(" \\\n"))).alias("text"), F.when(F.col("turn") % 2 == 0, F.array(F.array(F.lit("[ "), F.col("turn").cast("string")))).alias("rows"), F.concat("role", F.lit(" ]")).alias("caption"))
    b = markdown.shift_headings(b, 2)
    places = b.groupBy("doc_id").agg(F.sum("pos").alias("places"), F.max("level").alias("level"))
    spaced = markdown.haystacks(b).withColumn("squashed", F.regexp_replace("haystack", r"\[(\d+)", "[$1 "))
    return spaced.join(places.where("level <= 3"), "doc_id").select("doc_id", "places", "squashed")
