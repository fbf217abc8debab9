"""Text files: bytes to text, delimited tables, Markdown, RTF."""

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from lectern.functions.labels import ENCODING_NOTE
from lectern.functions.text import demote_headings, drop_blank_rows, paragraphs, sniff_delimiter

#: Byte-order marks, longest first (fixed values).
MARKS = ((b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
#: Older encodings in the order in which ties are settled (fixed values).
OLDER = ("cp950", "gb18030", "cp1252")


@lru_cache(maxsize=1)
def _weights() -> np.ndarray:
    """What each code point says for or against a text (fixed values): common CJK 1, rare CJK -1, control, private and unassigned characters -3, U+FFFD -5, others 0."""
    w = np.zeros(0x110000, np.int8)
    w[[c for c in range(0x110000) if unicodedata.category(chr(c)) in ("Cc", "Cn", "Co", "Cs")]] = -3
    w[[9, 10, 13]] = 0
    w[0x3400:0x4DC0] = w[0x20000:] = -1
    w[0x4E00:0xA000] = 1
    w[0xE000:0xF900] = -3
    w[0xFFFD] = -5
    return w


def plausibility(text: str) -> float:
    """Mean of the weights of a text's characters; 0 for an empty one."""
    return float(_weights()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].mean()) if text else 0.0


def _fits(data: bytes, encoding: str) -> str | None:
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        return None


def decode(data: bytes) -> tuple[str, str, bool]:
    """(text, encoding, sure): by a byte-order mark whose encoding fits, then UTF-8 if it fits, then the most plausible of the older ones.

    Of equally plausible ones the first counts; it is a guess below 0. If none fits, the first of them is taken with marks
    for what it cannot read.
    """
    marked = [name for mark, name in MARKS if data.startswith(mark)][:1]
    for name in [*marked, "utf-8"]:
        if (text := _fits(data, name)) is not None:
            return text, name, True
    told = {name: text for name in OLDER if (text := _fits(data, name)) is not None}
    if not told:
        return data.decode(OLDER[0], "replace"), OLDER[0], False
    # max() keeps the first of equals
    name = max(told, key=lambda n: plausibility(told[n]))
    return told[name], name, plausibility(told[name]) >= 0


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """files with text, encoding and sure (false where the encoding is a guess); null content counts as empty."""

    @pandas_udf("text string, encoding string, sure boolean")
    def of(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode(bytes(v) if v is not None else b"") for v in values], columns=["text", "encoding", "sure"])

    return files.withColumn("_d", of(F.col(content))).select(*[c for c in files.columns if c not in ("text", "encoding", "sure")], "_d.*")


def encoding_note(sure: Column) -> Column:
    """The note for a text whose encoding is a guess; null where it is sure."""
    return F.when(~F.coalesce(sure, F.lit(False)), F.lit(ENCODING_NOTE))


def text_blocks(texts: DataFrame) -> DataFrame:
    """Paragraph blocks (doc_id, pos, kind, text) of (doc_id, text)."""
    return texts.select("doc_id", F.posexplode(paragraphs(F.col("text"))).alias("pos", "text")).withColumn("kind", F.lit("para"))


#: Text in quotes; a doubled quote is part of it, and a last quote may be missing.
_QUOTED = '"[^"]*+(?:""[^"]*+)*+'


def _cell(value: Column) -> Column:
    """A cell as written, without its quotes and with doubled ones single; what follows a closing quote stays as it is."""
    inner = F.substring(value, F.lit(2), F.length(value) - 2)
    plain = value.endswith('"') & (F.length(value) > 1) & ~F.replace(inner, F.lit('""'), F.lit("")).contains('"')
    parts = f'(?s)^({_QUOTED})"?+(.*+)'
    body = lambda t: F.replace(t, F.lit('""'), F.lit('"'))
    rest = F.concat(body(F.substring(F.regexp_extract(value, parts, 1), 2, 1 << 30)), F.regexp_extract(value, parts, 2))
    return F.when(~value.startswith('"'), value).when(plain, body(inner)).otherwise(rest)


def delimited_rows(text: Column, delimiter: Column) -> Column:
    """Rows of cells of a delimited text; quoted cells hold delimiters, line ends and doubled quotes. Blank rows go, none is cut.

    A cell is quoted if it begins with a quote; a quote further on is a character like others. Rows and cells are found by
    what stands before them, as an empty one at the end would else be found twice. Their loops give nothing back, so a
    long cell takes no stack.
    """
    sign = lambda s: F.concat(F.lit("["), s["delimiter"], F.lit("]"))
    cell = lambda s: F.concat(F.lit(f'(?:{_QUOTED}(?:"[^\r\n'), s["delimiter"], F.lit(']*+)?+|[^\r\n'), s["delimiter"], F.lit("]*+)"))
    row = lambda s: F.concat(F.lit("(?:\r\n?|\n)("), cell(s), F.lit("(?:"), sign(s), cell(s), F.lit(")*+)"))
    # text and delimiter go along as an array: expressions from outside would be worked out again for each row
    given = F.struct(F.regexp_replace(F.coalesce(text, F.lit("")), "^\ufeff", "").alias("text"), delimiter.alias("delimiter"))
    found = F.transform(F.array(given), lambda s: F.struct(F.regexp_extract_all(F.concat(F.lit("\n"), s["text"]), row(s), F.lit(1)).alias("rows"), s["delimiter"].alias("delimiter"), F.concat(sign(s), F.lit("("), cell(s), F.lit(")")).alias("cell")))
    cells = lambda s: F.transform(s["rows"], lambda r: F.transform(F.regexp_extract_all(F.concat(s["delimiter"], r), s["cell"], F.lit(1)), _cell))
    return drop_blank_rows(F.get(F.transform(found, cells), F.lit(0)))


def delimited_blocks(texts: DataFrame) -> DataFrame:
    """One table block (doc_id, pos, kind, rows, has_header) for each text; the delimiter is found in its first lines.

    The rows leave a text by explode(): a filter on them would be moved in front of it and split the text anew, with
    whatever made the text.
    """
    x = texts.select("doc_id", sniff_delimiter(F.col("text")).alias("delimiter"), "text")
    filled = F.filter(F.array(delimited_rows(F.col("text"), F.col("delimiter"))), lambda rows: F.size(rows) > 0)
    return x.select("doc_id", F.posexplode(filled).alias("pos", "rows")).select("doc_id", "pos", F.lit("table").alias("kind"), "rows", F.lit(True).alias("has_header"))


def markdown_blocks(texts: DataFrame) -> DataFrame:
    """One raw block for each Markdown text, its headings one level lower."""
    return texts.select("doc_id", F.lit(0).alias("pos"), F.lit("raw").alias("kind"), demote_headings(F.col("text")).alias("text"))


_RTF = re.compile(r"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+|.)", re.I | re.S)
#: Groups that hold no text, and words that stand for characters (fixed values).
_RTF_SKIP = frozenset("fonttbl colortbl stylesheet info pict object header footer headerl headerr footerl footerr generator themedata datastore listtable listoverridetable".split())
_RTF_CHARS = {"par": "\n", "line": "\n", "tab": "\t", "sect": "\n\n", "page": "\n\n", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "cell": "\t", "row": "\n"}


def rtf_text(data: str, encoding: str = "cp1252") -> str:
    """Plain text of RTF, without formatting, tables of fonts and pictures."""
    out, stack, skip, wide, pending, after = [], [], False, 1, 0, bytearray()

    def flush():
        if after:
            out.append(bytes(after).decode(encoding, "replace"))
            after.clear()

    for m in _RTF.finditer(data):
        word, number, byte, sign, brace, run = m.groups()
        if byte is None:
            flush()
        if brace == "{":
            stack.append((skip, wide))
        elif brace == "}":
            skip, wide = stack.pop() if stack else (False, 1)
        elif sign:
            if sign == "*":
                skip = True
            elif not skip:
                out.append({"~": "\u00a0", "_": "-", "-": ""}.get(sign, sign))
        elif word:
            if word in _RTF_SKIP:
                skip = True
            elif word == "ansicpg" and number:
                encoding = f"cp{number}"
            elif word == "uc":
                wide = int(number or 1)
            elif word == "u" and number and not skip:
                out.append(chr(int(number) % 65536))
                pending = wide
            elif not skip and word in _RTF_CHARS:
                out.append(_RTF_CHARS[word])
        elif pending and byte:
            pending -= 1
        elif byte and not skip:
            after.append(int(byte, 16))
        elif run:
            told = min(pending, len(run))
            pending -= told
            if not skip:
                out.append(run[told:])
    flush()
    return "".join(out)


def rtf_blocks(files: DataFrame) -> DataFrame:
    """Paragraph blocks of (doc_id, content) RTF files."""

    @pandas_udf("string")
    def plain(values: pd.Series) -> pd.Series:
        return values.map(lambda v: rtf_text((v or b"").decode("latin-1")).replace("\n", "\n\n"))

    return text_blocks(files.select("doc_id", plain("content").alias("text")))
