"""Text functions as column expressions."""

import unicodedata
import zlib

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

from lectern.functions.labels import MARKER_PREFIX, SPEAKER, UNKNOWN, UNKNOWN_SPEAKER


def one_line(text: Column) -> Column:
    """Runs of white space as one space, trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def norm_text(text: Column) -> Column:
    """Letters and digits only, lower-cased."""
    return F.lower(F.regexp_replace(text, r"(?U)[\W_]+", ""))


def squash(text: Column) -> Column:
    """What an audit compares: link targets, autolink brackets, note marks, white space and backslashes removed."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\[((?:\\.|[^\]\n\\])*)\]\((?:<[^>\n]*>|[^)\n]*)\)", "$1")
    t = F.regexp_replace(t, r"(?i)<([a-z][\w+.-]*:[^>\s]*)>", "$1")
    t = F.regexp_replace(t, r"\[(?:註|附註)\d+\]", "")
    return F.regexp_replace(t, r"(?U)[\s\\]+", "")


def cell(text: Column) -> Column:
    """A Markdown table cell: backslashes and bars escaped, line ends as <br>, trimmed; null is empty."""
    t = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.trim(F.regexp_replace(t, "\r\n|\r|\n", "<br>"))


def has_content(cells: Column) -> Column:
    """Whether any cell is neither null nor blank."""
    return F.exists(cells, lambda c: F.coalesce(F.trim(c.cast("string")) != "", F.lit(False)))


def drop_blank_rows(rows: Column) -> Column:
    return F.filter(rows, has_content)


def yaml_scalar(value: Column) -> Column:
    """Plain if it is made of safe characters only, else quoted with escapes."""
    safe = value.rlike(r"^[0-9A-Za-z一-鿿_.\-/\\ ]+$") & (F.trim(value) == value)
    quoted = F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(safe, value).otherwise(quoted)


def note_marker(mark: Column, number: Column) -> Column:
    return F.concat(F.lit("["), mark, number.cast("string"), F.lit("]"))


def speaker_label(speaker: Column) -> Column:
    return F.when(speaker == UNKNOWN_SPEAKER, F.lit(UNKNOWN)).otherwise(F.concat(F.lit(SPEAKER + " "), (speaker + 1).cast("string")))


def is_marker(text: Column) -> Column:
    return F.coalesce(text.startswith(MARKER_PREFIX), F.lit(False))


def strip_punctuation(text: Column) -> Column:
    """Punctuation removed, but for . - : / between ASCII letters or digits."""
    return F.regexp_replace(text, r"(?<=[0-9A-Za-z])([.\-:/])(?=[0-9A-Za-z])|[,.!?;:，。、！？；：\-/]", "$1")


def reglue(text: Column) -> Column:
    """Spaces around . - : / between ASCII letters or digits removed."""
    return F.regexp_replace(text, r"(?<=[0-9A-Za-z])\s*([.\-:/])\s*(?=[0-9A-Za-z])", "$1")


def clean_path(text: Column) -> Column:
    """Outer white space and quotes removed."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), F.lit("\"' "))


def clean_paths(text: Column) -> Column:
    """A path for each line; blank lines go."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n"), clean_path), lambda p: p != "")


def append_paths(current: Column, added: Column) -> Column:
    """current and those of added that are not there yet, whatever their case; what current repeats stays."""
    fresh = F.filter(added, lambda p, i: ~F.exists(current, lambda c: F.lower(c) == F.lower(p)) & (F.array_position(F.transform(added, F.lower), F.lower(p)) == i + 1))
    return F.concat(current, fresh)


def suffix_of(path: Column) -> Column:
    """Lower-cased ending with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/\\.][^/\\]*?(\.[^./\\]*)$", 1))


def stem_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, trimmed; blank parts go."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    return F.filter(F.transform(F.split(t, r"\n[ \t]*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")


def sniff_delimiter(sample: Column, head: int = 20) -> Column:
    """The most frequent of comma, tab, semicolon and bar in the first lines; a comma if there is none, or on ties."""
    top = F.substring_index(F.regexp_replace(sample, "\r\n?", "\n"), "\n", head)
    count = lambda d: F.length(top) - F.length(F.replace(top, F.lit(d)))
    ranked = [F.struct(count(d).alias("n"), F.lit(-i).alias("rank"), F.lit(d).alias("delimiter")) for i, d in enumerate(",\t;|")]
    return F.coalesce(F.greatest(*ranked)["delimiter"], F.lit(","))


def demote_headings(text: Column) -> Column:
    """Markdown headings one level lower (6 at most), but not inside code fences.

    Lines alternate between outside and inside at each fence, so the text is cut at fences.
    """
    parts = F.split(text, r"(?m)(?=^ {0,3}(?:```|~~~))")
    down = lambda t: F.regexp_replace(t, r"(?m)^( {0,3})(#{1,5})(?=\s|$)", "$1$2#")
    # part 0 is outside; odd parts begin with an opening fence, even ones with a closing fence
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 0, down(p)).otherwise(p)), "")


def one_newline_pair(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def clean_cell_breaks(text: Column) -> Column:
    """Vertical tabs and form feeds as line ends; blanks at line ends go."""
    return F.regexp_replace(F.regexp_replace(text, "[\u000b\u000c]", "\n"), r"(?m)[ \t]+$", "")


def drop_leading_heading(text: Column) -> Column:
    return F.regexp_replace(text, r"^## [^\n]*\n+", "")


def markdown_link(text: Column, url: Column) -> Column:
    """[text](url); an autolink where both are equal, angle brackets where the URL has blanks or parentheses."""
    shown = F.regexp_replace(text, r"([\[\]])", r"\\$1")
    target = F.when(url.rlike(r"[\s()]"), F.concat(F.lit("<"), url, F.lit(">"))).otherwise(url)
    return F.when(F.coalesce(url, F.lit("")) == "", text).when(F.trim(text) == url, F.concat(F.lit("<"), url, F.lit(">"))).otherwise(F.concat(F.lit("["), shown, F.lit("]("), target, F.lit(")")))


def asset_link(folder: Column, name: Column) -> Column:
    """folder/name, percent-encoded but for the slash."""
    path = F.url_encode(F.concat(folder, F.lit("/"), name))
    for a, b in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        path = F.replace(path, F.lit(a), F.lit(b))
    return path


@pandas_udf(StringType())
def nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


#: Names that Windows keeps for devices (fixed values).
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10)))


def sanitize_name(name: Column, fallback: str = "檔案", most: int = 60) -> Column:
    """A file name without folders, illegal characters and device names, with a stem of at most `most` characters."""
    s = F.regexp_replace(F.replace(F.trim(nfc(F.coalesce(name, F.lit("")))), F.lit("\\"), F.lit("/")), r"^.*/", "")
    s = F.btrim(F.regexp_replace(s, r'[<>:"|?*\x00-\x1f]', "_"), F.lit(". "))
    s = F.when(s == "", F.lit(fallback)).otherwise(s)
    stem, ending = F.regexp_replace(s, r"\.[^.]*$", ""), F.regexp_extract(s, r"(\.[^.]+)$", 1)
    stem = F.when(F.upper(stem).isin(*RESERVED), F.concat(F.lit("_"), stem)).otherwise(stem)
    stem = F.btrim(F.substring(stem, 1, most), F.lit(". "))
    return F.concat(F.when(stem == "", F.lit(fallback)).otherwise(stem), ending)


def assets_name(stem: Column) -> Column:
    return F.concat(sanitize_name(stem, "doc"), F.lit(".assets"))


def content_tag(content: Column, digits: int = 8) -> Column:
    return F.substring(F.sha2(content.cast("binary"), 256), 1, digits)


@pandas_udf(DoubleType())
def compression_ratio(values: pd.Series) -> pd.Series:
    """UTF-8 bytes over bytes after zlib's strongest compression."""
    return values.map(lambda t: None if t is None else len(b := t.encode("utf-8", "surrogatepass")) / max(1, len(zlib.compress(b, 9))))


def is_degenerate(text: Column, least_chars: int = 80, ratio: float = 2.2) -> Column:
    """Whether a text repeats itself so much that it compresses too well."""
    return F.when(F.length(text) >= least_chars, compression_ratio(text) >= ratio).otherwise(False)


def degenerate_note(start: Column, end: Column, phrase: Column) -> Column:
    """Marker text for a degenerate segment: its times and the phrase that repeats."""
    from lectern.functions.times import mmss

    about = F.when(F.coalesce(phrase, F.lit("")) != "", F.concat(F.lit(",重複「"), phrase, F.lit("」"))).otherwise("")
    return F.concat(F.lit(MARKER_PREFIX + " "), mmss(start), F.lit("–"), mmss(end), about, F.lit(")"))


def replace_rules(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Literal replacements one after the other, longest first (equal lengths in their order); results can be replaced again."""
    for old, new in sorted(rules, key=lambda r: -len(r[0])):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def rename_at_once(text: Column, names: dict[str, str]) -> Column:
    """All names replaced in a single pass, the longest that fits at each place, so that swaps do not cascade."""
    if not names:
        return text
    ordered = sorted((n for n in names if n), key=lambda n: -len(n))
    found = "|".join("\\Q" + n.replace("\\E", "\\E\\\\E\\Q") + "\\E" for n in ordered)
    table = F.create_map(*[F.lit(x) for n in ordered for x in (n, names[n])])
    between, hits = F.split(text, found), F.regexp_extract_all(text, F.lit(f"({found})"), F.lit(1))
    return F.array_join(F.zip_with(between, hits, lambda b, h: F.concat(b, F.coalesce(F.element_at(table, h), F.lit("")))), "")
