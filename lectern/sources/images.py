"""Images of web pages: from resources of an archive, data URIs and files beside the page; nothing is fetched from elsewhere."""

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions.text import asset_link, suffix_of
from lectern.operators import batches
from lectern.sources.html import unescaped

#: What an image is called that has no text of its own.
UNNAMED = "圖片"
#: Bytes of a file beside the page at most.
MOST_BYTES = 64 << 20


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value in any quotes, without blanks at its ends; empty if there is none."""
    found = rf"""(?is)^<[^\s>]+(?:\s+[^\s=>]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+))?)*?\s+{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    return F.btrim(unescaped(F.concat(*[F.regexp_extract(tag, found, i) for i in (1, 2, 3)])), F.lit(" \t\r\n"))


def image_tags(pages: DataFrame) -> DataFrame:
    """(doc_id, path, nth, src, alt) of the img and image elements of pages (doc_id, path, html) that name a source, in order."""
    visible = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    tags = F.regexp_extract_all(visible, F.lit(r"""(?is)<(?:img|image)\b(?:[^>"']|"[^"]*"|'[^']*')*>"""), F.lit(0))
    x = pages.select("doc_id", "path", F.posexplode(tags).alias("nth", "tag"))
    named = [F.nullif(_attribute(F.col("tag"), a), F.lit("")) for a in ("src", "href", "xlink:href")]
    alt = F.coalesce(F.nullif(_attribute(F.col("tag"), "alt"), F.lit("")), F.lit(UNNAMED))
    return x.select("doc_id", "path", "nth", F.coalesce(*named).alias("src"), alt.alias("alt")).where("src is not null")


def page_images(pages: DataFrame, resources: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, nth, alt, src, kind, content, suffix) for each image of pages (doc_id, path, html).

    resources (doc_id, name, content) are parts of a page's own archive or mail, by the address that the page uses; files
    (path, content) lie beside pages. kind is resource, data, local, remote (another scheme, never fetched) or missing;
    content is null for the last two and for data that cannot be read. Names that come twice count once, with the longer content.
    """
    x = image_tags(pages)
    longest = lambda df, keys: df.groupBy(*keys).agg(F.max_by("content", F.length("content")).alias("content"))
    own = longest(resources.select("doc_id", F.col("name").alias("src"), "content"), ["doc_id", "src"]).withColumnRenamed("content", "part")
    beside = longest(files.where(F.length("content") < MOST_BYTES).select(F.col("path").alias("_at"), "content"), ["_at"]).withColumnRenamed("content", "file")
    data = F.lower(F.substring("src", 1, 5)) == "data:"
    at = batches.local_target(F.regexp_replace("path", r"[^/]*$", ""), F.col("src"))
    x = x.join(own, ["doc_id", "src"], "left").withColumn("_at", F.when(F.col("part").isNull() & ~data, at)).join(beside, "_at", "left")
    header, payload = F.substring_index("src", ",", 1), F.expr("substring(src, instr(src, ',') + 1)")
    plain = F.encode(F.try_url_decode(F.replace(payload, F.lit("+"), F.lit("%2B"))), "UTF-8")
    packed = F.try_to_binary(F.regexp_replace(payload, "[^A-Za-z0-9+/=]", ""), F.lit("base64"))
    read = F.when(F.contains(header, F.lit(";base64")), packed).otherwise(plain)
    kind = F.when(F.col("part").isNotNull(), "resource").when(data, "data").when(F.col("src").rlike("^[a-zA-Z][a-zA-Z0-9_+.-]*:"), "remote").when(F.col("file").isNotNull(), "local").otherwise("missing")
    content = F.coalesce("part", F.when(data, read).otherwise(F.col("file")))
    of_type = F.regexp_extract(header, r"image/([\w.+-]+)", 1)
    address = suffix_of(F.regexp_replace(F.regexp_replace("src", r"[?#].*$", ""), r"^.*/", "x/"))
    suffix = F.when(kind == "data", F.when(of_type != "", F.concat(F.lit("."), F.substring_index(of_type, "+", 1)))).otherwise(F.nullif(address, F.lit("")))
    return x.select("doc_id", "nth", "alt", "src", kind.alias("kind"), content.alias("content"), F.coalesce(suffix, F.lit(".png")).alias("suffix"))


def image_blocks(images: DataFrame, folder: Column) -> tuple[DataFrame, DataFrame]:
    """Blocks (doc_id, nth, md) of images with content, and the files (path, content) that they link to in folder (an expression of doc_id).

    Equal contents of a document are one file, numbered by first appearance.
    """
    x = images.where("content is not null").withColumn("digest", F.sha2("content", 256))
    numbered = batches.asset_numbers(x.select("doc_id", F.col("nth").alias("pos"), "digest", "suffix"))
    x = x.join(numbered.select("doc_id", F.col("pos").alias("nth"), "file"), ["doc_id", "nth"]).withColumn("link", asset_link(folder, F.col("file")))
    files = x.groupBy(F.concat(folder, F.lit("/"), "file").alias("path")).agg(F.first("content").alias("content"))
    return x.select("doc_id", "nth", F.concat(F.lit("!["), "alt", F.lit("]("), "link", F.lit(")")).alias("md")), files
