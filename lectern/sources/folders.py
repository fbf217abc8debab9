"""Folders of files through Spark's own readers, so that any store that Spark opens will do."""

from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.functions.text import suffix_of
from lectern.operators import batches

#: Files that may name images as their own, and the bytes of such a file that are searched for that.
REFERRING, SEARCHED = (".html", ".htm", ".xhtml", ".md"), 4 << 20
IMAGES = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp", ".gif")


def _relative(folder: str) -> Column:
    """The path of the row's file below the folder, without scheme and authority."""
    root = urlparse(folder).path.strip("/")
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.substr(path, F.instr(path, f"/{root}/") + len(root) + 2)


def _files(spark: SparkSession, folder: str, recursive: bool) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)


def listing(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, bytes, mtime) of the files in a folder, or below it too; path is relative to it.

    Sizes and times come from the listing; no file is opened. Spark's readers do not see names that begin with `.` or `_`.
    """
    x = _files(spark, folder, recursive).select(_relative(folder).alias("path"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_modification_time").alias("mtime"))
    return x if recursive else x.where(~F.contains("path", F.lit("/")))


def contents(spark: SparkSession, folder: str, suffixes: list[str], recursive: bool = True) -> DataFrame:
    """(path, content) of the files with one of the suffixes."""
    x = _files(spark, folder, recursive).select(_relative(folder).alias("path"), "content")
    return x.where(suffix_of(F.col("path")).isin(*suffixes))


def expanded(spark: SparkSession, folder: str, suffixes: list[str], recursive: bool = True) -> DataFrame:
    """(path, bytes, mtime) of what a batch takes from a folder, by lower-cased path.

    Files with one of the suffixes, but for those in hidden or .assets folders, lock files, and images that an HTML or
    Markdown file there shows: those belong to that file. Only the first SEARCHED bytes of such a file are searched.
    """
    found = batches.scan(listing(spark, folder, recursive), suffixes)
    images = found.where(suffix_of(F.col("path")).isin(*IMAGES))
    text = contents(spark, folder, list(REFERRING), recursive).select("path", F.decode(F.substring("content", 1, SEARCHED), "UTF-8").alias("content"))
    alone = batches.referenced_images(images.select("path"), batches.scan(text, list(REFERRING)))
    kept = found.where(~suffix_of(F.col("path")).isin(*IMAGES)).unionByName(images.join(alone.select("path"), "path", "left_semi").select(*found.columns))
    return kept.orderBy(F.lower("path"))
