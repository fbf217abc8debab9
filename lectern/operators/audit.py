"""What of the source is missing in the output."""

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.functions.markdown import block_text
from lectern.functions.text import squash
from lectern.sources.shared import stored

LEAST_CHARS = 8
#: Characters of the needles that one automaton holds (about a hundred bytes each), and bytes of the texts that it meets at once.
SHARD_CHARS, PART_BYTES = 1_000_000, 64 << 20


def missing(fragments: DataFrame, blocks: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """fragments (doc_id, at, fragment) whose squashed text, of `least` characters or more, is nowhere in their document's blocks.

    A document without blocks lacks all of them. Fragments and blocks of a document meet in one row, by one shuffle; null
    ids and null fragments are left out.
    """
    x = fragments.withColumn("_needle", squash(F.col("fragment"))).where(F.length("_needle") >= least)
    whole, text = F.struct(*fragments.columns), F.struct("pos", block_text().alias("t"))
    both = x.select("doc_id", F.struct(whole.alias("row"), "_needle").alias("f"), F.lit(None).cast(blocks.select(text.alias("b")).schema["b"].dataType).alias("b"))
    both = both.unionByName(blocks.select("doc_id", F.lit(None).cast(both.schema["f"].dataType).alias("f"), text.alias("b"))).where("doc_id is not null")
    met = both.groupBy("doc_id").agg(F.collect_list("f").alias("f"), squash(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda s: s["t"]), "\n")).alias("haystack"))
    lost = F.filter("f", lambda f: ~F.contains(F.col("haystack"), f["_needle"]))
    return met.select(F.explode(lost).alias("f")).select("f.row.*")


def gap_notes(gaps: DataFrame, examples: int = 3, chars: int = 20) -> DataFrame:
    """(doc_id, missing, examples): how many fragments are missing, and the start of the first ones."""
    first = F.slice(F.array_sort(F.collect_list(F.struct("at", F.substring("fragment", 1, chars).alias("f")))), 1, examples)
    return gaps.groupBy("doc_id").agg(F.count("*").alias("missing"), F.transform(first, lambda s: s["f"]).alias("examples"))


def _named(needles: list[str], batches):
    """Of the needles those that a text of the batches contains, by one pass of an automaton over each text; stops when all are found."""
    automaton = ahocorasick.Automaton()
    for n in needles:
        automaton.add_word(n, n)
    if not needles:
        return set()
    automaton.make_automaton()
    found: set[str] = set()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            if len(found) == len(needles):
                return found
            if text:
                found.update(n for _, n in automaton.iter(text))
    return found


def contained(needles: DataFrame, texts: DataFrame, shard_chars: int = SHARD_CHARS, part_bytes: int = PART_BYTES) -> DataFrame:
    """The different needles (text), none of them empty, that a text of texts (text) contains.

    Needles of up to shard_chars characters in all go to every task, which looks for all of them at once in the texts that
    it reads. More of them are cut into shards of that size, and each shard meets the texts in parts of about part_bytes.
    """
    spark = needles.sparkSession
    wanted = stored(needles.where(F.length("text") > 0).select("text").distinct(), "needles")
    chars = wanted.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    schema = pa.schema([("text", pa.string())])
    told = lambda found: pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], schema=schema)
    if chars <= shard_chars:
        held = spark.sparkContext.broadcast([r["text"] for r in wanted.collect()])
        return texts.select("text").mapInArrow(lambda batches: [told(_named(held.value, batches))], "text string").distinct()
    shards = -(-chars // shard_chars)
    size = texts.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0]
    parts = max(1, -(-size // part_bytes))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = wanted.select((F.pmod(F.xxhash64("text"), F.lit(shards))).cast("int").alias("shard"), each(parts).alias("part"), "text")
    read = texts.where(F.length("text") > 0).select("text", F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int").alias("part")).withColumn("shard", each(shards))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches([told(_named(left.column("text").to_pylist(), right.to_batches()))])

    keys = ("shard", "part")
    return asked.groupBy(*keys).cogroup(read.groupBy(*keys)).applyInArrow(meet, "text string").distinct()


def absent_everywhere(needles: DataFrame, texts: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """needles (..., text) of `least` characters or more that no text of texts (text) contains; shorter ones are left out."""
    long = needles.where(F.length("text") >= least)
    return long.join(contained(long.select("text"), texts), "text", "left_anti").select(*needles.columns)
