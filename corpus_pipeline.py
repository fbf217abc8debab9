"""A training corpus from documents: language, near copies, repeated passages, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and is written as Parquet before the next one reads it.
"""

from pyspark.sql import functions as F

from lectern.llm import bpe, language, mixing, simhash, suffixes
from lectern.llm.common import table, written

#: Bytes of a repeated passage: over 50 words have more, unless they are of two or three letters on average.
PASSAGE = 200
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark, docs, sf_dir):
    """Documents whose text has a language go on with the predicted one as lang; those it calls `und` go."""
    kept = language.identify(docs, docs).where(F.col("lang_pred") != language.UNKNOWN)
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark, docs, sf_dir):
    """One document of each SimHash component: the one with the smallest doc_id, by digest of equal ids; null ids come last.

    A document is told by its id, the digest of its text and a hash of its other columns, so that one of several with a
    null or repeated id neither brings others along nor takes their place.
    """
    key = ["_none", "_id", "_digest", "_rest"]
    none = F.col("doc_id").isNull()
    told = docs.select(*COLUMNS, none.alias("_none"), F.when(none, 0).otherwise(F.col("doc_id")).cast("long").alias("_id"), F.md5(F.coalesce("text", F.lit(""))).alias("_digest"), F.xxhash64(F.col("text").isNull(), "lang", "source", "n_chars").alias("_rest"))
    found = simhash.near_duplicates(told, carry=("_digest", "_rest"))
    lost = F.col("doc_id").isNull()
    first = found.groupBy("root").agg(F.min(F.struct(lost.alias("_none"), F.when(lost, 0).otherwise(F.col("doc_id")).cast("long").alias("_id"), "_digest", "_rest")).alias("k"))
    # equal rows meet before the join, so that a hot one is one row for each task
    return told.dropDuplicates(key).join(first.select("k.*"), key, "left_semi").select(*COLUMNS)


def suffix_dedup(spark, docs, sf_dir):
    """Texts without the passages that repeat; documents of which nothing is left go."""
    left = suffixes.remove_repeats(docs, PASSAGE, text=True).withColumn("text", F.col("kept_text"))
    return left.where("text <> ''").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark, docs, sf_dir):
    """Documents as often as the mixture takes them."""
    return mixing.mixed(docs).select(*COLUMNS)


def encode(spark, docs, sf_dir):
    """Token ids of each document, and the digest of their decoding."""
    return bpe.digests(bpe.encode_documents(docs))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: The stages learn a model, hash and sort suffixes; SQL has no form of them.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    name, stage = STAGES[-1]
    return written(stage(spark, docs, sf_dir), name)
