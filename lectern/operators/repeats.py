"""Texts that repeat themselves, and echoes of one track in another."""

from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from lectern.functions.text import norm_text
from lectern.operators.intervals import BUCKET, interval_pairs

LEAST_COUNT = 8
#: Characters of texts whose n-grams are counted at once; a longer text goes by itself.
CHARACTERS = 1 << 20
#: Marks that are stripped from a phrase (fixed value).
PUNCTUATION = ",。、?!;:.!?;: "


def _counted(texts: list[str], sizes: range) -> list[list[dict]]:
    """most_frequent_grams() of some texts: n-grams are numbers, made of that of the n-gram one shorter and the next character."""
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    row = np.repeat(np.arange(len(texts)), lengths)
    known, letter = np.unique(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), return_inverse=True)
    gram, at = row * len(known) + letter, np.arange(len(letter))
    out: list[list[dict]] = [[] for _ in texts]
    for n in range(2, max(sizes) + 1):
        at = at[at + n <= ends[row[at]]]
        _, first, number, count = np.unique(gram[at] * len(known) + letter[at + n - 1], return_index=True, return_inverse=True, return_counts=True)
        gram[at] = number
        if n in sizes:
            start = at[first]
            order = np.lexsort((start, -count, row[start]))
            best = order[np.diff(row[start][order], prepend=-1) > 0]
            for r, s, c in zip(row[start[best]].tolist(), start[best].tolist(), count[best].tolist()):
                s -= int(ends[r] - lengths[r])
                out[r].append({"n": n, "phrase": texts[r][s : s + n], "count": c})
    return out


def most_frequent_grams(sizes: range = range(2, 7)):
    """[(n, phrase, count)] of a text: for each length (2 or more) the n-gram that comes most often, the first seen of equals; overlaps count.

    A text's n-grams are counted where the text is, and only the most frequent ones leave the task.
    """

    @pandas_udf("array<struct<n:int,phrase:string,count:long>>")
    def of(texts: pd.Series) -> pd.Series:
        out, some, size = [], [], 0
        for t in texts.fillna(""):
            some.append(t)
            size += len(t)
            if size >= CHARACTERS:
                out += _counted(some, sizes)
                some, size = [], 0
        return pd.Series(out + _counted(some, sizes), index=texts.index, dtype=object)

    return of


def ngram_coverage(texts: DataFrame, text: Column, sizes: range = range(2, 7)) -> DataFrame:
    """(doc_id, n, phrase, count): most_frequent_grams() of each text, a row for each length."""
    return texts.select("doc_id", F.explode(most_frequent_grams(sizes)(text)).alias("g")).select("doc_id", "g.*")


def best_phrase(grams: Column, least: int = LEAST_COUNT) -> Column:
    """(phrase, count): of most_frequent_grams() the one with the greatest count * n, the shorter of equals, if it comes `least` times; else null."""
    often = F.filter(grams, lambda g: g["count"] >= least)
    best = F.array_max(F.transform(often, lambda g: F.struct((g["count"] * g["n"]).alias("covered"), (-g["n"]).alias("short"), g["phrase"].alias("phrase"), g["count"].alias("count"))))
    return F.when(best.isNotNull(), F.struct(best["phrase"].alias("phrase"), best["count"].alias("count")))


def best_phrases(texts: DataFrame, text: Column) -> DataFrame:
    """texts with `best` (see best_phrase); those without one have no row."""
    # a filter on the result would be pushed down and count all n-grams a second time
    return texts.select("*", F.explode(F.array_compact(F.array(best_phrase(most_frequent_grams()(text))))).alias("best"))


def natural_phrase(text: Column, phrase: Column) -> Column:
    """The phrase at its shortest period, turned so that it comes doubled in the text and does not start with a mark.

    Of several turns one that ends with a mark is preferred, then the one that comes doubled first; without any the period
    stands as it is. Marks at both ends go. An empty phrase stays empty.
    """
    n = F.length(phrase)
    period = F.get(F.filter(F.sequence(F.lit(1), n), lambda k: F.substr(phrase, k + 1) == F.substr(phrase, F.lit(1), n - k)), F.lit(0))
    unit = F.substr(phrase, F.lit(1), period)
    turns = F.transform(F.sequence(F.lit(0), period - 1), lambda i: F.concat(F.substr(unit, i + 1), F.substr(unit, F.lit(1), i)))
    mark = lambda c: F.contains(F.lit(PUNCTUATION), c)
    # the least of (no mark at the end, place, turn) among the turns that come doubled
    ranked = F.transform(turns, lambda t: F.struct((~mark(F.right(t, F.lit(1)))).alias("open"), F.instr(F.coalesce(text, F.lit("")), F.concat(t, t)).alias("at"), t.alias("turn")))
    best = F.array_min(F.filter(ranked, lambda r: (r["at"] > 0) & ~mark(F.left(r["turn"], F.lit(1)))))
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit("")).otherwise(F.btrim(F.coalesce(best["turn"], unit), F.lit(PUNCTUATION)))


def repeated_phrases(texts: DataFrame) -> DataFrame:
    """(doc_id, phrase) of texts (doc_id, text) with a phrase that repeats often; others have no row."""
    return best_phrases(texts, F.col("text")).select("doc_id", natural_phrase(F.col("text"), F.col("best.phrase")).alias("phrase"))


def match_ratio(least: float):
    """Ratcliff-Obershelp likeness of two texts, or an upper bound of it that is below `least` already."""

    @pandas_udf(DoubleType())
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            # letters that both have, as often as both have them, bound the letters of common blocks
            shared = 2 * sum((Counter(x) & Counter(y)).values()) / (len(x) + len(y)) if x and y else 0.0
            out.append(SequenceMatcher(None, x, y).ratio() if shared >= least and shared else shared)
        return pd.Series(out)

    return of


def echoes(mic: DataFrame, system: DataFrame, tolerance: float = 2.0, ratio: float = 0.66, least: int = 4, bucket: float = BUCKET) -> DataFrame:
    """(rec_id, seq) of mic segments that repeat what the system track says within `tolerance` seconds.

    Both: rec_id, seq, start, end, text. Texts are compared without marks, spaces and case: one segment that is `ratio` alike
    (if either has `least` characters), or a text of `least` characters within all nearby ones put together in order of
    start. An empty text is no echo.
    """
    a = mic.select("rec_id", "seq", "start", "end", norm_text(F.col("text")).alias("text")).where("text <> ''")
    b = system.select("rec_id", "seq", "start", "end", norm_text(F.col("text")).alias("text"))
    near = interval_pairs(a, b, bucket, tolerance, touching=True)
    long = (F.length("l_text") >= least) | (F.length("r_text") >= least)
    # a cheap bound first: the ratio cannot pass 2 * shorter / both
    bound = 2 * F.least(F.length("l_text"), F.length("r_text")) / (F.length("l_text") + F.length("r_text"))
    alike = near.where(long & (bound >= ratio)).withColumn("m", match_ratio(ratio)("l_text", "r_text")).where(F.col("m") >= ratio).select("rec_id", F.col("l_seq").alias("seq"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_start", "r_seq", "r_text"))), lambda s: s["r_text"]), "")
    inside = near.groupBy("rec_id", "l_seq").agg(F.first("l_text").alias("mine"), said.alias("said")).where((F.length("mine") >= least) & F.contains("said", "mine")).select("rec_id", F.col("l_seq").alias("seq"))
    return alike.union(inside).distinct()


def without_echoes(mic: DataFrame, system: DataFrame, **limits) -> DataFrame:
    return mic.join(echoes(mic, system, **limits), ["rec_id", "seq"], "left_anti")
