"""Lists of names: adding, removing, renaming, ordering, choices."""

from pyspark.sql import DataFrame, Window, functions as F


def first_kept(names: DataFrame) -> DataFrame:
    """(pos, name) of names (pos, name) trimmed, without blanks and repetitions; each keeps its first place."""
    x = names.select("pos", F.trim("name").alias("name")).where("name <> ''")
    return x.groupBy("name").agg(F.min("pos").alias("pos")).select("pos", "name")


def add(roster: DataFrame, new: DataFrame) -> DataFrame:
    """roster (pos, name) with the names of new (pos, name) that it lacks behind it."""
    last = roster.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("last"))  # one row
    fresh = first_kept(new).join(roster.select("name"), "name", "left_anti").join(F.broadcast(last), F.lit(True))
    place = F.row_number().over(Window.partitionBy("last").orderBy("pos"))
    return roster.select("pos", "name").unionByName(fresh.select((F.col("last") + place).alias("pos"), "name"))


def remove(roster: DataFrame, name: str) -> DataFrame:
    return roster.where(F.col("name") != name)


def rename(roster: DataFrame, old: str, new: str) -> DataFrame:
    """roster with `old` as `new` in its place; if both were there the first place stays."""
    return first_kept(roster.withColumn("name", F.when(F.col("name") == old, F.lit(new)).otherwise(F.col("name"))))


def in_roster_order(names: DataFrame, roster: DataFrame) -> DataFrame:
    """(place, name): distinct names by their place in the roster; those it lacks come last, by name."""
    x = names.select("name").distinct().join(roster.select("name", "pos"), "name", "left")
    return x.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("pos").asc_nulls_last(), "name")) - 1).alias("place"), "name")


def choices(filled: DataFrame, rivals: DataFrame, others: DataFrame) -> DataFrame:
    """(speaker, place, name): names to choose from for each speaker: filled in, then rivals, then all others, each once.

    filled, rivals: speaker, pos, name; others: pos, name.
    """
    speakers = filled.select("speaker").union(rivals.select("speaker")).distinct()
    rest = speakers.select("speaker", F.lit(1).alias("k")).join(others.select(F.lit(1).alias("k"), "pos", "name"), "k").select("speaker", "pos", "name")
    parts = [d.select("speaker", "name", F.struct(F.lit(i).alias("i"), F.col("pos").cast("long").alias("pos")).alias("at")) for i, d in enumerate((filled, rivals, rest))]
    x = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("trim(name) <> ''").groupBy("speaker", "name").agg(F.min("at").alias("at"))
    return x.select("speaker", (F.row_number().over(Window.partitionBy("speaker").orderBy("at", "name")) - 1).alias("place"), "name")


def library_summary(library: DataFrame, roster: DataFrame, shown: int = 3) -> DataFrame:
    """One row (samples, names, orphans, preview): sizes, and the first names that the roster lacks."""
    n = library.agg(F.count("*").alias("samples"), F.countDistinct("name").alias("names"))
    lone = library.select("name").distinct().join(roster.select("name"), "name", "left_anti")
    first = lone.orderBy("name").limit(shown).agg(F.sort_array(F.collect_list("name")).alias("preview"))
    return n.join(lone.agg(F.count("*").alias("orphans")), F.lit(True)).join(first, F.lit(True))  # one row each


def stage_progress(stages: DataFrame) -> DataFrame:
    """(job, done): a job is as far as its slowest stage."""
    return stages.groupBy("job").agg(F.min("done").alias("done"))
