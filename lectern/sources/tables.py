"""The driver's tables and the recordings that queries make of them."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt to as many tasks as shuffles have: a small file is one task, however much is made of its rows."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def seconds(ts: str = "ts") -> Column:
    """Seconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts}) / 1000000.0D")


def segments(spark, sf_dir, kind: str = "view", length: float = 1800.0, *more: str) -> DataFrame:
    """(rec_id, seq, start, end, text, more): events of a kind as segments of `length` seconds; the user is the recording."""
    s = seconds()
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).select(F.col("user_id").alias("rec_id"), F.col("event_id").alias("seq"), s.alias("start"), (s + length).alias("end"), F.col("props").alias("text"), *more)


def turns(spark, sf_dir, kind: str = "purchase", length: float = 1800.0) -> DataFrame:
    """(rec_id, idx, start, end, speaker, conf) of events; the speaker is event_id % 5, conf is value / 100, 0 for each seventh."""
    x = segments(spark, sf_dir, kind, length, "value").withColumnRenamed("seq", "idx")
    return x.select("rec_id", "idx", "start", "end", (F.col("idx") % 5).cast("int").alias("speaker"), F.when(F.col("idx") % 7 == 0, 0.0).otherwise(F.col("value") / 100).alias("conf"))


def spoken(spark, sf_dir) -> DataFrame:
    """(rec_id, seq, start, end, speaker, text) of all events: the type is the speaker, errors are markers, clicks unknown."""
    from lectern.functions.labels import MARKER_PREFIX

    s = seconds()
    kind = F.col("event_type")
    speaker = F.when(kind == "click", -1).when(kind == "view", 0).when(kind == "signup", 1).when(kind == "purchase", 2).otherwise(3)
    text = F.when(kind == "error", F.concat(F.lit(MARKER_PREFIX), F.col("event_id").cast("string"), F.lit(")"))).otherwise(F.concat(kind, F.col("event_id").cast("string"), F.lit(" ")))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("rec_id"), F.col("event_id").alias("seq"), s.alias("start"), (s + 1 + F.col("event_id") % 90).alias("end"), speaker.cast("int").alias("speaker"), text.alias("text"))


def voices(spark, sf_dir) -> DataFrame:
    """(seq, name, vec): embeddings as voice samples, the label as the name."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq"), F.concat(F.lit("n"), F.col("label").cast("string")).alias("name"), F.col("embedding").alias("vec"))
