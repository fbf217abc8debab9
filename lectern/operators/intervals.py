"""Joins of time intervals within a recording.

Rows are (rec_id, start, end, ...) with times in seconds. Interval pairs meet on
(rec_id, bucket): each interval lies in the time buckets that it touches, and a pair is
taken only in the first bucket that both touch, so that it comes once and a long
recording is spread over many tasks. Nearest turns come from running extremes over
both tables in order, a part of the recording in a task.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.operators.islands import running_extremes

#: Seconds in a bucket; about the length of the intervals that are joined.
BUCKET = 1800.0
#: Lengths of buckets, each four times the one before, that blocks of different lengths lie in.
LENGTHS = 6
#: Seconds in a part of a long recording whose rows are sorted in one task.
PART = 604800.0


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Length that two intervals share; 0 if they do not meet."""
    return F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def interval_pairs(left: DataFrame, right: DataFrame, bucket: float = BUCKET, pad: float = 0.0, touching: bool = False) -> DataFrame:
    """Pairs of one recording with a positive overlap (or, if touching, with ends that meet), after padding left by `pad`.

    Columns of left come as l_*, of right as r_*, besides rec_id. Null or reversed times meet nothing.
    """
    lefts = left.select("rec_id", *[F.col(c).alias(f"l_{c}") for c in left.columns if c != "rec_id"])
    rights = right.select("rec_id", *[F.col(c).alias(f"r_{c}") for c in right.columns if c != "rec_id"])
    at = lambda t: F.floor(t / bucket).cast("long")
    spread = lambda df, a, b, p: df.where(F.col(b) >= F.col(a)).withColumn(f"{p}first", at(F.col(a))).withColumn("bucket", F.explode(F.sequence(at(F.col(a)), at(F.col(b)))))
    lefts = spread(lefts.withColumns({"l_lo": F.col("l_start") - pad, "l_hi": F.col("l_end") + pad}), "l_lo", "l_hi", "l_")
    rights = spread(rights, "r_start", "r_end", "r_")
    meet = (F.col("l_lo") <= F.col("r_end")) & (F.col("r_start") <= F.col("l_hi")) if touching else (F.col("l_lo") < F.col("r_end")) & (F.col("r_start") < F.col("l_hi"))
    pairs = lefts.join(rights, ["rec_id", "bucket"]).where(meet & (F.col("bucket") == F.greatest("l_first", "r_first")))
    return pairs.drop("bucket", "l_first", "r_first", "l_lo", "l_hi")


def points_within(blocks: DataFrame, points: DataFrame, bucket: float = BUCKET) -> DataFrame:
    """Pairs of blocks (rec_id, start, end, ...) and points (rec_id, at, ...) with start <= at < end; columns as l_* and r_*.

    A block lies in buckets about as long as itself, so in two or three of them however long it is; a point is dealt to
    its bucket of each length. Only blocks above the longest bucket (3 weeks with the default) lie in more.
    """
    sizes = [bucket * 4**k for k in range(LENGTHS)]
    length = F.col("end") - F.col("start")
    level = sum((F.when(length > x, 1).otherwise(0) for x in sizes[:-1]), F.lit(0))
    at = lambda t, size: F.floor(t / size).cast("long")
    size = F.get(F.array(*map(F.lit, sizes)), F.col("level"))
    lefts = blocks.where(length > 0).withColumn("level", level).withColumn("bucket", F.explode(F.sequence(at(F.col("start"), size), at(F.col("end"), size))))
    lefts = lefts.select("rec_id", "level", "bucket", *[F.col(c).alias(f"l_{c}") for c in blocks.columns if c != "rec_id"])
    rights = points.where("at is not null").select("rec_id", F.posexplode(F.array(*[at(F.col("at"), x) for x in sizes])).alias("level", "bucket"), *[F.col(c).alias(f"r_{c}") for c in points.columns if c != "rec_id"])
    return lefts.join(rights, ["rec_id", "level", "bucket"]).where("r_at >= l_start and r_at < l_end").drop("level", "bucket")


def assign_speakers(segments: DataFrame, turns: DataFrame, bucket: float = BUCKET) -> DataFrame:
    """segments (rec_id, seq, start, end, ...) with a column `speaker` from turns (rec_id, idx, start, end, speaker).

    The turn with the longest positive overlap, the smallest idx among equals. Without overlap the turn nearest to the
    segment's middle: of those that start before it the one that ends last, or the first that starts at or after it; ties
    go to the smaller idx. Speaker 0 if the recording has no turns. (rec_id, seq) must be unique.
    """
    pairs = interval_pairs(segments.select("rec_id", "seq", "start", "end"), turns.select("rec_id", "idx", "start", "end", "speaker"), bucket)
    shared = overlap(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end"))
    best = pairs.where(shared > 0).groupBy("rec_id", F.col("l_seq").alias("seq")).agg(F.max(F.struct(shared.alias("o"), (-F.col("r_idx")).alias("i"), F.col("r_speaker").alias("s")))["s"].alias("by_overlap"))
    x = segments.join(best, ["rec_id", "seq"], "left")
    lone = x.where("by_overlap is null").select("rec_id", "seq", ((F.col("start") + F.col("end")) / 2).alias("at"), F.lit(0).alias("side"), F.lit(None).cast(_turn(turns)).alias("t"))
    turn = F.struct(F.col("end").alias("e"), (-F.col("idx")).alias("i"), F.col("speaker").alias("s"), F.col("start").alias("b"))
    both = lone.unionByName(turns.select("rec_id", F.lit(None).cast(segments.schema["seq"].dataType).alias("seq"), F.col("start").alias("at"), F.lit(1).alias("side"), turn.alias("t")))
    day = F.floor(F.col("at") / PART)
    first = F.struct(F.col("t.b").alias("b"), (-F.col("t.i")).alias("i"), F.col("t.s").alias("s"))
    right = F.when(F.col("t").isNotNull(), first)
    near = running_extremes(both, ["rec_id"], day, left=(F.col("t"), ["at", "side"], F.max, False), right=(right, [F.desc("at"), F.desc("side")], F.min, True)).where("side = 0")
    before = F.when(F.col("left").isNotNull(), F.struct((F.col("at") - F.col("left.e")).alias("d"), (-F.col("left.i")).alias("i"), F.col("left.s").alias("s")))
    after = F.when(F.col("right").isNotNull(), F.struct((F.col("right.b") - F.col("at")).alias("d"), F.col("right.i").alias("i"), F.col("right.s").alias("s")))
    near = near.select("rec_id", "seq", F.least(before, after)["s"].alias("by_distance"))
    x = x.join(near, ["rec_id", "seq"], "left")
    return x.select(*segments.columns, F.coalesce("by_overlap", "by_distance", F.lit(0)).cast("int").alias("speaker"))


def _turn(turns: DataFrame) -> str:
    kinds = dict(turns.dtypes)
    return f"struct<e:{kinds['end']},i:{kinds['idx']},s:{kinds['speaker']},b:{kinds['start']}>"


def cohesion(blocks: DataFrame, turns: DataFrame, bucket: float = BUCKET) -> DataFrame:
    """blocks (rec_id, seq, start, end, ...) with `cohesion`: the mean conf of turns by overlap; conf 0 is left out, 0 if none is left."""
    pairs = interval_pairs(blocks.select("rec_id", "seq", "start", "end"), turns.select("rec_id", "start", "end", "conf"), bucket).where("r_conf <> 0")
    o = overlap(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end"))
    mean = pairs.groupBy("rec_id", F.col("l_seq").alias("seq")).agg(F.try_divide(F.sum(o * F.col("r_conf")), F.sum(o)).alias("cohesion"))
    return blocks.join(mean, ["rec_id", "seq"], "left").select(*blocks.columns, F.coalesce("cohesion", F.lit(0.0)).alias("cohesion"))


def block_bounds(blocks: DataFrame, tail: float = 30.0) -> DataFrame:
    """blocks (rec_id, seq, start, ...) with `end`: the next block's start, or `tail` seconds after the last one's."""
    following = F.lead("start").over(Window.partitionBy("rec_id").orderBy("start", "seq"))
    return blocks.withColumn("end", F.coalesce(following, F.col("start") + tail))


def label_blocks(blocks: DataFrame, turns: DataFrame, bucket: float = BUCKET) -> DataFrame:
    """blocks (rec_id, seq, start, end, ...) with `label`: the speaker who talks longest in turns whose middle lies in the block.

    Ties go to the speaker seen first; a block without turns has the label of the one before it, 0 at the start.
    """
    middles = turns.select("rec_id", "idx", "speaker", (F.col("end") - F.col("start")).alias("seconds"), ((F.col("start") + F.col("end")) / 2).alias("at"))
    pairs = points_within(blocks.select("rec_id", "seq", "start", "end"), middles, bucket)
    sums = pairs.groupBy("rec_id", F.col("l_seq").alias("seq"), F.col("r_speaker").alias("s")).agg(F.sum("r_seconds").alias("n"), F.min("r_idx").alias("i"))
    own = sums.groupBy("rec_id", "seq").agg(F.max(F.struct("n", (-F.col("i")).alias("i"), "s"))["s"].alias("own"))
    x = blocks.join(own, ["rec_id", "seq"], "left")
    known = F.when(F.col("own").isNotNull(), F.struct("start", "seq", "own"))
    x = running_extremes(x, ["rec_id"], F.floor(F.col("start") / PART), _last=(known, ["start", "seq"], F.max, False))
    x = x.withColumn("label", F.coalesce("_last.own", F.lit(0)))
    return x.select(*blocks.columns, "label")


def block_vectors(spans: DataFrame, blocks: DataFrame, least_weight: float = 0.01, bucket: float = BUCKET) -> DataFrame:
    """blocks (rec_id, seq, start, end) with `vector`: the unit sum, by length, of the span vectors whose middle lies in the block.

    Spans are (rec_id, start, end, vec); those without a vector are left out. A block without vectors has a null vector.
    """
    from lectern.functions.vectors import normalized, weighted_sum

    m = (F.col("start") + F.col("end")) / 2
    points = spans.where("vec is not null").select("rec_id", "vec", F.greatest(F.col("end") - F.col("start"), F.lit(least_weight)).alias("w"), m.alias("start"), m.alias("end"))
    pairs = interval_pairs(blocks.select("rec_id", "seq", "start", "end"), points, bucket, touching=True).where("r_start >= l_start and r_start < l_end")
    sums = weighted_sum(pairs.withColumnsRenamed({"l_seq": "seq"}), ["rec_id", "seq"], "r_vec", F.col("r_w"))
    return blocks.join(sums.withColumn("vector", normalized(F.col("vector"), 1e-12)), ["rec_id", "seq"], "left").select(*blocks.columns, "vector")


def as_of(rows: DataFrame, keys: list[str], order: list, value: Column, name: str) -> DataFrame:
    """rows with the last non-null `value` up to each row."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
