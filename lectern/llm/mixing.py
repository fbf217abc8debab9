"""Mixing sources to target weights by Pareto order sampling.

A document's expected number of copies is its source's rate, tilted towards short
documents. Whole copies are taken for certain. The fractions are inclusion
probabilities: documents are ranked by their random odds divided by their inclusion
odds, and a source goes down its ranking and takes each document that still fits into
what is left of its target.
"""

from pyspark.sql import DataFrame, Window, functions as F

from lectern.llm.common import partitions, table, uniform, written

WORD = r"[^\x20\x09-\x0D]+"
SHARE = 1.5
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 2.0
#: Expected copies go with size to the power of -TILT.
TILT = 0.1
#: A place in the ranking has DIGITS digits of DIGIT_BITS bits; only the rows that share all digits of a cut are ordered one by one.
DIGITS, DIGIT_BITS = 2, 7
#: How often a source goes on behind a document that does not fit.
ROUNDS = 4
#: Equal rows numbered in one task.
CHUNK = 10_000


def targets(sizes: DataFrame, share: float = SHARE, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, target from (source, source_size).

    The k-th source by code point (null last) weighs weights[k % len(weights)]. Targets share `share` of all sizes
    by weight; none is above `most` times its source's size, and what that frees is shared again by weight.

    Sources fill up in order of most * size / weight. With the sources before the i-th full, the rest would get
    (total - full) / (weights left) for each unit of weight; the level is the first of these that the i-th source can hold.
    Sums run over a table of one row for each source.
    """
    whole = Window.partitionBy(F.lit(0))
    by_name = whole.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = whole.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("total", F.sum("source_size").over(whole) * F.lit(float(share)))
    s = s.withColumn("full", F.sum("cap").over(order) - F.col("cap")).withColumn("left", F.sum("weight").over(whole) - F.sum("weight").over(order) + F.col("weight"))
    s = s.withColumn("level", (F.col("total") - F.col("full")) / F.col("left")).withColumn("holds", F.col("level") * F.col("weight") <= F.col("cap"))
    s = s.withColumn("chosen", F.min(F.when(F.col("holds"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("level")))).over(whole)["level"])
    return s.select("source", "source_size", F.when(F.col("chosen").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("chosen") * F.col("weight"))).alias("target"))


def _named(source):
    """Sources as keys that are never null."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def _counted(docs: DataFrame, chunk: int) -> DataFrame:
    """(doc_id, source, size, h, nth): a row for each row of docs; nth numbers those that are equal in doc_id, source and text.

    Equal rows are counted first, so that many of them are one row for each task, and then spread again in chunks.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    kinds = written(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("h")).groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("n")), "kinds")
    few = kinds.where(F.col("n") <= chunk).withColumn("nth", F.explode(F.expr("sequence(1L, n)")))
    many = kinds.where(F.col("n") > chunk).withColumn("lo", F.explode(F.expr(f"sequence(1L, n, {chunk}L)"))).repartition(partitions(docs.sparkSession), "h", "lo")
    many = many.withColumn("nth", F.explode(F.expr(f"sequence(lo, least(n, lo + {chunk - 1}))"))).drop("lo")
    return few.unionByName(many).drop("n")


def _first_over(ranked: DataFrame, state: DataFrame) -> DataFrame:
    """state (s, room, after) with `cut`, where the first document stands that does not fit, and `left`, the room before it.

    Looks at open documents no larger than the room, behind `after`. A cut of null means that all of them fit. The cut is
    found digit by digit from sums, so that no task holds more than a sum for each value of a digit of its source.
    """
    at = F.struct("odds", "tie")
    seen = ranked.where("open").join(state, "s").where((F.col("size") <= F.col("room")) & (F.col("after").isNull() | (at > F.col("after"))))
    cells, found = seen.withColumn("base", F.lit(0).cast("long")), None
    for digit in range(DIGITS):
        place = F.shiftright("place", DIGIT_BITS * (DIGITS - 1 - digit))
        sums = cells.groupBy("s", place.alias("cell")).agg(F.sum("size").alias("here"), F.first("room").alias("room"), F.first("after").alias("after"), F.first("base").alias("base"))
        run = Window.partitionBy("s").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("sum", F.col("base") + F.sum("here").over(run))
        over = F.min(F.when(F.col("sum") > F.col("room"), F.struct("cell", (F.col("sum") - F.col("here")).alias("base"))))
        level = written(sums.groupBy("s").agg(F.first("room").alias("room"), F.first("after").alias("after"), over.alias("over")), "cell")
        found = level if found is None else found
        cells = seen.join(level.where("over is not null").select("s", "over.*"), "s").where(place == F.col("cell")).drop("cell")
    run = Window.partitionBy("s").orderBy("odds", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = cells.withColumn("sum", F.col("base") + F.sum("size").over(run)).where("sum > room")
    cut = rows.groupBy("s").agg(F.min(F.struct(at.alias("at"), (F.col("room") - F.col("sum") + F.col("size")).alias("left"))).alias("c"))
    return found.select("s", "room", "after").join(cut, "s", "left").select("s", "room", "after", F.col("c.at").alias("cut"), F.col("c.left").alias("left"))


def mix(docs: DataFrame, share: float = SHARE, weights: tuple = WEIGHTS, most: float = MOST, tilt: float = TILT, seed: int = 0, rounds: int = ROUNDS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, h, nth for every row of docs; `copies` (0 to `most`) is how often the mix takes it.

    Size is the number of words; a null text has none. Documents without words get no copies. A source whose target is
    `most` times its size takes each document `most` times. Any other takes the whole copies and then, down the ranking,
    each document that fits into the room that is left, stopping behind the `rounds`-th that does not fit.
    Chance comes from a hash of doc_id, text and, among rows equal in doc_id, source and text, the number nth, so that
    reruns agree and equal rows are drawn one by one. h is a hash of the text. A null source is a source of its own.
    An empty table gives no rows. Other columns of docs are left out.
    """
    unit = [F.col("doc_id"), F.col("h"), F.col("nth")]
    rows = _counted(docs, chunk).select("doc_id", "source", _named(F.col("source")).alias("s"), "size", "h", "nth", uniform(*unit, seed=seed).alias("u"), F.xxhash64(F.lit(seed + 1), *unit).alias("tie"))
    rows = written(rows, "mix")
    tilted = F.when(F.col("size") > 0, F.pow(F.col("size").cast("double"), F.lit(1.0 - tilt))).otherwise(0.0)
    per = rows.groupBy("source", "s").agg(F.sum("size").alias("source_size"), F.sum(tilted).alias("tilted"))
    goal = targets(per.select("source", "source_size"), share, weights, most).withColumn("s", _named(F.col("source"))).drop("source")
    goal = written(goal.join(per.select("s", "tilted"), "s"), "goal")
    x = rows.join(goal, "s")
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("tilted") * F.pow(F.col("size").cast("double"), F.lit(-tilt))).otherwise(0.0)
    full = F.col("target") >= F.col("source_size") * F.lit(most * (1 - 1e-9))
    x = x.withColumn("rate", F.when(full & (F.col("size") > 0), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), rate)))
    x = x.withColumn("whole", F.when(F.col("rate") >= most, F.lit(int(most))).otherwise(F.floor("rate")).cast("long"))
    x = x.withColumn("p", F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), F.col("rate") - F.col("whole"))))
    # random odds over inclusion odds, on a logistic scale so that places are bounded
    x = x.withColumn("odds", F.log(F.col("u") / (1 - F.col("u"))) - F.log(F.col("p") / (1 - F.col("p"))))
    x = x.withColumn("place", F.least(F.lit((1 << DIGITS * DIGIT_BITS) - 1), F.floor(F.lit(float(1 << DIGITS * DIGIT_BITS)) / (1 + F.exp(-F.col("odds")))).cast("int")))
    x = x.withColumn("open", (F.col("size") > 0) & (F.col("whole") < most))
    ranked = written(x.select("doc_id", "source", "s", "size", "source_size", "target", "h", "nth", "whole", "odds", "tie", "place", "open"), "ranked")
    state = ranked.groupBy("s").agg((F.first("target") - F.sum(F.col("size") * F.col("whole"))).alias("room"))
    # written, so that its size is known and the ranked rows stay where they are
    state = written(state.where("room >= 1").withColumn("after", F.lit(None).cast("struct<odds double, tie bigint>")), "state")
    steps = None
    for _ in range(rounds):
        step = written(_first_over(ranked, state), "step")
        steps = step if steps is None else steps.unionByName(step)
        state = step.where("cut is not null and left >= 1").select("s", F.col("left").alias("room"), F.col("cut").alias("after"))
        if state.isEmpty():
            break
    steps = steps.groupBy("s").agg(F.collect_list(F.struct("room", "after", "cut")).alias("steps"))  # at most `rounds` for each source
    at = F.struct("odds", "tie")
    taken = F.exists("steps", lambda t: (F.col("size") <= t["room"]) & (t["after"].isNull() | (at > t["after"])) & (t["cut"].isNull() | (at < t["cut"])))
    more = F.when(F.col("open") & F.coalesce(taken, F.lit(False)), 1).otherwise(0)
    return ranked.join(steps, "s", "left").select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + more).cast("long").alias("copies"), "h", "nth")


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """docs as the mix takes them: rows without copies go, rows with several repeat. Columns stay as they are.

    Rows equal in doc_id, source and text share their copies as evenly as whole numbers allow; where that leaves a rest,
    they are numbered in lanes, so that many of them are spread over tasks.
    """
    key = ["_i", "_n", "_s", "_h"]
    name = lambda h: [F.coalesce("doc_id", F.lit(0)).cast("long").alias("_i"), F.col("doc_id").isNull().alias("_n"), _named(F.col("source")).alias("_s"), h.alias("_h")]
    sums = mix(docs, **parameters).select(*name(F.col("h")), "copies").groupBy(*key).agg(F.sum("copies").alias("_sum"), F.count("*").alias("_rows"))
    sums = written(sums.where("_sum > 0").select(*key, F.expr("_sum div _rows").alias("_each"), (F.col("_sum") % F.col("_rows")).alias("_rest")), "copies")
    x = docs.select("*", *name(F.xxhash64("text"))).join(sums, key)
    out = x.where("_rest = 0").withColumn("_times", F.col("_each"))
    if not sums.where("_rest > 0").isEmpty():
        lanes = max(64, partitions(docs.sparkSession))
        laned = written(x.where("_rest > 0").withColumn("_lane", F.pmod(F.monotonically_increasing_id(), F.lit(lanes))), "laned")
        before = Window.partitionBy(*key).orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
        ahead = laned.groupBy(*key, "_lane").count().withColumn("_ahead", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
        nth = laned.withColumn("_nth", F.row_number().over(Window.partitionBy(*key, "_lane").orderBy("_each"))).join(ahead, [*key, "_lane"])
        odd = nth.withColumn("_times", F.col("_each") + F.when(F.col("_ahead") + F.col("_nth") <= F.col("_rest"), 1).otherwise(0))
        out = out.unionByName(odd.select(*out.columns))
    return out.where("_times > 0").withColumn("_r", F.explode(F.expr("sequence(1L, _times)"))).select(*docs.columns)


#: Targets alone, as SQL has them; the weights above repeat and the share is 150 %.
TARGETS_ORACLE = r"""
with recursive sizes as (
  select source, sum(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0))::bigint as source_size from documents group by source
), weighed as (
  select *, ([5.0, 2.0, 1.0])[((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1)::int]::double as weight, 2.0::double * source_size as cap from sizes
), filled as (
  select 0 as i, source, source_size, weight, cap, false as held from weighed
  union all
  select i + 1, source, source_size, weight, cap, held or weight * (1.5::double * (sum(source_size) over ()) - coalesce(sum(cap) filter (where held) over (), 0)) / (sum(weight) filter (where not held) over ()) > cap
  from filled where i < (select count(*) from sizes)
), last as (select * from filled where i = (select max(i) from filled))
select source, source_size,
  case when held then cap else weight * (1.5::double * (sum(source_size) over ()) - coalesce(sum(cap) filter (where held) over (), 0)) / (sum(weight) filter (where not held) over ()) end as target
from last
"""


def targets_query(spark, sf_dir):
    """Each source's size and target."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return targets(table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(size).alias("source_size")))


def query(spark, sf_dir):
    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
