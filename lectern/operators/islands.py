"""Gaps and islands, renumbering and windows over ordered rows."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions.text import is_marker


def islands(rows: DataFrame, keys: list[str], order: list, starts: Column, name: str = "island") -> DataFrame:
    """rows with a number that goes up at each row where `starts` is true (null counts as true); it may look back with lag()."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_new", F.coalesce(starts, F.lit(True)).cast("int")).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def sliced_islands(rows: DataFrame, keys: list[str], order: list[str], compare: list[str], starts, part: Column, name: str = "island") -> DataFrame:
    """As islands(), with the rows of a key spread over parts, for keys that hold a large share of all rows.

    part must rise with order within a key (a day, a chunk number). starts(previous) makes the condition from a struct of
    the row before with the columns `compare`, null for the first row of a key. Parts are numbered side by side; what a
    part needs from the ones before it, its last row and its count, comes from a table with a row for each part.
    """
    x = rows.withColumn("_part", part)
    within = Window.partitionBy(*keys, "_part").orderBy(*order)
    over_parts = Window.partitionBy(*keys).orderBy("_part")
    last = x.groupBy(*keys, "_part").agg(F.max_by(F.struct(*compare), F.struct(*order)).alias("_last"))
    x = x.join(last.select(*keys, "_part", F.lag("_last").over(over_parts).alias("_carry")), [*keys, "_part"])
    x = x.withColumn("_before", F.coalesce(F.lag(F.struct(*compare)).over(within), "_carry"))
    x = x.withColumn("_new", F.coalesce(starts(F.col("_before")), F.lit(True)).cast("int")).drop("_before", "_carry")
    sums = x.groupBy(*keys, "_part").agg(F.sum("_new").alias("_sum"))
    offsets = sums.select(*keys, "_part", (F.sum("_sum").over(over_parts.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_sum")).alias("_offset"))
    x = x.join(offsets, [*keys, "_part"])
    running = F.sum("_new").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return x.withColumn(name, running + F.col("_offset")).drop("_new", "_part", "_offset")


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: str, part: Column, name: str = "running") -> DataFrame:
    """rows with the sum of `value` up to each row of its key; a key's rows are spread over parts, which rise with order.

    Each part is summed by itself; what came before it is a running sum over a table with a row for each part.
    """
    x = rows.withColumn("_part", part)
    sums = x.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_ahead"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_part").eqNullSafe(F.col("_p"))]
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("_own", F.sum(value).over(within))
    for condition in same[1:]:
        same[0] = same[0] & condition
    return x.join(sums, same[0]).withColumn(name, F.col("_own") + F.col("_ahead")).select(*rows.columns, name)


def running_extremes(rows: DataFrame, keys: list[str], part: Column, **wanted) -> DataFrame:
    """rows with a column for each of `wanted`, name=(value, order, how, backwards): the greatest (how=F.max) or least (F.min)
    value up to each row of its key, from the end if backwards; null values are skipped.

    A key's rows are spread over parts, which rise with order, or fall with it if backwards. What the parts before a part
    hold comes from a table with a row for each part.
    """
    x = rows.withColumn("_part", part).withColumns({f"_v_{n}": value for n, (value, *_) in wanted.items()})
    tops = x.groupBy(*keys, "_part").agg(*[how(f"_v_{n}").alias(f"_c_{n}") for n, (_, _, how, _) in wanted.items()])
    ahead = lambda back: Window.partitionBy(*keys).orderBy(F.desc("_part") if back else F.asc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, "_part", *[how(f"_c_{n}").over(ahead(back)).alias(f"_c_{n}") for n, (_, _, how, back) in wanted.items()])
    x = x.join(tops, [*keys, "_part"], "left")
    for n, (_, order, how, _) in wanted.items():
        within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        x = x.withColumn(n, (F.greatest if how is F.max else F.least)(how(f"_v_{n}").over(within), f"_c_{n}"))
    return x.select(*rows.columns, *wanted)


def element_at_place(rows: DataFrame, keys: list[str], value: str, place, name: str) -> DataFrame:
    """(keys, name): the element at place(n), from 0, of each key's n values in order; null values are left out.

    Equal values are counted first, so that a key is a row for each different value, of which the shuffle keeps none in an array.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys)
    up_to = w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = counts.withColumns({"_upto": F.sum("_c").over(up_to), "_n": F.sum("_c").over(w)})
    return x.where((place(F.col("_n")) < F.col("_upto")) & (place(F.col("_n")) >= F.col("_upto") - F.col("_c"))).select(*keys, F.col(value).alias(name))


def speech_blocks(spoken: DataFrame, part: Column | None = None) -> DataFrame:
    """(rec_id, block, speaker, start, end, text, is_marker, segments) from spoken (rec_id, seq, start, end, speaker, text).

    Neighbours of one speaker are one block; a marker is a block of its own. A block ends where its last row ends, and
    its text is that of its rows without a separator. With part, which rises with seq, long recordings are spread over
    several tasks (see sliced_islands).
    """
    w = Window.partitionBy("rec_id").orderBy("seq")
    x = spoken.withColumn("is_marker", is_marker(F.col("text")))
    same = lambda speaker, marker: F.coalesce(F.col("speaker").eqNullSafe(speaker) & ~F.col("is_marker") & ~marker, F.lit(False))
    if part is None:
        x = islands(x, ["rec_id"], ["seq"], ~same(F.lag("speaker").over(w), F.lag("is_marker").over(w)), "block")
    else:
        x = sliced_islands(x, ["rec_id"], ["seq"], ["speaker", "is_marker"], lambda before: ~same(before["speaker"], before["is_marker"]), part, "block")
    rows = F.array_sort(F.collect_list(F.struct("seq", "start", "end", F.coalesce("text", F.lit("")).alias("text"))))
    x = x.groupBy("rec_id", "block").agg(F.first("speaker").alias("speaker"), F.first("is_marker").alias("is_marker"), rows.alias("r"))
    return x.select("rec_id", "block", "speaker", F.get("r", F.lit(0))["start"].alias("start"), F.element_at("r", -1)["end"].alias("end"), F.array_join(F.col("r.text"), "").alias("text"), "is_marker", F.size("r").alias("segments"))


def first_appearance(rows: DataFrame, keys: list[str], order: Column, label: str, name: str = "number", unknown: int | None = None) -> DataFrame:
    """rows with labels renumbered from 0 by where they come first; a label equal to `unknown` stays."""
    known = F.lit(True) if unknown is None else F.col(label) != unknown
    first = rows.where(known).groupBy(*keys, label).agg(F.min(order).alias("_first"))
    numbers = first.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy("_first")) - 1).drop("_first")
    x = rows.join(numbers, [*keys, label], "left")
    x = x if unknown is None else x.withColumn(name, F.coalesce(name, F.lit(unknown)))
    return x.select(*rows.columns, name)


def chunk_number(middle: Column, total: Column, window: float, overlap: float) -> Column:
    """The one of the overlapping windows that owns a middle: bounds lie in the middle of overlaps, outer windows own the rest."""
    step = window - overlap
    count = F.when(total <= window, F.lit(1)).otherwise(1 + F.ceil((total - window) / step))
    return F.least(count - 1, F.greatest(F.lit(0), F.floor((middle - overlap / 2) / step))).cast("int")


def sessions(rows: DataFrame, keys: list[str], time: Column, order: list, gap: float, name: str = "session", part: Column | None = None) -> DataFrame:
    """rows numbered by session; one starts where more than `gap` seconds have passed. With part, see sliced_islands."""
    if part is not None:
        timed = rows.withColumn("_time", time)
        return sliced_islands(timed, keys, order, ["_time"], lambda before: F.col("_time") - before["_time"] > gap, part, name).drop("_time")
    w = Window.partitionBy(*keys).orderBy(*order)
    return islands(rows, keys, order, time - F.lag(time).over(w) > gap, name)


def nth_occurrence(rows: DataFrame, keys: list[str], order: list, name: str = "nth") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def upper_median(rows: DataFrame, keys: list[str], value: str, name: str = "upper_median") -> DataFrame:
    """(keys, name): element n // 2 of each key's values in order."""
    return element_at_place(rows, keys, value, lambda n: F.floor(n / 2), name)


def floor_percentile(rows: DataFrame, keys: list[str], value: str, q: float, name: str = "percentile") -> DataFrame:
    """(keys, name): element min(n - 1, int(n * q)) of each key's values in order."""
    return element_at_place(rows, keys, value, lambda n: F.least(n - 1, F.floor(n * F.lit(q))), name)


def quietest(samples: DataFrame, keys: list[str], window: str) -> DataFrame:
    """(keys, window_start, rms) of the tumbling window with the least root mean square; samples (keys, ts, value). Ties: the first."""
    per = samples.groupBy(*keys, F.window("ts", window).alias("w")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    least = per.groupBy(*keys).agg(F.min(F.struct("rms", F.col("w.start").alias("window_start"))).alias("m"))
    return least.select(*keys, "m.window_start", "m.rms")


def trim_zero_runs(pcm: DataFrame, want: DataFrame, keep: int = 160) -> DataFrame:
    """Samples (rec_id, i, sample) without the zeros that are cut to lose `want` (rec_id, want) of each recording.

    Runs of zeros give up what they have above `keep`, the longest first (equal ones in order), until enough is gone;
    samples go from the end of a run. A recording that is not in want loses nothing.
    """
    w = Window.partitionBy("rec_id").orderBy("i")
    x = islands(pcm.withColumn("zero", F.col("sample") == 0), ["rec_id"], ["i"], F.col("zero") != F.lag("zero").over(w), "run")
    runs = x.where("zero").groupBy("rec_id", "run").agg(F.count("*").alias("n"), F.min("i").alias("first")).where(F.col("n") > keep)
    runs = runs.join(want, "rec_id").withColumn("can", F.col("n") - keep)
    longest = Window.partitionBy("rec_id").orderBy(F.desc("n"), "first").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = runs.withColumn("take", F.greatest(F.lit(0), F.least("can", F.col("want") - F.sum("can").over(longest) + F.col("can"))))
    cut = runs.select("rec_id", "run", (F.col("first") + F.col("n") - F.col("take")).alias("cut_from"))
    return x.join(cut, ["rec_id", "run"], "left").where("not zero or cut_from is null or i < cut_from").select("rec_id", "i", "sample")


def eta(marks: DataFrame, keys: list[str], least: float = 0.1, least_span: float = 30.0) -> DataFrame:
    """(keys, left): seconds to go at the rate between the first and last mark (t, done); null below `least` done or `least_span` seconds."""
    x = marks.groupBy(*keys).agg(F.min(F.struct("t", "done")).alias("a"), F.max(F.struct("t", "done")).alias("b"))
    rate = F.try_divide(F.col("b.done") - F.col("a.done"), F.col("b.t") - F.col("a.t"))
    ready = (F.col("b.done") >= least) & (F.col("b.t") - F.col("a.t") >= least_span) & (rate > 0)
    return x.select(*keys, F.when(ready, (1 - F.col("b.done")) / rate).alias("left"))
