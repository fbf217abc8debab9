"""Pairs of near vectors of one name, exactly, without a name being one task.

Rows of a name are dealt to cells by their distances to two pivots, in steps of at least
the radius, so that near rows lie in one cell or in adjoining ones; a cell with too many
rows is cut by hash. Cells whose distances to a third pivot are further apart than the
radius do not meet either. A task gets two cells and multiplies their matrices; what
comes back is a row for each row, not for each pair. The radius follows from the least
dot product and the longest vector of the name, so vectors need not have unit length.
"""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lectern.sources.shared import stored

#: Rows in a cell; a task holds two. Cells that rows could be spread over for each that they would fill.
CELL = 4_000
FILLED = 4
PIVOTS = 3


def _square(v):
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)


def _distance(u, v):
    return F.sqrt(_square(F.zip_with(u, v, lambda a, b: a - b)))


def dealt(rows: DataFrame, least: float, size: int = CELL) -> tuple[DataFrame, DataFrame]:
    """rows (seq, name, vec, ...) with `cell`, and pairs (a, b) of cells, a <= b, that can hold two with a dot product of `least`."""
    key = ["name", "dim"]
    x = rows.withColumns({"vec": F.transform("vec", lambda v: v.cast("double")), "dim": F.size("vec")})
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("seq"), "seq"))
    some = x.select(*key, "vec", "seq").withColumn("nth", nth).where(F.col("nth") <= PIVOTS).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "vec"))), lambda s: s["vec"]).alias("pivots"))
    longest = x.groupBy(*key).agg(F.max(_square(F.col("vec"))).alias("longest"))
    # a little more than the radius, for rounding
    radius = F.sqrt(F.greatest(F.lit(0.0), 2 * F.col("longest") - 2 * least)) + 1e-6
    known = some.join(longest, key).select(*key, "pivots", radius.alias("radius"))
    far = [_distance(F.col("vec"), F.element_at("pivots", F.least(F.lit(i + 1), F.size("pivots")))) for i in range(PIVOTS)]
    x = x.join(known, key).withColumns({f"d{i}": d for i, d in enumerate(far)})
    x = stored(x.drop("pivots"), "placed")
    # steps of the radius or more, so that cells are neither too large nor, where rows are few, many small ones
    spans = x.groupBy(*key).agg(F.count("*").alias("rows"), *[f(f"d{i}").alias(f"{n}{i}") for i in (0, 1) for n, f in (("least", F.min), ("most", F.max))])
    steps = F.ceil(F.sqrt(FILLED * F.col("rows") / size))
    spans = spans.select(*key, *[c for i in (0, 1) for c in (f"least{i}", ((F.col(f"most{i}") - F.col(f"least{i}")) / steps).alias(f"share{i}"))])
    place_of = lambda i: F.floor((F.col(f"d{i}") - F.col(f"least{i}")) / F.greatest("radius", f"share{i}"))
    x = x.join(spans, key).withColumns({f"b{i}": place_of(i) for i in (0, 1)}).drop("d0", "d1", "least0", "least1", "share0", "share1")
    place = [*key, "b0", "b1"]
    parts = x.groupBy(*place).agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    x = x.join(parts, place).withColumn("part", F.pmod(F.xxhash64("seq"), F.col("parts")).cast("int"))
    x = stored(x.withColumn("cell", F.concat_ws("|", "b0", "b1", "part", "dim", "name")).drop("parts"), "cells")
    cells = stored(x.groupBy(*place, "cell").agg(F.min("d2").alias("low"), F.max("d2").alias("high"), F.first("radius").alias("radius")), "cell-bounds")
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    asked = cells.withColumn("s", steps).select("name", "dim", (F.col("b0") + F.col("s.i")).alias("b0"), (F.col("b1") + F.col("s.j")).alias("b1"), F.col("cell").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"))
    meet = (F.col("a") <= F.col("cell")) & (F.col("low") - F.col("high_a") <= F.col("radius")) & (F.col("low_a") - F.col("high") <= F.col("radius"))
    return x, asked.join(cells, place).where(meet).select("a", F.col("cell").alias("b"))


def by_pairs(rows: DataFrame, least: float, task: Callable, schema: str, carry: tuple[str, ...] = (), size: int = CELL) -> DataFrame:
    """task(first, second) of the rows (seq, vec, carry) of each pair of cells that can hold near ones; second is None for a cell with itself."""
    held, pairs = dealt(rows, least, size)
    held = held.select("cell", "seq", "vec", *carry)
    pair = F.concat_ws("\n", "a", "b").alias("pair")
    first = held.join(pairs, F.col("cell") == F.col("a")).select(pair, F.lit(0).alias("side"), (F.col("a") == F.col("b")).alias("own"), "seq", "vec", *carry)
    second = held.join(pairs.where("a <> b"), F.col("cell") == F.col("b")).select(pair, F.lit(1).alias("side"), F.lit(False).alias("own"), "seq", "vec", *carry)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        one, two = (group[group["side"] == s].sort_values("seq") for s in (0, 1))
        return task(one, None if group["own"].iloc[0] else two)

    return first.unionByName(second).groupBy("pair").applyInPandas(run, schema)


def _near(one: pd.DataFrame, two: pd.DataFrame, least: float):
    """Places (i, j) of near rows, in bounded pieces."""
    if not len(one) or not len(two):
        return
    a, b = np.stack(one["vec"].to_list()), np.stack(two["vec"].to_list())
    for at in range(0, len(a), 512):
        i, j = np.nonzero(a[at : at + 512] @ b.T >= least)
        yield i + at, j


def earliest(rows: DataFrame, least: float, size: int = CELL) -> DataFrame:
    """(seq, of): for rows (seq, name, vec, asks, answers) that ask, the smallest seq before their own that answers and is near."""

    def task(one: pd.DataFrame, two: pd.DataFrame | None) -> pd.DataFrame:
        out = []
        for asked, told in ((one, one),) if two is None else ((one, two), (two, one)):
            asked, told = asked[asked["asks"]], told[told["answers"]]
            seq, other = asked["seq"].to_numpy(), told["seq"].to_numpy()
            best = np.full(len(seq), np.iinfo(np.int64).max)
            for i, j in _near(asked, told, least):
                before = other[j] < seq[i]
                np.minimum.at(best, i[before], other[j[before]])
            out.append(pd.DataFrame({"seq": seq, "of": best})[best < np.iinfo(np.int64).max])
        return pd.concat(out)

    return by_pairs(rows, least, task, "seq long, of long", ("asks", "answers"), size).groupBy("seq").agg(F.min("of").alias("of"))


def links(rows: DataFrame, least: float, size: int = CELL) -> DataFrame:
    """(a, b): links between rows (seq, name, vec) whose components are those of all near pairs; a task gives a link for each row at most."""

    def task(one: pd.DataFrame, two: pd.DataFrame | None) -> pd.DataFrame:
        seq = np.concatenate([one["seq"].to_numpy(), [] if two is None else two["seq"].to_numpy()]).astype(np.int64)
        label = np.arange(len(seq))
        for i, j in _near(one, one if two is None else two, least):
            j = j + (0 if two is None else len(one))
            while True:
                x, y = label[i], label[j]
                open_ = x != y
                if not open_.any():
                    break
                i, j, x, y = i[open_], j[open_], x[open_], y[open_]
                np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
                while (label[label] != label).any():
                    label = label[label]
        joined = label != np.arange(len(seq))
        return pd.DataFrame({"a": seq[joined], "b": seq[label[joined]]})

    return by_pairs(rows, least, task, "a long, b long", (), size)


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of links (a, b): root is the smallest that a node reaches.

    Every round links what is above a node, and then what is below it, to the smallest of its neighbours; rounds grow with
    the logarithm of the longest way. Links that do not change any more end it.
    """
    e = stored(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    nodes, seen = e.select(F.col("u").alias("node")).union(e.select("v")).distinct(), None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        up = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        least = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s")).select("s.*")
        e = stored(down.where("u > v").distinct(), "links")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        seen = state
