"""Voices by name: nearest samples with margins, suspects, duplicates, retention.

A library is (seq, name, vec) with seq as age. Vectors have unit length. Queries and
library meet in shards of the library, so that a name of any size is spread; each task
multiplies matrices and returns the names near the top, so that rows do not grow with
all pairs. A query goes to the shards that can hold a name that counts for it.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from lectern.operators import neighbours
from lectern.sources.shared import stored

THRESHOLD, MARGIN, RIVALS = 0.62, 0.10, 3
MOST_SAMPLES = 8
MISFILED, LONE, DUPLICATE, CONSISTENT = 0.20, 0.08, 0.999, 0.45
UNLIKE, AGAINST = 0.40, 0.50
#: Library rows in a shard; queries that meet it in one task.
SHARD, ASKED = 50_000, 20_000
#: Shards of a library at most, and samples that all tasks know.
PIVOTS = 1024
#: Cosines that a task holds at once.
PRODUCTS = 1 << 20
_LAST = np.iinfo(np.int64).max


def _doubles(v: str = "vec"):
    return F.transform(v, lambda x: x.cast("double"))


class _Routes:
    """Where a query may find names that count: shards are the samples nearest to a few pivots, with the widest angle to theirs.

    A dot product with a sample of a shard is at most that of the lengths times the cosine of the angle to the pivot less the
    shard's widest. What a query asks for at least comes from the pivots' own names at first, then from its nearest shard.
    """

    def __init__(self, pivots: np.ndarray, seqs: np.ndarray, names: np.ndarray, margin: float, least_names: int):
        self.seqs, self.names, self.margin, self.least = seqs, names, margin, least_names
        self.pivots = pivots
        self.unit = pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-12)
        self.width, self.longest, self.shortest = np.zeros(0), np.zeros(0), np.zeros(0)

    def angles(self, v: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) @ self.unit[: self.shards].T, -1, 1))

    def floor(self, scores: np.ndarray, names: np.ndarray) -> float:
        """What a name must reach to count, if these are some of the names' scores."""
        best: dict[str, float] = {}
        for n, x in zip(names, scores):
            if x > best.get(n, -np.inf):
                best[n] = x
        top = sorted(best.values(), reverse=True)
        return min(top[0] - self.margin, top[self.least - 1]) - 1e-9 if len(top) >= self.least else -np.inf

    def bounds(self, v: np.ndarray) -> np.ndarray:
        cos = np.cos(np.maximum(self.angles(v) - self.width - 1e-7, 0.0))
        return np.linalg.norm(v, axis=1, keepdims=True) * np.where(cos > 0, cos * self.longest, cos * self.shortest) + 1e-9


def _tops(asked: np.ndarray, own: np.ndarray, m: np.ndarray, seq: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query and name (samples m lie name by name, a name from each of `starts`) the best cosine and the first sample that has it.

    Names are taken some at a time, and a large one in pieces, so that no more than PRODUCTS cosines are there at once.
    """
    best, first = np.full((len(asked), len(starts)), -np.inf), np.full((len(asked), len(starts)), _LAST)
    step, ends = max(1, PRODUCTS // max(1, len(asked))), np.append(starts, len(m))[1:]
    for a in range(0, len(m), step):
        b = min(len(m), a + step)
        s = asked @ m[a:b].T
        s[own[:, None] == seq[None, a:b]] = -np.inf
        names = np.arange(np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left"))
        at = np.maximum(starts[names], a) - a
        top = np.maximum.reduceat(s, at, axis=1)
        where = np.minimum.reduceat(np.where(s == np.repeat(top, np.diff(np.append(at, b - a)), axis=1), seq[None, a:b], _LAST), at, axis=1)
        had, at_ = best[:, names], first[:, names]
        first[:, names] = np.where(top > had, where, np.where(top == had, np.minimum(where, at_), at_))
        best[:, names] = np.maximum(top, had)
    return best, first


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


def _shard_task(margin: float, least_names: int):
    """The names of a shard that may count for each query, from rows of samples (query is null) and of queries."""
    schema = pa.schema([("query", pa.int64()), ("name", pa.string()), ("score", pa.float64()), ("first_seq", pa.int64())])

    def task(rows: pa.Table) -> pa.Table:
        sample = pc.is_null(rows.column("query"))
        lib, asked = (rows.filter(keep).combine_chunks() for keep in (sample, pc.invert(sample)))
        out = []
        if lib.num_rows and asked.num_rows:
            names, at = np.unique(lib.column("name").to_numpy().astype(str), return_inverse=True)
            seq = lib.column("seq").to_numpy()
            order = np.lexsort((seq, at))
            starts = np.flatnonzero(np.diff(np.concatenate([[-1], at[order]])))
            m, seq = _matrix(lib.column("vec").combine_chunks())[order], seq[order]
            some = max(1, min(512, PRODUCTS // len(names)))
            for a in range(0, asked.num_rows, some):
                g = asked.slice(a, some)
                best, first = _tops(_matrix(g.column("vec").combine_chunks()), g.column("own_seq").to_numpy().astype(float), m, seq, starts)
                nth = min(least_names, len(names))
                top = -np.partition(-best, nth - 1, axis=1)[:, :nth]
                low = np.minimum(top.max(axis=1) - margin - 1e-9, top.min(axis=1))
                keep = (best >= low[:, None]) | (g.column("own_name").to_numpy()[:, None] == names[None, :])
                q, c = np.nonzero(keep & np.isfinite(best))
                out.append(pa.table([pa.array(g.column("query").to_numpy()[q]), pa.array(names[c].astype(object), pa.string()), pa.array(best[q, c]), pa.array(first[q, c])], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return task


def _meet(held: DataFrame, sent: DataFrame, task, parts: int) -> DataFrame:
    """task over each shard's samples (shard, part, ...) and the queries sent to it, in `parts` groups that each have all samples of a part."""
    null = lambda kind: F.lit(None).cast(kind)
    spread = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("lane")
    left = held.select("dim", "shard", "part", spread, null("long").alias("query"), null("long").alias("own_seq"), null("string").alias("own_name"), "name", "seq", "vec")
    right = sent.select("dim", "shard", "part", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int").alias("lane"), "query", "own_seq", "own_name", null("string").alias("name"), null("long").alias("seq"), "vec")
    found = left.unionByName(right).groupBy("dim", "shard", "part", "lane").applyInArrow(task, "query long, name string, score double, first_seq long")
    best = F.max(F.struct("score", (-F.col("first_seq")).alias("at"))).alias("b")
    return found.groupBy("query", "name").agg(best).select("query", "name", "b.score", (-F.col("b.at")).alias("first_seq"))


def name_scores(queries: DataFrame, library: DataFrame, margin: float = MARGIN, least_names: int = 3, shard: int = SHARD, *, sent: list | None = None) -> DataFrame:
    """(query, name, score, first_seq): the best cosine of each query (query, vec[, own_seq, own_name]) with a name's samples.

    What is within `margin` of a query's best name is complete, and so are at least `least_names` names and its own; a name
    that comes back from some of its shards only is neither. A sample with seq own_seq is skipped. Vectors of other lengths
    than the query's, and null vectors, are left out.

    A library of up to `shard` samples is one shard. A larger one is cut around pivots; a query goes to its nearest shard
    first, then to those that by their bounds can hold a name that counts beside what it found there, and to those of its
    own name. `sent` gets the numbers of rows sent in both rounds.
    """
    own = [c for c in ("own_seq", "own_name") if c in queries.columns]
    null = lambda kind: F.lit(None).cast(kind)
    lib = library.where("vec is not null").select(F.size("vec").alias("dim"), "name", F.col("seq").cast("long").alias("seq"), _doubles().alias("vec"))
    asked = queries.where("vec is not null").select(F.size("vec").alias("dim"), F.col("query").cast("long").alias("query"), F.col("own_seq").cast("long").alias("own_seq") if "own_seq" in own else null("long").alias("own_seq"), F.col("own_name") if "own_name" in own else null("string").alias("own_name"), _doubles().alias("vec"))
    task, count = _shard_task(margin, least_names), lib.count()
    n = int(library.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if count <= shard:
        one = lambda df: df.withColumns({"shard": F.lit(0), "part": F.lit(0)})
        return _meet(one(lib), one(asked), task, max(1, n, -(-asked.count() // ASKED)))
    shards = min(PIVOTS, -(-count // shard))
    routes = _pivoted(lib, shards, margin, least_names)
    width = F.element_at(F.col("r"), 2)
    placed = stored(lib.withColumn("r", _nearest(routes)("vec")).withColumns({"shard": F.element_at("r", 1).cast("int"), "angle": width, "length": F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))}).drop("r"), "shards")
    extent = placed.groupBy("dim", "shard").agg(F.max("angle").alias("width"), F.max("length").alias("longest"), F.min("length").alias("shortest"), F.ceil(F.count("*") / shard).cast("int").alias("parts")).collect()  # PIVOTS rows for each length of vectors at most
    for r in extent:
        _extend(routes[r["dim"]], r)
    parts = library.sparkSession.createDataFrame([(r["dim"], r["shard"], r["parts"]) for r in extent], "dim int, shard int, parts int")
    held = placed.join(F.broadcast(parts), ["dim", "shard"]).withColumn("part", F.pmod(F.xxhash64("name", "seq"), F.col("parts")).cast("int"))

    def lanes(queries: DataFrame) -> int:
        """Groups of a shard's queries, so that no task has more than about ASKED of them."""
        most = queries.groupBy("dim", "shard").count().agg(F.max("count")).first()[0] or 0
        return max(1, n // shards, -(-most // ASKED))

    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    to = lambda df: df.join(F.broadcast(parts), ["dim", "shard"]).select(*df.columns, each)
    known = asked.withColumn("r", _first_round(routes)("vec", "own_seq"))
    known = stored(known.select("dim", "query", "own_seq", "own_name", "vec", F.element_at("r", 1).cast("int").alias("shard"), F.element_at("r", 2).alias("floor")), "asked")
    near = stored(_meet(held, to(known.drop("floor")), task, lanes(known)), "near")
    # what the first round found raises what a name must reach
    top = F.slice(F.reverse(F.array_sort(F.collect_list("score"))), 1, least_names)
    reached = near.groupBy("query").agg(top.alias("top")).select("query", F.when(F.size("top") >= least_names, F.least(F.get("top", F.lit(0)) - margin, F.get("top", F.lit(least_names - 1))) - 1e-9).otherwise(-1e308).alias("reached"))
    again = known.join(reached, "query", "left").withColumn("floor", F.greatest("floor", F.coalesce("reached", F.lit(-1e308))))
    more = again.withColumn("to", F.explode(_second_round(routes)("vec", "floor"))).where("to <> shard")
    more = more.select("dim", "query", "own_seq", "own_name", "vec", F.col("to").alias("shard"))
    if "own_name" in own:
        homes = held.select("dim", F.col("name").alias("own_name"), F.col("shard").alias("to")).distinct()
        mine = known.join(homes, ["dim", "own_name"]).where("to <> shard").select("dim", "query", "own_seq", "own_name", "vec", F.col("to").alias("shard"))
        more = more.unionByName(mine).dropDuplicates(["query", "shard"])
    more = stored(more, "sent")
    if sent is not None:
        sent += [known.count(), more.count()]
    best = F.max(F.struct("score", (-F.col("first_seq")).alias("at"))).alias("b")
    both = near.unionByName(_meet(held, to(more), task, lanes(more)))
    return both.groupBy("query", "name").agg(best).select("query", "name", "b.score", (-F.col("b.at")).alias("first_seq"))


def _pivoted(lib: DataFrame, shards: int, margin: float, least_names: int) -> dict[int, _Routes]:
    """For each length of vectors up to PIVOTS samples, chosen by hash; the first `shards` of them are the pivots of shards."""
    nth = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("seq"), "seq"))
    rows = lib.withColumn("nth", nth).where(F.col("nth") <= PIVOTS).orderBy("dim", "nth").collect()
    out = {}
    for dim in sorted({r["dim"] for r in rows}):
        of = [r for r in rows if r["dim"] == dim]
        out[dim] = _Routes(np.array([r["vec"] for r in of]).reshape(len(of), dim), np.array([r["seq"] for r in of]), np.array([r["name"] for r in of], object), margin, least_names)
        out[dim].shards = min(shards, len(of))
        out[dim].width, out[dim].longest, out[dim].shortest = np.zeros(out[dim].shards), np.zeros(out[dim].shards), np.zeros(out[dim].shards)
    return out


def _extend(r: _Routes, row) -> None:
    r.width[row["shard"]], r.longest[row["shard"]], r.shortest[row["shard"]] = row["width"], row["longest"], row["shortest"]


def _by_length(v: pd.Series):
    """(dim, places, matrix) of the vectors of each length."""
    sizes = v.map(len).to_numpy()
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield dim, at, np.stack(v.iloc[at].to_list()).astype(float).reshape(len(at), dim)


def _nearest(routes: dict[int, _Routes]):
    """[shard, angle] of a sample."""

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        out = [None] * len(v)
        for dim, at, m in _by_length(v):
            angle = routes[dim].angles(m)
            near = angle.argmin(axis=1)
            for i, k in zip(at, zip(near.tolist(), angle[np.arange(len(m)), near].tolist())):
                out[i] = list(k)
        return pd.Series(out)

    return run


def _first_round(routes: dict[int, _Routes]):
    """[shard, floor] of a query: its nearest pivot's shard, and what the pivots' names say that a name must reach. -1 without samples of its length."""

    @F.pandas_udf("array<double>")
    def run(v: pd.Series, own: pd.Series) -> pd.Series:
        out = [[-1.0, -1e308]] * len(v)
        for dim, at, m in _by_length(v):
            if dim not in routes:
                continue
            r = routes[dim]
            s = m @ r.pivots.T
            s[own.iloc[at].to_numpy(float)[:, None] == r.seqs[None, :]] = -np.inf
            near = r.angles(m).argmin(axis=1)
            for i, k, row in zip(at, near.tolist(), s):
                out[i] = [float(k), max(r.floor(row[np.isfinite(row)], r.names[np.isfinite(row)]), -1e308)]
        return pd.Series(out)

    return run


def _second_round(routes: dict[int, _Routes]):
    """The shards of a query that can hold a name that reaches the floor."""

    @F.pandas_udf("array<int>")
    def run(v: pd.Series, floor: pd.Series) -> pd.Series:
        out = [[]] * len(v)
        for dim, at, m in _by_length(v):
            if dim in routes:
                can = routes[dim].bounds(m) >= floor.iloc[at].to_numpy()[:, None]
                for i, row in zip(at, can):
                    out[i] = np.flatnonzero(row).tolist()
        return pd.Series(out)

    return run


def ranked(scores: DataFrame) -> DataFrame:
    """scores with `rank` for each query: best first, the name with the earlier best sample among equals."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "first_seq", "name")))


def recognize(queries: DataFrame, library: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(query, name, score): the nearest name, if it reaches the threshold."""
    return ranked(name_scores(queries, library)).where((F.col("rank") == 1) & (F.col("score") >= threshold)).select("query", "name", "score")


def _with_second(scores: DataFrame) -> DataFrame:
    r = ranked(scores)
    w = Window.partitionBy("query").orderBy("rank")
    return r.withColumn("second", F.lead("score").over(w)).where("rank = 1")


def recognize_each(queries: DataFrame, library: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """(query, name, score): as recognize(), with the second name at least `margin` behind, and each name given once.

    The highest score gets a name, the smaller query among equals; others get nothing. With one name in the library no
    margin is asked for.
    """
    top = _with_second(name_scores(queries, library)).where((F.col("score") >= threshold) & (F.col("second").isNull() | ~(F.col("score") - F.col("second") < margin)))
    winner = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "query"))
    return top.withColumn("place", winner).where("place = 1").select("query", "name", "score")


def close_calls(queries: DataFrame, library: DataFrame, taken: DataFrame | None = None, threshold: float = THRESHOLD, margin: float = MARGIN, most: int = RIVALS) -> DataFrame:
    """(query, place, name, score): up to `most` names within the margin of the best, where the second is; names in taken (name) are left out."""
    r = ranked(name_scores(queries, library, margin))
    top = r.where("rank = 1 and score >= " + str(threshold)).select("query", F.col("score").alias("top"))
    second = r.where("rank = 2").select("query", F.col("score").alias("second"))
    near = top.join(second, "query").where(F.col("top") - F.col("second") < margin)
    rivals = r.join(near, "query").where(F.col("top") - F.col("score") < margin)
    if taken is not None:
        rivals = rivals.join(taken.select("name").distinct(), "name", "left_anti")
    place = F.row_number().over(Window.partitionBy("query").orderBy("rank"))
    return rivals.withColumn("place", place).where(F.col("place") <= most).select("query", "place", "name", "score")


def suspects(library: DataFrame, margin: float = MISFILED, lone: float = LONE) -> DataFrame:
    """(seq, name, own, other, best, gap, lead): samples of names with two or more that are nearer to another name.

    own: best cosine with the name's other samples; best: with another name `other`; gap = best - own; lead = best less the
    second other name's (0 if there is only one other). Kept if gap >= margin, and lead >= lone or there is no second.
    """
    q = library.select(F.col("seq").alias("query"), "vec", F.col("seq").alias("own_seq"), F.col("name").alias("own_name"))
    s = name_scores(q, library, least_names=3).join(library.select(F.col("seq").alias("query"), F.col("name").alias("own_name")), "query")
    own = s.where("name = own_name").select("query", F.col("score").alias("own"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "first_seq", "name")
    others = s.where("name <> own_name").withColumns({"second": F.lead("score").over(w), "rank": F.row_number().over(w)}).where("rank = 1")
    x = others.join(own, "query").withColumns({"gap": F.col("score") - F.col("own"), "lead": F.coalesce(F.col("score") - F.col("second"), F.lit(0.0))})
    kept = x.where((F.col("gap") >= margin) & (F.col("second").isNull() | (F.col("lead") >= lone)))
    return kept.select(F.col("query").alias("seq"), F.col("own_name").alias("name"), "own", F.col("name").alias("other"), F.col("score").alias("best"), "gap", "lead")


def wholly_suspect(found: DataFrame, library: DataFrame) -> DataFrame:
    """(name, samples, suspects, whole): whether every sample of a name is a suspect."""
    n = library.groupBy("name").agg(F.count("*").alias("samples"))
    return n.join(found.groupBy("name").agg(F.count("*").alias("suspects")), "name").withColumn("whole", F.col("samples") == F.col("suspects"))


def _first_kept(rows: pd.DataFrame, least: float) -> list[tuple]:
    """(seq, name, of_seq) of rows in order of seq that are near an earlier one that is kept."""
    out = []
    for _, same in rows.groupby(rows["vec"].map(len)):
        same = same.sort_values("seq")
        m, seq = np.stack(same["vec"].to_list()).astype(float), same["seq"].to_numpy()
        kept = np.zeros(len(m), bool)
        for i in range(len(m)):
            near = np.flatnonzero(kept[:i] & (m[:i] @ m[i] >= least))
            if len(near):
                out.append((seq[i], rows["name"].iloc[0], seq[near[0]]))
            else:
                kept[i] = True
    return out


def duplicates(library: DataFrame, least: float = DUPLICATE, size: int | None = None) -> DataFrame:
    """(seq, name, of_seq): samples near the first earlier one of their name that is kept; a sample is kept if there is none.

    A name of up to `size` samples is one task. Larger ones go in rounds over pairs of cells (see neighbours): a sample
    without an earlier open one near it is kept, and what is near a kept one is dropped. Equal vectors count once in that.
    """
    size = size or neighbours.CELL
    rows = library.where("vec is not null").select("seq", "name", "vec")
    counts = rows.groupBy("name").agg((F.count("*") > size).alias("large"))
    rows = stored(rows.join(counts, "name"), "samples")

    def task(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_first_kept(group, least), columns=["seq", "name", "of_seq"])

    found = rows.where("not large").drop("large").groupBy("name").applyInPandas(task, "seq long, name string, of_seq long")
    large = rows.where("large").select("seq", "name", "vec")
    if large.isEmpty():
        return found
    # equal vectors go with the first of them; shorter ones than `least` are not near themselves
    alike = F.when(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) < least, F.col("seq"))
    keyed = large.withColumn("alike", alike)
    firsts = keyed.groupBy("name", "vec", "alike").agg(F.min("seq").alias("first"))
    same = (F.col("name") == F.col("n")) & (F.col("vec") == F.col("v")) & F.col("alike").eqNullSafe(F.col("k"))
    copies = stored(keyed.join(firsts.toDF("n", "v", "k", "first"), same).select("seq", "name", "first"), "copies")
    every = stored(firsts.select(F.col("first").alias("seq"), "name", "vec"), "distinct")
    roles = lambda df, asks, answers: df.withColumns({"asks": F.lit(asks), "answers": F.lit(answers)})
    open_, kept = every, None
    while not open_.isEmpty():
        waits = stored(neighbours.earliest(roles(open_, True, True), least, size), "waits")
        now = stored(open_.join(waits, "seq", "left_anti"), "kept")
        rest = stored(open_.join(waits, "seq", "left_semi"), "rest")
        kept = now if kept is None else kept.unionByName(now)
        if rest.isEmpty():
            break
        gone = neighbours.earliest(roles(rest, True, False).unionByName(roles(now, False, True)), least, size)
        open_ = stored(rest.join(gone, "seq", "left_anti"), "open")
    dropped = every.join(kept.select("seq"), "seq", "left_anti")
    of = stored(neighbours.earliest(roles(dropped, True, False).unionByName(roles(kept, False, True)), least, size), "of")
    # a copy of a kept sample is its duplicate, that of a dropped one goes with it
    more = copies.join(of.withColumnRenamed("seq", "first"), "first", "left").where("of is not null or seq <> first").select("seq", "name", F.coalesce("of", "first").alias("of_seq"))
    return found.unionByName(more)


def margin_sweep(library: DataFrame, margins: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """(margin, evaluated, correct, wrong, precision) of matching each sample against the rest of the library."""
    q = library.select(F.col("seq").alias("query"), "vec", F.col("seq").alias("own_seq"), F.col("name").alias("own_name"))
    several = library.groupBy("name").count().where("count > 1").select(F.col("name").alias("own_name"))
    top = _with_second(name_scores(q, library)).join(library.select(F.col("seq").alias("query"), F.col("name").alias("own_name")), "query").join(several, "own_name", "left_semi")
    x = top.withColumn("margin", F.explode(F.array(*[F.lit(float(m)) for m in margins])))
    hit = (F.col("score") >= threshold) & (F.col("second").isNull() | ~(F.col("score") - F.col("second") < F.col("margin")))
    right = F.col("name") == F.col("own_name")
    out = x.groupBy("margin").agg(F.count("*").alias("evaluated"), F.sum((hit & right).cast("long")).alias("correct"), F.sum((hit & ~right).cast("long")).alias("wrong"))
    kept = F.col("correct") + F.col("wrong")
    return out.withColumn("precision", F.when(kept > 0, F.col("correct") / kept))


def retain(library: DataFrame, most: int = MOST_SAMPLES) -> DataFrame:
    """The library with the youngest `most` samples of each name."""
    return library.withColumn("_age", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("seq")))).where(F.col("_age") <= most).drop("_age")


def enroll(library: DataFrame, new: DataFrame, most: int = MOST_SAMPLES) -> DataFrame:
    """library and new (seq, name, vec) behind it, normalised; blank names are rejected, the oldest above `most` go."""
    from lectern.functions.vectors import normalized

    fresh = new.where(F.trim("name") != "").withColumn("vec", normalized(F.col("vec")).cast(library.schema["vec"].dataType))
    return retain(library.unionByName(fresh.select(*library.columns)), most)


def rename(library: DataFrame, old: str, new: str, most: int = MOST_SAMPLES) -> DataFrame:
    """Samples of `old` as `new` (merged if it exists); they keep their age, and the oldest above `most` go."""
    return retain(library.withColumn("name", F.when(F.col("name") == old, F.lit(new)).otherwise(F.col("name"))), most)


def rename_plan(library: DataFrame, old: str, new: str, most: int = MOST_SAMPLES) -> DataFrame:
    """One row (moving, existing, dropped) of what rename() would do."""
    moving, existing = F.count_if(F.col("name") == old), F.count_if(F.col("name") == new)
    return library.agg(moving.alias("moving"), existing.alias("existing"), F.greatest(F.lit(0), moving + existing - most).alias("dropped"))


def delete_samples(library: DataFrame, items: DataFrame) -> DataFrame:
    """library without items (name, nth): the nth sample of a name, counted from 0 by age before anything is deleted."""
    x = library.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy("seq")) - 1)
    return x.join(items.select("name", "nth").distinct(), ["name", "nth"], "left_anti").select(*library.columns)


def inconsistent(library: DataFrame, new: DataFrame, least: float = CONSISTENT, most: int = MOST_SAMPLES) -> DataFrame:
    """(query, name, score): new samples (query, name, vec) whose best cosine with the samples that their name keeps is below `least`.

    A name keeps its youngest `most` samples (see retain), so a new sample meets as many rows.
    """
    from lectern.functions.vectors import dot

    pairs = new.select("query", "name", F.col("vec").alias("v")).join(retain(library, most).select("name", "vec"), "name")
    return pairs.groupBy("query", "name").agg(F.max(dot(F.col("v"), F.col("vec"))).alias("score")).where(F.col("score") < least)


def unlike(library: DataFrame, least: float = UNLIKE, most: int = MOST_SAMPLES) -> DataFrame:
    """(name, score): names whose kept samples (the youngest `most`) have a pair below `least`, with the lowest cosine.

    That makes a name doubtful, not wrong; which sample is another's voice is told by suspects() or against().
    """
    from lectern.functions.vectors import dot

    kept = retain(library.where("vec is not null"), most).select("name", "seq", "vec")
    pairs = kept.join(kept.select("name", F.col("seq").alias("seq2"), F.col("vec").alias("vec2")), "name").where((F.col("seq") < F.col("seq2")) & (F.size("vec") == F.size("vec2")))
    return pairs.groupBy("name").agg(F.min(dot(F.col("vec"), F.col("vec2"))).alias("score")).where(F.col("score") < least)


def against(library: DataFrame, known: DataFrame, least: float = AGAINST) -> DataFrame:
    """(name, seq, label, score): for each sample the nearest voice of a meeting in which all are known (known: seq, label, vec).

    Names of which no sample is as near as `least` to any have no rows: they were not there.
    """
    q = library.select(F.col("seq").alias("query"), "vec")
    near = ranked(name_scores(q, known.withColumnRenamed("label", "name"))).where("rank = 1").select(F.col("query").alias("seq"), F.col("name").alias("label"), "score")
    x = near.join(library.select("seq", "name"), "seq")
    there = x.groupBy("name").agg(F.max("score").alias("top")).where(F.col("top") >= least).select("name")
    return x.join(there, "name", "left_semi").select("name", "seq", "label", "score")


def health_report(library: DataFrame, margin: float = MISFILED, lone: float = LONE, least: float = UNLIKE) -> DataFrame:
    """(kind, name, seq, other, score) of a library: what may be deleted, and what someone should listen to.

    duplicate: seq is as good as the sample other; misfiled: seq is nearer to the name other, by score; whole: every sample
    of the name is misfiled, so that it would go with them; unlike: the lowest cosine of the name's samples is below `least`.
    """
    text, null = lambda c: F.col(c).cast("string"), lambda kind: F.lit(None).cast(kind)
    found = stored(suspects(library, margin, lone), "suspects")
    row = lambda df, kind, seq, other, score: df.select(F.lit(kind).alias("kind"), "name", seq.alias("seq"), other.alias("other"), score.alias("score"))
    whole = wholly_suspect(found, library).where("whole")
    parts = [
        row(duplicates(library), "duplicate", F.col("seq"), text("of_seq"), null("double")),
        row(found, "misfiled", F.col("seq"), F.col("other"), F.col("gap")),
        row(whole, "whole", null("long"), null("string"), null("double")),
        row(unlike(library, least), "unlike", null("long"), null("string"), F.col("score")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
