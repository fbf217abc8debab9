"""Speech into chunks for a recogniser: packing, and cuts of long chunks at the quietest place of the samples.

A chunk takes speech until the next would make it too long, so each start follows from
the one before. Here each span points to the span at which a chunk that starts with it
would end; it is found within a slice of time, as chunks are short. From slice to slice
only the places at which chunks can enter are followed, and so a recording is spread
over as many rows as it has minutes.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lectern.operators.islands import running_sum
from lectern.sources.audio import RATE
from lectern.sources.shared import stored

PAD, MOST_GAP, MOST, SEARCH = 0.2, 3.0, 28.0, 10.0
#: Windows whose level is compared, and from one to the next.
QUIET_WINDOW, QUIET_HOP = 0.2, 0.05


def _next(spans: Column, e: Column, most_gap: float, most: float) -> Column:
    """(idx, a, next, end): the span at which a chunk that starts with e ends, and the latest end in it."""
    start = F.struct(e["z"].alias("end"), F.lit(None).cast("long").alias("next"))

    def step(s, x):
        stop = (x["a"] - s["end"] > most_gap) | (x["z"] - e["a"] > most)
        return F.when(s["next"].isNotNull(), s).when(stop, F.struct(s["end"], x["idx"].alias("next"))).otherwise(F.struct(F.greatest(s["end"], x["z"]).alias("end"), F.lit(None).cast("long").alias("next")))

    behind = F.filter(spans, lambda x: (x["idx"] > e["idx"]) & (x["idx"] <= e["idx"] + F.size(spans)))
    last = F.element_at(spans, -1)["idx"] + 1
    return F.aggregate(behind, start, step, lambda s: F.struct(e["idx"].alias("idx"), e["a"].alias("a"), F.coalesce(s["next"], last).alias("next"), s["end"].alias("end")))


def pack_speech(speech: DataFrame, total: DataFrame, pad: float = PAD, most_gap: float = MOST_GAP, most: float = MOST) -> DataFrame:
    """(rec_id, chunk, start, end): speech (rec_id, start, end) padded within [0, total], in order of start and end.

    A span joins the open chunk if it starts at most most_gap after the chunk's latest end and ends at most `most` after its
    start. Recordings without a total, and spans with a null, are left out.
    """
    width = 2 * (most + pad)  # what can join a chunk lies in the slice of its start or in the next
    x = speech.select("rec_id", "start", "end").where("start is not null and end is not null").join(total.select("rec_id", "total"), "rec_id")
    x = x.select("rec_id", "start", "end", F.greatest(F.lit(0.0), F.col("start") - pad).alias("a"), F.least("total", F.col("end") + pad).alias("z"), F.floor(F.col("start") / width).alias("slice"), F.lit(1).cast("long").alias("one"))
    x = running_sum(x, ["rec_id"], ["start", "end"], "one", F.col("slice"), "idx").withColumn("idx", F.col("idx") - 1)
    shown = x.withColumn("own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("slice", F.when(F.col("own"), F.col("slice")).otherwise(F.col("slice") - 1))
    slices = shown.groupBy("rec_id", "slice").agg(F.array_sort(F.collect_list(F.struct("idx", "a", "z", "own"))).alias("spans")).where(F.exists("spans", lambda s: s["own"]))
    slices = slices.select("rec_id", "slice", F.transform(F.filter("spans", lambda s: s["own"]), lambda e: _next(F.col("spans"), e, most_gap, most)).alias("hops"))
    # where a chunk that enters the slice with a span leaves it, from the last span to the first
    none = F.array().cast("array<struct<idx:bigint,leaves:bigint>>")
    leaves = lambda known, h: F.coalesce(F.get(F.filter(known, lambda k: k["idx"] == h["next"]), 0)["leaves"], h["next"])
    ways = F.aggregate(F.reverse("hops"), none, lambda known, h: F.concat(F.array(F.struct(h["idx"].alias("idx"), leaves(known, h).alias("leaves"))), known))
    slices = stored(slices.withColumn("ways", ways), "slices")
    way = slices.select("rec_id", "slice", F.explode("ways").alias("w")).select("rec_id", "slice", "w.idx", "w.leaves")
    entries = way.select("rec_id", F.col("leaves").alias("idx")).union(way.select("rec_id", F.lit(0).cast("long"))).distinct()
    # a few entries for each slice are left, whatever the number of spans
    steps = way.join(entries, ["rec_id", "idx"], "left_semi").groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("idx", "leaves", "slice"))).alias("steps"))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<slice:bigint,idx:bigint>>").alias("hit"))
    follow = lambda s, w: F.when(w["idx"] == s["at"], F.struct(w["leaves"].alias("at"), F.concat(s["hit"], F.array(F.struct(w["slice"].alias("slice"), w["idx"].alias("idx")))).alias("hit"))).otherwise(s)
    entered = steps.select("rec_id", F.explode(F.aggregate("steps", begin, follow, lambda s: s["hit"])).alias("e")).select("rec_id", "e.slice", F.col("e.idx").alias("entry"))
    started = F.struct(F.col("entry").alias("at"), F.array().cast(slices.schema["hops"].dataType).alias("out"))
    take = lambda s, h: F.when(h["idx"] == s["at"], F.struct(h["next"].alias("at"), F.concat(s["out"], F.array(h)).alias("out"))).otherwise(s)
    chunks = slices.join(entered, ["rec_id", "slice"]).select("rec_id", "slice", F.explode(F.aggregate("hops", started, take, lambda s: s["out"])).alias("h"))
    chunks = chunks.select("rec_id", "slice", F.col("h.idx").alias("idx"), F.col("h.a").alias("start"), F.col("h.end").alias("end"), F.lit(1).alias("one"))
    return running_sum(chunks, ["rec_id"], ["idx"], "one", F.col("slice"), "n").select("rec_id", (F.col("n") - 1).cast("int").alias("chunk"), "start", "end")


def quietest(samples: np.ndarray, lo: float, hi: float, rate: int = RATE) -> float:
    """The middle of the quietest window of samples of [lo, hi) seconds, the first of equals; the middle of both if there is no window.

    Levels come from running sums of squares, which are exact for 16-bit samples.
    """
    window, hop = int(QUIET_WINDOW * rate), int(QUIET_HOP * rate)
    if len(samples) <= window:
        return (lo + hi) / 2
    sums = np.concatenate([[0], np.cumsum(samples.astype(np.int64) ** 2)])
    at = np.arange(0, len(samples) - window, hop)
    return lo + (int(at[(sums[at + window] - sums[at]).argmin()]) + window / 2) / rate


class _Cutter:
    """Cuts one chunk while its samples come in order; it holds those of one search at most."""

    def __init__(self, start: float, end: float, most: float, search: float, rate: int):
        self.start, self.end, self.most, self.search, self.rate = start, end, most, search, rate
        self.held, self.first = np.zeros(0, np.int16), None
        self.cuts = [start]

    def _take(self, lo: float, hi: float) -> np.ndarray:
        a, b = int(lo * self.rate), int(hi * self.rate)
        return self.held[max(0, a - (self.first or 0)) : max(0, b - (self.first or 0))]

    def move(self, whole: bool) -> None:
        """All cuts for which the samples are there, or which are left when no more will come."""
        while self.end - self.start > self.most:
            lo, hi = self.start + self.most - self.search, self.start + self.most
            if not whole and (self.first is None or self.first + len(self.held) < int(hi * self.rate)):
                break
            self.start = quietest(self._take(lo, hi), lo, hi, self.rate)
            self.cuts.append(self.start)
        past = int((self.start + self.most - self.search) * self.rate) - (self.first or 0)
        if past > 0:
            self.first, self.held = (self.first or 0) + min(past, len(self.held)), self.held[past:]

    def add(self, first: int, pcm: np.ndarray) -> None:
        if self.first is None or first > self.first + len(self.held):  # samples that are missing are silence
            at = self.first if self.first is not None else first
            self.held, self.first = np.concatenate([self.held, np.zeros(first - at - len(self.held), np.int16)]), at
        self.held = np.concatenate([self.held, pcm[self.first + len(self.held) - first :]])
        self.move(False)


def split_long(chunks: DataFrame, pcm: DataFrame, most: float = MOST, search: float = SEARCH, rate: int = RATE) -> DataFrame:
    """(rec_id, chunk, part, start, end): chunks (rec_id, chunk, start, end) longer than `most` cut at the quietest place of the
    last `search` seconds before that, again and again, from pcm (rec_id, first, pcm) with rows of a second at most.

    Only samples of long chunks move, to where their chunk is cut, in order of time; a task holds `search` seconds of them.
    Where there are no samples a cut is in the middle of the search.
    """
    long, key = F.col("end") - F.col("start") > most, ["rec_id", "chunk"]
    kind = dict(chunks.dtypes)
    told = chunks.where(long).select(*key, "start", "end")
    none = told.select(*key, "start", "end", F.lit(-1).cast("long").alias("first"), F.lit(None).cast("array<smallint>").alias("pcm"))
    second = F.explode(F.sequence(F.floor("start") - 1, F.floor("end")))
    rows = told.withColumn("second", second).join(pcm.select("rec_id", F.floor(F.col("first") / rate).alias("second"), F.col("first").cast("long").alias("first"), F.col("pcm").cast("array<smallint>").alias("pcm")), ["rec_id", "second"])
    both = none.unionByName(rows.drop("second"))
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(n, *key).sortWithinPartitions(*key, "first")
    out = pa.schema([("part", pa.int32()), ("start", pa.float64()), ("end", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]):
        of, cutter = None, None

        def done():
            cutter.move(True)
            cuts = [*cutter.cuts, cutter.end]
            ids = [pa.array([v] * (len(cuts) - 1), t) for v, t in zip(of, kinds)]
            return pa.RecordBatch.from_arrays([*ids, pa.array(range(len(cuts) - 1), pa.int32()), pa.array(cuts[:-1]), pa.array(cuts[1:])], names=[*key, *out.names])

        for b in batches:
            kinds = [b.schema.field(k).type for k in key]
            for r in range(b.num_rows):
                this = tuple(b.column(k)[r].as_py() for k in key)
                if this != of:
                    if cutter:
                        yield done()
                    of, cutter = this, _Cutter(b.column("start")[r].as_py(), b.column("end")[r].as_py(), most, search, rate)
                samples = b.column("pcm")[r]
                if samples.is_valid:
                    cutter.add(b.column("first")[r].as_py(), samples.values.to_numpy())
        if cutter:
            yield done()

    cut = dealt.mapInArrow(run, f"rec_id {kind['rec_id']}, chunk {kind['chunk']}, part int, start double, end double")
    return chunks.where(~long).select(*key, F.lit(0).alias("part"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")).unionByName(cut)
