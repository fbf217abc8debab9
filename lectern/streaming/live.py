"""Live recordings as Structured Streaming: cut points, owned windows, diagnostics.

Inputs are streams of small rows (levels, segments, pulls); offsets and state live in the
query's checkpoint, so work that failed is replayed and nothing is counted twice.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators.islands import chunk_number

FIRST, LATER, SEARCH, DEFER = 60.0, 300.0, 30.0, 300.0
WINDOW, QUIET, QUIET_SHARE, TAIL = 0.5, 300.0, 0.3, 2.0


def next_cut(done: float, at: np.ndarray, rms: np.ndarray, window: float = WINDOW) -> float | None:
    """Where to cut what lies behind `done`, from levels of windows that start at `at`; None to wait for more.

    A minute must have passed for the first cut and five for later ones. The quietest window since half a minute before
    that is taken if it is quiet enough, after five more minutes in any case.
    """
    if not len(at):
        return None
    avail = float(at[-1]) + window
    least = FIRST if done == 0 else LATER
    if avail - done < least:
        return None
    near = at >= max(done, done + least - SEARCH) - 1e-9
    a, r = at[near], rms[near]
    forced = avail - done >= least + DEFER
    if len(a) < 2:
        return avail if forced else None
    best = int(r.argmin())
    if r[best] <= max(QUIET, QUIET_SHARE * float(np.median(r))) or forced:
        return float(a[best]) + window / 2
    return None


def cuts(levels: DataFrame) -> DataFrame:
    """(track, start, end): spans to transcribe, from a stream of levels (track, at, rms) in order of at for each track.

    State is the end of the last span and the levels behind it: ten minutes of them and a little more at most. A level is
    tried only once enough has passed, against the levels that a cut can lie at, so that time is linear in the levels.
    """

    def step(key, batches, state: GroupState):
        done, at, rms = state.get if state.exists else (0.0, [], [])
        seen = len(at)
        new = [(b["at"].to_numpy(float), b["rms"].to_numpy(float)) for b in batches]
        at, rms = np.concatenate([at, *(a for a, _ in new)]), np.concatenate([rms, *(r for _, r in new)])
        order = at.argsort(kind="stable")
        at, rms = at[order], rms[order]
        out = []
        # levels one after the other, so that how they are dealt to batches makes no difference
        i = seen
        while i < len(at):
            least = FIRST if done == 0 else LATER
            # a little early: next_cut() has the exact bounds
            i = max(i, int(at.searchsorted(done + least - WINDOW - 1e-6)))
            first = int(at.searchsorted(max(done, done + least - SEARCH - 1e-6)))
            cut = None
            while i < len(at) and cut is None:
                i += 1
                cut = next_cut(done, at[first:i], rms[first:i])
            if cut is not None:
                out.append((key[0], done, cut))
                done = cut
        left = at >= done
        state.update((done, at[left].tolist(), rms[left].tolist()))
        yield pd.DataFrame(out, columns=["track", "start", "end"])

    return levels.groupBy("track").applyInPandasWithState(step, "track string, start double, end double", "done double, at array<double>, rms array<double>", "append", GroupStateTimeout.NoTimeout)


def shifted(segments: DataFrame) -> DataFrame:
    """Segments (track, span_start, start, end, text) with times from the recording's start."""
    return segments.withColumns({"start": F.col("span_start") + F.col("start"), "end": F.col("span_start") + F.col("end")})


def owned_counts(events: DataFrame, total: Column, window: float = 900.0, overlap: float = 30.0) -> DataFrame:
    """(rec_id, chunk, events, seconds): events (rec_id, start, end) by the overlapping window that owns their middle, each once."""
    middle = (F.col("start") + F.col("end")) / 2
    x = events.withColumn("chunk", chunk_number(middle, total, window, overlap))
    return x.groupBy("rec_id", "chunk").agg(F.count("*").alias("events"), F.sum(F.col("end") - F.col("start")).alias("seconds"))


def capture_diagnostics(pulls: DataFrame, window: str = "30 seconds", late: str = "2 seconds") -> DataFrame:
    """(track, window, pulls, longest, p95, stalls) of a stream of pulls (track, ts, ms); a window is final two seconds after its end.

    A window holds some hundred pulls, so they fit the array that the percentile is taken from.
    """
    sorted_ms = F.sort_array(F.collect_list("ms"))
    x = pulls.withWatermark("ts", late).groupBy("track", F.window("ts", window)).agg(F.count("*").alias("pulls"), F.max("ms").alias("longest"), sorted_ms.alias("v"), F.count_if(F.col("ms") >= 40).alias("stalls"))
    return x.select("track", "window", "pulls", "longest", F.get("v", F.least(F.size("v") - 1, F.floor(F.size("v") * 0.95)).cast("int")).alias("p95"), "stalls")


def rate_limited(events: DataFrame, keys: list[str], every: str = "60 seconds") -> DataFrame:
    """A stream of events (ts, keys, ...) with repetitions of a key within the time left out."""
    return events.withWatermark("ts", every).dropDuplicatesWithinWatermark(keys)


def progress(updates: DataFrame) -> DataFrame:
    """(job, stage, done): the furthest of each stage; it never goes back."""
    return updates.groupBy("job", "stage").agg(F.max("done").alias("done"))


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there goes to Parquet at path; what a former run has written is not read again."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def latest(stream: DataFrame, path: str, checkpoint: str) -> None:
    """The state of an aggregation once everything that is there has been read goes to Parquet at path."""
    whole = lambda rows, _: rows.write.mode("overwrite").parquet(path)
    stream.writeStream.foreachBatch(whole).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start().awaitTermination()


def done_seconds(chunk: Column, step: float, overlap: float = 30.0) -> Column:
    """Seconds that are settled when the next chunk is number `chunk`: those that it does not own any more."""
    return F.when(chunk <= 0, F.lit(0.0)).otherwise(chunk * F.lit(step) + F.lit(overlap / 2))
