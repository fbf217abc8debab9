"""Work on recordings while they run: spans are transcribed as they come, and chunks are analysed when they are full.

Each track is a key with state: how far the work is done, the levels behind that place,
and when a step that failed may be tried again. A step has a number, and the state moves
on only when the step has given its rows; so a batch that fails and is run again gives
the rows that it would have given, under the same numbers. Polls happen when a row comes
and when a retry is due, in order of their time, whatever the batches are.

State lives in RocksDB (see state_in_rocksdb()), timers fire by the watermark of `ts`.
"""

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from lectern.streaming.live import LATER, SEARCH, WINDOW, next_cut

#: Seconds until a failed step is tried again; the end of a track is not cut off from less than LEFT seconds.
RETRY, LEFT, EPSILON = 60.0, 1.0, 0.05
#: Tries of a step at the end of a track, when nothing more will come.
TRIES = 3
#: Windows of the analysis of speakers, and how much two of them share.
CHUNK, OVERLAP = 300.0, 30.0
#: (track, start, end, attempt) -> (start, end, text) of segments, counted from the span's start.
Engine = Callable[[str, float, float, int], list[tuple[float, float, str]]]
SEGMENTS = "track string, step long, span_start double, span_end double, start double, end double, text string"
CHUNKS = "track string, chunk long, start double, end double, own_from double, own_to double, live boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_in_rocksdb(spark: SparkSession):
    """Queries started in this block keep their state in RocksDB, which states of several variables need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def quiet_cut(done: float, to: float, at: np.ndarray, rms: np.ndarray) -> float:
    """The middle of the quietest window of the last half minute before `to`; `to` itself if there are not two."""
    near = (at >= max(done, to - SEARCH) - 1e-9) & (at + WINDOW <= to + 1e-9)
    return float(at[near][rms[near].argmin()]) + WINDOW / 2 if near.sum() >= 2 else to


class Transcriber(StatefulProcessor):
    """Rows (track, ts, at, rms) in, segments out; rms is null in a track's last row, whose at is the length."""

    def __init__(self, engine: Engine, retry: float = RETRY):
        self.engine, self.retry = engine, retry

    def init(self, handle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "done double, step long, attempt int, due long")
        self.levels = handle.getListState("levels", "at double, rms double")

    def _load(self) -> None:
        place = self.place.get() if self.place.exists() else None
        self.done, self.step, self.attempt, self.due = place or (0.0, 0, 0, None)
        held = list(self.levels.get()) if self.levels.exists() else []
        self.at, self.rms = [x[0] for x in held], [x[1] for x in held]
        self.out: list[tuple] = []

    def _store(self) -> None:
        self.place.update((self.done, self.step, self.attempt, self.due))
        behind = [(a, r) for a, r in zip(self.at, self.rms) if a >= self.done]
        self.levels.put(behind) if behind else self.levels.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if self.due is not None:
            self.handle.registerTimer(self.due)

    def _run(self, track: str, end: float) -> None:
        """The next step, up to end. Raises what the engine raises, with nothing moved on."""
        rows = self.engine(track, self.done, end, self.attempt) if end - self.done > EPSILON else []
        self.out += [(track, self.step, self.done, end, self.done + a, self.done + b, text) for a, b, text in rows]
        self.done, self.step, self.attempt, self.due = end, self.step + 1, 0, None

    def _poll(self, track: str, now: int) -> None:
        if self.due is not None and now < self.due:
            return
        self.due = None
        while True:
            at, rms = np.array(self.at), np.array(self.rms)
            behind = at >= self.done
            cut = next_cut(self.done, at[behind], rms[behind])
            if cut is None:
                return
            try:
                self._run(track, cut)
            except Exception:  # whatever the engine's trouble is, it is tried again later, with what has come by then
                self.attempt += 1
                self.due = now + int(self.retry * 1000)
                return

    def _finish(self, track: str, length: float) -> None:
        """What is left, in spans of five minutes, each tried TRIES times at once. A failure then fails the batch, which is run again."""
        at, rms = np.array(self.at), np.array(self.rms)
        while self.done < length - EPSILON:
            cut = min(self.done + LATER, length)
            if length - cut > LEFT:
                cut = quiet_cut(self.done, cut, at, rms)
            for left in range(TRIES - 1, -1, -1):
                try:
                    self._run(track, cut)
                    break
                except Exception:
                    if not left:
                        raise
                    self.attempt += 1
        self.place.clear()
        self.levels.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def _given(self) -> pd.DataFrame:
        return pd.DataFrame(self.out, columns=["track", "step", "span_start", "span_end", "start", "end", "text"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        new = pd.concat(list(rows)).sort_values("at", kind="stable")
        ended = False
        for ts, at, rms in zip(new["ts"], new["at"], new["rms"]):
            now = int(pd.Timestamp(ts).timestamp() * 1000)
            if self.due is not None and self.due < now:
                self._poll(key[0], self.due)
            if pd.isna(rms):
                self._finish(key[0], float(at))
                self.done, self.step, self.attempt, self.due, self.at, self.rms = 0.0, 0, 0, None, [], []
                ended = True
                continue
            self.at.append(float(at))
            self.rms.append(float(rms))
            ended = False
            self._poll(key[0], now)
        if not ended:
            self._store()
        yield self._given()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        if self.due is not None:
            self._poll(key[0], self.due)
            self._store()
        yield self._given()

    def close(self) -> None:
        pass


def transcribed(levels: DataFrame, engine: Engine, retry: float = RETRY, late: str = "10 seconds") -> DataFrame:
    """Segments (track, step, span_start, span_end, start, end, text) of a stream of levels (track, ts, at, rms).

    Levels of a track come in order of at, of windows of half a second; ts is the time at a window's end. A span ends where
    next_cut() says. If the engine fails, the track waits `retry` seconds and cuts anew with what has come by then; other
    tracks go on. The row with a null rms ends a track: what is left is done at once, and its state goes.
    """
    x = levels.withWatermark("ts", late).groupBy("track")
    return x.transformWithStateInPandas(Transcriber(engine, retry), SEGMENTS, "Append", "EventTime")


class Chunker(StatefulProcessor):
    """Rows (track, seconds, ended) in, chunks to analyse out. analyse(track, chunk) may fail: then all waits for the end."""

    def __init__(self, analyse: Callable[[str, int], None], chunk: float, overlap: float):
        self.analyse, self.window, self.step, self.overlap = analyse, chunk, chunk - overlap, overlap

    def init(self, handle) -> None:
        self.next = handle.getValueState("next", "chunk long, given_up boolean")

    def _row(self, track: str, c: int, end: float, last: bool, live: bool) -> tuple:
        start = c * self.step
        return track, c, start, end, 0.0 if c == 0 else start + self.overlap / 2, end if last else start + self.window - self.overlap / 2, live

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        track = key[0]
        chunk, given_up = self.next.get() if self.next.exists() else (0, False)
        out = []
        for seconds, ended in pd.concat(list(rows)).sort_values(["seconds", "ended"])[["seconds", "ended"]].itertuples(index=False):
            while not given_up and chunk * self.step + self.window <= seconds + 1e-9:
                try:
                    self.analyse(track, chunk)
                except Exception:  # it was only meant to save time: the end does the rest
                    given_up = True
                    break
                out.append(self._row(track, chunk, chunk * self.step + self.window, False, True))
                chunk += 1
            if ended:
                whole = max(1, int(np.ceil(max(0.0, seconds - self.overlap) / self.step - 1e-9)))
                if chunk >= whole:  # all are done as if more came: what the last did not own is left
                    if seconds > chunk * self.step + self.overlap / 2:
                        out.append(self._row(track, chunk, seconds, True, False))
                else:
                    out += [self._row(track, c, min(c * self.step + self.window, seconds), c == whole - 1, False) for c in range(chunk, whole)]
                self.next.clear()
                chunk, given_up = 0, False
            else:
                self.next.update((chunk, given_up))
        yield pd.DataFrame(out, columns=["track", "chunk", "start", "end", "own_from", "own_to", "live"])

    def close(self) -> None:
        pass


def chunked(lengths: DataFrame, analyse: Callable[[str, int], None], chunk: float = CHUNK, overlap: float = OVERLAP) -> DataFrame:
    """(track, chunk, start, end, own_from, own_to, live) of a stream of lengths so far (track, seconds, ended).

    A chunk is given as soon as it is full and analysed. What it owns ends in the middle of the overlap with its neighbours,
    so that each second of a track is owned once. If analyse() fails, the rest of the track waits for its end; those
    chunks, and the last one, have live = false.
    """
    return lengths.groupBy("track").transformWithStateInPandas(Chunker(analyse, chunk, overlap), CHUNKS, "Append", "None")


def snapshot(segments: DataFrame) -> DataFrame:
    """Segments of all tracks by time, each step once, however often a sink that repeats has written it."""
    return segments.dropDuplicates(["track", "step", "start", "end", "text"]).orderBy("start", "end", "track")


def transcribed_until(segments: DataFrame) -> DataFrame:
    """One row: the second up to which all tracks that have a row are done."""
    return segments.groupBy("track").agg(F.max("span_end").alias("done")).agg(F.coalesce(F.min("done"), F.lit(0.0)).alias("until"))
