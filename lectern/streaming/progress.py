"""How long jobs will take, from a stream of progress marks."""

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

#: Seconds between samples; the window is this share of what has passed, within these bounds.
GAP, SHARE, SHORTEST, LONGEST = 5.0, 0.25, 120.0, 300.0
#: Share that must be done, and seconds that samples must span, before anything is said.
LEAST, SPAN = 0.10, 30.0
SCHEMA = "job string, t double, done double, left double"


class Remaining(StatefulProcessor):
    """Rows (job, t, done) in, (job, t, done, left) out. State: when the job began, and the samples of the window with one beyond it."""

    def init(self, handle) -> None:
        self.began = handle.getValueState("began", "t double")
        self.samples = handle.getListState("samples", "t double, done double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        marks = pd.concat(list(rows)).sort_values("t", kind="stable")
        held = deque(tuple(s) for s in self.samples.get()) if self.samples.exists() else deque()
        began = self.began.get()[0] if self.began.exists() else float(marks["t"].iloc[0])
        out = []
        for t, done in zip(marks["t"].astype(float), marks["done"].astype(float)):
            if held and done < held[-1][1]:  # it has begun anew
                held.clear()
            if not held or t - held[-1][0] >= GAP:
                held.append((t, done))
            past = t - min(max((t - began) * SHARE, SHORTEST), LONGEST)
            while len(held) > 1 and held[1][0] <= past:
                held.popleft()
            span, gained = t - held[0][0], done - held[0][1]
            told = LEAST <= done < 1.0 and span >= SPAN and gained > 0
            out.append((key[0], t, done, (1.0 - done) * span / gained if told else None))
        self.began.update((began,))
        self.samples.put(list(held))
        yield pd.DataFrame(out, columns=["job", "t", "done", "left"]).astype({"left": float})

    def close(self) -> None:
        pass


def remaining(marks: DataFrame) -> DataFrame:
    """(job, t, done, left): seconds to go at each mark (job, t, done) of a stream, null while it is too early to tell.

    The rate is that of a window of a quarter of the time that has passed, of two minutes at least and five at most; it starts
    anew when a job falls back. Marks of a job come in order of t; a job's state is some sixty samples.
    """
    return marks.groupBy("job").transformWithStateInPandas(Remaining(), SCHEMA, "Append", "None")
