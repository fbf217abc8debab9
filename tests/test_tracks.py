"""Live work against a plain loop; batches of any size, failures and restarts give the rows of one run."""

import os
import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.streaming import live, tracks


def levels_of(track, n, seed, hush=0.02):
    r = np.random.default_rng(seed)
    return [(track, k * 0.5, float(r.integers(900, 5000)) if r.random() > hush else 100.0) for k in range(n)]


def engine(track, start, end, attempt):
    if attempt < int(start * 4) % 3:
        raise ConnectionError("busy")
    return [(0.25, end - start, f"{track}@{start}#{attempt}")]


def plainly(levels, retry=60.0):
    """One loop over a track's levels, as if it were polled at the end of each window and when a retry is due."""
    track, out = levels[0][0], []
    done, step, attempt = 0.0, 0, 0
    due = None
    at, rms = [], []

    def run(end):
        nonlocal done, step, attempt
        if end - done > 0.05:
            out.extend((track, step, done, end, done + a, done + b, t) for a, b, t in engine(track, done, end, attempt))
        done, step, attempt = end, step + 1, 0

    def poll(now):
        nonlocal attempt, due
        if due is not None and now < due:
            return
        due = None
        while True:
            a, r = np.array(at), np.array(rms)
            cut = live.next_cut(done, a[a >= done], r[a >= done])
            if cut is None:
                return
            try:
                run(cut)
            except ConnectionError:
                attempt += 1
                due = now + retry
                return

    for _, a, r in levels:
        if due is not None and due < a + 0.5:
            poll(due)
        at.append(a)
        rms.append(r)
        poll(a + 0.5)
    whole = at[-1] + 0.5
    while done < whole - 0.05:
        cut = min(done + 300, whole)
        if whole - cut > 1:
            a, r = np.array(at), np.array(rms)
            near = (a >= max(done, cut - 30)) & (a + 0.5 <= cut)
            cut = float(a[near][r[near].argmin()]) + 0.25 if near.sum() >= 2 else cut
        while True:
            try:
                run(cut)
                break
            except ConnectionError:
                attempt += 1
    return out


def arriving(spark, tmp_path, rows, cuts):
    """A stream of files: rows in order of time, cut at the given places; files are read one to a batch."""
    folder = tmp_path / "levels"
    folder.mkdir()
    schema = "track string, ts timestamp, at double, rms double"
    rows = sorted(rows, key=lambda r: (r[1] + 0.5 * (r[2] is not None), r[0]))
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        data = pd.DataFrame([(t, pd.Timestamp(1_700_000_000 + x + 0.5 * (r is not None), unit="s", tz="UTC"), x, r) for t, x, r in rows[a:b]], columns=["track", "ts", "at", "rms"])
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / f"one{i}"))
        part = next(f for f in os.listdir(tmp_path / f"one{i}") if f.startswith("part-"))
        target = folder / f"{i:04}.parquet"
        shutil.copy(tmp_path / f"one{i}" / part, target)
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_rows_are_those_of_a_plain_loop_in_any_batches_and_after_failures(spark, tmp_path):
    all_levels = {"a": levels_of("a", 2600, 1), "b": levels_of("b", 1500, 2, hush=0), "c": levels_of("c", 90, 3)}
    want = sorted(x for rows in all_levels.values() for x in plainly(rows))
    assert any("#2" in x[-1] for x in want), "some steps fail more than once"
    rows = [x for v in all_levels.values() for x in v] + [(t, v[-1][1] + 0.5, None) for t, v in all_levels.items()]
    stream = tracks.transcribed(arriving(spark, tmp_path, rows, [700, 701, 2500, 3300]), engine)
    assert stream.isStreaming
    out, state, failed = str(tmp_path / "out"), str(tmp_path / "state"), []

    def sink(batch, number):
        # the batch is written and then its job fails: it comes again, under the same number
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number in (1, 3) and number not in failed:
            failed.append(number)
            raise OSError("lost")

    with tracks.state_in_rocksdb(spark):
        for _ in range(4):
            try:
                stream.writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
                break
            except Exception as e:
                assert "lost" in str(e)
    assert failed == [1, 3]
    got = spark.read.schema(tracks.SEGMENTS).parquet(*[f"{out}/{d}" for d in os.listdir(out)])
    assert sorted(tuple(r) for r in got.collect()) == want
    assert [r["start"] for r in tracks.snapshot(got.union(got)).collect()] == sorted(x[4] for x in want)
    assert tracks.transcribed_until(got).first()[0] == min(max(x[3] for x in want if x[0] == t) for t in all_levels)


def test_a_retry_is_due_without_new_rows(spark, tmp_path):
    """Another track's rows move the watermark past the retry of one that is silent."""
    quiet = [("s", k * 0.5, 100.0) for k in range(121)]  # the first cut is tried at 60 s
    other = [("o", k * 0.5, 5000.0) for k in range(600)]

    def busy(track, start, end, attempt):
        if not attempt:
            raise ConnectionError
        return [(0.0, end - start, str(attempt))]

    stream = tracks.transcribed(arriving(spark, tmp_path, quiet + other, [242, 600]), busy)
    with tracks.state_in_rocksdb(spark):
        live.drain(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = [tuple(r) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).where("track = 's'").collect()]
    assert [(g[1], g[6]) for g in got] == [(0, "1")] and 30 <= got[0][3] <= 60.5


@pytest.mark.parametrize("seconds, fails", [(0.0, None), (10.0, None), (299.5, None), (300.0, None), (314.0, None), (316.0, None), (900.0, None), (1000.0, 1), (1000.0, 0)])
def test_chunks_own_each_second_once(spark, tmp_path, seconds, fails):
    folder = tmp_path / "in"
    for i, s in enumerate([seconds / 3, seconds / 2, seconds]):
        spark.createDataFrame([("t", s, s == seconds and i == 2)], "track string, seconds double, ended boolean").coalesce(1).write.mode("append").parquet(str(folder))

    def analyse(track, chunk):
        if chunk == fails:
            raise MemoryError

    lengths = spark.readStream.schema("track string, seconds double, ended boolean").parquet(str(folder))
    with tracks.state_in_rocksdb(spark):
        live.drain(tracks.chunked(lengths, analyse), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted(tuple(r) for r in spark.read.schema(tracks.CHUNKS).parquet(str(tmp_path / "out")).collect())
    assert [g[1] for g in got] == list(range(len(got))) and got
    assert got[0][4] == 0 and got[-1][5] == seconds and all(a[5] == b[4] for a, b in zip(got, got[1:]))
    assert all(g[2] <= g[4] and g[5] <= g[3] and g[3] - g[2] <= 300 for g in got)
    assert [g[6] for g in got] == [c * 270 + 300 <= seconds and (fails is None or c < fails) for c in range(len(got))]


def left_plainly(marks):
    began, held, out = marks[0][0], [], []
    for t, d in marks:
        if held and d < held[-1][1]:
            held = []
        if not held or t - held[-1][0] >= 5:
            held.append((t, d))
        window = min(max((t - began) / 4, 120), 300)
        inside = [k for k, s in enumerate(held) if s[0] <= t - window]
        held = held[max(inside, default=0) :]
        span, gained = t - held[0][0], d - held[0][1]
        out.append((t, d, (1 - d) * span / gained if 0.1 <= d < 1 and span >= 30 and gained > 0 else None))
    return out


def test_progress_is_the_same_in_any_batches(spark, tmp_path):
    from lectern.streaming import progress

    r = np.random.default_rng(3)
    jobs = {}
    for job in "ab":
        t = np.cumsum(r.choice([0.5, 2.0, 20.0, 90.0], 300))
        d = np.minimum(np.cumsum(r.random(300) * 0.008), 1.0)
        d[150:] = np.minimum(np.cumsum(r.random(150) * 0.015), 1.0)
        jobs[job] = list(zip(t.tolist(), d.tolist()))
    folder = tmp_path / "marks"
    for i, cut in enumerate(np.array_split(np.arange(300), [1, 40, 41, 200])):
        rows = [(j, *m[k]) for j, m in jobs.items() for k in cut]
        spark.createDataFrame(rows, "job string, t double, done double").coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        part = next(f for f in os.listdir(tmp_path / f"p{i}") if f.startswith("part-"))
        folder.mkdir(exist_ok=True)
        shutil.copy(tmp_path / f"p{i}" / part, folder / f"{i}.parquet")
        os.utime(folder / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = progress.remaining(spark.readStream.schema("job string, t double, done double").option("maxFilesPerTrigger", 1).parquet(str(folder)))
    with tracks.state_in_rocksdb(spark):
        live.drain(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.schema(progress.SCHEMA).parquet(str(tmp_path / "out")).collect()
    for job, marks in jobs.items():
        mine = sorted((x["t"], x["done"], x["left"]) for x in got if x["job"] == job)
        want = left_plainly(marks)
        assert [m[:2] for m in mine] == [w[:2] for w in want]
        assert [m[2] for m in mine] == [w[2] if w[2] is None else pytest.approx(w[2]) for w in want] and any(w[2] for w in want)
