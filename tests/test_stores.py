"""Growing recordings, files written by jobs, folders."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.plans.documents import batch_report
from lectern.sources import audio, folders, recordings, writers


def wav(samples, tail=b""):
    return b"\0" * audio.HEADER + np.asarray(samples, "<i2").tobytes() + tail


def samples_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["path"], r["first"])):
        name = os.path.basename(r["path"])
        assert r["first"] == len(out.get(name, [])), "no gap and no repetition"
        out[name] = out.get(name, []) + r["pcm"]
    return out


@pytest.mark.parametrize("range_bytes", [1, 32_000, 100_000, 8 << 20])
def test_any_ranges_give_the_same_samples(spark, tmp_path, range_bytes):
    want = {"a.wav": np.arange(-20_000, 30_000) % 30_000, "b.wav": np.arange(7), "sub/c.wav": np.arange(16_000)}
    (tmp_path / "sub").mkdir()
    for name, s in want.items():
        (tmp_path / name).write_bytes(wav(s))
    (tmp_path / "short.wav").write_bytes(b"RIFF")
    (tmp_path / "half.wav").write_bytes(wav([], b"x"))
    (tmp_path / ".part.wav").write_bytes(wav([1]))
    (tmp_path / "note.txt").write_bytes(b"text")
    df = recordings.read(spark, str(tmp_path), range_bytes)
    got = samples_of(df)
    assert got == {os.path.basename(k): v.tolist() for k, v in want.items()}
    assert df.rdd.getNumPartitions() >= min(4, 100_000 // range_bytes)
    assert df.selectExpr("max(size(pcm))").first()[0] <= audio.RATE


def test_empty_and_missing_folders(spark, tmp_path):
    assert recordings.read(spark, str(tmp_path)).count() == 0
    assert recordings.read(spark, str(tmp_path / "none")).count() == 0


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    r = np.random.default_rng(1)
    full = {f"r{i}.wav": r.integers(-30_000, 30_000, 40_000 + i) for i in range(4)}
    for upto in (0, 1, 15_999, 16_001, 39_000, 50_000):
        for i, (name, s) in enumerate(full.items()):
            if i < 3 or upto > 16_000:  # one file comes later
                half = s[upto : upto + 1].astype("<i2").tobytes()[:1]  # a sample of which one byte is there
                (source / name).write_bytes(wav(s[:upto], half))
        # each run is a new query, as after a crash: only the checkpoint is left
        recordings.read_stream(spark, str(source), 50_000).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
        got = samples_of(spark.read.schema(recordings.SCHEMA).parquet(out))
        assert got == {k: v[:upto].tolist() for k, v in full.items() if upto and (source / k).exists()}


def test_a_file_that_shrinks_is_an_error(tmp_path):
    (tmp_path / "a.wav").write_bytes(wav(range(100)))
    reader = recordings.GrowingReader({"path": str(tmp_path)})
    end = reader.latestOffset()
    (tmp_path / "a.wav").write_bytes(wav(range(50)))
    assert reader.latestOffset() == end
    with pytest.raises(EOFError):
        list(reader.read(reader.partitions({}, end)[0]))


def test_available_seconds_counts_whole_samples(spark):
    got = spark.createDataFrame([(0,), (44,), (45,), (46,), (47,), (44 + 32_000,)], "n long").select(audio.available_seconds(F.col("n"))).collect()
    assert [r[0] for r in got] == [0, 0, 0, 1 / 16_000, 1 / 16_000, 1.0]


def tree(path):
    return {os.path.relpath(os.path.join(d, f), path): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(path) for f in names}


def test_failed_job_leaves_nothing_and_another_writes_all(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("d"), (F.col("id") % 3).cast("string"), F.lit("/é "), F.col("id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("---\nby: us\n---\n"), F.col("id").cast("string")).alias("content"))
    (tmp_path / "d0").mkdir()
    (tmp_path / "d0" / "é 0.md").write_text("mine; by: us")
    (tmp_path / "d1").mkdir()
    (tmp_path / "d1" / "é 1.md").write_text("---\nby: us\n---\nold")
    before = tree(tmp_path)
    failing = rows.withColumn("content", F.when(F.col("path").endswith("39.md"), F.raise_error(F.lit("no"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no"):
        writers.write_files(failing, str(tmp_path), "by: us")
    assert tree(tmp_path) == before and not [d for d in os.listdir(tmp_path) if d.startswith(writers.STAGING)]
    for _ in range(2):
        writers.write_files(rows, str(tmp_path), "by: us")
        got = tree(tmp_path)
        assert got.pop("d0/é 0.md") == b"mine; by: us"
        assert got == {r["path"]: r["content"].encode() for r in rows.collect() if r["path"] != "d0/é 0.md"}
    assert sorted(os.listdir(tmp_path)) == ["d0", "d1", "d2"]


def test_foreign_files(spark, tmp_path):
    rows = spark.createDataFrame([("a.md", "new"), ("b.md", "new"), (None, "x"), ("c.md", None)], "path string, content string")
    (tmp_path / "a.md").write_text("other")
    with pytest.raises(Exception, match="is not ours"):
        writers.write_files(rows, str(tmp_path), "m", writers.FAIL)
    assert tree(tmp_path) == {"a.md": b"other"}
    writers.write_files(rows, str(tmp_path), "m", writers.REPLACE)
    assert tree(tmp_path) == {"a.md": b"new", "b.md": b"new"}
    for bad in ("../x.md", "/etc/x", "a/../../x"):
        with pytest.raises(Exception, match="not below"):
            writers.write_files(spark.createDataFrame([(bad, "x")], "path string, content string"), str(tmp_path))
    writers.write_files(rows.limit(0), str(tmp_path / "empty"))
    assert tree(tmp_path) == {"a.md": b"new", "b.md": b"new"}


def test_folder_as_a_batch_finds_it(spark, tmp_path):
    root = tmp_path / "a+b c%20"
    files = {"x.TXT": "1", "Sub/y.txt": "22", ".git/z.txt": "3", "p.Assets/q.png": "4", "~$x.txt": "5", "Sub/shown.png": "6", "Sub/alone.png": "7", "Sub/page.md": "![i](shown.png)", "no.bin": "8", "ümlaut #1.txt": "9"}
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    got = [r["path"] for r in folders.expanded(spark, str(root), [".txt", ".png"]).collect()]
    assert got == ["Sub/alone.png", "Sub/y.txt", "x.TXT", "ümlaut #1.txt"]
    assert {r["path"] for r in folders.listing(spark, str(root), recursive=False).collect()} == {"x.TXT", "~$x.txt", "no.bin", "ümlaut #1.txt"}
    assert {r["path"]: bytes(r["content"]) for r in folders.contents(spark, str(root), [".bin", ".txt"]).collect()}["Sub/y.txt"] == b"22"


def test_report_names_the_first_paths(spark):
    rows = [(f"p{i:03}", None, None) for i in range(50)] * 2 + [("q", "bad", None), (None, "bad", None), ("s", None, "old")]
    got = {r["state"]: (r["files"], r["names"]) for r in batch_report(spark.createDataFrame(rows, "path string, error string, skipped string")).collect()}
    assert got == {"converted": (100, [f"p{i:03}" for i in range(20)]), "failed": (2, ["q"]), "skipped": (1, ["s"])}
