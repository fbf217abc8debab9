"""Operators against plain versions on random small inputs with ties."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import audit, batches, cluster, identity, intervals, islands, layout, packing, repeats, sampling, transcripts

SEGMENTS = "rec_id long, seq long, start double, end double, text string"
TURNS = "rec_id long, idx long, start double, end double, speaker int, conf double"


def recordings(seed, n=30):
    r = random.Random(seed)
    segments, turns = [], []
    for rec in range(n):
        for seq in range(r.randint(0, 12)):
            a = r.randint(0, 60)
            segments.append((rec, seq, float(a), float(a + r.choice([0, 1, 2, 5, 9])), f"t{seq} "))
        times = sorted(r.randint(0, 60) for _ in range(r.choice([0, 1, 3, 8])))
        for i, a in enumerate(times):
            turns.append((rec, i, float(a), float(a + r.choice([0, 1, 3, 10, 25])), r.randint(-1, 3), r.choice([0.0, 0.5, 0.25, 1.0])))
    return segments, turns


def plain_speaker(a, b, turns):
    if not turns:
        return 0
    best = max(((min(b, t[3]) - max(a, t[2]), -t[1], t[4]) for t in turns), key=lambda x: x[:2])
    if best[0] > 0:
        return best[2]
    mid, found = (a + b) / 2, []
    left = [t for t in turns if t[2] < mid]
    if left:
        t = max(left, key=lambda t: (t[3], -t[1]))
        found.append((mid - t[3], t[1], t[4]))
    right = [t for t in turns if t[2] >= mid]
    if right:
        t = min(right, key=lambda t: (t[2], t[1]))
        found.append((t[2] - mid, t[1], t[4]))
    return min(found)[2]


@pytest.mark.parametrize("seed, bucket", [(1, 7.0), (2, 1800.0)])
def test_assign_speakers(spark, seed, bucket):
    segments, turns = recordings(seed)
    got = {(r["rec_id"], r["seq"]): r["speaker"] for r in intervals.assign_speakers(spark.createDataFrame(segments, SEGMENTS), spark.createDataFrame(turns, TURNS), bucket).collect()}
    assert len(got) == len(segments)
    for rec, seq, a, b, _ in segments:
        assert got[rec, seq] == plain_speaker(a, b, [t for t in turns if t[0] == rec]), (rec, seq)


def test_points_within_blocks_of_all_lengths(spark):
    """Blocks shorter than a bucket, as long as many and longer than the longest bucket; long ones do not lie in each of the short buckets."""
    r = np.random.default_rng(5)
    blocks = [(1, i, a, a + n) for i, (a, n) in enumerate((float(r.uniform(-50, 3000)), float(n)) for n in [0, 0.3, 1, 1, 3.9, 4, 17, 64, 300, 1023, 1024, 5000])] + [(1, 99, 5.0, 4.0), (1, 100, None, 9.0), (2, 0, 0.0, 1e9)]
    points = [(1, i, float(a)) for i, a in enumerate([*r.uniform(-60, 4000, 300), *[b[2] for b in blocks[:12]], *[b[3] for b in blocks[:12]]])] + [(2, 0, 5e8), (2, 1, 1e9), (2, 2, None)]
    b, p = spark.createDataFrame(blocks, "rec_id long, seq long, start double, end double"), spark.createDataFrame(points, "rec_id long, idx long, at double")
    # a block of 1e9 seconds in buckets of 1800 would be 555,556 rows; with LENGTHS it is some 500
    got = sorted((x["rec_id"], x["l_seq"], x["r_idx"]) for x in intervals.points_within(b.where("rec_id = 1"), p, 1.0).collect())
    plain = lambda rec: sorted((q[0], x[1], q[1]) for x in blocks for q in points if x[0] == q[0] == rec and x[2] is not None and q[2] is not None and x[2] <= q[2] < x[3])
    assert got == plain(1)
    assert sorted((x["rec_id"], x["l_seq"], x["r_idx"]) for x in intervals.points_within(b.where("rec_id = 2"), p).collect()) == plain(2)


def test_cohesion_and_labels(spark):
    segments, turns = recordings(3)
    s, t = spark.createDataFrame(segments, SEGMENTS), spark.createDataFrame(turns, TURNS)
    for r in intervals.cohesion(s, t, 10.0).collect():
        o = [(max(0, min(r["end"], x[3]) - max(r["start"], x[2])), x[5]) for x in turns if x[0] == r["rec_id"] and x[5]]
        w = sum(x for x, _ in o)
        assert r["cohesion"] == pytest.approx(sum(x * c for x, c in o) / w if w else 0.0)
    blocks = intervals.block_bounds(s.select("rec_id", "seq", "start"))
    by = defaultdict(list)
    for r in intervals.label_blocks(blocks, t, 10.0).collect():
        by[r["rec_id"]].append(r)
    for rec, rows in by.items():
        last = 0
        for r in sorted(rows, key=lambda r: (r["start"], r["seq"])):
            n, first = defaultdict(float), {}
            for x in turns:
                if x[0] == rec and r["start"] <= (x[2] + x[3]) / 2 < r["end"]:
                    n[x[4]] += x[3] - x[2]
                    first.setdefault(x[4], x[1])
            if n:
                last = max(n, key=lambda k: (n[k], -first[k]))
            assert r["label"] == last


def test_block_vectors(spark):
    spans = spark.createDataFrame([(1, 0.0, 2.0, [1.0, 0.0]), (1, 2.0, 3.0, [0.0, 1.0]), (1, 9.0, 9.0, None)], "rec_id long, start double, end double, vec array<double>")
    blocks = spark.createDataFrame([(1, 0, 0.0, 5.0), (1, 1, 5.0, 12.0)], "rec_id long, seq long, start double, end double")
    got = {r["seq"]: r["vector"] for r in intervals.block_vectors(spans, blocks).collect()}
    assert got[0] == pytest.approx([2 / 5**0.5, 1 / 5**0.5]) and got[1] is None


def test_speech_blocks(spark):
    rows = [(1, 0, 0.0, 9.0, 0, "a"), (1, 1, 1.0, 2.0, 0, "b"), (1, 2, 2.0, 3.0, 0, "(此段轉錄異常 x"), (1, 3, 3.0, 4.0, 0, "c"), (1, 4, 4.0, 5.0, -1, None), (1, 5, 5.0, 6.0, -1, "d")]
    got = [tuple(r) for r in islands.speech_blocks(spark.createDataFrame(rows, "rec_id long, seq long, start double, end double, speaker int, text string")).orderBy("block").collect()]
    assert [(g[2], g[3], g[4], g[5], g[6]) for g in got] == [(0, 0.0, 2.0, "ab", False), (0, 2.0, 3.0, "(此段轉錄異常 x", True), (0, 3.0, 4.0, "c", False), (-1, 4.0, 6.0, "d", False)]


def test_sliced_islands_are_islands(spark):
    r = random.Random(4)
    rows = [(rec, seq, float(seq), float(seq + 1), r.choice([0, 0, 1, None]), r.choice(["a", "b", "(此段轉錄異常 x"])) for rec in range(3) for seq in range(80)]
    df = spark.createDataFrame(rows, "rec_id long, seq long, start double, end double, speaker int, text string")
    whole = sorted(map(str, islands.speech_blocks(df).collect()))
    for width in (1, 7, 1000):
        assert sorted(map(str, islands.speech_blocks(df, F.floor(F.col("seq") / width)).collect())) == whole
    sparse = df.where("seq % 13 < 5")
    a = islands.sessions(sparse, ["rec_id"], F.col("start"), ["seq"], 2.0)
    b = islands.sessions(sparse, ["rec_id"], F.col("start"), ["seq"], 2.0, part=F.floor(F.col("seq") / 10))
    assert sorted((x["rec_id"], x["seq"], x["session"]) for x in a.collect()) == sorted((x["rec_id"], x["seq"], x["session"]) for x in b.collect())


def test_first_appearance_keeps_unknown(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate([5, -1, 2, 5, 9])], "rec_id long, seq long, label int")
    got = [r["number"] for r in islands.first_appearance(rows, ["rec_id"], F.col("seq"), "label", unknown=-1).orderBy("seq").collect()]
    assert got == [0, -1, 1, 0, 2]


def test_each_middle_has_one_chunk(spark):
    total, w, o = 4000.0, 900.0, 30.0
    rows = spark.range(4001).select(F.col("id").cast("double").alias("m"))
    got = [r["c"] for r in rows.select("m", islands.chunk_number(F.col("m"), F.lit(total), w, o).alias("c")).orderBy("m").collect()]
    count = 1 + -(-(total - w) // (w - o))
    for m, c in enumerate(got):
        own = [k for k in range(int(count)) if (k == 0 or k * (w - o) + 15 <= m) and (k == count - 1 or m < (k + 1) * (w - o) + 15)]
        assert own == [c]


def test_trim_zero_runs(spark):
    pcm = [1] * 5 + [0] * 500 + [2] * 3 + [0] * 300 + [0] * 0 + [3] + [0] * 100
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(pcm)], "rec_id long, i long, sample short")
    got = islands.trim_zero_runs(rows, spark.createDataFrame([(1, 400)], "rec_id long, want long"))
    assert got.count() == len(pcm) - 400
    assert [r["sample"] for r in got.orderBy("i").collect() if r["sample"]] == [s for s in pcm if s]
    assert islands.trim_zero_runs(rows, spark.createDataFrame([(1, 10_000)], "rec_id long, want long")).count() == len(pcm) - 340 - 140


LIB = "seq long, name string, vec array<double>"


def voice_library(seed, n=60, dim=6):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(8, dim))
    out = []
    for i in range(n):
        k = int(r.integers(0, 8))
        v = centres[k] + r.normal(size=dim) * 0.6
        out.append((i, f"p{k}", (v / np.linalg.norm(v)).tolist()))
    return out


def plain_ranked(v, lib, skip=None):
    best = {}
    for seq, name, u in lib:
        if seq != skip and len(u) == len(v):
            s = float(np.dot(v, u))
            if name not in best or s > best[name][0]:
                best[name] = (s, seq)
    return sorted(((s, q, n) for n, (s, q) in best.items()), key=lambda x: (-x[0], x[1]))


@pytest.mark.parametrize("shard", [50_000, 10])
def test_matching(spark, shard, monkeypatch):
    monkeypatch.setattr(identity.name_scores, "__defaults__", (identity.MARGIN, 3, shard))
    lib, asked = voice_library(1), voice_library(2, 25)
    q = spark.createDataFrame([(s, v) for s, _, v in asked] + [(99, None)], "query long, vec array<double>")
    l = spark.createDataFrame([*lib, (500, "other", [1.0]), (501, "none", None)], LIB)
    ranks = {s: plain_ranked(v, lib) for s, _, v in asked}
    got = {r["query"]: (r["name"], r["score"]) for r in identity.recognize(q, l).collect()}
    want = {s: (r[0][2], pytest.approx(r[0][0])) for s, r in ranks.items() if r[0][0] >= 0.62}
    assert got == want
    winners = {}
    for s, r in ranks.items():
        if r[0][0] >= 0.62 and not r[0][0] - r[1][0] < 0.1:
            if r[0][2] not in winners or r[0][0] > winners[r[0][2]][1]:
                winners[r[0][2]] = (s, r[0][0])
    assert {r["name"]: r["query"] for r in identity.recognize_each(q, l).collect()} == {n: s for n, (s, _) in winners.items()}
    taken = spark.createDataFrame([("p1",)], "name string")
    calls = defaultdict(list)
    for r in identity.close_calls(q, l, taken).orderBy("place").collect():
        calls[r["query"]].append(r["name"])
    for s, r in ranks.items():
        near = r[0][0] >= 0.62 and r[0][0] - r[1][0] < 0.1
        assert calls.get(s, []) == ([n for x, _, n in r if r[0][0] - x < 0.1 and n != "p1"][:3] if near else [])


def test_hot_name_is_spread(spark):
    """A name with most samples goes to several tasks, and its score is the best of them all."""
    lib = [(s, "hot" if s % 8 else n, v) for s, n, v in voice_library(3)]
    asked = voice_library(4, 12)
    q, l = spark.createDataFrame([(s, v) for s, _, v in asked], "query long, vec array<double>"), spark.createDataFrame(lib, LIB)
    got = {(r["query"], r["name"]): (r["score"], r["first_seq"]) for r in identity.name_scores(q, l, shard=10).collect()}
    for s, _, v in asked:
        ranks = plain_ranked(v, lib)
        for i, (score, seq, name) in enumerate(ranks):
            if i < 3 or score >= ranks[0][0] - 0.1:
                assert got[s, name] == (pytest.approx(score), seq)
    plan = identity.name_scores(q, l, shard=10)._jdf.queryExecution().toString()
    assert "xxhash64(name#" in plan and ", seq#" in plan.split("xxhash64(name#", 1)[1][:30]


def test_suspects_and_sweep(spark):
    lib = voice_library(5)
    l = spark.createDataFrame(lib, LIB)
    names = defaultdict(int)
    for _, n, _ in lib:
        names[n] += 1
    want = {}
    for seq, name, v in lib:
        ranks = plain_ranked(v, lib, seq)
        own = [s for s, _, n in ranks if n == name]
        others = [x for x in ranks if x[2] != name]
        if own and others and others[0][0] - own[0] >= 0.1 and (len(others) == 1 or others[0][0] - others[1][0] >= 0.05):
            want[seq] = others[0][2]
    found = identity.suspects(l, 0.1, 0.05)
    assert {r["seq"]: r["other"] for r in found.collect()} == want
    whole = {r["name"]: r["whole"] for r in identity.wholly_suspect(found, l).collect()}
    assert whole == {n: sum(1 for s in want if lib[s][1] == n) == names[n] for n in {lib[s][1] for s in want}}
    row = identity.margin_sweep(l, [0.0]).first()
    hits = [(plain_ranked(v, lib, s)[0], n) for s, n, v in lib if names[n] > 1]
    assert row["correct"] == sum(h[0] >= 0.62 and h[2] == n for h, n in hits) and row["wrong"] == sum(h[0] >= 0.62 and h[2] != n for h, n in hits)


def test_library_upkeep(spark):
    l = spark.createDataFrame([(i, "a" if i % 2 else "b", [1.0, float(i)]) for i in range(20)], LIB)
    kept = [r["seq"] for r in identity.retain(l).where("name = 'a'").orderBy("seq").collect()]
    assert kept == [5, 7, 9, 11, 13, 15, 17, 19]
    more = identity.enroll(l, spark.createDataFrame([(20, "a", [3.0, 4.0]), (21, " ", [1.0, 0.0])], LIB))
    assert more.where("name = 'a'").count() == 8 and more.where("seq = 20").first()["vec"] == [0.6, 0.8] and more.where("seq = 21").count() == 0
    assert sorted(r["seq"] for r in identity.rename(l, "a", "b").collect()) == list(range(12, 20))
    assert tuple(identity.rename_plan(l, "a", "b").first()) == (10, 10, 12)
    left = identity.delete_samples(l, spark.createDataFrame([("a", 0), ("a", 9)], "name string, nth int"))
    assert sorted(r["seq"] for r in left.where("name = 'a'").collect()) == list(range(3, 19, 2))
    d = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.0]), (3, "a", [0.9999, 0.0141]), (4, "b", [1.0, 0.0])], LIB)
    assert sorted((r["seq"], r["of_seq"]) for r in identity.duplicates(d).collect()) == [(2, 1), (3, 1)]


def test_hints_and_check_first(spark):
    rows = [(1, 0, 0.0, 90.0, 0, "x" * 50), (1, 1, 0.0, 5.0, 0, "short"), (1, 2, 0.0, 5.0, 0, "equal"), (1, 3, 0.0, 1.0, 1, "(此段轉錄異常)"), (1, 4, 0.0, 99.0, 2, "long one")]
    got = {r["speaker"]: (r["segments"], r["text"]) for r in transcripts.speaker_hints(spark.createDataFrame(rows, "rec_id long, seq long, start double, end double, speaker int, text string")).collect()}
    assert got == {0: (3, "short"), 1: (1, "(此段轉錄異常)"), 2: (1, "long one")}
    q = spark.createDataFrame([(1, s, c) for s, c in enumerate([0.5, 0.9, 0.8, 0.7, 0.4])] + [(2, 0, 0.1), (2, 1, 0.9)], "rec_id long, speaker int, cohesion double")
    assert [(r["rec_id"], r["speaker"]) for r in transcripts.check_first(q).orderBy("place").collect()] == [(1, 4), (1, 0)]


def test_transcript_round_trip(spark):
    rows = [(1, 0, 0.0, 9.0, 0, "hello"), (1, 1, 9.0, 12.0, 1, "there"), (1, 2, 3661.0, 3662.0, -1, "hm")]
    spoken = spark.createDataFrame(rows, "rec_id long, seq long, start double, end double, speaker int, text string")
    quality = spark.createDataFrame([(1, 0, 1, 9.0, 0.5), (1, 1, 1, 3.0, 0.25)], "rec_id long, speaker int, segments long, seconds double, cohesion double")
    md = transcripts.render_transcript(spoken, F.lit("t"), quality)
    parsed = [(r["name"], r["start"], r["text"]) for r in transcripts.parse_transcripts(md).orderBy("seq").collect()]
    assert parsed == [("講者 1", 0.0, "hello"), ("講者 2", 9.0, "there"), ("未知", 3661.0, "hm")]
    text = transcripts.rename_speakers(md, {"講者 1": "講者 2", "講者 2": "Ann"}).first()["md"]
    assert "**講者 2** (00:00:00)" in text and "**Ann** (00:00:09)" in text and "| 講者 2 | 1 | 00:00:09 | 0.50 |" in text and "| Ann | 1 |" in text
    moved = transcripts.reassign(md, spark.createDataFrame([(1, "講者 2", 9.4, 1), (1, "講者 1", 5.0, 1)], "rec_id long, name string, start double, times int"), "Bo").first()
    assert moved["moved"] == 1 and "**Bo** (00:00:09)" in moved["md"]


def test_plans_of_what_to_hear(spark):
    r = random.Random(2)
    rows = [(rec, seq, float(r.randint(1, 50))) for rec in range(6) for seq in range(r.choice([3, 9, 40]))]
    df = spark.createDataFrame(rows, "rec_id long, seq long, seconds double")
    got = defaultdict(set)
    for x in sampling.plan_rows(df, 8).collect():
        got[x["rec_id"]].add(x["seq"])
    for rec in range(6):
        own = [x for x in rows if x[0] == rec]
        if len(own) <= 8:
            want = {x[1] for x in own}
        else:
            long = sorted(own, key=lambda x: (-x[2], x[1]))[:4]
            rest = [x for x in own if x not in long]
            want = {x[1] for x in long} | {rest[min(int(k * len(rest) / 4), len(rest) - 1)][1] for k in range(4)}
        assert got[rec] == want
    for rec in range(6):
        picked = [x for x in sampling.plan_seconds(df, ["rec_id"]).where(f"rec_id = {rec}").collect()]
        cost = sum(x[2] + 0.95 for x in rows if x[0] == rec and x[1] in {p["seq"] for p in picked})
        assert picked and cost <= max(180.0, sum(x[2] + 0.95 for x in rows if x[0] == rec) if cost <= 180 else 0)


def test_clusters(spark):
    r = np.random.default_rng(1)
    centres = np.eye(5)[:3]
    rows = []
    for i in range(90):
        k = i // 10 % 3
        v = centres[k] + r.normal(size=5) * 0.08
        rows.append((1, i, i * 4.0, i * 4.0 + (0.2 if i % 17 == 0 else 3.5), (v / np.linalg.norm(v)).tolist() if i % 17 else None))
    df = spark.createDataFrame(rows, "rec_id long, span_idx long, start double, end double, vec array<double>")
    for speakers in (0, 3):
        got = {x["span_idx"]: x["speaker"] for x in cluster.diarise(df, speakers).collect()}
        assert len({(got[i], i // 10 % 3) for i in range(90) if i % 17}) == 3
    assert {x["speaker"] for x in cluster.diarise(df, 1).collect()} == {0}
    blocks = cluster.speech_groups_of(df).agg(F.max("block")).first()[0] + 1
    assert blocks == 9


def test_packing_and_boxes(spark):
    speech = spark.createDataFrame([(1, 1.0, 5.0), (1, 7.0, 20.0), (1, 23.0, 40.0), (1, 41.0, 60.0), (1, 80.0, 81.0)], "rec_id long, start double, end double")
    got = [(round(r["start"], 3), round(r["end"], 3)) for r in packing.pack_speech(speech, spark.createDataFrame([(1, 80.5)], "rec_id long, total double")).orderBy("chunk").collect()]
    assert got == [(0.8, 20.2), (22.8, 40.2), (40.8, 60.2), (79.8, 80.5)]
    chunks = spark.createDataFrame([(1, 0, 0.0, 60.0), (1, 1, 60.0, 70.0)], "rec_id long, chunk int, start double, end double")
    levels = spark.createDataFrame([(1, i / 2, 5.0 if i in (50, 90) else 50.0) for i in range(140)], "rec_id long, at double, rms double")
    assert [(r["start"], r["end"]) for r in cluster.split_long(chunks, levels).orderBy("chunk", "part").collect()] == [(0.0, 25.0), (25.0, 45.0), (45.0, 60.0), (60.0, 70.0)]
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 5.0), (1, 7.0, 0.0, 9.0, 5.0), (1, 11.0, 4.0, 12.0, 6.0), (1, 50.0, 50.0, 60.0, 60.0)], "page long, x0 double, y0 double, x1 double, y1 double")
    assert [tuple(r)[2:] for r in cluster.near_boxes(boxes).orderBy("box").collect()] == [(0.0, 0.0, 12.0, 6.0), (50.0, 50.0, 60.0, 60.0)]
    words = spark.createDataFrame([(1, "b", 20.0, 1.0, 30.0, 11.0), (1, "a", 0.0, 0.0, 10.0, 10.0), (1, "c", 0.0, 20.0, 10.0, 30.0)], "page long, text string, x0 double, y0 double, x1 double, y1 double")
    assert [r["text"] for r in cluster.ocr_lines(words).orderBy("line").collect()] == ["a b", "c"]


def test_echoes(spark):
    mic = spark.createDataFrame([(1, 0, 10.0, 12.0, "Hello, there friend"), (1, 1, 50.0, 51.0, "my own words"), (1, 2, 13.0, 14.0, "abc"), (1, 3, 10.5, 11.0, "there friend how"), (1, 4, 11.0, 12.0, "...")], SEGMENTS)
    system = spark.createDataFrame([(1, 0, 8.0, 9.0, "hello there, friend"), (1, 1, 9.5, 11.5, "how are you")], SEGMENTS)
    assert sorted(r["seq"] for r in repeats.echoes(mic, system).collect()) == [0, 3]


def test_phrases(spark):
    t = spark.createDataFrame([(1, "go on. " * 12), (2, "nothing repeats here"), (3, None), (4, "")], "doc_id long, text string")
    assert [tuple(r) for r in repeats.repeated_phrases(t).collect()] == [(1, "go on")]


def test_audit(spark):
    schema = "doc_id long, pos int, kind string, text string, rows array<array<string>>, caption string"
    blocks = spark.createDataFrame([(1, 0, "para", "See [the full page](http://x) for more", None, None), (1, 1, "table", None, [["cell with", "some content"]], "cap")], schema)
    frags = spark.createDataFrame([(1, 0, "See the full page"), (1, 1, "some con tent"), (1, 2, "not there at all"), (1, 3, "short"), (2, 0, "no blocks here")], "doc_id long, at int, fragment string")
    gaps = audit.missing(frags, blocks)
    assert sorted((r["doc_id"], r["at"]) for r in gaps.collect()) == [(1, 2), (2, 0)]
    assert audit.gap_notes(gaps).where("doc_id = 1").first()["examples"] == ["not there at all"]
    needles = spark.createDataFrame([(1, "needle in it"), (2, "absent text"), (3, "tiny"), (4, "needle in it")], "k int, text string")
    hay = spark.createDataFrame([("xx needle in it yy",), (None,), ("",)], "text string")
    assert [r["k"] for r in audit.absent_everywhere(needles, hay).collect()] == [2]


def test_batches(spark):
    files = spark.createDataFrame([("/a/b.TXT",), ("/a/.git/c.txt",), ("/a/x.assets/d.txt",), ("/a/~$e.txt",), ("/a/f.bin",), ("/a/G.txt",)], "path string")
    assert [r["path"] for r in batches.scan(files, [".txt"]).collect()] == ["/a/b.TXT", "/a/G.txt"]
    paths = spark.createDataFrame([(0, ' "/a/x.txt" ', True), (1, "/A/X.TXT", True), (2, "/a/y.txt", False), (3, "/a/z.bin", True), (4, "", True), (5, "/a/w.txt", True)], "ord int, path string, exists boolean")
    assert [(r["ord"], r["reason"]) for r in batches.validate(paths, [".txt"], 1).orderBy("ord").collect()] == [(0, None), (1, "repeated"), (2, "missing"), (3, "unsupported"), (5, "too many")]
    assert sorted(r["path"] for r in batches.top_level(spark.createDataFrame([("/a",), ("/a/b",), ("/ab",), ("/c/d",)], "path string")).collect()) == ["/a", "/ab", "/c/d"]
    mail = spark.createDataFrame([(1, i, s) for i, s in enumerate([5, 100, 4, 3])], "mail_id long, ord int, size long")
    assert [r["admitted"] for r in batches.mail_budget(mail, most=3, most_bytes=10, most_one=50).orderBy("ord").collect()] == [True, False, True, False]
    names = spark.createDataFrame([(1, 0, "a.png"), (1, 1, "A.png"), (1, 2, "a.png"), (2, 0, "a.png")], "doc long, pos int, name string")
    assert [r["unique"] for r in batches.unique_names(names, ["doc"], ["pos"]).orderBy("doc", "pos").collect()] == ["a.png", "A-2.png", "a-3.png", "a.png"]
    one = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    assert tuple(batches.renamed(one("a", "b"), one("a", "c")).first()) == ("b", "c") and batches.renamed(one("a", "b"), one("c", "d")).count() == 0
    images = spark.createDataFrame([("/d/i/a b.png",), ("/d/c.png",), ("/e/c.png",)], "path string")
    pages = spark.createDataFrame([("/d/p/x.html", '<img src="../i/a%20b.png"> ![x](./../c.png) <a href="http://h/c.png">')], "path string, content string")
    assert [r["path"] for r in batches.referenced_images(images, pages).collect()] == ["/e/c.png"]


def test_titles_over_columns(spark):
    cells = spark.createDataFrame([("s", r, c, f"{r}{c}") for r in (1, 2, 5) for c in (0, 1, 2)], "sheet string, row int, col int, value string")
    titles = spark.createDataFrame([("s", 0, 0, 1, "A"), ("s", 4, 0, 0, "B")], "sheet string, row int, lo int, hi int, title string")
    got = {(r["row"], r["col"]): r["title"] for r in layout.titled_cells(cells, titles).collect()}
    assert got == {(1, 0): "A", (1, 1): "A", (1, 2): None, (2, 0): "A", (2, 1): "A", (2, 2): None, (5, 0): "B", (5, 1): "A", (5, 2): None}


@pytest.mark.parametrize("shard_chars, part_bytes", [(1_000_000, 1 << 20), (40, 200), (1, 50)])
def test_contained_needles_in_one_or_many_shards(stored, shard_chars, part_bytes):
    from lectern.operators import audit

    r = random.Random(6)
    texts = ["".join(r.choices("abé😀", k=r.randint(0, 60))) for _ in range(60)] + [None, "", "abab" * 500]
    needles = ["".join(r.choices("abé😀", k=r.randint(1, 5))) for _ in range(80)] + ["abababab", "é" * 30, "", None, "ab", "ab"]
    n, t = stored([(i, x) for i, x in enumerate(needles)], "k long, text string"), stored([(x, 1) for x in texts], "text string, k int")
    got = [x["text"] for x in audit.contained(n, t, shard_chars, part_bytes).collect()]
    assert sorted(got) == sorted({x for x in needles if x and any(y and x in y for y in texts)})
    assert audit.contained(n.limit(0), t).count() == 0 and audit.contained(n, t.limit(0)).count() == 0


def test_ratio_bound_loses_no_echo(spark):
    from difflib import SequenceMatcher

    r = random.Random(1)
    texts = ["".join(r.choices("abcdeé ", k=r.randint(0, 30))) for _ in range(60)]
    pairs = [(a, b) for a in texts for b in texts[::3]] + [(a, a[::-1]) for a in texts]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", repeats.match_ratio(0.66)("a", "b").alias("m")).collect()
    for a, b, m in got:
        want = SequenceMatcher(None, a, b).ratio() if a and b else 0.0
        assert m == want or want <= m < 0.66


def test_repeated_phrases_stay_where_their_text_is(stored):
    """Counts of n-grams are not dealt: a shuffle of them was hundreds of times the texts."""
    rows = [(1, "go on, " * 9), (2, None), (3, ""), (4, "a"), (5, "ab" * 8), (6, "abc\U0001d11e" * 12), (7, "word by word")]
    t = stored(rows, "doc_id long, text string")
    found = repeats.repeated_phrases(t)
    assert {tuple(r) for r in found.collect()} == {(1, "go on"), (5, "ab"), (6, "abc\U0001d11e")}
    assert "Exchange" not in found._jdf.queryExecution().toString()
    got = {tuple(r) for r in repeats.ngram_coverage(t, F.col("text")).where("doc_id in (4, 5)").collect()}
    assert got == {(5, 2, "ab", 8), (5, 3, "aba", 7), (5, 4, "abab", 7), (5, 5, "ababa", 6), (5, 6, "ababab", 6)}


def test_levels_of_a_minute_move_as_one_row(stored):
    """600 levels of a chunk were 600 rows of two shuffles."""
    rows = [(r, i / 2, float((i * 37 + r) % 101)) for r in range(3) for i in range(500)]
    levels = stored(rows, "rec_id long, at double, rms double")
    assert cluster._by_minute(levels).count() <= 3 * 5 + 8  # a minute may be cut between two files or batches
    chunks = stored([(r, 0, 0.0, 100.0 + 70 * r) for r in range(3)], "rec_id long, chunk int, start double, end double")
    want = []
    for r in range(3):
        a, part, end = 0.0, 0, 100.0 + 70 * r
        while end - a > 28:
            cut = min((x for x in rows if x[0] == r and a + 18 <= x[1] <= a + 28), key=lambda x: (x[2], x[1]))[1]
            want.append((r, 0, part, a, cut))
            a, part = cut, part + 1
        want.append((r, 0, part, a, end))
    shuffled = levels.orderBy(F.xxhash64("at"))
    for given in (levels, shuffled):
        assert sorted(tuple(x) for x in cluster.split_long(chunks, given).collect()) == want


def test_levels_never_pass_the_driver(spark, stored):
    """The plan took 600 levels made of each row for as small as the row, and sent all of them through the driver."""
    rec = stored([(r,) for r in range(20)], "rec_id long")
    levels = rec.select("rec_id", F.explode(F.sequence(F.lit(0), F.lit(599))).alias("k")).select("rec_id", (F.col("k") / 2).alias("at"), (F.col("k") % 101).cast("double").alias("rms"))
    chunks = rec.select("rec_id", F.lit(0).alias("chunk"), F.lit(0.0).alias("start"), F.lit(200.0).alias("end"))
    found = cluster.split_long(chunks, levels)
    assert found.where("part = 0").count() == 20
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_mail_budget_asks_only_mails_beyond_a_limit(spark):
    """Each mail's attachments met in a pandas group of their own, though all of them were admitted."""
    rng = random.Random(5)
    rows = [(m, i, rng.randint(0, 9)) for m in range(60) for i in range(rng.randint(1, 6))] + [(60, 0, 99), (61, 0, 5), (61, 1, 40)]
    mails = spark.createDataFrame(rows, "mail_id long, ord int, size long")
    for most in (4, None):
        want, used = {}, defaultdict(lambda: [0, 0])
        for m, i, size in rows:
            u = used[m]
            want[m, i] = (most is None or u[0] < most) and size <= 30 and u[1] + size <= 22
            if want[m, i]:
                u[:] = u[0] + 1, u[1] + size
        assert {(r["mail_id"], r["ord"]): r["admitted"] for r in batches.mail_budget(mails, most, 22, 30).collect()} == want
    asked = batches.mail_budget(mails)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in asked.split("FlatMapGroupsInPandas")[1]
