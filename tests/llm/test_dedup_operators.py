"""Suffix arrays, SimHash and Hamming search against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from lectern.llm import hamming, simhash, suffixes
from lectern.llm.common import table
from lectern.llm.components import components


def removed_plainly(texts, length):
    """Spans of each text that a string of `length` bytes covers which starts elsewhere too."""
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for r in raw:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, bytes(b for b, g in zip(r, gone) if not g)))
    return out


def planted(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdé", k=r.randint(1, 6)))
    passages = [" ".join(word() for _ in range(12)) for _ in range(4)]
    texts = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(r.randint(0, 20)))]
        for _ in range(r.choice([0, 0, 1, 2])):
            parts += [r.choice(passages)[r.choice([0, 0, 3]) :], word()]
        texts.append(" ".join(parts))
    texts += [texts[0], texts[0], texts[1] + "x", "a" * 200, "ab" * 90, "", None, "a" * 31]
    return texts


@pytest.mark.parametrize("seed, max_group", [(1, 2000), (2, 3), (3, 1)])
def test_repeats_as_brute_force(stored, seed, max_group):
    texts = planted(seed)
    docs = stored([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string")
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(docs, 32, max_group).collect()}
    for i, want in enumerate(removed_plainly(texts, 32)):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == want, i


def test_suffix_order_sorts():
    r = random.Random(5)
    for _ in range(40):
        text = bytes(r.choices(b"ab\xff", k=r.randint(1, 60))) + b"\xff"
        order = suffixes.suffix_order(text, np.ones(len(text), bool), len(text))
        assert [text[i:] for i in order] == sorted(text[i:] for i in range(len(text)))


def test_repeats_of_the_query(spark, sf_dir):
    import hashlib

    docs = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    want = dict(zip(docs, removed_plainly(docs.values(), 400)))
    got = suffixes.query(spark, sf_dir).collect()
    assert len(got) == len(want)
    for r in got:
        n, gone, spans, kept = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, gone, spans, hashlib.sha256(kept).hexdigest())


def test_text_without_broken_characters(stored):
    """Equal first bytes of different characters are cut off with what repeats before them."""
    shared = "x" * 40
    docs = stored([(1, shared + "é one"), (2, shared + "è two"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (bytes(r["kept"]), r["kept_text"]) for r in suffixes.remove_repeats(docs, 32, text=True).collect()}
    assert got == {1: (b"\xa9 one", " one"), 2: (b"\xa8 two", " two"), 3: (b"", "")}


def test_repeats_when_scans_are_split_anew(spark, tmp_path, monkeypatch):
    """Each later scan is split in another way, as when executors come and go."""
    texts = planted(13, 60)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows.repartition(9).write.parquet(str(tmp_path / "d"))
    plain, n = suffixes.written, 0

    def other_split(df, name):
        nonlocal n
        n += 1
        out = plain(df, name)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(1 + n % 5))
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(20_000 * (1 + n % 3)))
        return out

    monkeypatch.setattr(suffixes, "written", other_split)
    try:
        got = {r["doc_id"]: r for r in suffixes.remove_repeats(spark.read.parquet(str(tmp_path / "d")), 32).collect()}
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = removed_plainly(texts, 32)
    for i, (size, gone, spans, kept) in enumerate(want):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == (size, gone, spans, kept)


def test_repeats_of_nothing(stored):
    assert suffixes.remove_repeats(stored([], "doc_id long, text string")).count() == 0


def plain_fingerprint(text, shingle=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\x09\x0a\x0b\x0c\x0d":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(ids, fps, radius=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(ids))]


def test_fingerprints_as_plain():
    texts = ["", None, "One", "a b c d", "A B\tC  d e", "é ü ñ ß long " * 200, "x" * 3000 + " y", "\u00a0 a\u2003b c d e", *planted(9, 20)]
    assert simhash.fingerprint_all([t or "" for t in texts]).tolist() == [plain_fingerprint(t) for t in texts]


def test_simhash_query(spark, sf_dir):
    docs = [(r["doc_id"], plain_fingerprint(r["text"])) for r in table(spark, sf_dir, "documents").collect()]
    want = plain_components([d for d, _ in docs], [f for _, f in docs])
    got = {r["doc_id"]: r for r in simhash.query(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for (d, f), c in zip(docs, want):
        assert got[d]["fingerprint"] == f"{f:016x}" and got[d]["component_id"] == c


@pytest.mark.parametrize("max_shard", [20_000, 3])
def test_links_join_what_is_near(spark, max_shard):
    r = random.Random(11)
    base = [r.getrandbits(64) for _ in range(30)]
    codes = {b ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(8)} | {0, (1 << 64) - 1}
    codes = sorted(codes)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame([(c,) for c in signed], "fp long")
    got = {r["node"]: r["root"] for r in components(simhash.links(df, 4, max_shard)).collect()}
    want = plain_components(signed, codes)
    for c, w in zip(signed, want):
        mates = [x for x, y in zip(signed, want) if y == w]
        assert len({got.get(x, x) for x in mates}) == 1
    assert len({got.get(c, c) for c in signed}) == len(set(want))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (900, 900)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert {got[i] for i in range(201)} == {0} and got[501] == 500 and got[900] == 900


def test_near_duplicates_edges(spark):
    docs = spark.createDataFrame([(3, None, "x"), (2, " ", "x"), (None, "", "x"), (5, "some words here and there", "x"), (4, "some words here and there", "x"), (4, "some words here and there", "x")], "doc_id long, text string, fp string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(3, 2), (2, 2), (None, 2), (5, 4), (4, 4), (4, 4)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_search_as_brute_force(spark):
    r = np.random.default_rng(4)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    codes = np.concatenate([base[r.integers(0, 40, 700)] ^ (np.uint64(1) << r.integers(0, 64, 700).astype(np.uint64)), np.full(60, base[0]), r.integers(0, 2**63, 200, dtype=np.uint64)])
    ids = np.arange(len(codes)) * 3
    rows = spark.createDataFrame([(int(i), int(np.int64(c.view(np.int64)))) for i, c in zip(ids, codes)] + [(None, 5), (7, None)], "id long, code long")
    got = {}
    asked = rows.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    for x in hamming.nearest(rows, asked, 10).collect():
        got.setdefault(x["query_id"], {})[x["rank"]] = (x["distance"], x["id"])
    for i, c in zip(ids.tolist(), codes):
        if i % 50 == 0:
            d = np.bitwise_count(codes ^ c)
            want = sorted(zip(d.tolist(), ids.tolist()))[:10]
            assert [got[i][k] for k in range(1, 11)] == want
    assert hamming.nearest(rows.limit(0), asked).count() == 0


def test_search_finds_fewer_rows_than_asked_for(spark):
    rows = spark.createDataFrame([(1, 0), (2, -1), (2, -1)], "id long, code long")
    got = hamming.nearest(rows, rows.where("id = 1").withColumnRenamed("id", "query_id"), 10).orderBy("rank").collect()
    assert [(r["id"], r["distance"]) for r in got] == [(1, 0), (2, 64), (2, 64)]


def test_sign_codes_edges(spark):
    v = spark.createDataFrame([([1.0, -1.0, float("nan"), None, 2.0],), ([],), (None,), ([1.0] * 64,)], "embedding array<float>")
    assert [r["code"] for r in hamming.sign_codes(v).collect()] == [0b10001, None, None, -1]


def test_vectors_of_any_length(stored):
    """All elements count, also behind the 64th; shorter vectors are as if zeros followed."""
    r = np.random.default_rng(4)
    sizes = [70, 200, 200, 200, 130, 64, 1, 0]
    vectors = [r.normal(size=sizes[i % len(sizes)]).tolist() for i in range(400)]
    vectors[20:60] = [vectors[1][:64] + r.normal(size=136).tolist() for _ in range(40)]  # alike in the first 64
    vectors[60] = vectors[1]
    codes = hamming.sign_words(stored([(i, v) for i, v in enumerate(vectors)], "id long, embedding array<double>")).select("id", "code")
    bits = np.zeros((len(vectors), 256), bool)
    for i, v in enumerate(vectors):
        bits[i, : len(v)] = np.array(v) > 0
    ids = [i for i, v in enumerate(vectors) if v]
    got = {}
    for x in hamming.nearest(codes, codes.where("id % 9 = 1").withColumnRenamed("id", "query_id"), 7).collect():
        got.setdefault(x["query_id"], {})[x["rank"]] = (x["distance"], x["id"])
    for q in [i for i in ids if i % 9 == 1]:
        want = sorted((int((bits[q] ^ bits[i]).sum()), i) for i in ids)[:7]
        assert [got[q][k] for k in range(1, 8)] == want, q


def test_near_dedup_null_and_repeated_ids(spark, tmp_path):
    """A null or repeated id drops no other component's document, and each component keeps one row."""
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefgh", k=7))
    base = [" ".join(word() for _ in range(60)) for _ in range(14)]
    rows = [(None, t, "en", "s", 1) for t in base[:6]] * 2 + [(None, base[0], "en", "t", 1), (None, None, "en", "s", 0), (None, "", "en", "s", 0)]
    rows += [(7, t, "en", "s", 1) for t in base[6:9]] + [(7, base[6], "de", "s", 1), (3, base[9], "en", "s", 1), (7, base[9], "en", "s", 1)]
    rows += [(None, base[10], "en", "s", 1), (0, base[10], "en", "s", 1), (0, base[11], "en", "s", 1), (None, base[11] + " tail", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "d"))
    got = [tuple(x) for x in corpus_pipeline.near_dedup(spark, spark.read.parquet(str(tmp_path / "d")), str(tmp_path)).collect()]
    roots = plain_components(range(len(rows)), [plain_fingerprint(x[1] or "") for x in rows])
    groups = {}
    for x, root in zip(rows, roots):
        groups.setdefault(root, []).append(x)
    assert len(got) == len(groups) and len({x[1] or "" for x in got}) == len(got)
    rank = lambda x: (x[0] is None, x[0] or 0, hashlib.md5((x[1] or "").encode()).hexdigest())
    assert {rank(x) for x in got} == {min(map(rank, g)) for g in groups.values()} and set(got) <= set(rows)
