"""Token counts, byte-level BPE, fingerprints and language, against plain versions."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from lectern.llm import bpe, fingerprints, language, token_counts
from lectern.llm.common import table

ODD = ["", " ", "\n\n\n", "a", "it's we'll I'D", "x" * 5000, " \t  x  \r\n y ", "漢字カナ混じり文、です。", "🎉🎊 ok", "été à l'œuvre ça", "1234567890 12 3", "\u0000\ufffd", "a\u0301\u0302 b", "   trailing   ", "<|endoftext|>", "ab" * 3000]


@pytest.fixture(scope="module")
def plain():
    path, pattern = bpe.default_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(*bpe.default_vocabulary())


def test_perfect_hash_is_minimal_and_perfect(vocabulary):
    h = vocabulary.hash
    assert sorted(h.slots) == list(range(len(vocabulary.keys)))
    assert all(h.candidate(k) == i for i, k in enumerate(vocabulary.keys))
    assert vocabulary.whole(b"no such entry at all") is None


def test_bpe_as_tiktoken(vocabulary, plain):
    for t in ODD:
        ids = vocabulary.encode(t)
        assert ids == plain.encode_ordinary(t)
        assert vocabulary.decode(ids).decode() == t


def test_bpe_query(spark, sf_dir, plain):
    want = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    got = bpe.query(spark, sf_dir).collect()
    assert len(got) == len(want)
    for r in got:
        ids = plain.encode_ordinary(want[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((want[r["doc_id"]] or "").encode()).hexdigest()


def test_bpe_edges(spark):
    rows = spark.createDataFrame([(1, None, "x"), (None, "a b", "y"), (1, "", "z"), (1, None, "x")], "doc_id long, text string, token_ids string")
    got = bpe.digests(bpe.encode_documents(rows)).collect()
    assert sorted(r["n_tokens"] for r in got) == [0, 0, 0, 2]
    assert bpe.digests(bpe.encode_documents(rows.limit(0))).count() == 0


def test_edits_count_as_whole_texts_do(vocabulary, plain):
    r = random.Random(3)
    alphabet = "ab  \n'sé1漢.,\t"
    for _ in range(150):
        text = "".join(r.choices(alphabet, k=r.choice([0, 1, 5, 80, 700, 3000])))
        tree = token_counts.TokenTree(text, vocabulary)
        for _ in range(6):
            pos, cut = r.randint(0, len(text) + 3), r.choice([0, 1, 3, 50])
            new = "".join(r.choices(alphabet, k=r.choice([0, 1, 4, 40])))
            again = tree.edit(pos, cut, new)
            at = min(pos, len(text))
            text = text[:at] + new + text[at + cut :]
            assert tree.text() == text
            assert tree.n_chars == len(text)
            assert tree.n_tokens == len(plain.encode_ordinary(text))
            assert again <= len(text)


def test_small_edits_touch_little(vocabulary):
    tree = token_counts.TokenTree("word after word " * 20_000, vocabulary)
    assert tree.edit(100_000, 4, "other") < 2000


def test_edited_counts_edges(spark, plain):
    one = [{"pos": 1, "removed": 1, "added": "zz"}]
    rows = spark.createDataFrame([(1, None, one, 5), (2, "abc", None, 5), (3, "abc", one, 5), (3, "abc", one, 5), (None, "", [], 5)], "doc_id long, text string, edits array<struct<pos int, removed int, added string>>, n_tokens int")
    got = sorted((tuple(r) for r in token_counts.edited_counts(rows).collect()), key=str)
    assert len(got) == 5
    three = [g for g in got if g[0] == 3]
    assert three[0] == three[1] and three[0][3:5] == (4, len(plain.encode_ordinary("azzc")))
    assert [g[3] for g in got if g[0] == 1] == [2]


def test_other_patterns_need_their_reach(spark):
    rows = spark.createDataFrame([(1, "a  b", [{"pos": 2, "removed": 1, "added": "c"}])], "doc_id long, text string, edits array<struct<pos int, removed int, added string>>")
    with pytest.raises(ValueError):
        token_counts.edited_counts(rows, pattern=r"\w+|\W+")
    assert token_counts.edited_counts(rows, pattern=r"\w+|\W+", reach=1).first()["edited_chars"] == 4


def test_token_counts_query(spark, sf_dir, plain):
    want = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}
    for r in token_counts.query(spark, sf_dir).collect():
        t = want[r["doc_id"]]
        assert (r["n_chars"], r["n_tokens"]) == (len(t), len(plain.encode_ordinary(t)))
        n = len(t)
        e = t[: n // 3] + " revised it's 42" + t[n // 3 + 12 :]
        at = min(n * 2 // 3, len(e))
        e = e[:at] + f"\n\n  see #{r['doc_id']}" + e[at:] + " end"
        assert (r["edited_chars"], r["edited_tokens"]) == (len(e), len(plain.encode_ordinary(e)))


def plain_digest(data):
    """Counts of hashed triplets, one by one; quartile codes by rank in the sorted counts."""
    counts = [0] * 128
    tables = [[int(x) for x in t] for t in fingerprints._TABLE]
    for salt, (i, j, k) in enumerate([(0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4)]):
        for at in range(len(data) - k):
            h = tables[0][data[at + i]] + 3 * tables[1][data[at + j]] + 7 * tables[2][data[at + k]] + 331 * salt
            counts[(h * 0x9E3779B1 & 0xFFFFFFFF) >> 25] += 1
    ranked = sorted(counts)
    codes = [sum(c > ranked[q] for q in (31, 63, 95)) for c in counts]
    packed = bytes(codes[i] + 4 * codes[i + 1] + 16 * codes[i + 2] + 64 * codes[i + 3] for i in range(0, 128, 4))
    return f"{min(255, round(8 * math.log2(len(data) + 1))):02x}" + packed.hex()


def plain_likeness(a, b):
    codes = lambda d: [x >> s & 3 for x in bytes.fromhex(d)[1:] for s in (0, 2, 4, 6)]
    apart = sum(abs(x - y) for x, y in zip(codes(a), codes(b)))
    far = max(0, abs(int(a[:2], 16) - int(b[:2], 16)) - 1)
    return max(0.0, 1 - (apart + min(24, 2 * far)) / 160)


def check_fingerprints(got, rows):
    """got rows against rows (doc_id, text) in order, by a plain digest and likeness."""
    want = Counter()
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = (plain_digest(x.encode()) for x in (t, edited, nxt))
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == want


def test_fingerprints_query(spark, tmp_path):
    docs = [(r["doc_id"], r["text"] or "") for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    docs = [(i, t[:1500]) for i, t in docs]
    docs += [(90_000 + i, t) for i, t in enumerate(["", "a", "ab", "abc", "漢字" * 30, "x" * 4000])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = fingerprints.query(spark, str(tmp_path)).collect()
    check_fingerprints(got, sorted(docs, reverse=True))
    assert sum(r["near_edited"] for r in got) > sum(r["near_next"] for r in got)


@pytest.mark.parametrize("hot", [3, 1000])
def test_fingerprints_of_hot_ids(spark, hot, monkeypatch):
    """Many equal rows, many texts of one id and of null ids: every row is compared with the one after it."""
    monkeypatch.setattr(fingerprints, "CHUNK", 7)
    rows = [(5, "the same text every time")] * 60 + [(6, f"text number {i} of id six") for i in range(300)] + [(None, f"no id {i}") for i in range(150)] + [(None, "equal")] * 20 + [(i, f"w{i} " * i) for i in range(10, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tie = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    check_fingerprints(fingerprints.compare_with_next(df, hot).collect(), sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -tie[r[1]])))


def test_fingerprints_edges(spark):
    assert fingerprints.likeness([fingerprints.digest(b"")], [fingerprints.digest(b"")])[0] == 1
    one = spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")
    assert fingerprints.compare_with_next(one).first()["near_next"] == 1
    rows = spark.createDataFrame([(1, None, "q"), (1, "same text", "q"), (2, "same text", "q"), (None, "other", "q"), (None, "other", "q")], "doc_id long, text string, fingerprint string")
    got = fingerprints.compare_with_next(rows).collect()
    assert len(got) == 5
    assert len({r["fingerprint"] for r in got if r["n_chars"] == 9}) == 1
    assert fingerprints.compare_with_next(rows.limit(0)).count() == 0
    assert fingerprints.fingerprints(rows).columns == ["doc_id", "text", "fingerprint"]


def test_language_held_out(spark):
    path = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in table(spark, path, "documents").collect()}
    got = [r for r in language.query(spark, path).collect() if r["held_out"] and truth[r["doc_id"]]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark):
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 30)]
    rows += [(900, None, None, "s"), (901, "", None, "s"), (902, "123 !!", "en", "s"), (903, "the dog and a cat", None, "s"), (None, "die Katze", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert got[903]["lang_pred"] == "en" and got[None]["lang_pred"] == "de"
    nothing = language.identify(docs.where("lang is null")).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [500, 2000])
def test_language_sample_with_repeated_ids(spark, copies):
    """Copies of an id neither grow the sample nor push a language out of it."""
    rows = [(7, "the cat and the dog", "en")] * copies + [(8, "der Hund und die Katze", "de")] * copies + [(i, f"le chat {i} et le chien", "fr") for i in range(100, 1000)]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    got = language.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=40)
    by = Counter(lang for _, lang in got)
    assert by == {lang: min(40, len({r[:2] for r in rows if r[2] == lang})) for lang in {r[2] for r in rows}}
    assert len(language.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=2)) == len(by)


def test_letters_of_all_planes(spark):
    docs = spark.createDataFrame([(1, "the cat", "en"), (3, chr(0x30000) * 5, None), (5, "123", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs).collect()}
    assert got == {1: "en", 3: "en", 5: "und"}


def plain_ridge(train, ask):
    """Kernel ridge regression on exact n-gram sets, without landmarks and without hashing."""

    def grams(text):
        s = re.sub(r"[^\W\d_]+|(.)", lambda m: m[0] if m[1] is None else " ", " " + text.lower() + " ", flags=re.S)
        s = re.sub(" +", " ", s)
        return {s[i : i + n] for n in (1, 2, 3, 4) for i in range(len(s) - n + 1)}

    kernel = lambda a, b: np.array([[len(x & y) / (len(x) * len(y)) ** 0.5 for y in b] for x in a])
    languages = sorted({lang for _, lang in train})
    a = [grams(t) for t, _ in train]
    y = np.array([[1.0 if lang == x else -1.0 for x in languages] for _, lang in train])
    w = np.linalg.solve(kernel(a, a) + 0.02 * len(a) / 20 * np.eye(len(a)), y - y.mean(axis=0))
    return [languages[i] for i in (kernel([grams(t) for t in ask], a) @ w + y.mean(axis=0)).argmax(axis=1)]


def test_language_as_plain_kernel_machine(spark):
    docs = [(r["text"], r["lang"]) for r in table(spark, "/root/testdata/sf0.001", "documents").where("lang is not null and length(text) > 40").orderBy("doc_id").limit(160).collect()]
    train, ask = docs[:100], [t[:3000] for t, _ in docs[100:]]
    train = [(t[:3000], lang) for t, lang in train]
    got, _ = language.Classifier.fit(train, landmarks=100).predict(ask)
    assert sum(a == b for a, b in zip(got, plain_ridge(train, ask))) >= 0.95 * len(ask)


def test_language_of_long_texts(spark):
    """Held-out accuracy does not fall where many n-grams share a place."""
    rows = table(spark, "/root/testdata/sf0.01", "documents").where("lang is not null").select("text", "lang").collect()
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append(r["text"] or "")
    train = [(t, lang) for lang, found in by.items() for t in found[::2][:60] if t]
    model = language.Classifier.fit(train)
    long = [(" ".join(found[1::2])[:2_000_000], lang) for lang, found in by.items()]
    got, score = model.predict([t for t, _ in long])
    assert got == [lang for _, lang in long] and (score > 0).all()
