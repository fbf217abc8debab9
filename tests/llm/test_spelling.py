"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lectern.llm import spelling


def counted(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plainly(words):
    out = {}
    for w, n in words.items():
        around = sorted((-m, x) for x, m in words.items() if near(w, x))
        top = around[0] if around and -around[0][0] >= 10 * n else None
        out[w] = [top and top[1], None, n, len(around), top and -top[0]]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row[1] = root
    return out


def vocabulary(seed, n):
    r = random.Random(seed)
    words = {}
    stems = ["aaaaaaa", "aabaabaa", "preÿrun", "übermäßig", "abcdefgh"] + ["".join(r.choices("abÿ", k=r.randint(7, 9))) for _ in range(n)]
    for w in stems:
        for _ in range(4):
            words[w] = r.choice([2, 3, 20, 25, 200, 300, 4000])
            k = r.randrange(len(w) + 1)
            w = r.choice([w[:k] + r.choice("abé") + w[k:], w[:k] + w[k + 1 :], w[:k] + "c" + w[k + 1 :]])
            w = w if len(w) >= 7 else w + "zzz"
    return words


@pytest.mark.parametrize("size", [20_000, 40, 7])
def test_variants_as_brute_force(stored, monkeypatch, size):
    monkeypatch.setattr(spelling, "RANGE", size)
    words = vocabulary(size, 60)
    long = "abc" * 5000
    words |= {long: 50, long[:-1]: 3, long + "d": 2, "x" + long: 4}
    words |= {"prefixed" + "".join(x): 5 for x in zip("abcdeabcde", "aaaaabbbbb", "ccccccdddd")}
    got = spelling.variants(stored(list(words.items()), "word string, n long")).collect()
    assert len(got) == len(words)
    want = plainly(words)
    for r in got:
        assert [r["form"], r["root"], r["n"], r["n_near"], r["form_n"]] == want[r["word"]], r["word"]
    assert any(r["root"] not in (r["word"], r["form"]) and r["form"] for r in got)


def test_counts_as_plain_python(stored):
    r = random.Random(8)
    vocab = ["".join(r.choices("abcÉéßN", k=r.randint(3, 10))) for _ in range(60)]
    rows = [(i if i % 7 else None, r.choice([" ", "-", "1", "\n"]).join(r.choices(vocab, k=r.randint(0, 50)))) for i in range(120)]
    rows += [(1, None), (2, ""), (None, None), (3, "w" * 100_000 + " " + "w" * 100_000)] + [rows[5]] * 3
    docs = stored([(a, b, 1) for a, b in rows], "doc_id long, text string, n int")
    assert {x["word"]: x["n"] for x in spelling.word_counts(docs).collect()} == counted(rows)


def test_empty_tables(stored):
    docs = stored([], "doc_id long, text string")
    assert spelling.variants(spelling.word_counts(docs)).collect() == []
    docs = stored([(1, "ab"), (2, None)], "doc_id long, text string")
    assert spelling.variants(spelling.word_counts(docs)).collect() == []


def test_wavelet_tree_reports_the_range():
    r = np.random.default_rng(2)
    for n in (1, 2, 3, 64, 65, 300):
        values = r.permutation(n)
        tree = spelling.WaveletTree(values)
        a, b = np.sort(r.integers(0, n + 1, (2, 50)), axis=0)
        low, high = np.sort(r.integers(0, n + 1, (2, 50)), axis=0)
        i, value = tree.report(a, b, low, high)
        want = sorted((k, v) for k in range(50) for v in values[a[k] : b[k]].tolist() if low[k] <= v < high[k])
        assert sorted(zip(i.tolist(), value.tolist())) == want


def test_common_beginnings_ask_few_ranges():
    """A third of the words begin alike; still each asks in a few ranges only."""
    r = random.Random(4)
    words = sorted({("pre" if k % 3 == 0 else "") + "".join(r.choices("abcdefghij", k=8)) for k in range(6000)})
    raw = [w.encode("latin-1") for w in words]
    firsts, lasts = raw[::50], sorted(w[::-1] for w in raw)[::50]
    asked = [sum(b - a + 1 for a, b in spelling.split_at(w, firsts, lasts)[1:]) for w in raw]
    assert sum(asked) / len(asked) < 2.2 and max(asked) <= 4
