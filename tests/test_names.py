"""Nearest names over many shards against all pairs, and how few rows are sent."""

import numpy as np
import pytest

from lectern.operators import identity


def plainly(queries, library):
    out = {}
    for q, v, own, _ in queries:
        for s, n, u in library:
            if u is None or v is None or len(u) != len(v) or s == own:
                continue
            x = float(np.dot(u, v))
            if (q, n) not in out or (-x, s) < (-out[q, n][0], out[q, n][1]):
                out[q, n] = (x, s)
    return out


def voices(seed, n, spread, dim=12, lengths=(1.0,)):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(20, dim))
    rows = []
    for i in range(n):
        k = int(r.integers(20)) if i % 3 else 0  # a third of all samples bear one name
        v = centres[k] / np.linalg.norm(centres[k]) + r.normal(size=dim) * spread
        rows.append((i, f"n{k if r.random() < 0.97 else 19 - k}", (v / np.linalg.norm(v) * r.choice(lengths)).tolist()))
    return rows


@pytest.mark.parametrize("spread, shard, lengths", [(0.05, 60, (1.0,)), (0.3, 25, (1.0, 0.6, 1.3)), (2.0, 40, (1.0,)), (0.05, 10_000, (1.0,))])
def test_names_that_count_are_those_of_all_pairs(stored, spread, shard, lengths):
    library = voices(1, 500, spread, lengths=lengths) + [(900, "odd", [1.0, 0.0]), (901, "none", None)]
    queries = [(s, v, s, n) for s, n, v in library[::3]] + [(5000, [0.6, 0.8], None, None), (5001, [1.0] * 5, None, None), (5002, None, None, None)]
    lib = stored(library, "seq long, name string, vec array<double>")
    asked = stored(queries, "query long, vec array<double>, own_seq long, own_name string")
    want, got = plainly(queries, library), {}
    for r in identity.name_scores(asked, lib, shard=shard).collect():
        got[r["query"], r["name"]] = (r["score"], r["first_seq"])
    assert set(got) <= set(want)
    own = {q: n for q, _, _, n in queries}
    for q in {q for q, _ in want}:
        of = sorted((x for (p, _), (x, _) in want.items() if p == q), reverse=True)
        floor = min(of[0] - identity.MARGIN, of[min(3, len(of)) - 1])
        for (p, name), (x, first) in want.items():
            if p == q and (x >= floor or name == own[q]):
                assert got[q, name] == (pytest.approx(x, abs=1e-12), first), (q, name)


def test_few_rows_are_sent_where_voices_are_apart(stored):
    library = voices(2, 2000, 0.03)
    lib = stored(library, "seq long, name string, vec array<double>")
    asked = stored([(s, v, s, n) for s, n, v in library[::4]], "query long, vec array<double>, own_seq long, own_name string")
    sent: list[int] = []
    identity.name_scores(asked.drop("own_name"), lib, shard=40, sent=sent)
    shards = 50
    assert sent[0] == 500 and sent[0] + sent[1] < 0.5 * 500 * shards


def test_cosines_are_held_a_few_at_a_time(monkeypatch):
    """Memory of a task was five times all cosines of 512 queries with a shard."""
    r = np.random.default_rng(5)
    names, dim = np.sort(r.integers(0, 6, 400)), 8
    m = r.integers(-2, 3, (400, dim)).astype(float)  # many ties
    seq, asked = r.permutation(400), m[r.integers(0, 400, 30)]
    own = np.where(r.random(30) < 0.5, r.integers(0, 400, 30), np.nan)
    starts = np.unique(names, return_index=True)[1]
    s = asked @ m.T
    s[own[:, None] == seq[None, :]] = -np.inf
    want = np.stack([s[:, names == k].max(axis=1) for k in np.unique(names)], axis=1)
    firsts = np.stack([[seq[(names == k) & (row == row[names == k].max())].min() for row in s] for k in np.unique(names)], axis=1)
    for products in (30, 210, 5000, 1 << 20):
        monkeypatch.setattr(identity, "PRODUCTS", products)
        best, first = identity._tops(asked, own, m, seq, starts)
        assert (best == want).all() and (first == firsts).all()
