"""Near vectors of a name in cells against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import cluster, identity, neighbours


def library(seed, n, dim=6):
    """Half of all samples bear one name; there are copies, near copies, a drifting voice, short vectors and other lengths."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, dim))
    rows = []
    for i in range(n):
        name = "half" if i % 2 else f"n{i % 6}"
        v = centres[r.integers(5)] + r.normal(size=dim) * r.choice([0.0, 0.01, 0.3])
        if i % 7 == 0:
            v = np.cos(i / 40 + np.arange(dim))
        v = v / np.linalg.norm(v) * r.choice([1.0, 1.0, 1.0, 0.7, 1.02])
        rows.append((i, name, v.tolist()))
    return rows + [(n, "half", [1.0, 0.0]), (n + 1, "half", [1.0, 0.0]), (n + 2, "half", [0.1, 0.0]), (n + 3, "half", [0.1, 0.0]), (n + 4, "half", None), (n + 5, "n0", [])]


def first_kept(rows, least):
    out, kept = {}, {}
    for seq, name, v in sorted(rows):
        if v is None:
            continue
        of = next((s for s, u in kept.get(name, []) if len(u) == len(v) and float(np.dot(u, v)) >= least), None)
        if of is None:
            kept.setdefault(name, []).append((seq, v))
        else:
            out[seq] = (name, of)
    return out


def groups(rows, least):
    rows = [r for r in sorted(rows) if r[2] is not None]
    root = {s: s for s, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (s, n, v) in enumerate(rows):
        for t, m, u in rows[:i]:
            if n == m and len(u) == len(v) and float(np.dot(u, v)) >= least:
                a, b = sorted((find(s), find(t)))
                root[b] = a
    return {s: find(s) for s, _, _ in rows}


@pytest.mark.parametrize("least, size", [(0.999, 4000), (0.999, 20), (0.9, 15), (0.2, 40)])
def test_duplicates_and_groups_as_plain_loops(stored, least, size):
    rows = library(int(least * 100), 240)
    df = stored([(s, n, v, "x") for s, n, v in rows], "seq long, name string, vec array<double>, cell string")
    got = {r["seq"]: (r["name"], r["of_seq"]) for r in identity.duplicates(df, least, size).collect()}
    assert got == first_kept(rows, least) and got
    got = {r["seq"]: r["group"] for r in cluster.similar_groups(df, least, size).collect()}
    assert got == groups(rows, least)


def test_a_name_with_half_of_all_samples_is_spread(stored):
    rows = [r for r in library(3, 1200) if r[2] is not None and len(r[2]) == 6]
    df = stored(rows, "seq long, name string, vec array<double>")
    held, pairs = neighbours.dealt(df, 0.999, 50)
    sizes = held.groupBy("cell").count()
    assert sizes.agg(F.max("count")).first()[0] <= 100 and held.where("name = 'half'").select("cell").distinct().count() >= 12
    # the cells of a small radius meet few others
    cells = sizes.count()
    assert pairs.count() < cells * cells / 4


def test_empty_library(stored):
    df = stored([], "seq long, name string, vec array<double>")
    assert identity.duplicates(df).collect() == [] and cluster.similar_groups(df, 0.5).collect() == []


def test_components_of_ways_and_stars(stored):
    r = np.random.default_rng(4)
    way = list(range(200))
    r.shuffle(way)
    pairs = list(zip(way, way[1:])) + [(1000, k) for k in range(1001, 1100)] + [(5000, 5000)]
    got = {x["node"]: x["root"] for x in neighbours.components(stored([(int(a), int(b)) for a, b in pairs], "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(200)}, **{k: 1000 for k in range(1000, 1100)}}
