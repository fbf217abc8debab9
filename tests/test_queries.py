"""Registered queries: those with SQL against it, the others against plain versions on small tables."""

import math
import re
import zlib
from datetime import datetime, timedelta
from difflib import SequenceMatcher
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from lectern.operators import cluster
from lectern.queries import ORACLES, QUERIES, documents

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark, tmp_path, rows):
    """A folder with rows (user, hour, kind, props) as the table events."""
    t = datetime(2024, 1, 1)
    all_ = [(i, t + timedelta(hours=hour), user, kind, 0.0, props) for i, (user, hour, kind, props) in enumerate(rows)]
    spark.createDataFrame(all_, EVENTS).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path), all_


def test_echo_near(spark, tmp_path):
    props = ['{"k": 69}', '{"k": 68}', '{"other": "thing"}', '{"wholly": "unlike, 0123456789"}', '{"k": 6}', ""]
    rows = [(u, h * 17 % 101, ("view", "click", "error")[(h + u) % 3], props[(h * h + u) % 6]) for u in range(12) for h in range(u + 1)]
    rows += [(50, 0, "view", props[0]), (50, 1, "click", props[1]), (51, 0, "view", props[3]), (51, 1, "click", props[0]), (52, 0, "view", props[0]), (52, 60, "click", props[0])]
    sf, all_ = events(spark, tmp_path, rows)
    norm = lambda s: re.sub(r"[\W_]+", "", s).lower()
    want, inside_only = set(), set()
    for i, t, user, kind, _, p in all_:
        if kind != "view":
            continue
        mine = norm(kind + p)
        near = [norm("view" + x[5]) for x in sorted(all_, key=lambda x: (x[1], x[0])) if x[2] == user and x[3] == "click" and abs((x[1] - t).total_seconds()) <= 86402]
        if any(max(len(mine), len(o)) >= 4 and SequenceMatcher(None, mine, o).ratio() >= 0.66 for o in near):
            want.add((user, i))
        if len(mine) >= 4 and mine in "".join(near):
            inside_only.add((user, i))
    assert {tuple(r) for r in documents.QUERIES["echo_near"](spark, sf).collect()} == want | inside_only
    assert {tuple(r) for r in documents.QUERIES["echo_inside"](spark, sf).collect()} == inside_only
    assert want - inside_only and (50, len(rows) - 6) in want and {u for u, _ in want}.isdisjoint({51, 52})


def plain_phrase(text):
    """The n-gram of 2 to 6 with the greatest count * n, at its shortest period, turned to where it comes doubled; None if it comes under 8 times."""
    marks, best = ",。、?!;:.!?;: ", None
    for n in range(2, 7):
        grams = [text[i : i + n] for i in range(len(text) - n + 1)]
        counts = {g: sum(x == g for x in grams) for g in grams}
        if grams:
            g = max(counts, key=lambda g: (counts[g], -grams.index(g)))
            if counts[g] >= 8 and (best is None or counts[g] * n > best[0]):
                best = (counts[g] * n, g)
    if best is None:
        return None
    p = best[1]
    n = min(k for k in range(1, len(p) + 1) if (p[:k] * len(p))[: len(p)] == p)
    fit = [r for r in (p[i:n] + p[:n][:i] for i in range(n)) if r[0] not in marks and r * 2 in text]
    fit = [r for r in fit if r[-1] in marks] or fit
    return (min(fit, key=lambda r: text.find(r * 2)) if fit else p[:n]).strip(marks)


def test_repeated_phrases(spark, tmp_path):
    kinds = ["view", "purchase", "signup", "a", "no, ", "error", "purchase", "annotation", "x"]
    sf, all_ = events(spark, tmp_path, [(i, i, k, "") for i, k in enumerate(kinds * 3)])
    want = {i: p for i, _, _, k, *_ in all_ if (p := plain_phrase(k * 9 + str(i % 10))) is not None}
    assert {tuple(r) for r in documents.QUERIES["repeated_phrase_turned"](spark, sf).collect()} == set(want.items())
    assert all(i in want for i, k in enumerate(kinds * 3) if k == "purchase") and want[1] == "purcha"


def test_documents_that_repeat_themselves(spark, tmp_path):
    """Which documents compress too well, and what they repeat, by zlib and a plain search."""
    texts = ["", None, "short", "one two three " * 40, "ha, " * 100, "哈囉," * 60, "a b c d e f g h i j k l m n o p q r s t u v w x y z 0 1 2 3 4 5 6 7 8 9 A B C D E F G H I J K L", "x" * 79, "x" * 80, "so it goes. " * 30 + "and then it ends"]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    bad = {i: bool(t) and len(t) >= 80 and len(t.encode()) / len(zlib.compress(t.encode(), 9)) >= 2.2 for i, t in rows}
    assert {r["doc_id"]: r["degenerate"] for r in documents.QUERIES["degenerate_docs"](spark, str(tmp_path)).collect()} == bad
    want = {i: p for i, t in rows if bad[i] and (p := plain_phrase(t)) is not None}
    assert {r["doc_id"]: r["phrase"] for r in documents.QUERIES["repeated_phrase_all"](spark, str(tmp_path)).collect()} == want
    assert set(bad.values()) == {True, False} and len(want) >= 4


def test_spoken_words(spark, tmp_path):
    """Punctuation and tokens by expressions that look behind, one text at a time."""
    texts = ["Well, v1.2 is out; see a/b-c!", "3:45, 10-12. end.", "。你好,世界!A-1、B", "", "a . b : c", "--x--", "1,000 a.b.c ."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def stripped(t):
        inside = lambda i: 0 < i < len(t) - 1 and t[i] in ".-:/" and all(c.isascii() and c.isalnum() for c in (t[i - 1], t[i + 1]))
        return "".join(c for i, c in enumerate(t) if c not in ",.!?;:，。、！？；：-/" or inside(i))

    def glued(t):
        return re.sub(r"(?<=[0-9A-Za-z])\s*([.\-:/])\s*(?=[0-9A-Za-z])", r"\1", re.sub(r"([.\-:/])", r" \1 ", t))

    got = {r["doc_id"]: (r["plain"], r["glued"]) for r in QUERIES["spoken_words"](spark, str(tmp_path)).collect()}
    assert got == {i: (stripped(t), glued(t)) for i, t in enumerate(texts)}


def plain_clusters(vecs, seconds, blocks, speakers):
    """Clusters of spans by merging the nearest two of all pairs, again and again, as the rules say."""
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    x = np.array([unit(v) for v in vecs - np.average(vecs, axis=0, weights=seconds)])
    groups = [[i for i in range(len(x)) if blocks[i] == b] for b in sorted(set(blocks))]
    if speakers == 1 or len(groups) == 1:
        return [list(range(len(x)))]
    centre = lambda g: unit(sum(seconds[i] * x[i] for i in g))
    length = lambda g: sum(seconds[i] for i in g)
    cos = lambda a, b: float(centre(a) @ centre(b))

    def join(a, b):
        groups.remove(a)
        groups.remove(b)
        groups.append(a + b)

    def best():
        return max(((cos(a, b), a, b) for i, a in enumerate(groups) for b in groups[:i]), key=lambda t: t[0])

    while len(groups) > max(1, speakers):
        c, a, b = best()
        if speakers <= 0 and c < 0.60:
            break
        join(a, b)
    if speakers <= 0:
        while len(groups) > 1 and (tiny := sorted((g for g in groups if length(g) < 20), key=min)):
            join(tiny[0], max((g for g in groups if g is not tiny[0]), key=lambda g: cos(g, tiny[0])))
        while (minor := [g for g in groups if length(g) < 60]) and len(minor) < len(groups):
            c, a, b = max(((cos(a, b), a, b) for a in minor for b in groups if length(b) >= 60), key=lambda t: t[0])
            if c < 0.30:
                break
            join(a, b)
        while len(groups) > 30:
            join(*best()[1:])
    return groups


def test_merging_as_plain():
    r = np.random.default_rng(3)
    for _ in range(60):
        n, k = int(r.integers(2, 40)), int(r.integers(1, 5))
        vecs = r.normal(size=(k, 6))[r.integers(0, k, n)] + r.normal(size=(n, 6)) * r.choice([0.1, 0.5])
        seconds, blocks = r.uniform(1, r.choice([5, 40]), n), np.unique(np.sort(r.integers(0, n, n)), return_inverse=True)[1]
        for speakers in (0, 1, 2):
            got, conf = cluster.merge_blocks(vecs, seconds, blocks, speakers)
            want = plain_clusters(vecs, seconds, blocks.tolist(), speakers)
            assert {frozenset(np.flatnonzero(got == c).tolist()) for c in set(got.tolist())} == {frozenset(g) for g in want}
            assert ((-1 - 1e-9 <= conf) & (conf <= 1 + 1e-9)).all()


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_as_sql(spark, sf_dir, tables, name):
    rows = lambda df: sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)
    got, want = QUERIES[name](spark, sf_dir).toPandas(), tables.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def as_sql(spark, tmp_path, name, table, rows, schema):
    """Rows of a query and of its SQL on a folder with one table, as texts, so that -0.0 is not 0.0."""
    path = f"{tmp_path}/{table}.parquet"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{path}/*.parquet'")
    want = con.sql(ORACLES[name])
    return [sorted(map(str, r)) for r in ([tuple(x) for x in QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()], want.fetchall())]


@pytest.mark.parametrize("name", ["block_vectors", "label_centroids"])
def test_vectors_that_round_to_zero_keep_their_sign(spark, tmp_path, name):
    got, want = as_sql(spark, tmp_path, name, "embeddings", [(1, 3, [-1e-7, 1.0, 1e-7]), (60, 4, [0.0, -1.0, -1e-7])], "vec_id long, label long, embedding array<float>")
    assert got == want and any("-0.0" in r for r in got)


def test_rendered_texts_are_cut_where_sql_cuts_them(spark, tmp_path):
    turns = [(1, 0, "user", "Nineteen letters ab\nand more"), (1, 1, "bot", " \n a paragraph\n"), (1, 2, "user", "ab\ncd"), (2, 0, "user", " ends with a break\n\n"), (3, 1, "bot", "\tx\n\n")]
    got, want = as_sql(spark, tmp_path, "md_render_document", "conversations", turns, "conv_id long, turn long, role string, text string")
    assert got == want
