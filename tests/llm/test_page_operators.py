"""HTML extraction, URL filters, mixing and the pipeline."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import html_extraction, language, mixing, practice_pages, url_filter
from lectern.llm.common import table
from lectern.llm.dom import Tree
from tests.llm.handwritten_pages import PAGES
from tests.llm.test_dedup_operators import plain_components, plain_fingerprint, removed_plainly


@pytest.fixture(scope="module")
def extractor():
    return html_extraction.Extractor(500)


def main_text(page):
    tree = Tree(page)
    mark = [1 if f'{practice_pages.MARK}="1"' in a else 0 if f'{practice_pages.MARK}="0"' in a else -1 for a in tree.attrs]
    for v in range(1, len(mark)):
        if mark[v] < 0 and tree.tag[v] not in ("html", "body", "head"):
            mark[v] = mark[tree.parent[v]]
    return tree.text([m != 0 and t != "head" for m, t in zip(mark, tree.tag)])


def test_extraction_of_unseen_layouts(extractor):
    pages = practice_pages.practice_pages(120, seed=1234)
    got = extractor.extract([re.sub(rf' {practice_pages.MARK}="\d"', "", p) for p in pages])
    want = [main_text(p) for p in pages]
    f1 = []
    for a, b in zip(got, want):
        x, y = Counter(a.split()), Counter(b.split())
        f1.append(2 * sum((x & y).values()) / max(1, sum(x.values()) + sum(y.values())))
    assert np.mean(f1) > 0.96
    assert np.mean([a == b for a, b in zip(got, want)]) > 0.8


def test_extraction_of_a_page(extractor):
    page = """<!doctype html><html><head><title>T</title><script>var a="</p><p>no";</script></head><body>
    <header class="site-header"><a href="/">Home of it</a></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
    <div class="cookie-notice">We use cookies here.</div>
    <main><article><h1>Caf&eacute; &amp; more</h1><p>First   para with <b>bold</b>text, and a line.<br>Next line, which goes on for a while.
    <p>Second &#x201c;para&#x201d; &lt;b&gt; has words, and some more of them.<!-- no --><div class="ad">Buy this now, cheap.</div><ul><li>One thing, in a list.<li>Two things, in a list.</ul></article></main>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href="/x">X</a></li></ul></aside>
    <div id="comments"><div class="comment"><p>I think so too.</p></div></div><form><label>Mail</label><input><button>Go</button></form>
    <footer>&copy; 2024 All rights</footer></body></html>"""
    got = extractor.extract([page])[0]
    assert got == "Café & more First para with boldtext, and a line. Next line, which goes on for a while. Second “para” <b> has words, and some more of them. One thing, in a list. Two things, in a list."


def test_extraction_of_handwritten_pages():
    """Layouts that the generator did not make; word by word."""
    got = html_extraction.fitted().extract([p for p, _ in PAGES])
    for a, (_, want) in zip(got, PAGES):
        x, y = Counter(a.split()), Counter(want.split())
        f1 = 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values()))
        assert f1 > 0.9, (a, want)
    assert sum(a == want for a, (_, want) in zip(got, PAGES)) >= 4


def test_dropped_nodes_hold_nothing_that_is_kept(extractor):
    for p in practice_pages.practice_pages(30, seed=77):
        tree = Tree(p)
        kept = html_extraction.decode(tree, extractor.trees.log_odds(html_extraction.features([tree])))
        assert all(not kept[v] or kept[tree.parent[v]] for v in range(1, len(tree.tag)))


def test_extraction_edges(spark, extractor):
    assert extractor.extract([]) == []
    odd = ["", "<", "plain words", "<p", "<!-- open", "<script>x", "a < b & c", "<div>" * 3000 + "deep", "</p></div>", "&#0;&#xffffffff;&nope;", '<p class="a>b">x</p>']
    assert len(extractor.extract(odd)) == len(odd)
    assert extractor.extract(["plain words"]) == ["plain words"]
    rows = spark.createDataFrame([(1, None, "u", 3), (1, None, "u", 3), (None, "<p>x y z, and so on.</p>", None, 3)], "page_id long, html string, url string, text int")
    got = html_extraction.extract_text(rows, practice=60)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r["text"], r["n_chars"]) for r in got.collect())[:2] == [("", 0), ("", 0)]
    assert html_extraction.extract_text(rows.limit(0), practice=60).count() == 0


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/a?b#c", "http://example.com", "http://example.com/", "http://notexample.com/en/x", "x://y://z/en/", "http://a.net/es/1", "http://a.net/fr", "http://a.net/de/1?q=/es/", "http://anet/es/", "http://com/x", "http://é.net/fr/ü", "http://a.b?x://c/d", "http://a#b/c", "http://A.com:80/en/1", "http://example.com/en/\nx"]


def test_urls_as_plain(spark, sf_dir):
    for rows in (list(enumerate(URLS)), [(r["page_id"], r["url"]) for r in table(spark, sf_dir, "pages").collect()]):
        got = {r["page_id"]: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
        assert len(got) == len(rows)
        for i, u in rows:
            host, path = plain_url(u)
            rule, verdict = plain_rule(host, path)
            assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
            assert got[i]["verdict"] == verdict if rule else got[i]["verdict"] in ("allow", "block")


def test_templates_learn_from_labels(spark):
    rows = [(f"http://h.org/spam/{i}/x", "block" if i % 10 else None) for i in range(300)] + [(f"http://h.org/news/{i}", "allow" if i % 10 else None) for i in range(300)]
    rows += [(f"http://h.org/cheap/{i}/x", "block") for i in range(100)] + [("http://h.org/odd", None), ("http://other.org/spam/1/x", None)]
    df = spark.createDataFrame(rows, "url string, label string")
    got = url_filter.filter_urls(df, rules=(), label="label").collect()
    by = defaultdict(set)
    for r in got:
        by[r["host"], r["template"]].add(r["verdict"])
    assert by["h.org", "/spam/{n}/x"] == {"block"} and by["h.org", "/news/{n}"] == {"allow"} and by["h.org", "/cheap/{n}/x"] == {"block"}
    assert by["h.org", "/*"] == {"allow"} and by["other.org", "/*/*/*"] == {"allow"}
    assert url_filter.filter_urls(df.limit(0), rules=(), label="label").count() == 0


def differ(a, b):
    """Whether the block rates of two sets of (template, labelled, blocked) are 1.96 standard errors apart."""
    (n, x), (m, y) = ((sum(k[1] for k in g), sum(k[2] for k in g)) for g in (a, b))
    p = (x + y) / (n + m)
    return abs(y / m - x / n) > 1.96 * math.sqrt(p * (1 - p) * (1 / n + 1 / m))


@pytest.mark.parametrize("counts", [[(30, 3 * k) for k in range(11)], [(400, 10 * k) for k in range(41)], [(5, k % 6) for k in range(40)], [(1, 0), (1, 1), (0, 0), (3000, 2990)]])
def test_merged_branches_by_their_meaning(stored, counts):
    """No branch differs from the group it joined, groups next to each other differ, and a ladder does not become one group."""
    leaves = [("h", f"/k{i:02}", n, b) for i, (n, b) in enumerate(counts)]
    got = {r["template"]: r for r in url_filter.judged(stored(leaves, "host string, template string, labelled long, blocked long")).collect()}
    assert len(got) == len(leaves)
    groups = defaultdict(list)
    for _, t, n, b in sorted(leaves, key=lambda x: (x[3] / max(x[2], 1), x[1])):
        if n:
            groups[got[t]["branch"]].append((t, n, b))
        else:
            assert not got[t]["rejected"]
    ordered = list(groups.values())
    assert [t for g in ordered for t, _, _ in g] == [t for _, t, n, b in sorted(leaves, key=lambda x: (x[3] / max(x[2], 1), x[1])) if n], "groups are runs of rates"
    assert all(differ(a, b) for a, b in zip(ordered, ordered[1:]))
    if len(counts) in (11, 41):
        first, last = ordered[0][0][0], ordered[-1][-1][0]
        assert got[first]["branch"] != got[last]["branch"] and not got[first]["rejected"] and got[last]["rejected"]
        assert all(not differ(g[:-1], g[-1:]) for g in ordered if len(g) > 1)


def plain_verdicts(urls):
    """(rule, verdict) of each url by the rules and a plain template tree."""
    rules = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}

    def parts(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path

    def rule(host, path):
        fits = [r for r in rules if (host == (h := r.split("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
        return max(fits, key=len, default=None)

    def segments(path):
        ending = r"(?=$|\.[A-Za-z]{1,5}$)"
        out = []
        for x in path.split("/")[1:]:
            x = re.sub(r"^\d+" + ending, "{n}", x)
            out.append(re.sub(r"^(?=[0-9a-fA-F-]*\d)[0-9a-fA-F-]{8,}" + ending, "{x}", x))
        return out

    found = [(*parts(u), rule(*parts(u))) for u in urls]
    paths = [[host, segments(path), ""] for host, path, _ in found]
    for level in range(max((len(s) for _, s, _ in paths), default=0)):
        kid, total = Counter(), Counter()
        for host, seg, t in paths:
            if level < len(seg):
                kid[host, t, seg[level]] += 1
                total[host, t] += 1
        for x in paths:
            if level < len(x[1]):
                n = kid[x[0], x[2], x[1][level]]
                x[2] += "/" + (x[1][level] if n >= 5 and n >= total[x[0], x[2]] * 0.01 else "*")
    leaf = defaultdict(lambda: [0, 0])
    for (host, _, t), (_, _, r) in zip(paths, found):
        leaf[host, t][0] += r is not None
        leaf[host, t][1] += r is not None and rules[r] == "block"
    overall = (sum(b for _, b in leaf.values()) + 1) / (sum(n for n, _ in leaf.values()) + 2)
    forms = defaultdict(list)
    for (host, t), (n, b) in leaf.items():
        if n:
            forms[host, re.sub(r"(?<=/)(?!\*|\{)[^/]+", "_", t)].append((b / n, t, n, b))
    rejected = set()
    for (host, _), branches in forms.items():
        groups = []
        for step in sorted({b * 1000 // n for _, _, n, b in branches}):
            these = [(t, n, b) for _, t, n, b in branches if b * 1000 // n == step]
            if groups and not differ(groups[-1], these):
                groups[-1] += these
            else:
                groups.append(these)
        for g in groups:
            if (sum(b for _, _, b in g) + 10 * overall) / (sum(n for _, n, _ in g) + 10) >= 0.8:
                rejected |= {(host, t) for t, _, _ in g}
    return [(r, rules[r] if r else "block" if (host, t) in rejected else "allow") for (host, _, t), (_, _, r) in zip(paths, found)]


def test_verdicts_as_plain(spark, tmp_path):
    """Every verdict of the table, and of deep paths, ties and repeated rows, against a plain tree."""
    urls = [r["url"] for r in table(spark, "/root/testdata/sf0.01", "pages").collect()]
    r = np.random.default_rng(2)
    deep = "/".join(["a"] * 14)
    urls += [f"http://X.net/es/{k}/{i}" for k in ("one", "two") for i in range(20)] + [f"http://x.net/{k}/{i}" for k in ("one", "two", "es2") for i in range(9)]
    urls += [f"https://d.org/{deep}/{r.choice(['x', 'y', 'z'])}/{i}?q" for i in range(30)] + [f"https://d.org/{deep}"] * 3 + [None, "no scheme", "http://", "http://h.net", "http://h.net/fr/#x/y", "ftp://h.net/fr//"]
    urls += [f"http://q.net/{k}/{i}/{d}" for i in range(40) for k, d in (("fr", "deadbeef01"), (r.choice(["p", "fr"]), "news.html"))]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {x["page_id"]: (x["rule"], x["verdict"]) for x in url_filter.query(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(urls))] == plain_verdicts(urls)
    assert {v for _, v in got.values()} == {"allow", "block"}


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        over = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * sizes[s]}
        if not over:
            for s in open_:
                target[s] = left * weight[s] / sum(weight[x] for x in open_)
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(spark):
    r = np.random.default_rng(8)
    rows = [(int(i), " ".join(["w"] * int(n)), s) for i, (n, s) in enumerate(zip(r.integers(1, 60, 3000), r.choice(["a", "b", "c", "é"], 3000, p=[0.05, 0.6, 0.3, 0.05])))]
    rows += [(5000 + i, "x y z", None) for i in range(200)] + [(6000, None, "a"), (6001, "", "nothing"), (None, "q r", "c"), (1, rows[1][1], rows[1][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("clash"))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for x in got:
        sizes[x["source"]] += x["size"]
        taken[x["source"]] += x["size"] * x["copies"]
        assert 0 <= x["copies"] <= 2
    want = plain_targets(dict(sizes))
    for x in got:
        assert x["source_size"] == sizes[x["source"]] and x["target"] == pytest.approx(want[x["source"]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(60, 0.02 * want[s])
    again = sorted((str(x["doc_id"]), x["size"], x["copies"]) for x in mixing.mix(docs.repartition(3)).collect())
    assert again == sorted((str(x["doc_id"]), x["size"], x["copies"]) for x in got)
    assert mixing.mixed(docs).count() == sum(x["copies"] for x in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def plain_copies(units, target, rounds=mixing.ROUNDS, most=2, tilt=0.1):
    """Copies by (h, nth) for a source's units (size, u, tie, key): whole copies, then what fits, down the ranking."""
    total, tilted = sum(x[0] for x in units), sum(x[0] ** (1 - tilt) for x in units if x[0])
    whole, ranking = {}, []
    for size, u, tie, key in units:
        rate = 0.0 if not size else float(most) if target >= most * total * (1 - 1e-9) else min(most, target / tilted * size**-tilt)
        whole[key] = math.floor(rate)
        if size and whole[key] < most:
            p = min(1 - 1e-9, max(1e-9, rate - whole[key]))
            ranking.append((math.log(u / (1 - u)) - math.log(p / (1 - p)), tie, size, key))
    room, misses, limit = target - sum(x[0] * whole[x[3]] for x in units), 0, math.inf
    if room < 1:
        return whole
    limit = room
    for _, _, size, key in sorted(ranking):
        if size > limit:
            continue
        if size <= room:
            whole[key] += 1
            room -= size
            continue
        misses, limit = misses + 1, room
        if misses == rounds or room < 1:
            break
    return whole


def test_mixing_as_plain_and_repeated_rows(spark):
    """The sampling against a plain walk down the ranking; sources of equal rows keep to their target."""
    r = np.random.default_rng(21)
    rows = [(1, "w " * 37, "equal")] * 150 + [(2, "v " * 11, "equal too")] * 110 + [(int(i), "x " * int(n), "long") for i, n in enumerate(r.integers(1, 40, 300))] + [(999, "x " * 4000, "long")]
    rows += [(int(i), "y " * int(n), None) for i, n in enumerate(r.integers(1, 400, 200))] + [(5, "z " * 9, "b")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    x = mixing.mix(docs, chunk=40).withColumn("u", mixing.uniform("doc_id", "h", "nth")).withColumn("tie", F.xxhash64(F.lit(1), "doc_id", "h", "nth")).collect()
    assert len(x) == len(rows)
    by = defaultdict(list)
    for row in x:
        by[row["source"]].append(row)
    for source, found in by.items():
        target = found[0]["target"]
        want = plain_copies([(f["size"], f["u"], f["tie"], (f["doc_id"], f["h"], f["nth"])) for f in found], target)
        assert {(f["doc_id"], f["h"], f["nth"]): f["copies"] for f in found} == want, source
        assert target - 40 <= sum(f["size"] * f["copies"] for f in found) <= target
    out = mixing.mixed(docs, chunk=40).groupBy("doc_id", "source").count().collect()
    copies = Counter()
    for row in x:
        copies[row["doc_id"], row["source"]] += row["copies"]
    assert {(o["doc_id"], o["source"]): o["count"] for o in out} == {k: n for k, n in copies.items() if n}


def test_targets_as_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = {a: (b, c) for a, b, c in con.execute(mixing.TARGETS_ORACLE).fetchall()}
    got = {r["source"]: (r["source_size"], r["target"]) for r in mixing.targets_query(spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    for s, (size, target) in got.items():
        assert size == want[s][0] and target == pytest.approx(want[s][1], rel=1e-9)


def test_pipeline_stages(spark, tmp_path):
    """Each stage on its own input, against plain versions of what it decides."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    extra = spark.createDataFrame([(90001, None, "en", "s", 0), (90002, "123 456", "en", "s", 7), (90003, "", None, None, 0)], docs.schema)
    docs.unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    docs, sf = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        path = str(tmp_path / name)
        out.write.parquet(path)
        before, docs = docs.collect(), spark.read.parquet(path)
        after = docs.collect()
        kept.append(len(after))
        if name == "language_id":
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or "")}
            assert all(r["lang"] != language.UNKNOWN for r in after)
        elif name == "near_dedup":
            ids = [r["doc_id"] for r in before]
            roots = plain_components(ids, [plain_fingerprint(r["text"]) for r in before])
            assert sorted(r["doc_id"] for r in after) == sorted(set(roots))
        elif name == "suffix_dedup":
            want = {r["doc_id"]: w[3] for r, w in zip(before, removed_plainly([r["text"] for r in before], corpus_pipeline.PASSAGE)) if w[3].decode("utf-8", "ignore")}
            assert {r["doc_id"] for r in after} == set(want)
            for r in after:
                assert r["text"] == want[r["doc_id"]].decode("utf-8", "ignore") and r["n_chars"] == len(r["text"])
        elif name == "mix_sources":
            copies = Counter(r["doc_id"] for r in after)
            assert max(copies.values()) <= 2
        else:
            assert len(after) == len(before) and set(docs.columns) >= {"doc_id", "n_tokens"}
    assert kept[0] >= kept[1] >= kept[2] > 0


def test_pipeline_drops_repeated_passages(spark, tmp_path):
    """Passages of 51 words that several documents share go; documents that share nothing stay as they are, very long ones too."""
    r = np.random.default_rng(17)
    word = lambda: "".join(r.choice(list("abcdefghijklmnop"), r.integers(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(51) for _ in range(6)]
    clean = {i: prose(120) for i in range(40)} | {40: prose(20_000), 41: "", 42: None}
    shared = {100 + i: f"{prose(70)} {passages[i % 6]} {prose(70)}" for i in range(24)}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in (clean | shared).items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "d"))
    got = {x["doc_id"]: x["text"] for x in corpus_pipeline.suffix_dedup(spark, spark.read.parquet(str(tmp_path / "d")), str(tmp_path)).collect()}
    assert {i: t for i, t in got.items() if i < 100} == {i: t for i, t in clean.items() if t}
    assert got.keys() >= shared.keys() and not any(p in t for p in passages for t in got.values())
    for i, t in shared.items():
        before, after = t.split(passages[(i - 100) % 6])
        assert got[i].startswith(before.strip()[:-8]) and got[i].endswith(after.strip()[8:])
