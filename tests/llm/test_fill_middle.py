"""Fill-in-middle against plain Python, and the round trip."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from lectern.llm import fill_middle


def plainly(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_as_plain_python_and_back(stored):
    r = random.Random(3)
    pieces = ["word", "Zwei", " ", "\n", "é", "日本", "😀", "<", "<P", "S>", ">", "M", "\t", "1", "<<", "\r\n", " "]
    rows = [(i, "".join(r.choices(pieces, k=r.randint(0, 40))), "x", 1) for i in range(400)]
    rows += [(1000, "", "x", 1), (1001, None, "x", 1), (None, "some words here", "x", 1), (None, None, "x", 1), (1002, "a <M> b", "x", 1), (1003, "<P>", "x", 1), (1004, "wort" * 200_000 + " .", "x", 1), (1005, "- " * 100_000, "x", 1)]
    rows += [rows[0]] * 3
    docs = stored(rows, "doc_id long, text string, form string, n int")
    made = fill_middle.fill_in_middle(docs).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    got = made.select("doc_id", "text", "n", "form", F.length("prefix"), F.length("middle"), "output", "back").collect()
    assert len(got) == len(rows)
    for doc_id, text, *rest, back in got:
        assert tuple(rest) == plainly(doc_id, text)
        assert back == (text or "")
    forms = [g["form"] for g in got]
    assert 0.6 < sum(f != "plain" for f in forms) / len(forms) < 1 and forms.count("spm") > 30


def test_empty_table_and_rates(spark, stored):
    docs = stored([], "doc_id long, text string")
    assert fill_middle.fill_in_middle(docs).count() == 0
    docs = stored([(i, "a b c") for i in range(50)], "doc_id long, text string")
    assert fill_middle.fill_in_middle(docs, rate=0).where("form <> 'plain' or output <> text or prefix is not null").count() == 0
    assert fill_middle.fill_in_middle(docs, rate=100, spm_rate=100).where("form <> 'spm'").count() == 0


def test_no_shuffle_and_no_python(stored):
    plan = fill_middle.fill_in_middle(stored([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
