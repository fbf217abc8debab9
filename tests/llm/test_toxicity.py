"""Toxicity: features by hand, calibration against a plain fit, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np
import pytest

from lectern.llm import toxicity as tox

NICE = "the river house walked quietly green table seven morning letters open window paper garden music light stone you we read".split()
RUDE = "zorble grunk idiot".split()


def corpus(n, seed=1, flip=0.03):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad = r.random() < 0.25
        words = [w.capitalize() if r.random() < 0.1 else w for w in r.choices(NICE, k=r.randint(1, 80))]
        for _ in range(r.randint(1, 5) if bad else 0):
            words.insert(r.randrange(len(words) + 1), r.choice(RUDE) + r.choice(["", ",", "!"]))
        docs.append((i, " ".join(words), 7.0))
        if r.random() < 0.8:
            labels.append((i, int(bad != (r.random() < flip)), bad))
    return docs, labels


def test_features_by_hand():
    text = "YOU are an 1d10t, you IDIOT! really? grunk baaad a1"
    f = dict(zip(tox.FEATURES, tox.Featurizer({"idiot"}, {"grunk"}).vector(text)))
    assert f["given"] == 1 / 10 and f["learned"] == 1 / 10 and f["disguised"] == 1 / 10
    assert f["second"] == 2 / 10 and f["near_second"] == 1.0 and f["shouted"] == 2 / 10
    assert f["kinds"] == 2 and f["log_hits"] == np.log1p(3) and f["drawn_out"] == 1 / 10 and f["mixed"] == 2 / 10
    assert f["exclaimed"] == 1 / len(text) and f["asked"] == 1 / len(text) and f["marks"] == 1 / len(text) and f["digits"] == 4 / len(text)
    assert tox.Featurizer({"idiot"}, ()).vector("id*i*ot iiidiot i.d.i.o.t idiots riot")[3] == 3 / 5
    assert not any(tox.Featurizer({"idiot"}, ()).vector(""))


def test_isotonic_as_plain_pooling():
    r = np.random.default_rng(3)
    for n in (1, 2, 30):
        x, y = r.integers(0, 12, n).astype(float), r.integers(0, 2, n).astype(float)
        places, levels = tox.isotonic(x, y)
        assert (np.diff(levels) > 0).all() and (np.diff(places) > 0).all()
        # the value of the best monotone fit: the largest over starts of the least over ends of the mean between
        keys = sorted(set(x))
        for k in keys:
            best = max(min(y[(x >= a) & (x <= b)].mean() for b in keys if b >= k) for a in keys if a <= k)
            at = np.interp(k, places, levels)
            assert levels.min() - 1e-9 <= at <= levels.max() + 1e-9
            assert min(abs(levels - best)) < 1e-9


def test_held_out_accuracy_and_odd_rows(stored):
    docs, labels = corpus(1500)
    odd = [(5000, None, 1.0), (5001, "", 1.0), (None, "you idiot grunk zorble", 1.0), (5002, "grunk " * 50_000, 1.0), (5003, "w" * 200_000, 1.0)] + [docs[3]] * 5
    table = stored(docs + odd, "doc_id long, text string, score double")
    marks = stored(labels + [(5003, None, True), (None, 1, True), (labels[0][0], labels[0][1], True)], "doc_id long, toxic int, bad boolean")
    model = tox.fit(tox.labelled_sample(table, marks))
    assert {"grunk", "zorble"} <= model.learned and not model.learned & set(NICE)
    rows = tox.toxicity(table, model).select("doc_id", "text", "score", "predicted", tox.held_out().alias("held")).collect()
    assert len(rows) == len(docs) + len(odd)
    truth = {i: bad for i, _, bad in labels}
    held = [r for r in rows if r["doc_id"] in truth and r["held"]]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[5000]["score"] == by[5001]["score"] < 0.5 and by[None]["predicted"] == 1 == by[5002]["predicted"] and by[5003]["predicted"] == 0
    # calibrated: of the texts scored between bounds about the mean score is toxic
    near = np.array([(r["score"], truth[r["doc_id"]]) for r in rows if r["doc_id"] in truth])
    assert abs(near[:, 0].mean() - near[:, 1].mean()) < 0.05


@pytest.mark.parametrize("labels, want", [([], 0.0), ([(1, 0), (2, 0)], 0.0), ([(1, 1), (2, 1), (3, 2)], 1.0)])
def test_without_labels_of_both_kinds(stored, labels, want):
    docs = stored([(i, "some text") for i in range(6)], "doc_id long, text string")
    model = tox.fit(tox.labelled_sample(docs, stored(labels, "doc_id long, toxic int")))
    assert {r["score"] for r in tox.toxicity(docs, model).collect()} == {want}
    assert tox.toxicity(docs.limit(0), model).collect() == []


def test_sample_is_bounded_and_leaves_out_held_out_rows(stored):
    docs, labels = corpus(300)
    docs += [(7, f"copy {i}", 1.0) for i in range(400)]
    sample = tox.labelled_sample(stored(docs, "doc_id long, text string, n double"), stored(labels, "doc_id long, toxic int, bad boolean"), 50).collect()
    assert 0 < len(sample) <= 50
    held = {t for i, t, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    assert not held & {r["text"] for r in sample}
