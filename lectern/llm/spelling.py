"""Spelling variants: words one letter apart, found by range reporting in two orders.

All words of one length are sorted twice, forwards and by their reversals. Words that
begin with what stands before an edited place are an interval of the first order, and
words that end with what stands behind it one of the second; a wavelet tree over the
places of the first order in the second reports the words in both. An inserted letter
is looked for among the words of one letter more, a replaced one among those of the
same length, and a deleted one is the other's inserted one.

The vocabulary is cut into ranges of about equal size in either order. A word asks
for the edits behind a place of its own in the ranges that its beginning up to there
touches, and for those before it in the ranges of its ending; the place is the one
that touches the fewest, so that many words with one beginning or ending are no hot
spot. Letters are of U+0000 to U+00FF, one byte each.
"""

import re
import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm.common import record_batch, slices, table, written

RUN = "[A-Za-zÀ-ÿ]+"
#: A run loses a letter if its hash is a multiple of this; 0 changes none.
EVERY = 31
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A word is a variant of a near word that is so many times as frequent.
TIMES = 10
#: Words in a range, and the most ranges of an order, whose first words go to all tasks.
RANGE, MOST_RANGES = 20_000, 10_000
#: Letters times words, and rectangles, that are looked up at once.
BLOCK = 1 << 21
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", every: int = EVERY, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all texts, for words of at least so many letters and occurrences.

    Runs of letters are lower-cased in A-Z. If `every` divides the CRC-32 h of `<doc_id>:<run>`, the run loses its letter
    at h % length. A null text has no words, a null id counts as an empty one.
    """
    find = re.compile(RUN).findall
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        for b in slices(batches, "text", 1 << 23):
            total = Counter()
            for name, value in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                start = zlib.crc32(f"{name or ''}:".encode())
                lowered = (value or "").encode().translate(_LOWER).decode()
                for w, n in Counter(find(lowered)).items():
                    if len(w) < least_length:
                        continue
                    if every:
                        h = zlib.crc32(w.encode(), start)
                        if not h % every:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                            if len(w) < least_length:
                                continue
                    total[w] += n
            if total:
                yield record_batch(schema, list(total), list(total.values()))

    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class WaveletTree:
    """A sequence of numbers below its length by their bits, from the top; reports those of a range that stand in a range."""

    def __init__(self, values: np.ndarray):
        self.depth = max(int(len(values) - 1).bit_length(), 1)
        self.ones = []  # of each level: how many ones stand before each place, and how many zeros the level has
        v = values.astype(np.int64)
        for bit in range(self.depth - 1, -1, -1):
            one = (v >> bit) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(one)]))
            v = np.concatenate([v[one == 0], v[one == 1]])

    def report(self, a, b, low, high):
        """(i, value) of all values in [low[i], high[i]) at places [a[i], b[i])."""
        i, node = np.arange(len(a)), np.zeros(len(a), np.int64)
        for level, ones in enumerate(self.ones):
            size = 1 << (self.depth - 1 - level)
            zeros = len(ones) - 1 - ones[-1]
            a1, b1 = ones[a], ones[b]
            a, b = np.concatenate([a - a1, zeros + a1]), np.concatenate([b - b1, zeros + b1])
            i, node = np.concatenate([i, i]), np.concatenate([node, node + size])
            on = np.flatnonzero((a < b) & (node < high[i]) & (node + size > low[i]))
            a, b, i, node = a[on], b[on], i[on], node[on]
        return i, node


def _matrix(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def _order(rows: np.ndarray) -> np.ndarray:
    return np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")


def intervals(rows: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of letters asked and each length of its beginning: the first and the one behind the last of the sorted rows that begin so."""
    k, width = asked.shape
    lo, hi = np.zeros((k, width + 1), np.int32), np.zeros((k, width + 1), np.int32)
    a, b = np.zeros(k, np.int64), np.full(k, len(rows), np.int64)
    hi[:, 0] = b
    for i in range(width):
        if (b - a).max(initial=0) <= 1:  # one row at most is left for each: how far it agrees
            row = rows[np.minimum(a, len(rows) - 1), i:width]
            agree = np.logical_and.accumulate(row == asked[:, i:], axis=1) & (a < b)[:, None]
            lo[:, i + 1 :], hi[:, i + 1 :] = a[:, None], a[:, None] + agree
            break
        for side in (0, 1):
            left, right = a.copy(), b.copy()
            while True:
                on = np.flatnonzero(left < right)
                if not len(on):
                    break
                mid = (left[on] + right[on]) >> 1
                before = rows[mid, i] < asked[on, i] + np.uint16(side)
                left[on] = np.where(before, mid + 1, left[on])
                right[on] = np.where(before, right[on], mid)
            if side:
                b = left
            else:
                a, first = a, left
        a = first
        lo[:, i + 1], hi[:, i + 1] = a, b
    return lo, hi


class Orders:
    """Words of one length in both orders, with a wavelet tree from one to the other. words are sorted and distinct."""

    def __init__(self, words: list[bytes]):
        self.rows = _matrix(words)
        self.mirror = np.ascontiguousarray(self.rows[:, ::-1])
        self.by_end = _order(self.mirror)
        self.mirror = self.mirror[self.by_end]
        place = np.empty(len(words), np.int64)
        place[self.by_end] = np.arange(len(words))
        self.tree = WaveletTree(place)

    def near(self, asked: np.ndarray, start: np.ndarray, stop: np.ndarray):
        """(query, found) for edits of the asked words at places in [start, stop): replaced letters where the words have
        this length, inserted ones where they have one letter less. A letter put into a run of the same letter counts
        in front of the run only, so that no pair comes twice."""
        length, width = self.rows.shape[1], asked.shape[1]
        step = max(1, BLOCK // (width + 1))
        for at in range(0, len(asked), step):
            q, s, e = asked[at : at + step], start[at : at + step], stop[at : at + step]
            a, b = intervals(self.rows, q)
            c, d = intervals(self.mirror, np.ascontiguousarray(q[:, ::-1]))
            i = np.arange(length)
            behind = length - 1 - i  # letters behind the edited place
            a, b, c, d = a[:, i], b[:, i], c[:, behind], d[:, behind]
            own = self._has(q)[:, None] if width == length else 0  # a word is in its own intervals
            ask = (b - a > own) & (d - c > own) & (i >= s[:, None]) & (i < e[:, None])
            who, where = np.nonzero(ask)
            for x in range(0, len(who), BLOCK // 16):
                w, p = who[x : x + BLOCK // 16], where[x : x + BLOCK // 16]
                n, value = self.tree.report(a[w, p].astype(np.int64), b[w, p].astype(np.int64), c[w, p], d[w, p])
                found, w, p = self.by_end[value], w[n], p[n]
                letter = self.rows[found, p]
                keep = q[w, p] != letter if width == length else (p == 0) | (q[w, np.maximum(p - 1, 0)] != letter)
                yield at + w[keep], found[keep]

    def _has(self, q: np.ndarray) -> np.ndarray:
        kind = f"S{self.rows.shape[1]}"
        rows, q = self.rows.view(kind).ravel(), np.ascontiguousarray(q).view(kind).ravel()
        return rows[np.minimum(np.searchsorted(rows, q), len(rows) - 1)] == q


def touched(firsts: list[bytes], beginning: bytes) -> tuple[int, int]:
    """The first and the last range, by their first words, that can hold words with this beginning."""
    k = len(beginning)
    return max(bisect_right(firsts, beginning) - 1, 0), max(bisect_right(firsts, beginning, key=lambda f: f[:k]) - 1, 0)


def split_at(word: bytes, firsts: list[bytes], lasts: list[bytes]) -> tuple[int, tuple[int, int], tuple[int, int]]:
    """The place whose beginning and ending touch the fewest ranges, nearest to the middle, and the ranges of either order."""
    mirror, middle = word[::-1], (len(word) + 1) // 2
    best = None
    for k in sorted(range(len(word) + 1), key=lambda k: abs(k - middle)):
        f, r = touched(firsts, word[:k]), touched(lasts, mirror[: len(word) - k])
        cost = f[1] - f[0] + r[1] - r[0]
        if best is None or cost < best[0]:
            best = (cost, k, f, r)
        if not cost:
            break
    return best[1:]


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for all ordered pairs of words (word, n) that differ by one inserted, deleted or replaced letter; each pair once."""
    spark = words.sparkSession
    count = words.count()
    ranges = max(1, min(MOST_RANGES, -(-count // RANGE)))
    ordered = lambda key, side: words.repartitionByRange(ranges, key).select("word", "n", F.lit(side).alias("side"), F.spark_partition_id().alias("range"))
    kept = written(ordered(F.col("word"), 0).unionByName(ordered(F.reverse("word"), 1)), "ranges")
    # at most MOST_RANGES for each order
    bounds = kept.groupBy("side", "range").agg(F.min(F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word"))).alias("first")).collect()
    firsts, ids = [], []
    for side in (0, 1):
        own = sorted((r["first"].encode("latin-1"), r["range"]) for r in bounds if r["side"] == side)
        firsts.append([f for f, _ in own])
        ids.append([i for _, i in own])
    asked = pa.schema([("word", pa.string()), ("n", pa.int64()), ("side", pa.int32()), ("range", pa.int32()), ("cut", pa.int32())])

    def ask(batches):
        for b in batches:
            out = [[], [], [], [], []]
            for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
                cut, *both = split_at(w.encode("latin-1"), *firsts)
                for side, (low, high) in enumerate(both):
                    for r in ids[side][low : high + 1]:
                        for column, value in zip(out, (w, n, side, r, cut)):
                            column.append(value)
            if out[0]:
                yield record_batch(asked, *out)

    questions = words.mapInArrow(ask, "word string, n long, side int, range int, cut int")
    pair = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])

    def by_length(t: pa.Table) -> dict[int, tuple]:
        """Of each length the sorted words, their counts and, for questions, their cuts."""
        w = np.array([x.encode("latin-1") for x in t.column("word").to_pylist()], dtype=object)
        n, cut = t.column("n").to_numpy(), t.column("cut").to_numpy() if "cut" in t.column_names else np.zeros(len(w), np.int64)
        sizes = np.array([len(x) for x in w], np.int64)
        out = {}
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            at = at[np.argsort(w[at])]
            out[size] = (w[at], n[at], cut[at])
        return out

    def match(key, held: pa.Table, questions: pa.Table) -> pa.Table:
        side = key[0].as_py()
        have, want = by_length(held), by_length(questions)
        text = lambda words: [x.decode("latin-1") for x in words]
        out = []
        for size, (own, own_n, _) in have.items():
            orders = None
            for width in (size, size - 1):
                if width not in want:
                    continue
                orders = orders or Orders(own.tolist())
                q, q_n, cut = want[width]
                start, stop = (cut, np.full(len(q), size)) if side == 0 else (np.zeros(len(q), np.int64), cut)
                for i, j in orders.near(_matrix(q.tolist()), start, stop):
                    out.append(pa.table([text(q[i]), text(own[j]), own_n[j]], schema=pair))
                    if width < size:
                        out.append(pa.table([text(own[j]), text(q[i]), q_n[i]], schema=pair))
        return pa.concat_tables(out) if out else pair.empty_table()

    keys = ("side", "range")
    return kept.groupBy(*keys).cogroup(questions.groupBy(*keys)).applyInArrow(match, "word string, near string, near_n long")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word (word, n), where words are distinct.

    form is the near word of largest n (ties: the smallest in code-point order) if that is at least `times` n, else null;
    root is what the forms lead to, the word itself without a form. As n grows with each step by `times`, there is no
    circle, and the way is short.
    """
    words = written(words.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = near_pairs(words)
    rows = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n")).unionByName(pairs.withColumn("n", F.lit(None).cast("long")))
    best = rows.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))).alias("top"))
    frequent = -F.col("top.less") >= times * F.col("n")
    formed = written(best.select("word", "n", "n_near", F.when(frequent, F.col("top.near")).alias("form"), F.when(frequent, -F.col("top.less")).alias("form_n")), "formed")
    # each round doubles the steps that a word has gone
    steps = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = written(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "steps")
        if steps.where("moved").isEmpty():
            break
        steps = steps.drop("moved")
    return formed.join(steps.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir):
    return variants(word_counts(table(spark, sf_dir, "documents").select("doc_id", "text")))
