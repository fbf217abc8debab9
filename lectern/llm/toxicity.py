"""Toxicity scores: boosted trees over a few dense features of a text, with isotonic calibration.

Features are rates and densities, so that they mean the same for short and long texts:
words of a given lexicon and of one learned from labelled texts, disguised spellings of
either, how often a second person stands near such words, capitals, punctuation and
signs of obfuscation. The learned lexicon's densities of a training text come from a
lexicon learned on the other half of the texts; calibration uses scores of trees that
have not seen the text.
"""

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lectern.llm.boosting import BoostedTrees
from lectern.llm.common import record_batch, slices, table, texts, written

#: Labelled texts to learn from, at most.
SAMPLE = 20_000
#: Insults to start from; a parameter of fit().
LEXICON = frozenset(
    "arsehole asshole bastard bitch clown coward crap creep cretin cunt degenerate disgusting dumb dumbass fool fuck fucking garbage idiot idiotic imbecile jerk kill liar loser lowlife maggot moron moronic nazi parasite pathetic pig retard retarded scum shit shut slut stupid trash ugly vermin whore worthless "
    "abschaum arschloch depp dreck dumm dummkopf erbärmlich fotze hurensohn idioten mistkerl missgeburt schlampe schwein spast trottel versager wertlos widerlich "
    "abruti connard connasse crétin débile dégoûtant enculé imbécile merde minable ordure pourriture pute raclure salaud salope stupide "
    "asqueroso basura cabrón cobarde escoria estúpido estúpida gilipollas imbécil inútil mierda patético payaso pendejo puta puto".split()
)
SECOND = frozenset("you your yours yourself you're ur u ya du dich dir dein deine deinen ihr euch euer tu te toi ton tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Words between an insult and a second person that still count as near.
REACH = 5
#: Learned words: least number of toxic texts, least log-odds, most words.
LEAST_TEXTS, LEAST_ODDS, MOST_WORDS = 4, 2.0, 300
#: Texts of each fold for calibration, trees, and their depth.
FOLDS, TREES, DEPTH = 4, 40, 4
FEATURES = ("log_words", "given", "learned", "disguised", "kinds", "log_hits", "second", "near_second", "capitals", "shouted", "exclaimed", "asked", "marks", "mixed", "drawn_out", "digits")
_EDGE = ".,;:!?\"'()[]{}<>«»„“”‘’…-–—*_~`"
_LIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t"})


def bare(token: str) -> str:
    """A lower-cased token without marks at its ends."""
    return token.strip(_EDGE)


def undisguised(token: str) -> str:
    """What a token may stand for: digits and signs read as letters, other signs left out, runs of one letter as one."""
    letters = [c for c in token.translate(_LIKE) if c.isalpha()]
    return "".join(c for i, c in enumerate(letters) if not i or c != letters[i - 1])


def _squeezed(words) -> frozenset:
    return frozenset(undisguised(w) for w in words if len(w) > 3)


class Featurizer:
    """Feature vectors of texts for a given and a learned lexicon."""

    def __init__(self, given, learned):
        self.given, self.learned = frozenset(given), frozenset(learned)
        self.disguises = _squeezed(self.given | self.learned)
        self.known: dict[str, tuple] = {}

    def _kind(self, token: str) -> tuple[int, int, int, int, int, int]:
        """given, learned, disguised, second person, mixed, drawn out"""
        word = bare(token)
        given, learned = word in self.given, word in self.learned
        mixed = not word.isalpha() and any(c.isalpha() for c in word) and any(not c.isalpha() and c not in "-'’" for c in word)
        drawn = any(a == b == c and a.isalpha() for a, b, c in zip(word, word[1:], word[2:]))
        # a disguise has other signs than letters, or drawn-out letters
        hidden = not given and not learned and (mixed or drawn or not token.isalpha() and word != token) and not self.disguises.isdisjoint((undisguised(token), undisguised(word)))
        return given, learned, hidden, word in SECOND, mixed, drawn

    def vector(self, text: str) -> list[float]:
        tokens = text.lower().split()
        kinds = Counter(tokens)
        if len(self.known) > 200_000:
            self.known.clear()
        for t in kinds:
            if t not in self.known:
                if len(t) > 64:  # no word; not kept
                    kinds[t] = -kinds[t]
                else:
                    self.known[t] = self._kind(t)
        sums, hits = [0] * 6, 0
        named = set()
        for t, n in kinds.items():
            kind = self.known[t] if n > 0 else self._kind(t)
            if any(kind):
                for j, x in enumerate(kind):
                    sums[j] += x * abs(n)
                if kind[0] or kind[1] or kind[2]:
                    hits += abs(n)
                    named.add(t)
        near = 0
        if named and sums[3]:
            at = np.array([i for i, t in enumerate(tokens) if t in named])
            second = np.array([i for i, t in enumerate(tokens) if self.known.get(t, (0,) * 6)[3]])
            after = np.searchsorted(second, at)
            gap = np.minimum(np.abs(second[np.minimum(after, len(second) - 1)] - at), np.abs(at - second[np.maximum(after - 1, 0)]))
            near = int((gap <= REACH).sum())
        chars = Counter(text)
        count = lambda test: sum(n for c, n in chars.items() if test(c))
        letters, size, words = max(count(str.isalpha), 1), max(len(text), 1), max(len(tokens), 1)
        marks = count(lambda c: not c.isalnum() and not c.isspace() and c not in "!?")
        shouted = sum(t.isupper() and len(t) > 1 for t in text.split()) if count(str.isupper) * 20 > letters else 0
        return [
            np.log1p(len(tokens)), sums[0] / words, sums[1] / words, sums[2] / words, len({undisguised(bare(t)) for t in named}), np.log1p(hits), sums[3] / words, near / max(hits, 1),
            count(str.isupper) / letters, shouted / words, chars["!"] / size, chars["?"] / size, marks / size, sums[4] / words, sums[5] / words, count(str.isdigit) / size,
        ]

    def matrix(self, values: list[str]) -> np.ndarray:
        return np.array([self.vector(v) for v in values], np.float64).reshape(len(values), len(FEATURES))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and means of the blocks of the best non-decreasing fit of y by x; equal x share a block."""
    values, of = np.unique(x, return_inverse=True)
    blocks: list[list[float]] = []  # weight, sum of y, sum of x
    for n, total, value in zip(np.bincount(of), np.bincount(of, y), values):
        blocks.append([n, total, value * n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    weight, sums, places = (np.array(c) for c in zip(*blocks))
    return places / weight, sums / weight


@dataclass
class Model:
    """What a text's score needs. Without labels of both kinds trees is None and all scores are `base`."""

    given: frozenset
    learned: frozenset
    trees: BoostedTrees | None = None
    places: np.ndarray | None = None
    levels: np.ndarray | None = None
    base: float = 0.0

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(features):
            return np.full(len(features), self.base)
        return np.clip(np.interp(self.trees.log_odds(features), self.places, self.levels), 0.0, 1.0)


def held_out():
    """Whether the CRC-32 of doc_id as text is a multiple of five; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(h, text, toxic) of at most `most` labelled texts that are not held out, chosen by hash; h tells id and text.

    A document with several labels is toxic if one says so; labels and ids that are null are left out. Equal texts of one
    id count once.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic").where(~held_out())
    ids = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most `most` ids of fixed size
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").select(F.xxhash64("doc_id", "text").alias("h"), "text", "toxic")
    last = rows.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    return written(rows.where(F.col("h") <= F.lit(last)).dropDuplicates(["h"]), "sample")


def learned_words(sample: DataFrame, most: int = MOST_WORDS) -> list[frozenset]:
    """Three lexicons: of the sample's texts with even and with odd h, and of all."""

    schema = pa.schema([("half", pa.int32()), ("word", pa.string()), ("toxic", pa.int32())])

    def run(batches):
        for b in slices(batches, "text"):
            for h, toxic, text in zip(b.column("h").to_pylist(), b.column("toxic").to_pylist(), texts(b)):
                words = sorted({w for t in text.lower().split() if 2 < len(w := bare(t)) <= 64})
                yield record_batch(schema, [h % 2] * len(words), words, [int(toxic > 0)] * len(words))

    size = sample.groupBy(F.pmod("h", F.lit(2)).alias("half")).agg(F.sum((F.col("toxic") > 0).cast("long")).alias("toxic"), F.count("*").alias("n")).collect()
    toxic, n = ({r["half"]: r[k] for r in size} for k in ("toxic", "n"))
    counts = sample.select("h", "toxic", "text").mapInArrow(run, "half int, word string, toxic int")
    counts = counts.groupBy("word").agg(*[F.count(F.when((F.col("half") == h) & (F.col("toxic") == y), 1)).alias(f"{'ct'[y]}{h}") for h in (0, 1) for y in (0, 1)])
    counts = written(counts.where(F.col("t0") + F.col("t1") >= LEAST_TEXTS), "words")
    out = []
    for halves in ((0,), (1,), (0, 1)):
        t, c = (sum((F.col(f"{x}{h}") for h in halves), F.lit(0)) for x in "tc")
        all_toxic = sum(toxic.get(h, 0) for h in halves)
        all_clean = sum(n.get(h, 0) for h in halves) - all_toxic
        odds = F.log((t + 0.5) / F.lit(all_toxic + 1.0)) - F.log((c + 0.5) / F.lit(all_clean + 1.0))
        top = counts.select("word", odds.alias("odds"), t.alias("t")).where((F.col("odds") >= LEAST_ODDS) & (F.col("t") >= max(1, LEAST_TEXTS * len(halves) // 2)))
        # at most `most` words
        out.append(frozenset(r["word"] for r in top.orderBy(F.desc(F.col("odds") * F.log1p("t")), "word").limit(most).collect()))
    return out


def fit(sample: DataFrame, given=LEXICON) -> Model:
    """A model from a labelled_sample; the driver gets one vector of fixed size for each of its rows."""
    even, odd, learned = learned_words(sample)
    schema = pa.schema([("h", pa.int64()), ("toxic", pa.int32()), ("x", pa.list_(pa.float64()))])

    def run(batches):
        other = (Featurizer(given, odd), Featurizer(given, even))  # of an even row: the words of the odd ones
        for b in slices(batches, "text"):
            h = b.column("h").to_pylist()
            x = [other[k % 2].vector(t) for k, t in zip(h, texts(b))]
            yield record_batch(schema, h, [int(t > 0) for t in b.column("toxic").to_pylist()], x)

    rows = sorted(sample.select("h", "toxic", "text").mapInArrow(run, "h long, toxic int, x array<double>").collect(), key=lambda r: r["h"])
    y = np.array([r["toxic"] for r in rows], np.float64)
    model = Model(frozenset(given), learned, base=float(y.mean()) if len(y) else 0.0)
    if len(y) < 2 or y.min() == y.max():
        return model
    x, one = np.array([r["x"] for r in rows]), np.ones(len(y))
    fold = np.arange(len(y)) % FOLDS  # rows are in order of a hash
    unseen = np.zeros(len(y))
    for k in range(FOLDS):
        rest = fold != k
        unseen[~rest] = BoostedTrees.fit(x[rest], y[rest], one[rest], trees=TREES, depth=DEPTH, rate=0.15).log_odds(x[~rest])
    model.trees = BoostedTrees.fit(x, y, one, trees=TREES, depth=DEPTH, rate=0.15)
    model.places, model.levels = isotonic(unseen, y)
    return model


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """docs with columns score (0 to 1) and predicted (1 from a score of 0.5 on), from the text alone.

    A null text is scored like an empty one. Equal texts have equal scores. Columns of these names in docs are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred words and some thousand numbers
    out = docs.drop("score", "predicted")

    def run(batches):
        features = Featurizer(shared.value.given, shared.value.learned)
        for batch in slices(batches, "text"):
            score = shared.value.scores(features.matrix(texts(batch)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return out.mapInArrow(run, StructType([*out.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(labelled_sample(docs, table(spark, sf_dir, "labels")))
    return toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
