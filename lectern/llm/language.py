"""Language identification with a string kernel.

Two texts are as alike as the n-grams (1 to 4 letters, blended) that both contain,
over the root of the product of how many each contains. A Nyström map through
landmark texts and one ridge regression for each language give the scores. The
kernel is linear in the presence vector, so the landmark product and the ridge
weights collapse into one matrix, and a batch of texts is scored by one product.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lectern.llm.common import flat_bytes, mix64, record_batch, slices, table, texts, written

ORDERS = (1, 2, 3, 4)
DIMS = 1 << 15
#: Bounds of what is fitted: labelled rows for each language and in all, landmarks in all. Every language keeps a row and a landmark.
TRAIN_PER_LANGUAGE, TRAIN_ROWS, LANDMARKS = 400, 4000, 160
#: Texts whose n-grams are held at once while fitting.
_BLOCK = 128
RIDGE = 0.02
UNKNOWN = "und"
#: Scores go through a softmax of this steepness.
STEEPNESS = 8.0


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


_IS_LETTER = None


def presence(values: list[str], dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """(rows x dims) 0/1 matrix of hashed n-grams, and whether each text has a letter.

    Texts are lower-cased; every run of other characters is one boundary mark.
    """
    global _IS_LETTER
    if _IS_LETTER is None:
        _IS_LETTER = _letters()
    x = np.zeros((len(values), dims), np.float32)
    has = np.zeros(len(values), bool)
    for r, text in enumerate(values):
        a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _IS_LETTER[a]
        if not letter.any():
            continue
        has[r] = True
        a = np.where(letter, a, np.uint32(32))
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first mark after a letter
        a = np.concatenate([[np.uint32(32)], a[keep], [np.uint32(32)]]).astype(np.uint32)
        h = np.zeros(len(a), np.uint32)
        for n in ORDERS:
            if len(a) < n:
                break
            h = (h[: len(a) - n + 1] * np.uint32(0x01000193)) ^ (a[n - 1 :] * np.uint32(0x9E3779B1))
            g = (h ^ np.uint32(n * 0x27D4EB2F)) * np.uint32(0x85EBCA6B)
            x[r, (g >> np.uint32(17)) % np.uint32(dims)] = 1.0
    return x, has


def packed(row: np.ndarray) -> bytes:
    """A presence vector as bits: DIMS / 8 bytes."""
    return np.packbits(row > 0).tobytes()


class Classifier:
    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.weights = languages, weights

    @classmethod
    def fit(cls, rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> "Classifier":
        """rows: (text, language)."""
        return cls.fit_packed([(packed(presence([text])[0][0]), lang) for text, lang in rows], landmarks, ridge)

    @classmethod
    def fit_packed(cls, rows: list[tuple[bytes, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> "Classifier":
        """rows: (packed presence vector, language). Landmarks are dealt to the languages in turn."""
        languages = sorted({lang for _, lang in rows})
        if not languages:
            return cls([], np.zeros((DIMS, 0), np.float32))
        y = np.array([languages.index(lang) for _, lang in rows])
        vectors = [v for v, _ in rows]

        def unit(values: list[bytes]) -> np.ndarray:
            x = np.unpackbits(np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1), axis=1).astype(np.float32)
            x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1.0))
            return x

        seen: dict[int, int] = {}
        turn = []
        for k in y.tolist():
            turn.append(seen.get(k, 0))
            seen[k] = turn[-1] + 1
        at = sorted(range(len(rows)), key=lambda i: (turn[i], y[i]))[: max(landmarks, len(languages))]
        marks = unit([vectors[i] for i in at])
        knm = np.concatenate([unit(vectors[a : a + _BLOCK]) @ marks.T for a in range(0, len(rows), _BLOCK)])
        val, vec = np.linalg.eigh(knm[at].astype(np.float64))
        keep = val > 1e-6 * max(val.max(), 1e-12)
        half = vec[:, keep] / np.sqrt(val[keep])  # Nyström: K_mm^(-1/2)
        phi = np.hstack([knm @ half, np.ones((len(rows), 1))])
        goal = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
        share = np.bincount(y, minlength=len(languages))
        w = (1.0 / np.maximum(share, 1))[y][:, None]  # each language counts alike
        w = w * len(rows) / w.sum()
        penalty = ridge * len(rows) * np.eye(phi.shape[1]) / phi.shape[1]
        penalty[-1, -1] = 1e-6
        beta = np.linalg.solve(phi.T @ (w * phi) + penalty, phi.T @ (w * goal))
        model = cls(languages, (marks.T @ (half @ beta[:-1])).astype(np.float32))
        model.bias = beta[-1]
        return model

    bias = 0.0

    def scores(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ridge output (rows x languages), and whether each text has a letter."""
        x, has = presence(values)
        return x @ self.weights / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1.0)) + self.bias, has

    def predict(self, values: list[str]) -> tuple[list[str], np.ndarray]:
        s, has = self.scores(values)
        if not self.languages or not values:
            return [UNKNOWN] * len(values), np.zeros(len(values))
        e = np.exp(STEEPNESS * (s - s.max(axis=1, keepdims=True)))
        best = s.argmax(axis=1)
        # how sure the choice is, times how much of the ideal output 1 it reaches
        p = e[np.arange(len(values)), best] / e.sum(axis=1) * np.clip((s[np.arange(len(values)), best] + 1) / 2, 0, 1)
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best, has)], np.where(has, p, 0.0)


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled_sample(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE, max_rows: int = TRAIN_ROWS) -> list[tuple[bytes, str]]:
    """(packed presence vector, language) of at most per_language labelled texts of each language, for the driver.

    In all there are at most max_rows, or one for each language where there are more languages than that. Texts are chosen
    by a hash of doc_id and text, one for each pair, however often it comes. The driver gets a vector of fixed size for each.
    """
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    top = 1 << 40
    rows = rows.select("text", "lang", F.pmod(F.xxhash64(F.lit(1), "doc_id", "text"), F.lit(top)).alias("h"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"), F.min("h").alias("least"))
    sizes = written(sizes, "languages")
    count = sizes.count()
    if not count:
        return []
    per_language = min(per_language, max(1, max_rows // count))
    # hashes below this bound: enough for per_language different ones, and the least one always
    below = F.greatest(F.col("least") + 1, F.least(F.lit(float(top)), F.lit(float(top) * (1.5 * per_language + 50)) / F.col("n")).cast("long"))
    near = sizes.select(F.col("lang").alias("l"), below.alias("below"))
    few = rows.join(near, F.col("lang") == F.col("l")).where("h < below").drop("l", "below")
    nth = Window.partitionBy("lang").orderBy("h")
    # copies of a text meet as partial minima; then each language has about 1.5 times per_language rows
    chosen = few.groupBy("lang", "h").agg(F.min("text").alias("text")).withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= per_language)
    schema = pa.schema([("lang", pa.string()), ("nth", pa.int32()), ("seen", pa.binary())])

    def run(batches):
        for batch in slices(batches, "text"):
            seen = [packed(presence([t])[0][0]) for t in texts(batch)]
            yield record_batch(schema, batch.column("lang"), batch.column("nth"), pa.array(seen, pa.binary()))

    found = chosen.select("text", "lang", "nth").mapInArrow(run, "lang string, nth int, seen binary").collect()
    return [(bytes(r["seen"]), r["lang"]) for r in sorted(found, key=lambda r: (r["nth"], r["lang"]))]


def identify(docs: DataFrame, sample_from: DataFrame | None = None) -> DataFrame:
    """docs with columns lang_pred and score, from the text alone.

    `und` and score 0 where the text is null or has no letter, or where nothing could be learned. Learns from
    labelled_sample(sample_from or docs). Columns of these names in docs are replaced.
    """
    sc = docs.sparkSession.sparkContext
    model = sc.broadcast(Classifier.fit_packed(labelled_sample(sample_from if sample_from is not None else docs)))
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    out = docs.select(*keep)
    schema = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for batch in slices(batches, "text"):
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                lang, score = model.value.predict(texts(part))
                arrays = [*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names, *schema.names])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    return out.mapInArrow(run, StructType([*out.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), docs)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
