"""Quartile bucket digests of whole texts.

Six kinds of byte triplets from each window of five bytes are hashed into 128
buckets. A bucket's code says in which quarter of the counts it falls; the
document's length is kept on a logarithmic scale. Two digests compare by the
bounded sum of their code and length differences.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.functions import pandas_udf

from lectern.llm.common import mix64, partitions, record_batch, slices, table, texts, written

BUCKETS = 128
#: Places of a triplet's bytes in the window, and the salt of each kind (fixed values).
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
#: The difference at which likeness reaches 0: codes can differ by 3 in every bucket, by chance about by 1.25.
CODE_SPAN = 1.25 * BUCKETS
LENGTH_WEIGHT, LENGTH_CAP = 2.0, 24.0
#: Equal rows beyond which they are dealt once, and how many of them are told again by one row.
HOT, CHUNK = 1000, 10_000
DIGEST_CHARS = 2 + BUCKETS // 2

_rng = np.random.default_rng(20)
_TABLE = mix64(_rng.integers(0, 2**63, (3, 256), dtype=np.uint64)).astype(np.uint32) & np.uint32(BUCKETS * 8 - 1)


def digest(data: bytes) -> str:
    """Hex: length code (2 digits), then a 2-bit code for each bucket."""
    b = np.frombuffer(data, np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    n = len(b)
    for salt, (i, j, k) in enumerate(TRIPLETS):
        if n > k:
            m = n - k
            h = _TABLE[0][b[i : i + m]] + _TABLE[1][b[j : j + m]] * np.uint32(3) + _TABLE[2][b[k : k + m]] * np.uint32(7) + np.uint32(salt * 331)
            h *= np.uint32(0x9E3779B1)
            counts += np.bincount(h >> np.uint32(25), minlength=BUCKETS)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    size = min(255, int(round(8 * np.log2(n + 1))))
    return f"{size:02x}{packed.tobytes().hex()}"


def _codes(digests: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(digests)), np.uint8).reshape(len(digests), -1)
    p = raw[:, 1:]
    return raw[:, 0].astype(np.int64), np.stack([p & 3, p >> 2 & 3, p >> 4 & 3, p >> 6], axis=2).reshape(len(digests), -1).astype(np.int64)


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """0 to 1 for each pair; 1 for equal digests."""
    if not a:
        return np.zeros(0)
    (la, ca), (lb, cb) = _codes(a), _codes(b)
    d = np.abs(ca - cb).sum(axis=1) + np.minimum(LENGTH_CAP, LENGTH_WEIGHT * np.maximum(0, np.abs(la - lb) - 1))
    return np.maximum(0.0, 1.0 - d / CODE_SPAN)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column `fingerprint` of `text`. A null text has the digest of the empty text."""

    @pandas_udf("string")
    def of(values):
        return values.map(lambda t: digest((t or "").encode("utf-8", "surrogatepass")))

    return docs.withColumn("fingerprint", of(F.col(text)))


def _ranges(sizes: list[tuple[int, int, bool]], target: float) -> list[tuple[int, int]]:
    """(first range, number of ranges) of each bucket, from (bucket, bytes, whether it is one id) in order.

    Neighbouring buckets share a range up to `target` bytes; a bucket of one id and more bytes is split into several.
    """
    out, part, held = [], 0, 0
    for _, size, one in sizes:
        parts = max(1, int(size // target)) if one else 1
        if held and (parts > 1 or held + size > target):
            part, held = part + 1, 0
        out.append((part, parts))
        if parts > 1:
            part, held = part + parts, 0
        else:
            held += size or 1
    return out


def _ranged(docs: DataFrame, n: int) -> tuple[DataFrame, int]:
    """docs with a column `part`, ranges of about equal bytes in descending (doc_id, tie), and the number of ranges.

    Null ids come last. An id with many rows is cut by its rows' text hashes.
    """
    cuts = docs.select("doc_id").where("doc_id is not null").approxQuantile("doc_id", [i / (4 * n) for i in range(1, 4 * n)], 0.05 / n)
    cuts = np.unique(np.array([int(c) for c in cuts], np.int64))

    @pandas_udf("int")
    def bucket(doc_id, none):
        import pandas as pd

        # buckets in descending order; a cut that is an id has a bucket of its own
        up = np.searchsorted(cuts, doc_id.to_numpy(), "left") + np.searchsorted(cuts, doc_id.to_numpy(), "right")
        return pd.Series(np.where(none.to_numpy(), 2 * len(cuts) + 1, 2 * len(cuts) - up).astype(np.int32))

    x = docs.withColumn("bucket", bucket(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull()))
    bytes_ = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    sizes = sorted(tuple(r) for r in x.groupBy("bucket").agg(F.sum(bytes_), F.max(F.coalesce("doc_id", F.lit(0))) == F.min(F.coalesce("doc_id", F.lit(0)))).collect())  # 8 n rows at most
    if not sizes:
        return x.withColumn("part", F.lit(0)), 1
    places = _ranges(sizes, max(1.0, sum(s[1] for s in sizes) / n))
    first, parts = np.zeros(2 * len(cuts) + 2, np.int64), np.ones(2 * len(cuts) + 2, np.int64)
    for (b, _, _), (f, m) in zip(sizes, places):
        first[b], parts[b] = f, m

    @pandas_udf("int")
    def part(bucket, tie):
        import pandas as pd

        b = bucket.to_numpy()
        down = (tie.to_numpy() ^ np.int64(2**63 - 1)).view(np.uint64)  # 0 for the largest tie
        return pd.Series((first[b] + ((down >> np.uint64(32)) * parts[b].astype(np.uint64) >> np.uint64(32)).astype(np.int64)).astype(np.int32))

    f, m = places[-1]
    return x.withColumn("part", part("bucket", "tie")).drop("bucket"), f + m


def compare_with_next(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """For each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's, in descending doc_id; after the last comes the first. Null texts count as empty. Null ids come after
    all others; rows of one id follow each other by their texts' hash. A single row is its own next one. Columns
    other than doc_id and text are left out.

    Texts are dealt once, to ranges of doc_id of about equal bytes, one range to a task. Each range also needs the first
    row of the range after it: those rows (one for each range, and its equals) are sent to two ranges. Rows that come more
    than `hot` times are dealt once, with their number: all but the last of them have their own like as the next one.
    """
    spark = docs.sparkSession
    n = max(2, partitions(spark))
    docs = docs.select("doc_id", "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tie"))
    kinds = docs.groupBy("doc_id", "tie").agg(F.count("*").alias("times"))
    rows = kinds.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    often = written(kinds.where(F.col("times") > max(hot, rows // 50_000)), "often")  # 50,000 rows at most
    any_often = not often.isEmpty()
    counted = docs.withColumn("times", F.lit(1).cast("long"))
    if any_often:
        o = F.broadcast(often.select(F.col("doc_id").alias("o_id"), F.col("tie").alias("o_tie"), F.col("times").alias("o_times")))
        marked = docs.join(o, F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("tie") == F.col("o_tie")), "left")
        once = marked.where("o_times is not null").groupBy("doc_id", "tie").agg(F.first("text").alias("text"), F.first("o_times").alias("times"))
        counted = marked.where("o_times is null").select("doc_id", "text", "tie", F.lit(1).cast("long").alias("times")).unionByName(once)
    ranged, count = _ranged(counted, n)
    firsts = sorted(ranged.groupBy("part").agg(F.max(F.struct("doc_id", "tie")).alias("first")).collect())  # a row for each range
    extra = [(int(f["part"]), int(f["first"]["doc_id"] or 0), f["first"]["doc_id"] is None, f["first"]["tie"], int(firsts[i - 1]["part"])) for i, f in enumerate(firsts)]
    extra = spark.createDataFrame(extra, "part int, x_id long, x_null boolean, tie long, before int")
    id_is = (F.col("x_id") == F.coalesce("doc_id", F.lit(0))) & (F.col("x_null") == F.col("doc_id").isNull())
    dealt = ranged.join(F.broadcast(extra.withColumnRenamed("part", "x_part").withColumnRenamed("tie", "x_tie")), (F.col("part") == F.col("x_part")) & (F.col("tie") == F.col("x_tie")) & id_is, "left")
    to = lambda part, more: F.struct(part.alias("to"), F.lit(more).alias("extra"))
    dealt = dealt.select("doc_id", "text", "tie", "times", F.inline(F.when(F.col("before").isNull(), F.array(to(F.col("part"), False))).otherwise(F.array(to(F.col("part"), False), to(F.col("before"), True)))))
    dealt = dealt.repartitionById(count, F.col("to")).sortWithinPartitions("to", "extra", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("next_fingerprint", pa.string()), ("times", pa.int64())])

    def fingerprinted(batches):
        for b in slices(batches, "text"):
            for to, more, doc_id, times, text in zip(*(b.column(c).to_pylist() for c in ("to", "extra", "doc_id", "times")), texts(b)):
                yield to, more, doc_id, text, digest(text.encode("utf-8", "surrogatepass")), times

    def compared(doc_id, text, fp, following, next_fp, times):
        half = len(text) // 2
        edited = (text[: len(text) - half] + following[:half]).encode("utf-8", "surrogatepass")
        return doc_id, len(text), hashlib.sha256(edited).hexdigest(), fp, digest(edited), next_fp, times

    def run(batches):
        held, out = None, []
        for to, more, doc_id, text, fp, times in fingerprinted(batches):
            if held is not None and held[0] == to and not held[1]:
                out.append(compared(*held[2:5], text, fp, 1))
            if times > 1 and not more:
                own = compared(doc_id, text, fp, text, fp, 1)
                out += [(*own[:-1], min(CHUNK, times - 1 - i)) for i in range(0, times - 1, CHUNK)]
            if len(out) >= 500:
                yield record_batch(schema, *map(list, zip(*out)))
                out = []
            held = (to, more, doc_id, text, fp)
        if out:
            yield record_batch(schema, *map(list, zip(*out)))

    @pandas_udf("double")
    def near(a, b):
        import pandas as pd

        return pd.Series(likeness(a.tolist(), b.tolist()))

    found = dealt.select("to", "extra", "doc_id", "times", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, times long")
    if any_often:
        found = written(found, "compared")
        again = found.where("times > 1").repartition(n, F.monotonically_increasing_id()).withColumn("_r", F.explode(F.expr("sequence(1L, times)"))).drop("_r")
        found = found.where("times = 1").unionByName(again)
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("fingerprint", "edited_fingerprint").alias("near_edited"), near("fingerprint", "next_fingerprint").alias("near_next"))


def query(spark, sf_dir):
    return compare_with_next(table(spark, sf_dir, "documents"))
