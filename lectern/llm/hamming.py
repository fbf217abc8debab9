"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are dealt to shards by hash, and every query goes to every shard. A shard cuts
its codes into segments and indexes each segment's values. A query looks up the values
at distance 0, then 1, 2, ... of its own segments, one segment after the other. Once
segments 0 to s have been searched to radius r and the others to r - 1, every code
within segments * r + s has been seen; the query stops when the k-th verified distance
is no more than that.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lectern.llm.common import partitions, record_batch, table, written

#: Bits of a word; a code has as many words as it needs.
WORD = 64
TOP = 10
#: Codes in a shard at most, on average; small inputs are dealt to LEAST_SHARDS for parallel work.
SHARD_CODES, LEAST_SHARDS = 1 << 20, 16
#: Looked-up values held at once.
_LOOKUPS = 1 << 19


def sign_codes(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vectors with a long column `code`: bit i is 1 if element i (of the first 64) is above zero. See sign_words() for longer vectors.

    NaN and null elements count as not above zero; a null or empty vector has a null code.
    """
    bits = F.aggregate(
        F.transform(F.slice(F.col(vector), 1, WORD), lambda x, i: F.when((x > 0) & ~F.isnan(x), F.expr("1L")).otherwise(F.expr("0L")) * F.element_at(F.array(*[F.lit(1 << j if j < 63 else -(1 << 63)).cast("long") for j in range(WORD)]), i + 1)),
        F.lit(0).cast("long"),
        lambda a, b: a.bitwiseOR(b),
    )
    return vectors.withColumn("code", F.when(F.size(vector) > 0, bits))


def sign_words(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vectors with a column `code`, an array of longs: bit i of word w is 1 if element 64 * w + i is above zero.

    NaN and null elements count as not above zero; a null or empty vector has a null code.
    """
    powers = F.array(*[F.lit(1 << j if j < 63 else -(1 << 63)).cast("long") for j in range(WORD)])

    def word(w):
        bits = F.transform(F.slice(F.col(vector), w * WORD + 1, F.lit(WORD)), lambda x, i: F.when((x > 0) & ~F.isnan(x), F.element_at(powers, i + 1)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    words = F.sequence(F.lit(0), F.floor((F.size(vector) - 1) / WORD).cast("int"))
    return vectors.withColumn("code", F.when(F.size(vector) > 0, F.transform(words, word)))


class MultiIndex:
    """Segment indexes over distinct codes, a row of 64-bit words each; every segment lies within a word."""

    def __init__(self, codes: np.ndarray, weight: np.ndarray):
        n, words = codes.shape
        self.codes, self.weight, self.bits = codes, weight, WORD * words
        each = int(np.clip(round(WORD / max(4.0, np.log2(max(n, 2)))), 4, 16))
        self.m = each * words
        cuts = [WORD * i // each for i in range(each + 1)]
        self.word = [w for w in range(words) for _ in range(each)]
        self.low = [np.uint64(a) for a in cuts[:-1]] * words
        self.width = [b - a for a, b in zip(cuts, cuts[1:])] * words
        self.order, self.first = [], []
        for s in range(self.m):
            value = self.segment(codes, s)
            self.order.append(np.argsort(value, kind="stable"))
            self.first.append(np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << self.width[s]))]))
        self._masks: dict[tuple[int, int], np.ndarray] = {}

    def segment(self, codes: np.ndarray, s: int) -> np.ndarray:
        return ((codes[:, self.word[s]] >> self.low[s]) & np.uint64((1 << self.width[s]) - 1)).astype(np.int64)

    def masks(self, width: int, radius: int) -> np.ndarray:
        if (width, radius) not in self._masks:
            self._masks[width, radius] = np.array([sum(1 << i for i in c) for c in combinations(range(width), radius)], np.int64)
        return self._masks[width, radius]

    def _step(self, queries: np.ndarray, which: np.ndarray, s: int, r: int):
        """(query index, code index, distance) of codes that segment s finds first, at radius r."""
        masks = self.masks(self.width[s], r)
        block = max(1, _LOOKUPS // max(1, len(masks)))
        for a in range(0, len(which), block):
            q = which[a : a + block]
            value = self.segment(queries[q], s)[:, None] ^ masks[None, :]
            lo, hi = self.first[s][value].ravel(), self.first[s][value + 1].ravel()
            size = hi - lo
            owner = np.repeat(np.repeat(q, len(masks)), size)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
            code = self.order[s][at]
            x = queries[owner] ^ self.codes[code]
            fresh = np.ones(len(x), bool)
            for t in range(self.m):
                if t != s:
                    d = np.bitwise_count(self.segment(x, t))
                    fresh &= d > r if t < s else d >= r
            yield owner[fresh], code[fresh], np.bitwise_count(x[fresh]).sum(axis=1, dtype=np.int64)

    def search(self, queries: np.ndarray, k: int):
        """(query index, code index, distance): the nearest codes that hold k rows, and all as near as the last of them."""
        n = len(queries)
        seen = np.zeros((n, self.bits + 1), np.int64)
        live, found = np.arange(n), []
        for r in range(max(self.width) + 1):
            for s in range(self.m):
                if r > self.width[s] or not len(live):
                    continue
                for owner, code, d in self._step(queries, live, s, r):
                    np.add.at(seen, (owner, d), self.weight[code])
                    found.append((owner, code, d))
                covered = min(self.bits, self.m * r + s)
                live = live[seen[live, : covered + 1].sum(axis=1) < k]
        if not found:
            return (np.zeros(0, np.int64),) * 3
        owner, code, d = map(np.concatenate, zip(*found))
        reach = (np.cumsum(seen, axis=1) < k).sum(axis=1)  # the k-th distance
        near = d <= reach[owner]
        return owner[near], code[near], d[near]


def nearest(index: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank (from 1), id, distance: the k rows of index (id, code) nearest to each row of queries (query_id, code).

    Codes are longs or arrays of longs; shorter ones count as if zeros followed.

    Order is by distance, then id; a query that is itself in the index finds itself. Rows without a code or an id are
    left out; repeated ids keep their rows, repeated query ids are one query for each different code. An empty index
    gives no rows.

    The index is dealt once; a row is sent for each query and shard, so what is sent grows as queries times index rows
    over SHARD_CODES. Within a shard a query looks up some thousand values instead of all codes.
    """
    spark = index.sparkSession
    words_of = lambda df: df if dict(df.dtypes)["code"].startswith("array") else df.withColumn("code", F.when(F.col("code").isNotNull(), F.array(F.col("code").cast("long"))))
    index, queries = words_of(index), words_of(queries)
    most = lambda df: df.agg(F.coalesce(F.max(F.size("code")), F.lit(1))).first()[0]
    words = max(1, most(index), most(queries))
    whole = F.concat("code", F.array_repeat(F.lit(0).cast("long"), F.lit(words) - F.size("code")))
    index, queries = index.withColumn("code", whole), queries.withColumn("code", whole)
    by_id = Window.partitionBy("code").orderBy("id")
    # of equal codes only the first k ids can be among the nearest
    kept = index.select("id", "code").where("id is not null and code is not null").withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k)
    codes = written(kept.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    shards = max(LEAST_SHARDS, -(-codes.count() // SHARD_CODES))
    asked = queries.select("query_id", "code").where("query_id is not null and code is not null").distinct()
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "query_id", "code", F.lit(None).cast("array<bigint>").alias("ids"))
    held = codes.select(F.pmod(F.xxhash64("code"), F.lit(shards)).cast("int").alias("shard"), F.lit(None).cast("long").alias("query_id"), "code", "ids")
    dealt = held.unionByName(sent).repartition(max(shards, partitions(spark)), "shard").sortWithinPartitions("shard", F.col("query_id").asc_nulls_first(), "code")
    schema = pa.schema([("query_id", pa.int64()), ("code", pa.list_(pa.int64())), ("distance", pa.int32()), ("id", pa.int64())])

    def answers(tree, ids, query_id, code):
        owner, at, d = tree.search(code, k)
        order = np.lexsort((d, owner))
        owner, at, d = owner[order], at[order], d[order]
        rows = [(int(o), int(x), i) for o, c, x in zip(owner, at, d) for i in ids[c]]
        rows.sort()
        out, last, n = [], -1, 0
        for o, x, i in rows:
            n = n + 1 if o == last else 1
            last = o
            if n <= k:
                out.append((query_id[o], code[o].view(np.int64), x, i))
        if out:
            yield record_batch(schema, *map(list, zip(*out)))

    def matrix(column) -> np.ndarray:
        return column.flatten().to_numpy().view(np.uint64).reshape(-1, words)

    def run(batches):
        shard, codes, ids, tree = None, [], [], None
        for batch in batches:
            at = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if not part.num_rows:
                    continue
                if at[a] != shard:
                    shard, codes, ids, tree = at[a], [], [], None
                own = part.column("query_id").null_count
                if own:
                    codes.append(matrix(part.column("code").slice(0, own)))
                    ids += part.column("ids").slice(0, own).to_pylist()
                asked = part.slice(own)
                if not asked.num_rows or not ids:
                    continue
                if tree is None:
                    tree = MultiIndex(np.concatenate(codes), np.array([len(i) for i in ids]))
                for c in range(0, asked.num_rows, 256):
                    q = asked.slice(c, 256)
                    yield from answers(tree, ids, q.column("query_id").to_numpy(), matrix(q.column("code")))

    near = dealt.mapInArrow(run, "query_id long, code array<bigint>, distance int, id long")
    best = Window.partitionBy("query_id", "code").orderBy("distance", "id")
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "distance")


ORACLE = """
with codes as (
  select vec_id, list_sum(list_transform(range(1, len(embedding[1:64]) + 1), lambda i: case when embedding[i] > 0 and not isnan(embedding[i]) then (1::hugeint << (i - 1)::int) else 0::hugeint end))::ubigint as code
  from embeddings where len(embedding) > 0 and vec_id is not null
), pairs as (
  select q.vec_id as query_id, x.vec_id as id, bit_count(xor(q.code, x.code)::hugeint)::int as distance
  from codes q, codes x where q.vec_id % 50 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by distance, id)::int as rank from pairs
)
select query_id, rank, id, distance from ranked where rank <= 10
"""


def query(spark, sf_dir):
    """The ten nearest of all vectors for every vector whose id is divisible by 50."""
    codes = sign_words(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select(F.col("vec_id").alias("id"), "code")
    return nearest(codes, codes.where("id % 50 = 0").withColumnRenamed("id", "query_id"))
