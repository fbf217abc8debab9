"""SimHash near-duplicates found with BK-trees.

Fingerprints that differ in at most four bits agree in one of five bit blocks, so
each fingerprint goes to five shards, one for each block and its value. A shard that
holds too many is divided again by the same rule over its other bits. Inside a shard
a BK-tree keys children by their Hamming distance to the parent, and a search follows
only edges within the radius. Trees travel with their shard, as their number grows
with the data and a broadcast would have no bound.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm.common import record_batch, partitions, slices, table, texts, written
from lectern.llm.components import components
from lectern.llm.xxh64 import hash_ranges

SHINGLE = 4
BITS, RADIUS = 64, 4
#: Fingerprints in one shard beyond which it is divided again.
MAX_SHARD = 20_000
#: Lanes over which the look-up of a component's smallest doc_id is dealt.
LANES = 16
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_TO_SPACE = bytes(32 if b in _SPACE else _LOWER[b] for b in range(256))

#: The bits of a byte as eight counters of one byte each: 255 of them add up without a carry.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").reshape(-1).view(np.uint64)


def fingerprint_all(values: list[str], shingle: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """For each text the majority bits of its shingles' XXH64; 0 without words."""
    out = np.zeros(len(values), np.uint64)
    raw = [t.encode("utf-8", "surrogatepass") for t in values]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=offsets[1:])
    data = (b" ".join(raw) + b" ").translate(_TO_SPACE)
    a = np.frombuffer(data, np.uint8)
    word = a != 32
    keep = word.copy()
    keep[1:] |= word[:-1]  # one space behind each word
    inside = np.flatnonzero(keep)
    word, a = word[inside], a[inside]
    if not len(a):
        return out
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(~word)
    doc = np.searchsorted(offsets, inside[starts], side="right") - 1
    words = np.bincount(doc, minlength=len(values))
    begin = np.cumsum(words) - words
    # a document of fewer words than a shingle is one shingle
    count = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
    owner = np.repeat(np.arange(len(values)), count)
    base = np.cumsum(count) - count
    i = np.arange(len(owner)) - base[owner] + begin[owner]
    last = i + np.minimum(shingle, words[owner]) - 1
    h = hash_ranges(a.tobytes(), starts[i], ends[last] - starts[i], seed)
    for d in np.flatnonzero(count).tolist():
        part = h[base[d] : base[d] + count[d]]
        lanes = np.zeros((-(-len(part) // 255) * 255, 8), np.uint64)
        lanes[: len(part)] = _LANES[part.view(np.uint8).reshape(-1, 8)]
        sums = lanes.reshape(-1, 255, 8).sum(axis=1).view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
        out[d] = np.packbits(sums * 2 > len(part), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (64 bits as a signed long) and the columns `carry` for each row; a null text has no words."""
    fixed = [("doc_id", pa.int64()), ("fp", pa.int64())]

    def run(batches):
        for b in slices(batches, "text"):
            fps = fingerprint_all(texts(b), shingle).view(np.int64)
            schema = pa.schema([*fixed, *[b.schema.field(c) for c in carry]])
            yield record_batch(schema, b.column("doc_id").cast(pa.int64()), pa.array(fps), *[b.column(c) for c in carry])

    rest = docs.select(*carry)
    return docs.select("doc_id", F.col(text).alias("text"), *carry).mapInArrow(run, ", ".join(["doc_id long, fp long", *[f"{c} {kind}" for c, kind in rest.dtypes]]))


class Forest:
    """BK-trees over groups of distinct 64-bit codes, built and searched level by level for all groups at once.

    codes must be grouped: group is ascending. A node's children are contiguous in `order`, by their distance to it.
    """

    def __init__(self, codes: np.ndarray, group: np.ndarray):
        n = len(codes)
        self.codes = codes
        self.group = group
        self.key = np.zeros(n, np.int64)  # distance to the parent
        self.first = np.full(n, 0, np.int64)  # children of node i: kids[first[i]:first[i] + number[i]]
        self.number = np.zeros(n, np.int64)
        kids, base = [], 0
        items, cluster = np.arange(n), np.unique(group, return_inverse=True)[1] if n else np.zeros(0, np.int64)
        head = np.ones(n, bool)
        head[1:] = cluster[1:] != cluster[:-1]
        self.roots = items[head]
        while len(items):
            head = np.ones(len(items), bool)
            head[1:] = cluster[1:] != cluster[:-1]
            node = np.repeat(items[head], np.diff(np.append(np.flatnonzero(head), len(items))))
            below, above = items[~head], node[~head]
            if not len(below):
                break
            d = np.bitwise_count(self.codes[below] ^ self.codes[above]).astype(np.int64)
            order = np.lexsort((d, above))
            below, above, d = below[order], above[order], d[order]
            cut = np.ones(len(below), bool)
            cut[1:] = (above[1:] != above[:-1]) | (d[1:] != d[:-1])
            child, parent = below[cut], above[cut]
            self.key[child] = d[cut]
            start = np.ones(len(child), bool)
            start[1:] = parent[1:] != parent[:-1]
            at = np.flatnonzero(start)
            self.first[parent[at]] = base + at
            self.number[parent[at]] = np.diff(np.append(at, len(child)))
            kids.append(child)
            base += len(child)
            items, cluster = below, np.cumsum(cut)
        self.kids = np.concatenate(kids) if kids else np.zeros(0, np.int64)

    def pairs(self, radius: int, block: int = 1 << 16):
        """Arrays (query, found) of items of one group within the radius, each pair once, in bounded pieces."""
        n = len(self.codes)
        which = np.searchsorted(self.group[self.roots], self.group) if n else np.zeros(0, np.int64)
        stack = [(np.arange(a, min(n, a + block)), self.roots[which[a : a + block]]) for a in range(0, n, block)]
        while stack:
            q, node = stack.pop()
            if len(q) > 4 * block:
                half = len(q) // 2
                stack += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            d = np.bitwise_count(self.codes[q] ^ self.codes[node]).astype(np.int64)
            hit = (d <= radius) & (node > q)
            if hit.any():
                yield q[hit], node[hit]
            has = self.number[node] > 0
            q, node, d = q[has], node[has], d[has]
            if not len(q):
                continue
            number = self.number[node]
            rep = np.repeat(np.arange(len(q)), number)
            kid = self.kids[np.repeat(self.first[node], number) + np.arange(len(rep)) - np.repeat(np.cumsum(number) - number, number)]
            near = np.abs(self.key[kid] - d[rep]) <= radius
            if near.any():
                stack.append((q[rep[near]], kid[near]))


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest-member labels after joining a[i] with b[i]; labels[x] is a root, and roots label themselves."""
    while True:
        ra, rb = labels[a], labels[b]
        open_ = ra != rb
        if not open_.any():
            return labels
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(labels, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def _blocks(lo: int, hi: int, n: int) -> list[tuple[int, int]]:
    cuts = [lo + (hi - lo) * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:]))


def links(fps: DataFrame, radius: int = RADIUS, max_shard: int = MAX_SHARD) -> DataFrame:
    """(a, b) pairs of distinct fingerprints `fp` whose components are those of all pairs within the radius.

    A shard returns a link from each member of a component to its smallest member instead of all pairs, so
    the result is in proportion to the input.
    """
    spark = fps.sparkSession
    bit = lambda lo, hi: F.shiftrightunsigned(F.col("fp"), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
    level1 = _blocks(0, BITS, radius + 1)
    one = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), bit(lo, hi).alias("v")) for i, (lo, hi) in enumerate(level1)])).alias("s")).select("fp", "s.i", "s.v")
    hot = written(one.groupBy("i", "v").count().where(F.col("count") > max_shard).select("i", "v", F.lit(True).alias("hot")), "hot")
    marked = one.join(hot, ["i", "v"], "left")
    whole = marked.where("hot is null").select("fp", F.struct("i", "v", F.lit(-1).alias("j"), F.lit(0).cast("long").alias("w")).alias("shard"))
    # the other blocks' bits of a hot shard, in radius + 1 parts: these pieces of the blocks to the left and right
    parts = []
    for i, own in enumerate(level1):
        rest = [b for b in level1 if b != own]
        positions = [p for lo, hi in rest for p in range(lo, hi)]
        for j, (a, b) in enumerate(_blocks(0, len(positions), radius + 1)):
            value = sum((F.shiftrightunsigned(F.col("fp"), p).bitwiseAND(F.lit(1)) * F.lit(1 << k) for k, p in enumerate(positions[a:b])), F.lit(0))
            parts.append(F.struct(F.lit(i).alias("i2"), F.lit(j).alias("j"), value.cast("long").alias("w")))
    divided = marked.where("hot").select("fp", "i", "v", F.explode(F.filter(F.array(*parts), lambda s: s["i2"] == F.col("i"))).alias("s")).select("fp", F.struct("i", "v", "s.j", "s.w").alias("shard"))
    n = partitions(spark)
    dealt = whole.unionByName(divided).select("fp", F.xxhash64("shard").alias("shard")).repartition(n, "shard").sortWithinPartitions("shard", "fp")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def join(shard, fp):
        one_of = np.ones(len(fp), bool)
        one_of[1:] = (shard[1:] != shard[:-1]) | (fp[1:] != fp[:-1])
        shard, fp = shard[one_of], fp[one_of]
        labels = np.arange(len(fp))
        forest = Forest(fp.view(np.uint64), shard)
        for a, b in forest.pairs(radius):
            labels = join_labels(labels, a, b)
        linked = labels != np.arange(len(fp))
        if linked.any():
            yield record_batch(schema, pa.array(fp[linked]), pa.array(fp[labels[linked]]))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            shard, fp = (batch.column(c).to_numpy() for c in ("shard", "fp"))
            while len(shard):
                # whole shards only, a few hundred thousand rows at a time
                if size + len(shard) < 200_000:
                    held.append((shard, fp))
                    size += len(shard)
                    break
                last = held[-1][0][-1] if held else None
                if last is not None and shard[0] != last:
                    yield from join(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
                    continue
                same = int(np.searchsorted(shard, last, side="right")) if last is not None else 0
                cut = same if last is not None else int(np.searchsorted(shard, shard[-1], side="left")) or len(shard)
                held.append((shard[:cut], fp[:cut]))
                size += cut
                shard, fp = shard[cut:], fp[cut:]
                if len(shard):
                    yield from join(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
                else:
                    break
        if held:
            yield from join(*map(np.concatenate, zip(*held)))

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, max_shard: int = MAX_SHARD, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp, component_id, root and `carry` for each row of docs; component_id is the smallest doc_id that the row reaches.

    Rows link if their fingerprints differ in at most `radius` bits; equal texts always do. Null texts and texts
    without words have fingerprint zero. Null ids are left out of the minimum (a component of null ids alone has a
    null component_id); root, the smallest fingerprint of a component, tells all components apart. Columns other than
    doc_id, text and those in `carry` are left out.
    """
    rows = written(fingerprints(docs, shingle=shingle, carry=carry), "fp")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    tree = components(links(fps.select("fp"), radius, max_shard))
    reached = fps.join(tree, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # only components of several fingerprints need a look-up; it is dealt by lanes, so that a giant one is not one task
    lowest = reached.groupBy("root").agg(F.min("least").alias("lowest"), F.count("*").alias("n")).where("n > 1").drop("n")
    lowest = lowest.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))))
    laned = written(reached.withColumn("lane", F.pmod(F.xxhash64("fp"), F.lit(LANES)).cast("int")), "reached")
    named = laned.join(lowest, ["root", "lane"], "left").select(F.col("fp").alias("k"), F.coalesce("lowest", "least").alias("component_id"), "root")
    named = written(named, "named")
    return rows.join(named, F.col("fp") == F.col("k")).select("doc_id", "fp", "component_id", "root", *carry)


def query(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
