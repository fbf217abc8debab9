"""Removal of repeated passages with suffix arrays.

Where to look: every `length`-byte string picks the window of ANCHOR bytes in it whose
hash is smallest, by content alone, so equal strings pick the same one. Neighbouring
string starts that pick the same window form a piece; only pieces whose anchor occurs
elsewhere can hold a repeat. Pieces that are equal as wholes are counted as copies.

What repeats: the different pieces of an anchor meet in one task, where a two-stage
suffix sort orders their suffixes. Suffixes smaller than their successors are sorted
directly, all others are induced from them by a scan over the buckets of first bytes,
and adjacent suffixes with a common prefix of `length` bytes are repeats. An anchor
with more different pieces than MAX_GROUP is divided: its pieces are cut on an ever
finer grid and regrouped by the bytes that all strings of a cut share, down to cuts of
a single string, whose group has a single piece.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from lectern.llm.common import flat_bytes, mix64, partitions, record_batch, slices, table, written

LENGTH, ANCHOR = 400, 64
MAX_GROUP = 250
GRIDS = (64, 16, 4, 1)
#: Bytes of pieces in one suffix array, unless one group has more.
SHARD_BYTES = 400_000
_SEP = b"\xff"  # in no UTF-8 text

_rng = np.random.default_rng(5)
_BYTE = _rng.integers(1, 2**63, (2, 256), dtype=np.uint64) | np.uint64(1)
#: Base of the polynomial hash and its inverse modulo 2^64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = max(n, 1 << 20)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - 1, b, np.uint64)])) for b in (_BASE, _BACK)]
    return _powers[0][:n], _powers[1][:n]


class RangeHash:
    """Hashes of any byte range of an array, equal for equal bytes."""

    def __init__(self, data: np.ndarray, kind: int):
        up, self.back = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[kind][data] * up[:-1], out=self.sums[1:])

    def __call__(self, lo, hi):
        return mix64((self.sums[hi] - self.sums[lo]) * self.back[lo])


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    n = len(a)
    p = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    p[:n] = a
    p = p.reshape(-1, w)
    left = np.minimum.accumulate(p, axis=1).ravel()
    right = np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def pieces(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """(document, start in it, number of string starts, anchor hash, piece hash, anchor place less start) arrays.

    A piece of n starts covers n + length - 1 bytes. Documents shorter than length have none.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(data) < length:
        return none
    one = RangeHash(data, 0)
    i = np.arange(len(data) - anchor + 1)
    h = one(slice(0, len(i)), slice(anchor, anchor + len(i)))
    key = (h >> np.uint64(32) << np.uint64(32)) | i.astype(np.uint64)  # leftmost of equal hashes
    best = _sliding_min(key, length - anchor + 1)
    size = np.diff(offsets)
    doc = np.repeat(np.arange(len(size)), np.maximum(size - length + 1, 0))
    count = np.maximum(size - length + 1, 0)
    s = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(offsets[:-1], count)
    if not len(s):
        return none
    at = (best[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.ones(len(s), bool)
    first[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    f = np.flatnonzero(first)
    n = np.diff(np.append(f, len(s)))
    start = s[f]
    return doc[f], start - offsets[doc[f]], n, h[at[f]].view(np.int64), RangeHash(data, 1)(start, start + n + length - 1).view(np.int64), at[f] - start


def suffix_order(text: bytes, inside: np.ndarray, depth: int) -> np.ndarray:
    """Places `inside` (a mask) of text in the order of their suffixes' first `depth` bytes at least.

    The place after a larger-than-successor place of `inside` must be inside too.
    """
    n = len(text)
    t = np.frombuffer(text, np.uint8)
    rise = np.zeros(n, np.int8)
    rise[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1])
    rise[-1] = -1  # the empty suffix is smaller
    turn = np.flatnonzero(rise)
    small = rise[turn[np.searchsorted(turn, np.arange(n))]] > 0
    # stage one: the suffixes smaller than their successors, sorted directly
    direct = np.flatnonzero(small & inside).tolist()
    direct.sort(key=lambda i: text[i : i + depth])
    # stage two: buckets by first byte hold the larger suffixes before the smaller ones
    byte = t[inside]
    total = np.bincount(byte, minlength=256)
    bucket = np.cumsum(total) - total
    head = bucket.tolist()
    order = [-1] * int(total.sum())
    lower = np.bincount(t[direct], minlength=256) if direct else np.zeros(256, np.int64)
    at = 0
    for c in np.flatnonzero(lower).tolist():
        end = int(bucket[c] + total[c])
        order[end - int(lower[c]) : end] = direct[at : at + int(lower[c])]
        at += int(lower[c])
    induced = (inside & ~small).tolist()
    if n and induced[n - 1]:
        c = text[n - 1]
        order[head[c]] = n - 1
        head[c] += 1
    for i in order_scan(order):
        j = i - 1
        if j >= 0 and induced[j]:
            c = text[j]
            order[head[c]] = j
            head[c] += 1
    return np.array(order, np.int64)


def order_scan(order: list[int]):
    """The entries of a list that fills up ahead of the scan."""
    for i in order:
        if i >= 0:
            yield i


def repeated_starts(found: list[tuple[bytes, int, int]], length: int = LENGTH) -> list[np.ndarray]:
    """For pieces (bytes, number of starts, copies): which of a piece's starts repeat, within it, in another or in a copy."""
    text = _SEP.join(p for p, _, _ in found) + _SEP
    offsets = np.zeros(len(found) + 1, np.int64)
    np.cumsum([len(p) + 1 for p, _, _ in found], out=offsets[1:])
    number = np.array([n for _, n, _ in found], np.int64)
    t = np.frombuffer(text, np.uint8)
    owner = np.repeat(np.arange(len(found)), number)
    starts = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number) + offsets[owner]
    own = np.zeros(len(text), bool)
    own[starts] = True
    inside = own.copy()
    # behind each piece's starts, on to the first suffix that is smaller than its successor
    more = offsets[:-1] + number
    while len(more):
        more = more[more < len(text)]
        inside[more] = True
        more = more[more + 1 < len(text)]
        more = more[t[more] >= t[more + 1]] + 1
        more = more[~inside[more]]
    order = suffix_order(text, inside, length)
    order = order[own[order]]
    words = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,)) if len(text) >= 8 else np.zeros(0, "<u8")
    # adjacent common prefixes, in words of eight bytes, as far as `length`
    a, b = order[:-1], order[1:]
    live = np.arange(len(a))
    for step in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        live = live[words[a[live] + step] == words[b[live] + step]]
    again = np.zeros(len(text), bool)
    again[a[live]] = True
    again[b[live]] = True
    return [np.ones(n, bool) if copies > 1 else again[o : o + n] for (_, n, copies), o in zip(found, offsets.tolist())]


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[0::2].tolist(), (edge[1::2] - 1).tolist()))


_FOUND = pa.schema([("k", pa.int64()), ("p", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def _compare(grouped: DataFrame, length: int) -> DataFrame:
    """(k, p, lo, hi) runs of repeated starts, from (k, p, n, copies, piece) with all pieces of a k."""

    def flush(rows):
        for (k, p), again in zip([r[:2] for r in rows], repeated_starts([(r[4], r[2], r[3]) for r in rows], length)):
            for lo, hi in _runs(again):
                yield k, p, lo, hi

    def run(batches):
        rows, size, out = [], 0, []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("k", "p", "n", "copies", "piece"))):
                if size >= SHARD_BYTES and rows[-1][0] != r[0]:
                    out += flush(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[4])
            if len(out) > 20_000:
                yield record_batch(_FOUND, *map(list, zip(*out)))
                out = []
        if rows:
            out += flush(rows)
        if out:
            yield record_batch(_FOUND, *map(list, zip(*out)))

    dealt = grouped.select("k", "p", "n", "copies", "piece").repartition(partitions(grouped.sparkSession), "k").sortWithinPartitions("k", "p")
    return dealt.mapInArrow(run, "k long, p long, lo int, hi int")


def _finer(hot: DataFrame, grid: int, length: int) -> DataFrame:
    """Pieces (k, p, n, copies, shift, piece) cut at multiples of grid from their anchor, with new keys.

    Returns (k0, p0, off, k, p, n, copies, shift, piece): off is the cut's first start within piece (k0, p0).
    """
    names = ["k0", "p0", "off", "k", "p", "n", "copies", "shift", "piece"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches):
        for batch in slices(batches, "piece", 1 << 19):
            out = []
            for k, p, n, copies, shift, piece in zip(*(batch.column(c).to_pylist() for c in ("k", "p", "n", "copies", "shift", "piece"))):
                data = np.frombuffer(piece, np.uint8)
                one, two = RangeHash(data, 0), RangeHash(data, 1)
                # start s lies at s - shift from the anchor; cut where that passes a multiple of grid
                cell = (np.arange(n) - shift) // grid
                cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), n]
                for a, b in zip(cuts, cuts[1:]):
                    c = int(cell[a])
                    lo, hi = (c + 1) * grid - 1 + shift, c * grid + shift + length  # shared by all strings of the cell
                    core = int(one(np.array([max(lo, 0)]), np.array([hi]))[0])
                    key = int(mix64(np.array([core ^ (k & (2**64 - 1)) ^ (c & 0xFFFF) * 0x9E3779B97F4A7C15 % 2**64], np.uint64))[0])
                    whole = int(two(np.array([a]), np.array([b + length - 1]))[0])
                    sign = lambda x: x - (1 << 64) if x >> 63 else x
                    out.append((k, p, a, sign(key), sign(whole), b - a, copies, shift - a, piece[a : b + length - 1]))
            if out:
                yield record_batch(schema, *map(list, zip(*out)))

    return hot.mapInArrow(run, "k0 long, p0 long, off int, k long, p long, n int, copies long, shift int, piece binary")


def repeats(docs: DataFrame, length: int = LENGTH, max_group: int = MAX_GROUP) -> DataFrame:
    """(rid, spans array<struct<lo, hi>>): starts lo to hi of repeated length-byte strings, for rows of docs (rid, text) that have any."""
    spark = docs.sparkSession
    schema = pa.schema([("rid", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("k", pa.int64()), ("p", pa.int64()), ("shift", pa.int32())])

    def cut(batches):
        for batch in slices(batches, "text", 1 << 19):
            rid = batch.column("rid").to_numpy()
            data, offsets = flat_bytes([b"" if t is None else t for t in batch.column("text").to_pylist()])
            doc, start, n, k, p, shift = pieces(data, offsets, length, max(1, min(ANCHOR, length // 4)))
            yield record_batch(schema, pa.array(rid[doc]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(k), pa.array(p), pa.array(shift.astype(np.int32)))

    raw = docs.select("rid", F.col("text").cast("binary").alias("text"))
    cuts = written(raw.mapInArrow(cut, "rid long, start int, n int, k long, p long, shift int"), "pieces")
    kinds = cuts.groupBy("k", "p").agg(F.count("*").alias("copies"))
    # written, so that the join has an exchange on both sides and a frequent anchor's kinds can be split; the members then
    # join on (k, p), as on k alone a frequent anchor's pieces would meet in one task
    keys = written(kinds.groupBy("k").agg(F.count("*").alias("kinds"), F.sum("copies").alias("total")).where("total > 1"), "keys")
    live = written(kinds.join(keys, "k").select("k", "p", "kinds", "copies"), "live")
    members = written(cuts.join(live, ["k", "p"]).select("rid", "start", "n", "k", "p", "shift", "kinds", "copies"), "members")
    # equal wholes of an anchor with no other piece: every start repeats
    found = members.where("kinds = 1").groupBy("k", "p").agg(F.lit(0).alias("lo"), (F.max("n") - 1).alias("hi"))
    one = members.where("kinds > 1").groupBy("k", "p").agg(F.min(F.struct("rid", "start", "n", "shift")).alias("one"), F.first("kinds").alias("kinds"), F.first("copies").alias("copies"))
    wanted = one.select("one.rid", F.struct("k", "p", "kinds", "copies", F.col("one.start").alias("start"), F.col("one.n").alias("n"), F.col("one.shift").alias("shift")).alias("w")).groupBy("rid").agg(F.collect_list("w").alias("wanted"))
    text = raw.join(wanted.hint("shuffle_hash"), "rid").select("text", F.explode("wanted").alias("w")).select("w.*", F.expr(f"substring(text, w.start + 1, w.n + {length - 1})").alias("piece"))
    text = written(text, "texts")
    found = found.unionByName(_compare(text.where(F.col("kinds") <= max_group), length))
    hot, back = text.where(F.col("kinds") > max_group).select("k", "p", "n", "copies", "shift", "piece"), []
    for grid in [g for g in GRIDS if g <= max(1, length // 2)]:  # strings of a cut share bytes
        if hot.isEmpty():
            break
        finer = written(_finer(hot, grid, length), "finer")
        kinds = finer.groupBy("k", "p").agg(F.sum("copies").alias("copies"), F.min(F.struct("k0", "p0", "off")).alias("one"))
        keys = written(kinds.groupBy("k").agg(F.count("*").alias("kinds"), F.sum("copies").alias("total")).where("total > 1"), "keys")
        live_cuts = written(kinds.join(keys, "k"), "live")
        chosen = live_cuts.select("k", "p", "kinds", F.col("copies").alias("sum"), "one.*").hint("shuffle_hash")
        ones = finer.drop("copies").join(chosen, ["k", "p", "k0", "p0", "off"]).withColumnRenamed("sum", "copies")
        ones = written(ones.select("k", "p", "n", "copies", "shift", "kinds", "piece"), "ones")
        last = grid == GRIDS[-1]
        small = ones.where("kinds = 1").select("k", "p", F.lit(0).alias("lo"), (F.col("n") - 1).alias("hi")).unionByName(_compare(ones.where((F.col("kinds") > 1) & (F.col("kinds") <= (1 << 60 if last else max_group))), length))
        back.append((finer.select("k0", "p0", "off", "k", "p"), small))
        hot = ones.where((F.col("kinds") > max_group)).select("k", "p", "n", "copies", "shift", "piece") if not last else ones.limit(0)
    up = None
    for names, small in reversed(back):
        small = small if up is None else small.unionByName(up)
        up = names.join(small, ["k", "p"]).select(F.col("k0").alias("k"), F.col("p0").alias("p"), (F.col("off") + F.col("lo")).alias("lo"), (F.col("off") + F.col("hi")).alias("hi"))
    if up is not None:
        found = found.unionByName(up)
    # written, so that the join has an exchange on both sides and large groups of equal pieces can be split
    found = written(found.groupBy("k", "p").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")), "found")
    spans = members.select("rid", "start", "k", "p").join(found, ["k", "p"]).select("rid", F.expr("transform(runs, r -> struct(start + r.lo as lo, start + r.hi as hi))").alias("runs"))
    return spans.groupBy("rid").agg(F.flatten(F.collect_list("runs")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, max_group: int = MAX_GROUP, text: bool = False) -> DataFrame:
    """docs with columns kept (binary: the bytes that stay), n_bytes, n_removed, n_spans; with text, kept_text too.

    kept_text is kept as text: where a removed string begins or ends within a character, the rest of it goes too.

    A byte goes if a `length`-byte string that covers it also starts anywhere else in the table, the same text
    included. Null texts count as empty. Rows are numbered once, in a table that all later steps read, so that
    neither a lost executor nor another split of the input shifts the numbers. Columns of these names in docs are
    replaced.
    """
    names = ["kept", "n_bytes", "n_removed", "n_spans", *(["kept_text"] if text else [])]
    docs = written(docs.drop(*names, "rid").withColumn("rid", F.monotonically_increasing_id()), "numbered")
    spans = repeats(docs.select("rid", "text"), length, max_group)
    x = docs.join(spans.hint("shuffle_hash"), "rid", "left").drop("rid").withColumn("_raw", F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    keep = [f for f in x.schema.fields if f.name not in ("spans", "_raw")]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for batch in slices(batches, "_raw"):
            rows = []
            for raw, runs in zip(batch.column("_raw").to_pylist(), batch.column("spans").to_pylist()):
                if not runs:
                    rows.append((raw, len(raw), 0, 0))
                    continue
                kept, last, gone, count = [], 0, 0, 0
                for lo, hi in sorted((r["lo"], r["hi"] + length) for r in runs):
                    if count == 0 or lo > last:
                        kept.append(raw[last:lo])
                        count += 1
                        gone += hi - lo
                        last = hi
                    elif hi > last:
                        gone += hi - last
                        last = hi
                kept.append(raw[last:])
                rows.append((b"".join(kept), len(raw), gone, count))
            columns = list(zip(*rows))
            if text:
                columns.append([b.decode("utf-8", "ignore") for b in columns[0]])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=[f.name for f in keep] + names)

    return x.mapInArrow(run, StructType([*keep, StructField("kept", BinaryType()), *(StructField(n, LongType()) for n in names[1:4]), *(StructField(n, StringType()) for n in names[4:])]))


def query(spark, sf_dir):
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
