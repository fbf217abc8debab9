"""Byte-level BPE with two tiers of lookup.

Tier one: a minimal perfect hash over the vocabulary resolves every pre-token
that is itself an entry. Tier two: a heap over linked bytes merges the rest,
lowest rank first and leftmost among equals. Each batch resolves a distinct
pre-token once and keeps the answer in a bounded memo.
"""

import base64
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from lectern.llm.common import record_batch, slices, table, texts

MEMO_ENTRIES = 400_000
MASK = (1 << 32) - 1


def default_vocabulary() -> tuple[str, str]:
    """(path, pattern) of the multilingual public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


class PerfectHash:
    """Minimal perfect hash of byte strings: a displacement for each bucket.

    Buckets are placed largest first; a bucket of one key stores its slot itself,
    so that every slot is used.
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 3)
        buckets: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for i, k in enumerate(keys):
            h = xxhash.xxh64_intdigest(k)
            buckets[h % self.buckets].append((i, h))
        self.shift = [0] * self.buckets
        self.slots = [-1] * n
        order = sorted(range(self.buckets), key=lambda b: -len(buckets[b]))
        free = None
        for b in order:
            group = buckets[b]
            if not group:
                break
            if len(group) == 1:
                if free is None:
                    free = iter([s for s in range(n) if self.slots[s] < 0])
                at = next(free)
                self.shift[b], self.slots[at] = -at - 1, group[0][0]
                continue
            d = 0
            while True:
                at = [self._slot(h, d) for _, h in group]
                if len(set(at)) == len(at) and all(self.slots[s] < 0 for s in at):
                    break
                d += 1
            self.shift[b] = d
            for s, (i, _) in zip(at, group):
                self.slots[s] = i

    def _slot(self, h: int, d: int) -> int:
        return ((h >> 32) + d * ((h & MASK) | 1) + d * d * d) % self.n

    def candidate(self, key: bytes) -> int:
        """Index of the only key that can equal `key`."""
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.buckets]
        return self.slots[-d - 1 if d < 0 else self._slot(h, d)]


class Memo(dict):
    """Pre-token to ids; what it doesn't hold yet is resolved when asked for."""

    def __init__(self, resolve):
        super().__init__()
        self.resolve = resolve

    def __missing__(self, piece: str) -> tuple[int, ...]:
        self[piece] = ids = self.resolve(piece)
        return ids


class Vocabulary:
    """Ranks, their bytes, and the two tiers."""

    def __init__(self, path: str, pattern: str):
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.pattern = pattern
        self.keys = list(self.ranks)
        self.ids = [self.ranks[k] for k in self.keys]
        self.hash = PerfectHash(self.keys)
        self.bytes_of = {i: k for k, i in self.ranks.items()}
        self._start()

    def _start(self):
        self.findall = regex.compile(self.pattern).findall
        self.memo = Memo(self.piece_ids)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("findall", "memo")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def whole(self, piece: bytes) -> int | None:
        at = self.hash.candidate(piece)
        return self.ids[at] if self.keys[at] == piece else None

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece that is no entry itself."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # node i covers piece[i:end[i]]; the next node starts at end[i]
        before = list(range(-1, n - 1))
        alive = bytearray(b"\x01" * n)
        heap = []
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := end[i]) >= n or end[j] != stop:
                continue
            alive[j] = 0
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (k := before[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        one = self.whole(data)
        return (one,) if one is not None else tuple(self.merge(data))

    def known(self) -> Memo:
        """The memo, emptied if it has grown past its bound."""
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        return self.memo

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known().__getitem__, self.findall(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, token_ids array<int>, decoded binary (the ids decoded again), a row for each row of docs.

    A null or empty text has no ids and decodes to no bytes. Equal rows give equal rows.
    Other columns of docs are left out. The vocabulary (bounded: one file) is broadcast.
    """
    known = default_vocabulary()
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(path or known[0], pattern or known[1]))
    schema = pa.schema([("doc_id", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches):
        v = vocabulary.value
        for batch in slices(batches, "text"):
            ids = [v.encode(t) for t in texts(batch)]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
            yield record_batch(schema, batch.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), [v.decode(x) for x in ids])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, token_ids array<int>, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode_documents()."""
    return encoded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def query(spark, sf_dir):
    return digests(encode_documents(table(spark, sf_dir, "documents")))
