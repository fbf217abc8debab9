"""Edit-aware token counts.

Each document keeps a segment tree whose leaves are short runs of pre-tokens and
whose inner nodes hold sums of code points and tokens. An edit finds its place by
descending the sums, re-encodes from the last pre-token that the edit can reach to
the first old boundary at which splitting falls into step again, and updates the
sums on the way to the root.
"""

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm.bpe import Vocabulary, default_vocabulary
from lectern.llm.common import record_batch, slices, table, texts

LEAF = 64
#: Code points behind a pre-token that its match can look at, in the public pattern.
REACH = 2


class TokenTree:
    def __init__(self, text: str, vocabulary: Vocabulary, reach: int = REACH):
        self.v, self.reach = vocabulary, reach
        pieces = vocabulary.findall(text)
        counts = list(map(len, map(vocabulary.known().__getitem__, pieces)))
        sizes = list(map(len, pieces))
        self.leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.size = 1
        while self.size < len(self.leaves):
            self.size *= 2
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i in range(len(self.leaves)):
            self.chars[self.size + i] = sum(sizes[i * LEAF : (i + 1) * LEAF])
            self.tokens[self.size + i] = sum(counts[i * LEAF : (i + 1) * LEAF])
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)

    def _leaf_at(self, pos: int) -> tuple[int, int]:
        """The leaf that holds code point pos, and the place where that leaf starts."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if pos >= start + self.chars[i]:
                start += self.chars[i]
                i += 1
        return min(i - self.size, len(self.leaves) - 1), start

    def _store(self, k: int, pieces: list[str]) -> None:
        memo = self.v.known()
        self.leaves[k] = pieces
        i = self.size + k
        self.chars[i], self.tokens[i] = sum(map(len, pieces)), sum(len(memo[p]) for p in pieces)
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def edit(self, pos: int, delete: int, insert: str) -> int:
        """Replace code points [pos, pos + delete) by insert; returns the code points that were re-encoded."""
        pos = max(0, min(pos, self.n_chars))
        delete = max(0, min(delete, self.n_chars - pos))
        if not delete and not insert:
            return 0
        k, start = self._leaf_at(max(0, min(pos - self.reach, self.n_chars - 1)))
        first, head = k, []
        for p in self.leaves[k]:
            if start + len(p) > pos - self.reach:
                break
            head.append(p)
            start += len(p)
        rest = self.leaves[k][len(head) :]
        old, ends, at = [], set(), 0  # old pre-tokens from start on, and where they end behind start
        more = rest
        while True:
            for p in more:
                old.append(p)
                at += len(p)
                ends.add(at)
            final = k + 1 >= len(self.leaves)
            if final or at >= pos - start + delete + self.reach:
                raw = "".join(old)
                new = raw[: pos - start] + insert + raw[pos - start + delete :]
                done, stop, shift = [], 0, delete - len(insert)
                for p in self.v.findall(new):
                    if not final and stop + len(p) + self.reach > len(new):
                        break
                    done.append(p)
                    stop += len(p)
                    if stop >= pos - start + len(insert) and stop + shift in ends:
                        break
                if stop == len(new) or stop >= pos - start + len(insert) and stop + shift in ends:
                    break
                if final:
                    break
            k += 1
            more = self.leaves[k]
        tail, at = [], 0
        for p in old:
            at += len(p)
            if at > stop + shift:
                tail.append(p)
        for i in range(first + 1, k + 1):
            self._store(i, [])
        self._store(first, head + done + tail)
        return stop


def edited_counts(docs: DataFrame, path: str | None = None, pattern: str | None = None, reach: int | None = None) -> DataFrame:
    """docs: doc_id, text, edits array<struct<pos int, removed int, added string>>, applied in order, each to
    the text that the one before left. Returns doc_id, n_chars, n_tokens of the text, edited_chars,
    edited_tokens after all edits, and reencoded_chars (what was split and encoded again for the edits).

    A null text counts as empty; null edits as none; a place outside the text is moved to its end. Another pattern than
    the public one needs its reach: how many code points behind a pre-token its match can look at.
    """
    known = default_vocabulary()
    if reach is None and pattern not in (None, known[1]):
        raise ValueError("a pattern other than the public one needs its reach")
    reach = REACH if reach is None else reach
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(path or known[0], pattern or known[1]))
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_chars", "n_tokens", "edited_chars", "edited_tokens", "reencoded_chars")])

    def run(batches):
        v = vocabulary.value
        for batch in slices(batches, "text"):
            rows = []
            for text, edits in zip(texts(batch), batch.column("edits").to_pylist()):
                tree = TokenTree(text, v, reach)
                before = (tree.n_chars, tree.n_tokens)
                again = sum(tree.edit(e["pos"] or 0, e["removed"] or 0, e["added"] or "") for e in edits or [] if e)
                rows.append((*before, tree.n_chars, tree.n_tokens, again))
            yield record_batch(schema, batch.column("doc_id").cast(pa.int64()), *map(list, zip(*rows)))

    return docs.select("doc_id", "text", "edits").mapInArrow(run, ", ".join(f"{n} long" for n in schema.names))


def with_standard_edits(docs: DataFrame) -> DataFrame:
    """Three edits for each document: a replacement after a third, an insertion after two thirds, an end note."""
    n = F.coalesce(F.length("text"), F.lit(0))
    one = lambda pos, removed, added: F.struct(pos.cast("int").alias("pos"), F.lit(removed).alias("removed"), added.alias("added"))
    return docs.withColumn(
        "edits",
        F.array(one(F.floor(n / 3), 12, F.lit(" revised it's 42")), one(F.floor(n * 2 / 3), 0, F.concat(F.lit("\n\n  see #"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), one(n + 1000, 0, F.lit(" end"))),
    )


def query(spark, sf_dir):
    """Counts of every document before and after the standard edits."""
    return edited_counts(with_standard_edits(table(spark, sf_dir, "documents").select("doc_id", "text")))
