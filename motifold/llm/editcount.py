"""Token counts under edits, with a segment tree over each document's pre-tokens.

A leaf holds up to `LEAF` pre-tokens: their lengths and their numbers of tokens. Inner nodes hold sums, so a
place is found, and a changed leaf's sums are passed up, in logarithmic time. An edit splits anew from a few
pre-tokens before it to the first old border behind it: what follows a border doesn't depend on what is
before. Only pre-tokens in between are encoded.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from .bpe import Encoder, default_vocabulary, encoder, share
from .common import documents, pick, slices

#: Pre-tokens of a leaf at first, and how many times as many make the tree be built again.
LEAF, CROWDED = 64, 8
#: Pre-tokens before an edit that are split again: a blank run's split depends on what follows it.
BACK = 3


class Tree:
    """Lengths in characters and numbers of tokens of a text's pre-tokens, in leaves under binary sums."""

    def __init__(self, lengths: list[int], counts: list[int]):
        self.build(lengths, counts)

    def build(self, lengths: list[int], counts: list[int]) -> None:
        self.lengths = [lengths[i : i + LEAF] for i in range(0, len(lengths), LEAF)] or [[]]
        self.counts = [counts[i : i + LEAF] for i in range(0, len(counts), LEAF)] or [[]]
        self.size = 1 << (len(self.lengths) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        self.chars[self.size : self.size + len(self.lengths)] = map(sum, self.lengths)
        self.tokens[self.size : self.size + len(self.counts)] = map(sum, self.counts)
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, place: int) -> tuple[int, int, int]:
        """(leaf, index, start) of the pre-token that holds a character; of the last one, for a place at the end."""
        place = min(place, self.chars[1] - 1)
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if place >= start + self.chars[i]:
                start += self.chars[i]
                i += 1
        leaf = i - self.size
        ends = list(accumulate(self.lengths[leaf]))
        k = bisect_right(ends, place - start)
        return leaf, k, start + (ends[k - 1] if k else 0)

    def before(self, leaf: int, k: int, start: int, n: int) -> tuple[int, int, int]:
        """The pre-token n places before, or the first."""
        while n and (leaf or k):
            if k:
                k -= 1
                start -= self.lengths[leaf][k]
                n -= 1
            else:
                leaf -= 1
                k = len(self.lengths[leaf])
        return leaf, k, start

    def replace(self, first: tuple[int, int], last: tuple[int, int], lengths: list[int], counts: list[int]) -> None:
        """Put new pre-tokens in the place of those from `first` (leaf, index) up to `last`, which stays."""
        (a, i), (b, j) = first, last
        tail = self.lengths[b][j:], self.counts[b][j:]
        self.lengths[a] = self.lengths[a][:i] + lengths + tail[0]
        self.counts[a] = self.counts[a][:i] + counts + tail[1]
        for leaf in range(a + 1, b + 1):
            self.lengths[leaf], self.counts[leaf] = [], []
        if len(self.lengths[a]) > CROWDED * LEAF:
            self.build([x for leaf in self.lengths for x in leaf], [x for leaf in self.counts for x in leaf])
            return
        low, high = self.size + a, self.size + b
        for leaf in range(a, b + 1):
            self.chars[self.size + leaf], self.tokens[self.size + leaf] = sum(self.lengths[leaf]), sum(self.counts[leaf])
        while low > 1:
            low, high = low // 2, high // 2
            for i in range(low, high + 1):
                self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
                self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]


class Document:
    """A text with its tree. state: (lengths, counts) kept from before; without it, the text is encoded."""

    def __init__(self, e: Encoder, text: str, state: tuple[list[int], list[int]] | None = None):
        self.e, self.text, self.encoded = e, text, 0
        if state is None:
            state = [], []
            for m in e.pattern_for(text).finditer(text):  # a piece at a time, as there can be very many
                state[0].append(len(m[0]))
                state[1].append(len(e.ids(m[0])))
        self.tree = Tree(*state)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from `start` up to `end`, which are clipped to the text."""
        n = len(self.text)
        start = max(0, min(start, n))
        end = max(start, min(end, n))
        text = self.text[:start] + new + self.text[end:]
        shift = len(text) - n
        tree = self.tree
        if not n:
            self.__init__(self.e, text)
            self.encoded = sum(map(len, self.tree.lengths))
            return
        leaf, k, at = tree.before(*tree.find(max(0, start - 1)), BACK)
        first, pos = (leaf, k), at
        lengths, counts = [], []
        if at < len(text):
            for m in self.e.pattern_for(text).finditer(text, at):
                while at < m.start() - shift and leaf < len(tree.lengths):  # the old border that this one could be
                    if k < len(tree.lengths[leaf]):
                        at += tree.lengths[leaf][k]
                        k += 1
                    else:
                        leaf, k = leaf + 1, 0
                if m.start() >= start + len(new) and at == m.start() - shift and at >= end:
                    break
                lengths.append(len(m[0]))
                counts.append(len(self.e.ids(m[0])))
                pos = m.end()
            else:
                pos = len(text)
        if pos == len(text):  # no border in common up to the end
            leaf = len(tree.lengths) - 1
            k = len(tree.lengths[leaf])
        self.encoded += len(lengths)
        tree.replace(first, (leaf, k), lengths, counts)
        self.text = text

    def state(self) -> tuple[list[int], list[int]]:
        return [x for leaf in self.tree.lengths for x in leaf], [x for leaf in self.tree.counts for x in leaf]


def count_edits(rows: DataFrame, path: str, pattern: str, keep: bool = False) -> DataFrame:
    """Of (doc_id, text, edits[, lengths, counts]): n_tokens, n_after, n_pieces, n_encoded of every row.

    edits: structs (start, end, new) in code points, done one after the other, each on what the one before
    left. lengths, counts: the tree's leaves as kept by an earlier call (`keep` gives them, and the new text);
    without them, or with nulls, the text is encoded once. n_encoded: pre-tokens that edits made be encoded.
    A null text counts as an empty one, null edits as none, and a null in an edit as 0 or no text.
    """
    names = ["doc_id", "text", "edits"] + [n for n in ("lengths", "counts") if "lengths" in rows.columns]
    rows = pick(rows, *names)
    shared = share(rows.sparkSession, path, pattern)

    def batches(it):
        import pyarrow as pa

        e = encoder(shared)
        for batch in it:
            for start, texts in slices(batch.column(1)):
                own = batch.slice(start, len(texts))
                others = [c.to_pylist() for c in own.columns[2:]]
                found = []
                for text, edits, *state in zip(texts, *others):
                    d = Document(e, text or "", state if state and state[0] is not None else None)
                    n = d.tree.total
                    for x in edits or ():
                        if x is not None:
                            d.edit(x["start"] or 0, x["end"] or 0, x["new"] or "")
                    found.append((n, d.tree.total, sum(map(len, d.tree.lengths)), d.encoded) + ((d.text, *d.state()) if keep else ()))
                cols = list(zip(*found))
                out = [own.column(0), *(pa.array(c, pa.int64()) for c in cols[:4])]
                if keep:
                    out += [pa.array(cols[4], pa.string()), *(pa.array(c, pa.list_(pa.int32())) for c in cols[5:])]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "n_after", "n_pieces", "n_encoded", "text", "lengths", "counts"][: len(out)])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(batches, f"doc_id {kind}, n_tokens bigint, n_after bigint, n_pieces bigint, n_encoded bigint" + ", text string, lengths array<int>, counts array<int>" * keep)


def review_edits() -> Column:
    """Three edits of each document, by its id and length: a note at one place, a cut of 40 characters at another, a mask at a third."""
    n = F.length(F.coalesce("text", F.lit("")))
    place = lambda k, room: F.pmod(F.crc32(F.concat(F.lit(f"{k}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), room.cast("bigint") + 1).cast("int")
    edit = lambda at, size, new: F.struct(at.alias("start"), (at + size).alias("end"), F.lit(new).alias("new"))
    note = " [edited: see the review]"
    return F.array(edit(place(1, n), 0, note), edit(place(2, n), 40, ""), edit(place(3, n), 10, "[MASKED]"))


def op8_tokencounts(spark, sf_dir: str) -> DataFrame:
    docs = pick(documents(spark, sf_dir), "doc_id", "text")
    return count_edits(docs.withColumn("edits", review_edits()), *default_vocabulary())
