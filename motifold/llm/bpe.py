"""Byte-level BPE by backtracking over longest matches.

Of each piece (a match of the splitting pattern), bytes are mapped to Latin-1 so that an Aho-Corasick
automaton over all tokens finds the longest token at each place in one pass. The encoder then walks from
longest match to longest match, takes a shorter prefix token where two neighbours would not have been
left apart by the merges, and goes back where no prefix is left, marking the place as a dead end. Each
place is given up at most once, so the work is linear in the piece. Whether two tokens can stand side by
side is decided by undoing merges, the latest first, and is memoised.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain, islice

from pyspark.sql import DataFrame

from .common import documents, pick, slices

#: Entries of a worker's memos of pieces and of pairs; the older half goes beyond that.
MEMO = 800_000
#: Characters beyond which a text's pieces are drawn one run at a time.
LONG = 1 << 20
RUN = 100_000
#: Bytes of a piece up to which longest tokens are found on demand.
LOOKUP = 256


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def plain_pattern(pattern: str) -> str:
    """The splitting pattern for the standard library, which is several times faster.

    Classes of letters, numbers and blanks are spelled out as ranges of characters, asked of tiktoken's own
    engine, since libraries differ in their version of Unicode.
    """
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)

    def ranges(kind: str) -> str:
        probe = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        spans: list[list[int]] = []
        for c in map(ord, probe.decode(probe.encode_ordinary(every))):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)

    contractions, _, rest = pattern.partition("| ?\\p{L}+")
    if rest.startswith("| ?\\p{N}+") and re.fullmatch("('[a-z]+\\|?)+", contractions):
        pattern = f" ?\\p{{L}}+|{contractions}{rest}"  # a contraction begins with neither a blank nor a letter; letters first is faster
    letter, number, blank = ranges(r"\p{L}"), ranges(r"\p{N}"), ranges(r"\s")
    for kind, spelled in ((r"[^\s\p{L}\p{N}]", f"[^{blank}{letter}{number}]"), (r"\p{L}", f"[{letter}]"), (r"\p{N}", f"[{number}]"), (r"\S", f"[^{blank}]"), (r"\s", f"[{blank}]")):
        pattern = pattern.replace(kind, spelled)
    return pattern


def for_common_planes(pattern: str) -> str:
    """The same for texts without characters beyond U+FFFF, whose classes are compiled to bitmaps."""
    return re.sub(r"\\U000[1-9a-f][0-9a-f]{4}-\\U00[0-9a-f]{6}|\\U0010[0-9a-f]{4}-\\U0010[0-9a-f]{4}", "", pattern)


def merged_halves(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """The two tokens from which the merges make each token; tokens that they can't make are left out."""
    halves = {}
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] >= rank:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        if len(parts) == 2:
            halves[rank] = (ranks[parts[0]], ranks[parts[1]])
    return halves


class Memo(dict):
    """A bounded memo of a function, in two generations."""

    def __init__(self, of, most: int = MEMO):
        self.of, self.half, self.old = of, most // 2, {}

    def __missing__(self, key):
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        self[key] = value = self.of(key) if value is None else value
        return value


class Encoder:
    """ranks: bytes of a token to its id; ids are also the order of merges. pattern: as plain_pattern() gives it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, halves: dict[int, tuple[int, int]] | None = None):
        import ahocorasick

        self.ranks, self.pattern, self.common = ranks, re.compile(pattern), re.compile(for_common_planes(pattern))
        self.halves = merged_halves(ranks) if halves is None else halves
        self.pairs = {pair: rank for rank, pair in self.halves.items()}
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for rank, token in self.bytes.items()}
        self.text = {rank: str(rank) for rank in self.bytes}
        made = {t: r for t, r in ranks.items() if len(t) == 1 or r in self.halves}
        self.shorter = {r: next((made[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in made), -1) for t, r in made.items()}
        self.longest = ahocorasick.Automaton()
        for token, rank in made.items():
            self.longest.add_word(token.decode("latin-1"), rank)
        self.longest.make_automaton()
        self.fits = Memo(self._fits)  # by left << 32 | right
        self.memo = Memo(self._piece)

    def _fits(self, pair: int) -> bool:
        """Whether the merges leave two tokens side by side."""
        left, right = pair >> 32, pair & 0xFFFFFFFF
        limit = 1 << 60
        while True:
            if self.pairs.get((left, right), limit) < limit:
                return False  # these would have been merged before the later of the two was made
            if left > right:  # undo the later merge: keep what touches the border
                limit, halves = left, self.halves.get(left)
                if halves:
                    left = halves[1]
                    continue
                limit, halves = right + 1, self.halves.get(right)
                if not halves:
                    return True
                right = halves[0]
            else:
                limit, halves = right + 1, self.halves.get(right)
                if halves:
                    right = halves[0]
                    continue
                limit, halves = left, self.halves.get(left)
                if not halves:
                    return True
                left = halves[1]

    def _piece(self, piece: str) -> list[int]:
        return self.encode_piece(piece.encode())

    def ids(self, piece: str) -> list[int]:
        """A piece's ids; those of long ones aren't kept."""
        return self.memo[piece] if len(piece) < LOOKUP else self._piece(piece)

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, latin, longest = len(piece), piece.decode("latin-1"), self.longest.iter_long
        out, dead, at = [], set(), 0
        fits, size, shorter = self.fits, self.size, self.shorter
        table = None
        if n > LOOKUP:  # of a long piece, the longest token at every place, since starting again costs a pass
            table, ahead = [0] * n, iter(())
            for last, rank in self.longest.iter(latin):
                table[last + 1 - size[rank]] = rank  # of those that start here, the longest ends last
            token = table[0]
        else:
            ahead = longest(latin)
            token = next(ahead)[1]
        while True:
            end = at + size[token]
            if end not in dead and (not out or fits[out[-1] << 32 | token]):
                out.append(token)
                if end == n:
                    return out
                at = end
                last, token = next(ahead, (n, 0))
                if table:
                    token = table[at]
                elif last + 1 - size[token] != at:  # not on the way of the longest matches any more
                    ahead = longest(latin, at)
                    token = next(ahead)[1]
            elif (token := shorter[token]) < 0:
                dead.add(at)
                token = out.pop()
                at -= size[token]

    def pattern_for(self, text: str) -> re.Pattern:
        return self.common if len(text.encode("utf-16-le")) == 2 * len(text) else self.pattern

    def runs(self, text: str):
        """The text's ids, run by run."""
        pattern = self.pattern_for(text)
        if len(text) <= LONG:
            yield list(chain.from_iterable(map(self.memo.__getitem__, pattern.findall(text))))
            return
        pieces = (m[0] for m in pattern.finditer(text))
        while run := list(islice(pieces, RUN)):
            yield list(chain.from_iterable(map(self.ids, run)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.runs(text)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def digest(self, text: str, keep: list[int] | None = None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids, SHA-256 of the bytes that they decode to; the ids are added to `keep`."""
        n, ids_sha, bytes_sha = 0, hashlib.sha256(), hashlib.sha256()
        for ids in self.runs(text):
            if ids:
                ids_sha.update(("," * (n > 0) + ",".join(map(self.text.__getitem__, ids))).encode())
                bytes_sha.update(self.decode(ids))
                n += len(ids)
                if keep is not None:
                    keep.extend(ids)
        return n, ids_sha.hexdigest(), bytes_sha.hexdigest()


_encoders: dict[str, Encoder] = {}


def encoder(shared) -> Encoder:
    """One for each Python worker and vocabulary."""
    key, *parts = shared.value
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(*parts)
    return _encoders[key]


def share(spark, path: str, pattern: str):
    """Broadcast a vocabulary, with a digest of all of it: two entries for each token, whatever the data."""
    ranks = read_ranks(path)
    key = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()
    return spark.sparkContext.broadcast((key, ranks, plain_pattern(pattern), merged_halves(ranks)))


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """Encode and decode each text: doc_id, n_tokens, ids_sha256, decoded_sha256 and, on demand, ids.

    A null text counts as an empty one: no tokens, digests of nothing. Each row gives a row, repeated or
    not; other columns are ignored. A very long text is handled run by run and never held twice.
    """
    shared = share(docs.sparkSession, path, pattern)

    def batches(it):
        import pyarrow as pa

        e = encoder(shared)
        for batch in it:
            for start, texts in slices(batch.column(1)):
                kept = [[] if ids else None for _ in texts]
                cols = list(zip(*(e.digest(t or "", k) for t, k in zip(texts, kept))))
                own = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())]
                if ids:
                    own.append(pa.array(kept, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), *own], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + ids])

    rows = pick(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(batches, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)


def decode_documents(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """The texts (doc_id, text) of rows (doc_id, ids); null ids give an empty text."""
    shared = share(rows.sparkSession, path, pattern)

    def batches(it):
        import pyarrow as pa

        e = encoder(shared)
        for batch in it:
            texts = [e.decode(x or ()).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    picked = pick(rows, "doc_id", "ids")
    return picked.mapInArrow(batches, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, text string")


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), *default_vocabulary())
