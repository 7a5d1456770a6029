"""Language-model scores: prediction by partial matching (PPM) over bytes, and a base of word counts.

The trie of contexts is held by levels: a level has the bytes seen after each context of its length, in order, and
the context that escapes lead to is the same but for its first byte, a level below. All n-grams of `ORDER` bytes of context and a byte are kept, however rare and however many: they are what the
model is. They are packed for each chunk of texts and dealt out by the last `TAIL` bytes of their contexts, so a shard
has all that the code lengths of its n-grams need of contexts of TAIL bytes and more; the shorter ones are
few (256 ** TAIL n-grams at most) and are broadcast. The code length of each n-gram that a chunk has
goes back to the chunk, whose texts are scored by looking their n-grams up. Nothing of the longer contexts is gathered
in one place.

Escapes are estimated by method D (of each byte's count, half a one goes to the escape), and bytes seen in a longer context are excluded from the shorter one.

The base needs the count of each word of a text. Words are numbered within chunks of texts, and the distinct
ones of a chunk are packed and dealt out by a hash, as n-grams are, so what is shuffled is one row for each chunk
and shard. A shard sums the counts and sends each chunk those of its words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import documents, pick, slices, stage

#: Bytes of the longest context; bytes at its end by which n-grams are dealt out; shards of them at least.
ORDER, TAIL, SHARDS = 5, 3, 256
#: What a byte's count in a context gives to the escape.
HALF = 0.5
#: Ends a text and stands before it; this byte is in no UTF-8.
MARK = 0xFF
#: Bytes of text handled at a time; of a chunk whose words are numbered together.
RUN, CHUNK = 1 << 21, 1 << 25
#: Distinct words of a chunk, and distinct n-grams held by a task, after which they are passed on.
WORDS, GRAMS = 1 << 20, 1 << 20


def segments(texts: list[bytes], order: int = ORDER, run: int = RUN):
    """(bytes, valid, owner) arrays for groups of texts; before each run of a text stand `order` bytes of context."""
    import numpy as np

    def group(parts, owners):
        sizes = np.array([len(p) for p in parts])
        starts = np.cumsum(sizes) - sizes
        valid = np.ones(sizes.sum(), bool)
        valid[(starts[:, None] + np.arange(order)).ravel()] = False
        return np.frombuffer(b"".join(parts), np.uint8), valid, np.repeat(np.array(owners), sizes)

    parts, owners, total = [], [], 0
    for i, text in enumerate(texts):
        whole = bytes([MARK]) * order + text + bytes([MARK])
        for at in range(order, len(whole), run):
            part = whole[at - order : at + run]
            if parts and total + len(part) > run:
                yield group(parts, owners)
                parts, owners, total = [], [], 0
            parts.append(part)
            owners.append(i)
            total += len(part)
    if parts:
        yield group(parts, owners)


def grams(texts: list[bytes], order: int = ORDER):
    """(keys, counts): `order` bytes of context and the byte after them, as one number."""
    import numpy as np

    found = []
    for a, valid, _ in segments(texts, order):
        key = np.zeros(len(a) - order, np.int64)
        for j in range(order + 1):
            key = key << 8 | a[j : j + len(key)]
        found.append(np.unique(key[valid[order:]], return_counts=True))
    return merged(found)


def merged(found: list):
    import numpy as np

    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, counts = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def lowered(text: str | None) -> bytes:
    return (text or "").encode().lower()  # of bytes: A to Z alone


def pack(raw: bytes) -> bytes:
    import pyarrow as pa

    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def unpack(data: bytes) -> bytes:
    import pyarrow as pa

    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def pack_numbers(numbers) -> bytes:
    """Of 64-bit numbers: their differences, all first bytes before all second ones."""
    import numpy as np

    return pack(np.diff(numbers, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_numbers(data: bytes):
    import numpy as np

    return np.cumsum(np.ascontiguousarray(np.frombuffer(unpack(data), np.uint8).reshape(8, -1).T).view("<i8").ravel())


def turned(keys, back: bool = False):
    """Keys with the last TAIL bytes of their contexts in front, so that those of a shard lie close together."""
    tail, rest = 8 * TAIL, 8 * (ORDER - TAIL)
    if back:
        return (keys >> 8 & ((1 << rest) - 1)) << 8 + tail | (keys >> 8 + rest) << 8 | keys & 0xFF
    return (keys >> 8 & ((1 << tail) - 1)) << 8 + rest | (keys >> 8 + tail) << 8 | keys & 0xFF


def dealt(keys, counts, shards: int):
    """(shard, keys, counts), packed: contexts with the same last TAIL bytes are in one shard."""
    import numpy as np

    keys = turned(keys)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    own = ((keys >> 8 * (ORDER - TAIL + 1)) * 0x9E3779B1 >> 15 & 0xFFFFFFFF) % shards
    order = np.argsort(own, kind="stable")
    keys, counts, own = keys[order], counts[order], own[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(own)]):
        yield int(own[a]), pack_numbers(keys[a:b]), pack_numbers(counts[a:b])


class Level:
    """Contexts of one length: bytes seen after them (`entries`: context and byte), how often; sums for each context."""

    def __init__(self, keys, counts, order: int, below: Level | None):
        import numpy as np

        kept = counts > 0
        self.order = order
        self.entries, self.n = merged([(keys[kept] & ((1 << 8 * (order + 1)) - 1), counts[kept])])
        nodes = self.entries >> 8
        first = np.flatnonzero(np.diff(nodes, prepend=-1))
        sums = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0, np.int64)
        self.nodes, self.total, self.kinds = nodes[first], sums(self.n), sums(np.ones(len(nodes), np.int64))
        # how often the shorter context has the bytes that are seen in this one
        self.shadow = sums(below.count(self.entries)) if below else None

    def count(self, keys):
        return _found(self.entries, keys & ((1 << 8 * (self.order + 1)) - 1), self.n)

    def of(self, keys, *values):
        nodes = keys >> 8 & ((1 << 8 * self.order) - 1)
        return [_found(self.nodes, nodes, v) for v in values]


def _found(table, wanted, values):
    """The values of what is wanted in a sorted table; zero for what isn't there."""
    import numpy as np

    if not len(table):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return np.where(table[at] == wanted, values[at], 0)


def short_levels(keys, counts) -> list[Level]:
    """The levels of contexts of less than TAIL bytes, from all n-grams with TAIL bytes."""
    out: list[Level] = []
    for o in range(TAIL):
        out.append(Level(keys, counts, o, out[-1] if out else None))
    return out


def code_lengths(keys, counts, short: list[Level], order: int = ORDER):
    """log10 probability of the last byte of each n-gram after the bytes before it.

    keys: distinct n-grams, with all those of the training texts whose contexts have the same last TAIL bytes;
    counts: how often the training texts have them, zero for those of other texts alone.
    """
    import numpy as np

    levels = list(short)
    for o in range(TAIL, order + 1):
        levels.append(Level(keys, counts, o, levels[-1]))
    out, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
    shadow = kinds_above = np.zeros(len(keys), np.int64)
    for level in reversed(levels):
        n = level.count(keys)
        total, kinds = level.of(keys, level.total, level.kinds)
        left, escapes = np.maximum(total - shadow, 1), kinds - kinds_above
        out += np.where(open_ & (n > 0), np.log10(np.maximum(n - HALF, HALF) / left), 0)
        open_ &= n == 0
        out += np.where(open_ & (escapes > 0), np.log10(np.maximum(HALF * escapes, HALF) / left), 0)
        if level.order:
            (shadow,), kinds_above = level.of(keys, level.shadow), kinds
    return out - open_ * np.log10(max(1, 256 - len(levels[0].entries)))


FIELDS = "chunk bigint, doc_id array<{kind}>, held_out array<boolean>, n_words array<bigint>, sizes array<bigint>, texts binary, n_ids array<bigint>, ids binary, shard int, words binary, places binary, keys binary, counts binary"

#: The columns of a row of texts.
TEXTS = ("doc_id", "held_out", "n_words", "sizes", "texts", "n_ids", "ids")


def dealt_words(words: list[bytes], counts, shards: int):
    """(shard, words, their places, counts), packed."""
    from zlib import crc32

    import numpy as np

    own = np.fromiter(map(crc32, words), np.int64, len(words)) % shards
    order = np.argsort(own, kind="stable")
    own = own[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(own)]):
        at = order[a:b]
        yield int(own[a]), pack(b" ".join([words[i] for i in at.tolist()])), pack_numbers(at), pack_numbers(counts[at])


def chunks(rows: DataFrame, shards: int) -> DataFrame:
    """Of (doc_id, held_out, text), in chunks: rows of texts with numbered words; for each shard, rows of words and of n-grams."""

    def batches(it):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 32
        longs = pa.list_(pa.int64())
        types = {"chunk": pa.int64(), "doc_id": longs, "held_out": pa.list_(pa.bool_()), "n_words": longs, "sizes": longs, "texts": pa.binary(), "n_ids": longs, "ids": pa.binary(), "shard": pa.int32(), "words": pa.binary(), "places": pa.binary(), "keys": pa.binary(), "counts": pa.binary()}
        known: dict[bytes, int] = {}
        learnt = np.zeros(0, np.int64)
        held: list = []
        chunk = size = 0

        def made(**own):
            own["chunk"] = task + chunk
            return pa.RecordBatch.from_arrays([own[c] if isinstance(own.get(c), pa.Array) else pa.array([own.get(c)], t) for c, t in types.items()], names=list(types))

        def gathered():
            for shard, words, places, counts in dealt_words(list(known), learnt, shards):
                yield made(shard=shard, words=words, places=places, counts=counts)
            for shard, keys, counts in dealt(*merged(held), shards):
                yield made(shard=shard, keys=keys, counts=counts)

        for batch in it:
            types["doc_id"] = pa.list_(batch.column(0).type)
            for start, texts in slices(batch.column(2), RUN, 1 << 16):
                raws = [lowered(t) for t in texts]
                out = batch.column(1).slice(start, len(texts)).to_pylist()
                packed, n_words, n_ids, train_ids = [], [], [], []
                for raw, o in zip(raws, out):
                    words = raw.split()  # of bytes: at the six ASCII blanks alone
                    ids = np.array([known.setdefault(w, len(known)) for w in words], np.uint32)
                    n_words.append(len(words))
                    if not o:
                        train_ids.append(ids)
                    ids, times = np.unique(ids, return_counts=True)
                    n_ids.append(len(ids))
                    packed.append(np.concatenate((np.diff(ids, prepend=np.uint32(0)), times.astype(np.uint32))))
                more = np.bincount(np.concatenate(train_ids), minlength=len(known)) if train_ids else np.zeros(len(known), np.int64)
                more[: len(learnt)] += learnt
                learnt = more
                held.append(grams([r for r, o in zip(raws, out) if not o]))
                keys, counts = grams([r for r, o in zip(raws, out) if o])
                held.append((keys, counts * 0))
                if sum(len(x[0]) for x in held) > max(GRAMS, 2 * len(held[0][0])):
                    held = [merged(held)]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), batch.column(i).slice(start, len(texts))) for i in (0, 1)]
                yield made(doc_id=lists[0], held_out=lists[1], n_words=n_words, sizes=[len(r) for r in raws], texts=pack(b"".join(raws)), n_ids=n_ids, ids=pack(np.concatenate(packed).tobytes()))
                size += sum(map(len, raws))
                if size >= CHUNK or len(known) >= WORDS or len(held[0][0]) >= 2 * GRAMS:
                    yield from gathered()
                    known, learnt, held, size, chunk = {}, np.zeros(0, np.int64), [], 0, chunk + 1
        yield from gathered()

    return rows.mapInArrow(batches, FIELDS.format(kind=rows.schema["doc_id"].dataType.simpleString()))


def count_words(packed: DataFrame) -> DataFrame:
    """(chunk, places, c) of the words in (chunk, shard, words, places, counts), by the counts of all chunks.

    n, v: on one row of a shard, how often its words occur in the training texts, and how many of them do.
    """

    def shard(table):
        import numpy as np
        import pyarrow as pa

        parts = [unpack(x.as_py()).split(b" ") for x in table["words"]]
        ends = np.cumsum([len(p) for p in parts])
        at = pa.array([w for p in parts for w in p], pa.binary()).dictionary_encode().indices.to_numpy()
        del parts
        sums = np.bincount(at, np.concatenate([unpack_numbers(x.as_py()) for x in table["counts"]])).astype(np.int64)
        c = [pack_numbers(x) for x in np.split(sums[at], ends[:-1])]
        one = lambda x: pa.array([int(x), *[0] * (len(ends) - 1)], pa.int64())
        return pa.table({"chunk": table["chunk"], "places": table["places"], "c": pa.array(c, pa.binary()), "n": one(sums.sum()), "v": one((sums > 0).sum())})

    return packed.groupBy("shard").applyInArrow(shard, "chunk bigint, places binary, c binary, n bigint, v bigint")


def short_grams(packed: DataFrame) -> DataFrame:
    """(key, n): the last TAIL bytes of the n-grams in (keys, counts), with partial counts."""

    def batches(it):
        import pyarrow as pa

        held: list = []
        for batch in it:
            for keys, counts in zip(batch.column(0), batch.column(1)):
                held.append((turned(unpack_numbers(keys.as_py()), True) & ((1 << 8 * TAIL) - 1), unpack_numbers(counts.as_py())))
                if sum(len(x[0]) for x in held) > max(GRAMS, 2 * len(held[0][0])):
                    held = [merged(held)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(held)], names=["key", "n"])

    return packed.mapInArrow(batches, "key bigint, n bigint")


def gram_costs(packed: DataFrame) -> DataFrame:
    """(chunk, keys, costs) of the n-grams in (chunk, shard, keys, counts), by the counts of all chunks."""
    got = short_grams(packed.select("keys", "counts")).groupBy("key").agg(F.sum("n").alias("n")).where("n > 0").orderBy("key").toArrow()  # 256 ** TAIL rows at most
    shared = packed.sparkSession.sparkContext.broadcast(short_levels(got["key"].to_numpy(), got["n"].to_numpy()))

    def shard(table):
        import numpy as np
        import pyarrow as pa

        parts = [turned(unpack_numbers(x.as_py()), True) for x in table["keys"]]
        keys, at = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.bincount(at, np.concatenate([unpack_numbers(x.as_py()) for x in table["counts"]]), len(keys)).astype(np.int64)
        costs = code_lengths(keys, counts, shared.value).astype(np.float32)[at]
        ends = np.cumsum([len(p) for p in parts])
        costs = [pack(c.view(np.uint8).reshape(-1, 4).T.tobytes()) for c in np.split(costs, ends[:-1])]
        return pa.table({"chunk": table["chunk"], "keys": table["keys"], "costs": pa.array(costs, pa.binary())})

    return packed.groupBy("shard").applyInArrow(shard, "chunk bigint, keys binary, costs binary")


def scores(texts: list[bytes], keys, costs):
    """log10 probability of each text and its end; keys (in order) and costs: n-grams, with all those of the texts."""
    import numpy as np

    out = np.zeros(len(texts))
    for a, valid, owner in segments(texts, ORDER):
        key = np.zeros(len(a) - ORDER, np.int64)
        for j in range(ORDER + 1):
            key = key << 8 | a[j : j + len(key)]
        kept = valid[ORDER:]
        key, at = np.unique(key[kept], return_inverse=True)
        out += np.bincount(owner[ORDER:][kept], costs[np.searchsorted(keys, key)][at], len(texts))
    return out


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Texts are lower-cased (A to Z). A null text counts as an empty one: one token, its end. A null id is
    learnt from. Rows that are repeated are learnt from and scored as often as they occur. With nothing to
    learn from, all bytes are equally likely. Scores of the model include the text's blanks and its end.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    rows = pick(docs, "doc_id", "text").select("doc_id", held.alias("held_out"), "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    packed = stage(chunks(rows, max(SHARDS, size >> 25)))
    texts = packed.where("texts is not null")
    costs = gram_costs(packed.where("keys is not null").select("chunk", "shard", "keys", "counts"))
    words = stage(count_words(packed.where("words is not null").select("chunk", "shard", "words", "places", "counts")))
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    ends = texts.agg(F.coalesce(F.sum(F.size(F.filter("held_out", lambda x: ~x))), F.lit(0))).first()[0]
    n, v = n + ends, v + (ends > 0)
    share = float(n + (v + 1))

    def chunk(own):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        joined = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        some = lambda name: own.filter(pc.is_valid(own[name]))
        counted, found = some("c"), some("costs")
        places = joined((unpack_numbers(x.as_py()) for x in counted["places"]), np.int64)
        c = np.zeros(len(places), np.int64)
        c[places] = joined((unpack_numbers(x.as_py()) for x in counted["c"]), np.int64)
        logs = np.log10((c + 1) / share)
        keys = joined((turned(unpack_numbers(x.as_py()), True) for x in found["keys"]), np.int64)
        cost = joined((np.ascontiguousarray(np.frombuffer(unpack(x.as_py()), np.uint8).reshape(4, -1).T).view(np.float32).ravel() for x in found["costs"]), np.float32)
        order = np.argsort(keys)
        keys, cost = keys[order], cost[order]
        tables = []
        for row in some("texts").select(list(TEXTS)).to_batches(1):
            if not row.num_rows:
                continue
            sizes, n_ids = (np.array(row[x][0].as_py(), np.int64) for x in ("sizes", "n_ids"))
            whole, cuts = unpack(row["texts"][0].as_py()), np.cumsum(sizes).tolist()
            score = scores([whole[b - n : b] for b, n in zip(cuts, sizes.tolist())], keys, cost)
            ids = np.frombuffer(unpack(row["ids"][0].as_py()), np.uint32).astype(np.int64)
            sums, known = [], []
            for part in np.split(ids, np.cumsum(2 * n_ids)[:-1]):
                ids, times = part.reshape(2, -1)
                ids = np.cumsum(ids)
                sums.append(float((logs[ids] * times).sum()) + np.log10((ends + 1) / share))
                known.append(int(times[c[ids] > 0].sum()) + (ends > 0))
            n_tokens = pa.array(row["n_words"][0].values.to_numpy() + 1)
            tables.append(pa.table({"doc_id": row["doc_id"][0].values, "held_out": row["held_out"][0].values, "n_tokens": n_tokens, "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array(np.full(len(n_tokens), n)), "base_score": pa.array(sums, pa.float64()), "score": pa.array(score)}))
        return pa.concat_tables(tables)

    own = texts.select("chunk", *TEXTS).unionByName(costs, allowMissingColumns=True).unionByName(words.drop("n", "v"), allowMissingColumns=True)
    # a group holds a chunk, which is bounded
    return own.groupBy("chunk").applyInArrow(chunk, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op1_lmscore(spark, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
