"""Benchmark decontamination with a BM25 index of the test items and block-max WAND.

The items are indexed, not the corpus, and each training passage is a query. Passages are windows of words of
which each shares half with the next. They are twice as long as the items that they can hold: lengths are
classed by powers of two, so an item that occurs lies whole in a passage, and a long one doesn't lengthen the
passages of others. An item's impacts are divided by its score of itself, so one threshold serves all items.

Block-max WAND runs for many passages at a time, over flat arrays:
1. Pivots. Of each item, the commonest terms that add up to `COMMON` of its score at most are taken for granted;
   the other ones' lists are read. What they add to an item has to reach the rest of the threshold.
2. Blocks. For the pairs of passage and item that are left, the largest impacts of the lists' blocks that
   could hold the item are added up.
3. Scores. What still can reach the threshold is scored with all of its terms.
All items above the threshold are verified by the overlap of their question and their answer.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import repeat

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import documents, pick, positional, slices, stage

#: BM25's constants; part of an item's own score that a passage has to reach; words of a shingle.
K1, B, LEAST, SHINGLE = 1.2, 0.75, 0.5, 5
#: Part of the question's shingles, and of the answer's words, that a passage has to hold.
OVERLAP = 0.8
#: Part of an item's score that terms may have whose lists aren't read for pivots.
COMMON = 0.25
#: Words of the shortest passages; postings of a block; pairs of term and item looked up at a time.
PASSAGE, BLOCK, PAIRS = 64, 32, 1 << 20
#: Bytes of items in one index; indexes that one scan of the documents holds; bytes of a text handled at a time.
SHARD, HELD, RUN = 1 << 24, 4, 1 << 22

#: Lower-cases A to Z and blanks what is ASCII but neither letter nor digit.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(PLAIN).split()


def parts_of(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item: all but its last sentence or line, and that; the last quarter of the words of a single one."""
    text = (text or "").strip()
    cut = max(text.rfind("\n"), *(text.rfind(mark, 0, len(text) - 1) for mark in (". ", "? ", "! ", ".\n")))
    question, answer = (words_of(text[: cut + 1]), words_of(text[cut + 1 :])) if cut > 0 else ([], words_of(text))
    if len(question) < SHINGLE:
        whole = question + answer
        n = len(whole) - len(whole) // 4
        question, answer = whole[:n], whole[n:]
    return question, answer


def shingles(words: list[bytes], n: int = SHINGLE) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


class Index:
    """Flat posting lists over items, which are numbered by id.

    counts: (items, words of all of them, and for each word the items that have it), if these are only a part of all items.
    """

    def __init__(self, items: list[tuple[object, str | None]], counts: tuple[int, int, dict[bytes, int]] | None = None):
        import numpy as np

        # items without words can't be found
        self.items = [x for x in sorted(items, key=lambda x: str(x[0])) if words_of(x[1])]
        self.term: dict[bytes, int] = {}
        bags = [np.array([self.term.setdefault(w, len(self.term)) for w in words_of(t)], np.int64) for _, t in self.items]
        n, lengths = len(bags), np.array([len(b) for b in bags], np.int64)
        self.n = max(1, n)
        #: half of the words of a passage that can hold the item
        self.step = np.array([max(PASSAGE, 2 << (k - 1).bit_length()) // 2 for k in lengths.tolist()], np.int64)
        self.longest = int(2 * self.step.max()) if n else PASSAGE
        terms = np.concatenate(bags) if n else np.zeros(0, np.int64)
        own, times = np.unique(terms * self.n + np.repeat(np.arange(n), lengths), return_counts=True)
        term, item = np.divmod(own, self.n)
        if counts is None:
            total, words, held = n, len(terms), np.bincount(term, minlength=len(self.term))
        else:
            total, words, held = counts[0], counts[1], np.array([counts[2][w] for w in self.term], np.int64)
        norm = K1 * (1 - B + B * lengths[item] * total / max(1, words))
        impact = np.log(1 + (total - held + 0.5) / (held + 0.5))[term] * times * (K1 + 1) / (times + norm)
        impact /= np.bincount(item, impact, n)[item]
        self._lists(own, impact)
        self._pivots(term, item, impact, held[term])

    def _lists(self, keys, impact) -> None:
        """Postings by term * n + item; for each block of a list, its last posting and its largest impact."""
        import numpy as np

        self.keys, self.impact = keys, impact
        first = np.flatnonzero(np.diff(keys // self.n, prepend=-1))
        sizes = np.diff(np.append(first, len(keys)))
        blocks = -(-sizes // BLOCK)
        place = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begins = np.repeat(first, blocks) + place * BLOCK
        ends = np.minimum(begins + BLOCK, np.repeat(first + sizes, blocks))
        self.block_last = keys[ends - 1]
        self.block_most = np.maximum.reduceat(impact, begins) if len(begins) else impact

    def _pivots(self, term, item, impact, held) -> None:
        """Lists of the terms that are read for pivots, by term; their postings are numbered by item."""
        import numpy as np

        order = np.lexsort((-held, item))  # the commonest terms of each item first
        so_far = np.cumsum(impact[order])
        first = np.flatnonzero(np.diff(item[order], prepend=-1))
        before = np.repeat((so_far - impact[order])[first], np.diff(np.append(first, len(order))))
        granted = so_far - before <= COMMON
        read = order[~granted]
        #: what the lists that are read have to add to an item
        self.needed = LEAST - 1e-9 - np.bincount(item[order[granted]], impact[order[granted]], self.n)
        self.read_item, self.read_impact = item[read], impact[read]
        by_term = np.argsort(term[read], kind="stable")
        self.read_number = by_term
        self.read_at = np.searchsorted(term[read][by_term], np.arange(len(self.term) + 1))

    def pivots(self, terms, starts):
        """(run of words, place of the passage, item) of all pairs that can reach the threshold.

        terms: of several runs of words, one after the other, -1 for other words; starts: where each begins.
        """
        import numpy as np

        sizes = np.diff(np.append(starts, len(terms)))
        at = np.flatnonzero(terms >= 0)
        times = self.read_at[terms[at] + 1] - self.read_at[terms[at]]
        at, times = at[times > 0], times[times > 0]
        total = int(times.sum())
        if not total:
            return (np.zeros(0, np.int64),) * 3
        number = self.read_number[np.repeat(self.read_at[terms[at]] - np.cumsum(times) + times, times) + np.arange(total)]
        run = np.searchsorted(starts, at, "right") - 1
        step = self.step[self.read_item[number]]
        half = np.repeat(at - starts[run], times) // step
        run = np.repeat(run, times)
        last = np.maximum(0, -(-sizes[run] // step) - 2)  # the last passage ends with the run
        base = np.cumsum(sizes // (PASSAGE // 2) + 1)  # of places of passages
        base = (base - sizes // (PASSAGE // 2) - 1)[run]
        # a word is in the passage that begins in its half and in the one before; a term counts once in a passage
        p = len(self.read_item)
        pair = np.concatenate([((base + x) * p + number)[(x >= 0) & (x <= last)] for x in (half, half - 1)])
        pair.sort()
        pair = pair[np.diff(pair, prepend=-1) > 0]
        place, number = np.divmod(pair, p)
        item = self.read_item[number]
        first = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0))
        good = first[np.add.reduceat(self.read_impact[number], first) >= self.needed[item[first]]]
        place, item = place[good], item[good]
        begins = np.cumsum(sizes // (PASSAGE // 2) + 1) - sizes // (PASSAGE // 2) - 1
        run = np.searchsorted(begins, place, "right") - 1
        return run, place - begins[run], item

    def search(self, passages: list, which, item, least: float = LEAST):
        """The scores of pairs of a passage (`which`, of the arrays of distinct terms) and an item; zero for all below `least`."""
        import numpy as np

        out = np.zeros(len(item))
        sizes = np.array([len(p) for p in passages], np.int64)[which]
        ends = np.cumsum(sizes)
        a = 0
        while a < len(item):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + PAIRS)))
            pair = np.repeat(np.arange(b - a), sizes[a:b])
            keys = np.concatenate([passages[k] for k in which[a:b].tolist()]) * self.n + item[a:b][pair]
            block = np.minimum(np.searchsorted(self.block_last, keys), len(self.block_last) - 1)
            most = np.where(self.block_last[block] // self.n == keys // self.n, self.block_most[block], 0)
            live = np.bincount(pair, most, b - a) >= least - 1e-9
            pair, keys = pair[live[pair]], keys[live[pair]]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            out[a:b] = np.bincount(pair, np.where(self.keys[at] == keys, self.impact[at], 0), b - a)
            a = b
        return np.where(out >= least - 1e-9, out, 0)

    def verify(self, item: int, passage: list[bytes]) -> tuple[float, float]:
        """Part of the question's shingles and of the answer's words in a passage."""
        question, answer = parts_of(self.items[item][1])
        own = shingles(question)
        q = len(own & shingles(passage, len(next(iter(own))))) / len(own) if own else 1.0
        left: dict[bytes, int] = defaultdict(int)
        for w in passage:
            left[w] += 1
        hits = 0
        for w in answer:
            hits += left[w] > 0
            left[w] -= 1
        return q, hits / len(answer) if answer else 1.0

    def matches(self, texts: list[str | None]) -> list[dict[int, tuple[float, float, float]]]:
        """For each text, item: (score, question's overlap, answer's overlap) of the best passage that holds it."""
        import numpy as np

        out: list[dict] = [{} for _ in texts]
        if not self.items:
            return out
        runs = [(i, words) for i, text in enumerate(texts) for words in self._runs(text)]
        starts = np.cumsum([0, *(len(words) for _, words in runs)])[:-1]
        terms = np.fromiter((t for _, words in runs for t in map(self.term.get, words, repeat(-1))), np.int64)
        run, place, item = self.pivots(terms, starts)
        if not len(item):
            return out
        step = self.step[item]
        begin, end = place * step, (place + 2) * step
        spans, which = np.unique(np.stack((run, begin, end)), axis=1, return_inverse=True)
        passages = []
        for r, a, b in spans.T.tolist():
            known = np.unique(terms[starts[r] + a : starts[r] + min(b, len(runs[r][1]))])
            passages.append(known[known >= 0])
        score = self.search(passages, which.ravel(), item)
        for k in np.flatnonzero(score).tolist():
            i, words = runs[run[k]]
            q, a = self.verify(int(item[k]), words[begin[k] : end[k]])
            if q >= OVERLAP and a >= OVERLAP:
                out[i][int(item[k])] = max(out[i].get(int(item[k]), (0.0,)), (float(score[k]), q, a))
        return out

    def _runs(self, text: str | None):
        """The words of a text; those of a very long one in runs, each led by the last passage of the one before."""
        raw = (text or "").encode().translate(PLAIN)
        at, led = 0, b""
        while len(raw) - at > RUN:
            cut = raw.find(b" ", at + RUN)
            if cut < 0:
                break
            part = led + raw[at:cut]
            yield part.split()
            led = b" ".join(part.rsplit(None, self.longest)[-self.longest :]) + b" "
            at = cut
        yield (led + raw[at:]).split() if at else raw.split()


def word_counts(items: DataFrame) -> DataFrame:
    """(word, held, n): for each word, the items that have it and its occurrences; for the empty word, the number of items with words."""

    def batches(it):
        import pyarrow as pa

        for batch in it:
            held, times = Counter(), Counter()
            for _, texts in slices(batch.column(1)):
                for words in map(words_of, texts):
                    held.update({*words, b""} if words else ())
                    times.update(words)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64()), pa.array([times[w] for w in held], pa.int64())], names=["word", "held", "n"])

    return items.mapInArrow(batches, "word binary, held bigint, n bigint").groupBy("word").agg(F.sum("held").alias("held"), F.sum("n").alias("n"))


def indexes(benchmark: DataFrame):
    """Broadcast indexes of all items, up to HELD at a time, each over about SHARD bytes of items; items are dealt out by a hash.

    Scores depend on counts over all items, so they are the same for any number of indexes.
    """
    spark = benchmark.sparkSession
    items = pick(benchmark, "item_id", "text").where("text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-total // SHARD)
    if n <= 1:
        if n:
            yield [spark.sparkContext.broadcast(Index([tuple(r) for r in items.collect()]))]
        return
    items = stage(items.withColumn("k", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int")))
    counts = stage(word_counts(items.select("item_id", "text")))
    whole, words = counts.agg(F.max(F.when(F.length("word") == 0, F.col("held"))), F.sum("n")).first()
    for first in range(0, n, HELD):
        found = []
        for k in range(first, min(n, first + HELD)):
            mine = items.where(F.col("k") == k).select("item_id", "text")
            held = counts.join(word_counts(mine).select("word"), "word").select("word", "held").toArrow()  # words of one index
            known = dict(zip(held["word"].to_pylist(), held["held"].to_pylist()))
            found.append(spark.sparkContext.broadcast(Index([tuple(r) for r in mine.collect()], (whole, words, known))))
        yield found


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): items that documents hold, by their best passage.

    Words are compared without case (A to Z) and punctuation. Texts that are null or empty hold nothing, and
    such items are held by nothing. Each row is searched, so rows that are repeated give their pairs again;
    items that are repeated count once for each id. Other columns are ignored.
    """
    rows, ids = pick(docs, "doc_id", "text"), pick(benchmark, "item_id").schema[0].dataType
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {ids.simpleString()}, score double, question_overlap double, answer_overlap double"
    kind = to_arrow_type(ids)
    out = docs.sparkSession.createDataFrame([], schema)
    for shared in indexes(benchmark):

        def batches(it, shared=shared):
            import pyarrow as pa

            for batch in it:
                for start, texts in slices(batch.column(1)):
                    rows = [(start + i, x.value.items[k][0], *v) for x in shared for i, own in enumerate(x.value.matches(texts)) for k, v in own.items()]
                    if rows:
                        at, item, *rest = zip(*rows)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(item, kind), *(pa.array(x, pa.float64()) for x in rest)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        out = out.union(rows.mapInArrow(batches, schema))
    return out


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns, whatever their names. Null and empty texts hold none, so they stay; rows that are repeated stay as often."""
    plain, name = positional(docs)
    at = plain.columns.index(name["text"])
    for shared in indexes(benchmark):

        def batches(it, shared=shared):
            import pyarrow as pa

            for batch in it:
                clean = [not any(found) for _, texts in slices(batch.column(at)) for found in zip(*(x.value.matches(texts) for x in shared))]
                yield batch.filter(pa.array(clean, pa.bool_()))

        plain = plain.mapInArrow(batches, plain.schema)
    return plain.toDF(*docs.columns)
