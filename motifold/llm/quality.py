"""Quality rules: base measures of a text and a hashed n-gram classifier, in Arrow batches.

The classifier is a logistic regression over hashed words, pairs of words and character 4-grams, each kind
by its mean over the text. It is fitted on a bounded sample of labelled rows (`SAMPLE`), its probability
is calibrated (Platt) on rows held out of the fit, and texts are scored against fixed thresholds.
Hashing and scoring work on the bytes of many texts at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import documents, pick, positional, slices

#: Labelled rows that the classifier is fitted on, the first by a hash of their id.
SAMPLE = 2000
#: Log2 of the buckets of each kind of n-gram; bytes in a character n-gram.
BITS, GRAM = 15, 4
#: A text is rejected below this calibrated probability of good quality.
KEEP = 0.5
#: Fixed limits of the base rules: words at least; per cent of words in repeated windows at most.
MIN_WORDS, MAX_REPEAT = 50, 50
SYMBOLS, BLANKS = b"#*$%&|<>", b" \t\n\v\f\r"
#: Bytes hashed at a time; a longer text goes in several runs.
RUN = 1 << 20


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    import numpy as np

    raw = (text or "").encode()
    words = raw.split()  # of bytes: at the six ASCII blanks alone
    inked = raw.translate(None, BLANKS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats, known = 0, {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(words) > 3 and len(known) < len(words):
        pairs = ids[:-1] * len(known) + ids[1:]
        if len(known) >= 1 << 20:  # else three ids fit into 63 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        windows = pairs[:-1] * len(known) + ids[2:]
        _, which, n = np.unique(windows, return_inverse=True, return_counts=True)
        covered = np.zeros(len(words), bool)
        again = n[which] > 1
        for k in range(3):
            covered[k : k + len(again)] |= again
        repeats = int(covered.sum())
    return len(words), len(inked.decode()), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeats


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT * n_words


class Grams:
    """Buckets of the n-grams in the bytes of several texts, by kind, with the text that each is of.

    leads: for each, bytes at its start that were counted before, so what ends in them isn't counted again.
    """

    def __init__(self, raws: list[bytes], leads: list[int] | None = None):
        import numpy as np

        a = np.frombuffer(b"\n".join(raws), np.uint8)
        starts = np.cumsum([0, *(len(r) + 1 for r in raws)])
        owner = np.repeat(np.arange(len(raws), dtype=np.int32), np.diff(starts))[: len(a)]
        owner[starts[1:-1] - 1] = -1  # what stands between two texts is of neither
        fresh = np.ones(len(a), bool)
        for start, lead in zip(starts.tolist(), leads or ()):
            fresh[start : start + lead] = False
        u = a.astype(np.uint32)
        gram = np.zeros(max(0, len(a) - GRAM + 1), np.uint32)
        for j in range(GRAM):
            gram = gram * np.uint32(0x01000193) + u[j : j + len(gram)]
        whole = (owner[: len(gram)] == owner[GRAM - 1 :]) & (owner[: len(gram)] >= 0) & fresh[GRAM - 1 :] if len(gram) else np.zeros(0, bool)
        chars, of_char = _bucket(gram.astype(np.uint64))[whole], owner[: len(gram)][whole]

        ink = ~((a == 32) | ((a >= 9) & (a <= 13)))
        begin = np.flatnonzero(ink & ~np.concatenate(([False], ink[:-1])))
        if len(begin):
            # a word's bytes, each times an odd number of its place in the word
            word = np.cumsum(np.bincount(begin, minlength=len(a))) - 1
            place = np.arange(len(a)) - begin[np.maximum(word, 0)]
            odd = (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
            words = np.add.reduceat(np.where(ink, (a.astype(np.uint64) + np.uint64(1)) * odd, np.uint64(0)), begin)
        else:
            words = np.zeros(0, np.uint64)
        of_word = owner[begin]
        new = fresh[begin]
        together = (of_word[:-1] == of_word[1:]) & new[1:]
        pairs = (words[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + words[1:])[together]
        size = 1 << BITS
        #: (bucket, owner) for each kind; buckets of one kind follow those of another
        self.kinds = [(chars, of_char), (_bucket(words[new]) + size, of_word[new]), (_bucket(pairs) + 2 * size, of_word[:-1][together])]
        self.n = len(raws)


def _bucket(h):
    import numpy as np

    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64)


def runs(raw: bytes):
    """(run, lead): a long text in runs that end at blanks, or anywhere if there is none near. A run begins with the last word of the one before, which is its lead, so no n-gram is lost."""
    at = lead = 0
    while len(raw) - at > RUN:
        cut = raw.rfind(b" ", at + RUN // 2, at + RUN)
        cut = cut if cut > 0 else at + RUN
        yield raw[at - lead : cut], lead
        lead = max(cut - 1 - raw.rfind(b" ", at, cut), GRAM - 1)
        at = cut
    yield raw[at - lead :], lead


def margins(texts: list[str | None], weights):
    """For each text, the sum over kinds of the mean weight of its n-grams."""
    import numpy as np

    raws, leads, of = [], [], []
    for i, t in enumerate(texts):
        for r, lead in runs((t or "").encode()):
            raws.append(r)
            leads.append(lead)
            of.append(i)
    of = np.array(of, np.int64)
    out = np.zeros(len(texts))
    sums, counts = np.zeros((3, len(texts))), np.zeros((3, len(texts)))
    start = 0
    while start < len(raws):
        end, total = start, 0
        while end < len(raws) and (end == start or total + len(raws[end]) <= RUN):
            total += len(raws[end])
            end += 1
        g = Grams(raws[start:end], leads[start:end])
        for k, (bucket, owner) in enumerate(g.kinds):
            np.add.at(sums[k], of[start:end], np.bincount(owner, weights[bucket], g.n))
            np.add.at(counts[k], of[start:end], np.bincount(owner, minlength=g.n))
        start = end
    for k in range(3):
        out += np.divide(sums[k], counts[k], out=np.zeros(len(texts)), where=counts[k] > 0)
    return out


def features(text: str | None) -> tuple[bytes, bytes]:
    """Buckets (int32) and values (float32) of a text, each kind's values adding up to 1."""
    import numpy as np

    total = np.zeros(3 << BITS)
    for raw, lead in runs((text or "").encode()):
        for bucket, _ in Grams([raw], [lead]).kinds:
            total += np.bincount(bucket, minlength=len(total))
    parts = total.reshape(3, -1)
    parts /= np.maximum(parts.sum(1, keepdims=True), 1)
    at = np.flatnonzero(total)
    return at.astype(np.int32).tobytes(), total[at].astype(np.float32).tobytes()


def fit(buckets: list, values: list, good, held, steps: int = 80, penalty: float = 1e-4):
    """(weights, a, b): the probability of good quality is sigmoid(a * margin + b)."""
    import numpy as np

    y, held = np.asarray(good, float), np.asarray(held)
    train, size = ~held, 3 << BITS

    def flat(which):
        """The n-grams of some rows, one row after the other, and the sums of values over each row."""
        lengths = np.array([len(buckets[i]) for i in which], np.int64)
        full = np.flatnonzero(lengths)
        starts = (np.cumsum(lengths) - lengths)[full]

        def sums(v):
            out = np.zeros(len(which))
            out[full] = np.add.reduceat(v, starts) if len(full) else 0.0
            return out

        at, x = (np.concatenate([np.zeros(0, kind), *(parts[i] for i in which)], dtype=kind) for parts, kind in ((buckets, np.int64), (values, np.float64)))
        x *= 30.0  # means are small; this is the scale of the steps below
        return at, x, lengths, sums

    mine = np.flatnonzero(train)
    at, x, lengths, sums = flat(mine)
    share = y[train].mean()
    cost = np.where(y[mine] > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) / len(mine)
    w, b, velocity, vb = np.zeros(size), 0.0, np.zeros(size), 0.0
    curve = 0.25 * np.bincount(at, np.repeat(cost, lengths) * x * x, size) + 0.02  # a bound of each weight's curvature, damped
    for _ in range(steps):
        ahead = w + 0.9 * velocity
        m = sums(x * ahead[at]) + b + 0.9 * vb
        err = cost * (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[mine])
        grad = np.bincount(at, x * np.repeat(err, lengths), size) + penalty * ahead
        velocity = 0.9 * velocity - 0.1 * grad / curve
        vb = 0.9 * vb - 0.4 * err.sum()
        w, b = w + velocity, b + vb
    margin = np.zeros(len(y))
    margin[mine] = sums(x * w[at])
    del at, x
    at, x, _, sums = flat(np.flatnonzero(held))
    margin[held] = sums(x * w[at])
    use = held if 0 < y[held].sum() < held.sum() else train
    m, t = margin[use], y[use]
    pos, neg = t.sum(), len(t) - t.sum()
    goal = np.where(t > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, c = 1.0, b
    for _ in range(100):  # Newton's steps for the two numbers of the calibration
        p = 1 / (1 + np.exp(-np.clip(a * m + c, -30, 30)))
        g = np.array([((p - goal) * m).sum(), (p - goal).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * m * m).sum() + 1e-6, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, c = a - step[0], c - step[1]
        if abs(step).max() < 1e-7:
            break
    return w * 30.0, float(a), float(c)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """The classifier of `sample` labelled rows; None if they aren't of both kinds.

    Labels that are null are passed over; a document that is labelled or kept more than once counts once.
    """
    import numpy as np

    chosen = pick(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows
    texts = texts.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text"))

    def batches(it):
        import pyarrow as pa

        for batch in it:
            both = [features(t) for _, xs in slices(batch.column(2)) for t in xs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in both], pa.binary()), pa.array([x for _, x in both], pa.binary())], names=["doc_id", "quality", "at", "x"])

    kinds = [texts.schema[n].dataType.simpleString() for n in ("doc_id", "quality")]
    rows = texts.mapInArrow(batches, f"doc_id {kinds[0]}, quality {kinds[1]}, at binary, x binary").toArrow().sort_by("doc_id")  # at most `sample` rows
    good = [x > 0 for x in rows["quality"].to_pylist()]
    if all(good) or not any(good):
        return None
    held = [i % 4 == 0 for i in range(len(good))]
    if len({g for g, h in zip(good, held) if not h}) < 2:
        held = [False] * len(good)
    numbers = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in rows[name]]
    return fit(numbers("at", np.int32), numbers("x", np.float32), good, held)


def score(docs: DataFrame, model, text: str = "text", whole: bool = False, keep: float = KEEP) -> DataFrame:
    """All columns of `docs`, but the text unless `whole`, and the measures and the verdict."""
    at = docs.columns.index(text)
    stay = [i for i in range(len(docs.columns)) if whole or i != at]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large for any input

    def batches(it):
        import numpy as np
        import pyarrow as pa

        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        for batch in it:
            for start, texts in slices(batch.column(at)):
                m = list(zip(*map(measures, texts)))
                fails = [base_fails(a, b) for a, b in zip(m[0], m[4])]
                if shared.value is None:
                    p = np.ones(len(texts))
                else:
                    w, a, b = shared.value
                    p = 1 / (1 + np.exp(-np.clip(a * margins(texts, w) + b, -30, 30)))
                kept = [bool(q >= keep) and not f for q, f in zip(p, fails)]
                own = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*(own.column(i) for i in stay), *(pa.array(x, pa.int64()) for x in m), pa.array(fails), pa.array(kept), pa.array(p, pa.float64())],
                    names=[*(own.schema.names[i] for i in stay), *names, "base_failed", "kept", "quality"],
                )

    before = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in (docs.schema.fields[i] for i in stay))
    return docs.mapInArrow(batches, f"{before}n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, quality double")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed, kept, quality (calibrated probability) of every row.

    A null text counts as an empty one, which fails the base rules. If the labels aren't of both kinds (an
    empty table, say), the base rules alone decide. Each row gives a row; other columns are ignored.
    """
    return score(pick(docs, "doc_id", "text"), train(docs, labels))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns, whatever their names. Null and empty texts fail the base rules, so they go; rows that are repeated stay as often."""
    plain, name = positional(docs)
    model = train(docs, labels)
    scored = score(plain, model, name["text"], whole=True)
    return scored.where("kept").select(*plain.columns).toDF(*docs.columns)
