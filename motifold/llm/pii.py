"""Personal data by candidate gradient boosting, with DataFrame functions only on the main path.

Base kinds (email, ip, card, phone) follow fixed patterns and checks. Beside them, high-recall generators
propose overlapping spans; each candidate gets features of its format and of the text around it; boosted
trees, written out as a SQL expression, score it; calibrated thresholds choose. All of this happens within
a row, so nothing is shuffled and no key can be hot.

The trees are trained in the driver on `EXAMPLES` sentences made from templates by a seeded generator
(the tables have no labels for personal data); their features come from the same expressions. Half of the
examples are kept for calibration and for the thresholds.
"""

from __future__ import annotations

import random
import string

from pyspark.sql import Column, DataFrame, functions as F

from .common import documents, pick, positional

# Kinds in order, and their patterns. Possessive repeats and the look-behinds give the matches
# of the plain patterns in linear time: a run of name characters that is not followed by @ has no match at
# any of its places, unless it was cut by the match before (\G).
KINDS = ["email", "ip", "card", "phone", "secret", "id"]
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text that lacks this has no match of the kind.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){11}", "phone": r"\+[0-9]"}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: (kind, what a text needs, pattern) of the generators.
GENERATORS = [
    ("secret", "(?i:pass|pwd|secret|token|key|auth)", r"""(?i:passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key|auth)[ \t]*[=:][ \t]*["']?[A-Za-z0-9+/_.!@#$%^&*~=-]{4,}+["']?"""),
    ("secret", "[0-9]", r"(?<![A-Za-z0-9])[A-Z0-9]{16,}+(?![A-Za-z0-9])"),
    ("secret", "[0-9]", r"(?<![A-Za-z0-9])[a-f0-9]{32,}+(?![A-Za-z0-9])"),
    ("phone", "[0-9]{3}", r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    # next to other digits, the base pattern takes both for one number, which then fails
    ("card", NEEDS["card"], r"(?<![0-9])(?:(?:[0-9]{4}[ -]?){3}[0-9]{4}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9])"),
    ("id", "[0-9]-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
]
AROUND = 24
#: Sentences made for training; trees, their depth, their share of a step; precision asked of a threshold.
EXAMPLES, TREES, DEPTH, STEP, PRECISION = 3000, 24, 3, 0.3, 0.98
#: Matches whose places are summed at a time.
BLOCK = 256


def _places(gaps: Column, matches: Column) -> Column:
    """Structs (s, e, v, before, after) of the matches: code points, end exclusive, text and what stands around it.

    Lengths are summed in blocks, as an array that grows by one element is copied each time.
    """
    n = F.size(matches)
    blocks = F.sequence(F.lit(0), F.call_function("div", n - 1, F.lit(BLOCK)).cast("int"))
    item = "struct<s:int,e:int,v:string,before:string,after:string>"

    def one(state: Column, i: Column) -> Column:
        at = state["at"] + F.length(F.get(gaps, i))
        end = at + F.length(F.get(matches, i))
        found = F.struct(at.alias("s"), end.alias("e"), F.get(matches, i).alias("v"), F.right(F.get(gaps, i), F.lit(AROUND)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(AROUND)).alias("after"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(found)).alias("out"))

    def block(state: Column, b: Column) -> Column:
        own = F.sequence(b * BLOCK, F.least((b + 1) * BLOCK, n) - 1)
        done = F.aggregate(own, F.struct(state["at"].alias("at"), F.array().cast(f"array<{item}>").alias("out")), one)
        return F.struct(done["at"].alias("at"), F.concat(state["out"], F.array(done["out"])).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{item}>>").alias("out"))
    none = F.array().cast(f"array<{item}>")
    return F.when(n > 0, F.aggregate(blocks, start, block, lambda x: F.flatten(x["out"]))).otherwise(none)


def matched(df: DataFrame, text: str, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """With a column for each (name, needs, pattern): the pattern's matches, as _places() gives them."""
    has = lambda needs: F.col(text).rlike(needs) if needs != "@" else F.contains(text, F.lit("@"))
    none = F.array().cast("array<string>")
    df = df.withColumns({f"{n}_m": F.when(has(needs), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for n, needs, p in patterns})
    df = df.withColumns({f"{n}_g": F.when(F.size(f"{n}_m") > 0, F.split(text, p, -1)).otherwise(none) for n, _, p in patterns})
    df = df.withColumns({n: _places(F.col(f"{n}_g"), F.col(f"{n}_m")) for n, _, _ in patterns})
    return df.drop(*(f"{n}_{x}" for n, _, _ in patterns for x in "mg"))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    """Whether the digits' check sum fits."""
    two = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.split(F.reverse(_digits(v)), ""), lambda d, i: F.when(i % 2 == 0, F.try_to_number(d, F.lit("9")).cast("int")).otherwise(two(F.try_to_number(d, F.lit("9")).cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _holds(kind: str, x: Column) -> Column:
    v = x["v"]
    if kind == "ip":
        return v.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        n = F.length(_digits(v))
        return F.when((n >= 12) & (n <= 19), _luhn(v)).otherwise(False)
    if kind == "phone":
        n = F.length(_digits(v))
        return (n >= 9) & (n <= 15)
    return F.lit(True)


FEATURES = ["kind", "length", "digits", "upper", "lower", "other", "hexes", "variety", "word", "keyword", "told", "quoted", "money", "joined", "luhn"]


def _features(kind: Column, x: Column) -> Column:
    """Format and context of a candidate, as doubles."""
    v, before = x["v"], F.lower(F.regexp_extract(x["before"], r"([^\n]*)\z", 1))
    length = F.length(v)
    count = lambda p: length - F.length(F.regexp_replace(v, p, ""))
    value = F.regexp_extract(v, r"""[=:][ \t]*["']?([A-Za-z0-9+/_.!@#$%^&*~=-]+)""", 1)
    core = F.when(F.length(value) > 0, value).otherwise(v)
    all_ = {
        "kind": kind, "length": F.length(core), "digits": F.length(_digits(core)), "upper": count("[A-Z]"), "lower": count("[a-z]"), "other": count("[^A-Za-z0-9]"),
        "hexes": F.length(F.regexp_replace(core, "[^a-f0-9]", "")) / F.greatest(F.length(core), F.lit(1)),
        "variety": F.size(F.array_distinct(F.split(core, ""))),
        "word": core.rlike("^[A-Za-z]+$").cast("int"),
        "keyword": F.when(F.length(value) > 0, 1).otherwise(0),
        "told": before.rlike(r"(phone|call|tel|mobile|cell|fax|contact|ssn|social|security|taxpayer|reach|ring|dial|text me|whatsapp|key|secret|token|password|credential|aws|card|visa|amex)").cast("int"),
        "quoted": v.rlike("[\"']").cast("int"),
        "money": before.rlike(r"(commit|sha1?|sha256|md5|hash|checksum|isbn|order|invoice|version|part|serial|batch|digest|revision|ticket|item|tracking|model|[$€])(?: number| no\.?| id| code| is)? *[:=#]? *$").cast("int"),
        "joined": before.rlike("[A-Za-z0-9_/.-]$").cast("int"),
        "luhn": F.when((F.length(_digits(core)) >= 12) & (F.length(_digits(core)) <= 19), _luhn(core)).otherwise(False).cast("int"),
    }
    return F.struct(*(all_[n].cast("double").alias(n) for n in FEATURES))


def candidates(df: DataFrame, text: str, out: str) -> DataFrame:
    """With `out`: structs (s, e, k, f) of all that the generators propose, with features."""
    names = [f"{out}{i}" for i in range(len(GENERATORS))]
    df = matched(df, text, [(n, needs, p) for n, (_, needs, p) in zip(names, GENERATORS)])
    each = [_proposed(F.col(n), KINDS.index(kind)) for n, (kind, _, _) in zip(names, GENERATORS)]
    return df.withColumn(out, F.concat(*each)).drop(*names)


def _proposed(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e"), _features(F.lit(kind), x).alias("f")))


# Training


def _examples(n: int, seed: int) -> list[tuple[str, int]]:
    """Sentences, each with one thing that looks like personal data, and whether it is."""
    r = random.Random(seed)
    pool = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    digits, hexes, caps = string.digits, "0123456789abcdef", string.ascii_uppercase + string.digits
    word = lambda: pool(string.ascii_lowercase, r.randint(2, 9))
    phone = lambda: r.choice(["{}-{}-{}", "({}) {}-{}", "{}.{}.{}", "{} {} {}"]).format(pool(digits, 3), pool(digits, 3), pool(digits, 4))
    mixed = string.ascii_letters + digits

    def card(right: bool) -> str:
        body = r.choice("3456") + pool(digits, 14)
        each = [int(c) * (2 - i % 2) for i, c in enumerate(body)]
        check = -sum(x - 9 if x > 9 else x for x in each) % 10
        number = body + str(check if right else (check + r.randint(1, 9)) % 10)
        between = r.choice(["", "", " ", "-"])
        return between.join(number[i : i + 4] for i in range(0, 16, 4))

    good = [
        lambda: card(True),
        lambda: card(True),
        lambda: f'{r.choice(["token", "secret", "api_key", "auth"])}{r.choice([" = ", "=", ": "])}"{pool(hexes, r.choice([32, 40, 64]))}"',
        lambda: f"{r.choice(['password', 'passwd', 'pwd'])}{r.choice(['=', ' = ', ': '])}{pool(r.choice([hexes, mixed]), r.randint(10, 24))}",
        lambda: f"{r.choice(['api-key', 'access_key', 'token'])}={pool(mixed, r.randint(16, 40))}",
        lambda: f"{r.choice(['', 'aws key ', 'key '])}AKIA{pool(caps, 16)}",
        lambda: f"{r.choice(['phone', 'call', 'tel', 'contact', 'mobile', 'cell', 'fax', 'ring', 'reach', 'text me', 'dial'])}{r.choice([' ', ': ', ' me at ', ' on ', ' number ', ' her at '])}{phone()}",
        lambda: f"{r.choice(['', 'on ', 'at ', 'or '])}{r.choice(['({}) {}-{}', '{}-{}-{}']).format(pool(digits, 3), pool(digits, 3), pool(digits, 4))}",
        lambda: f"{r.choice(['SSN', 'social security number', 'ssn', 'social security no', 'SSN no.', 'taxpayer', ''])}{r.choice([' ', ': ', ' is ', ' was '])}{pool(digits, 3)}-{pool(digits, 2)}-{pool(digits, 4)}",
        lambda: f"{r.choice(['password', 'passwd', 'pwd', 'secret'])}{r.choice(['=', ' = ', ': '])}{word()}{pool(digits, r.randint(1, 4))}{r.choice(['', '!', '&', '#', '$'])}{pool(mixed, r.randint(1, 6))}",
    ]
    bad = [
        lambda: f"{r.choice(['token', 'secret', 'key', 'password', 'auth'])}{r.choice([': ', ' = ', '='])}{word()}",
        lambda: f"{r.choice(['commit', 'sha', 'md5', 'hash', 'checksum', 'revision'])} {pool(hexes, r.choice([32, 40, 64]))}",
        lambda: f"{r.choice(['order', 'serial', 'part', 'batch', 'ticket', 'item'])} {pool(caps, r.randint(16, 24))}",
        lambda: pool(digits, r.randint(20, 40)),
        lambda: card(False),
        lambda: card(False),
        lambda: pool(string.ascii_uppercase, r.randint(16, 30)),
        lambda: f"{r.choice(['order', 'isbn', 'invoice', 'part', 'serial', 'ticket', 'tracking', 'model'])}{r.choice([' ', ' number ', ' no. ', ' id ', ': ', ' #'])}{pool(digits, 3)}-{pool(digits, 2)}-{pool(digits, 4)}",
        lambda: f"{r.choice(['order', 'serial', 'part', 'version', 'invoice', 'item', 'tracking', 'model'])}{r.choice([' ', ' number ', ' no. ', ': '])}{phone()}",
        lambda: f"{r.choice(['of', 'scored', 'had', 'from', 'with', 'to'])} {r.choice(['{} {} {}', '{}.{}.{}']).format(pool(digits, 3), pool(digits, 3), pool(digits, 4))}",
        lambda: f"token: {r.choice(['true', 'false', 'none', 'null', '1.0', 'abcd'])}",
    ]
    out = []
    for i in range(n):
        label = i % 2
        out.append((" ".join([*(word() for _ in range(r.randint(1, 6))), r.choice(good if label else bad)(), *(word() for _ in range(r.randint(1, 6)))]), label))
    return out


def _boost(x, y, trees: int = TREES, depth: int = DEPTH, step: float = STEP):
    """(start, trees): trees are nested (feature, limit, tree if at most, tree if more) or leaf values."""
    import numpy as np

    def grow(rows, g, h, d):
        leaf = float(-step * g[rows].sum() / (h[rows].sum() + 1.0))
        if d == 0 or len(rows) < 10:
            return leaf
        best = (1e-3, None)
        for j in range(x.shape[1]):
            order = rows[np.argsort(x[rows, j], kind="stable")]
            v = x[order, j]
            gs, hs = np.cumsum(g[order]), np.cumsum(h[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if len(cut):
                a, b, s, t = gs[cut], hs[cut], gs[-1], hs[-1]
                gain = a * a / (b + 1) + (s - a) ** 2 / (t - b + 1) - s * s / (t + 1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), (j, float(v[cut[k]] + v[cut[k] + 1]) / 2))
        if best[1] is None:
            return leaf
        j, limit = best[1]
        low = x[rows, j] <= limit
        return (j, limit, grow(rows[low], g, h, d - 1), grow(rows[~low], g, h, d - 1))

    start = float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
    f, out = np.full(len(y), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        out.append(grow(np.arange(len(y)), p - y, p * (1 - p), depth))
        f = f + np.array([_follow(out[-1], row) for row in x])
    return start, out


def _follow(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def _written(tree, f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    return F.when(f[FEATURES[tree[0]]] <= tree[1], _written(tree[2], f)).otherwise(_written(tree[3], f))


class Model:
    """Trees, their calibration (a * margin + b), and a threshold of the probability for each kind."""

    def __init__(self, start, trees, a, b, limits):
        self.start, self.trees, self.a, self.b, self.limits = start, trees, a, b, limits

    def margin(self, f: Column) -> Column:
        return sum((_written(t, f) for t in self.trees), F.lit(self.start))

    def chosen(self, k: Column, f: Column) -> Column:
        import math

        limit = F.lit(math.inf)
        for kind, p in self.limits.items():
            limit = F.when(k == kind, F.lit((math.log(p / (1 - p)) - self.b) / self.a)).otherwise(limit)
        return self.margin(f) >= limit


_trained: dict[tuple, Model] = {}


def train(spark, examples: int = EXAMPLES, seed: int = 11) -> Model:
    """The model; the same for any data. It is kept for as long as the driver runs."""
    import numpy as np

    if (examples, seed) in _trained:
        return _trained[examples, seed]
    made = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(_examples(examples, seed))], "i int, t string, y int").repartition(2)
    got = candidates(made, "t", "c").select("i", "y", F.explode("c").alias("c")).select("i", "y", "c.k", "c.f.*")
    rows = sorted(map(tuple, got.collect()))
    x, y = np.array([r[3:] for r in rows]), np.array([float(r[1]) for r in rows])
    kinds, held = np.array([r[2] for r in rows]), np.array([r[0] // 2 % 2 == 1 for r in rows])
    start, trees = _boost(x[~held], y[~held])
    m = start + np.array([sum(_follow(t, row) for t in trees) for row in x[held]])
    t = y[held]
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's steps for the calibration
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        v = p * (1 - p) + 1e-6
        g = np.array([((p - t) * m).sum() + 1e-3 * (a - 1), (p - t).sum()])
        s = np.linalg.solve(np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-6]]), g)
        a, b = a - np.clip(s[0], -1, 1), b - np.clip(s[1], -1, 1)
    p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
    limits = {}
    for kind in sorted(set(kinds.tolist())):
        mine = kinds[held] == kind
        for limit in (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99):
            hit = mine & (p >= limit)
            if hit.any() and t[hit].mean() >= PRECISION:
                limits[kind] = limit
                break
    _trained[examples, seed] = model = Model(start, trees, float(a), float(b), limits)
    return model


# Detection


def _blocks(spans: Column) -> Column:
    """An array in slices of BLOCK, none for an empty one."""
    n = F.size(spans)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.call_function("div", n - 1, F.lit(BLOCK)).cast("int")), lambda b: F.slice(spans, b * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array())


def _reached(df: DataFrame, spans: str, out: str) -> DataFrame:
    """With `out`: the structs of `spans`, which are ordered by s and have an e, and p: the largest e before each, at first 0.

    By blocks, so that no array grows by one element at a time for long.
    """
    df = df.withColumn(f"{out}_b", _blocks(F.col(spans)))
    most = F.transform(f"{out}_b", lambda b: F.array_max(F.transform(b, lambda x: x["e"])))
    grown = lambda state, x: F.concat(state, F.array(F.greatest(F.element_at(state, -1), x)))
    df = df.withColumn(f"{out}_p", F.aggregate(most, F.array(F.lit(0)), grown))

    def block(b: Column, i: Column) -> Column:
        before = F.aggregate(F.transform(b, lambda x: x["e"]), F.array(F.get(f"{out}_p", i)), grown)
        return F.zip_with(b, F.slice(before, F.lit(1), F.size(b)), lambda x, p: F.struct(x.alias("x"), p.alias("p")))

    return df.withColumn(out, F.flatten(F.transform(f"{out}_b", block))).drop(f"{out}_b", f"{out}_p")


def find(df: DataFrame, text: str, model: Model, out: str) -> DataFrame:
    """With `out`_base and `out`_all: structs (s, k, e), ordered by start, then kind.

    All that the model chooses stays, overlapping or not, but for what lies within another span.
    """
    names = {k: f"{out}_{k}" for k in BASE}
    df = matched(df, text, [(names[k], NEEDS[k], p) for k, p in BASE.items()])
    df = candidates(df, text, f"{out}_c")
    span = lambda k: lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))
    base = F.concat(*(F.transform(F.filter(names[k], _check(k)), span(KINDS.index(k))) for k in BASE))
    df = df.withColumn(f"{out}_base", F.array_sort(base))
    # what lies within another span comes after it in this order, and doesn't reach beyond what comes before
    keyed = lambda own: lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("ne"), F.lit(own).alias("m"), x["k"].alias("k"), x["e"].alias("e"))
    more = F.filter(f"{out}_c", lambda c: model.chosen(c["k"], c["f"]))
    df = df.withColumn(f"{out}_o", F.array_sort(F.concat(F.transform(f"{out}_base", keyed(0)), F.transform(more, keyed(1)))))
    df = _reached(df, f"{out}_o", f"{out}_r")
    kept = F.filter(f"{out}_r", lambda y: (y["x"]["m"] == 0) | (y["p"] < y["x"]["e"]))
    df = df.withColumn(f"{out}_all", F.array_sort(F.transform(kept, lambda y: F.struct(y["x"]["s"].alias("s"), y["x"]["k"].alias("k"), y["x"]["e"].alias("e")))))
    return df.drop(*names.values(), f"{out}_c", f"{out}_o", f"{out}_r")


def _check(kind: str):
    return lambda x: _holds(kind, x)


def _joined(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def personal_data(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base ones and the method's).

    A null text counts as an empty one and has no spans. Each row gives a row; other columns are ignored.
    Of equal starts, spans come in the order of KINDS. The method adds no span that lies within another one; spans can overlap.
    """
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = find(rows, "text", model or train(docs.sparkSession), "x")
    of = lambda k: F.size(F.filter("x_base", lambda x: x["k"] == KINDS.index(k))).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *map(of, BASE), F.sha2(_joined("x_base").cast("binary"), 256).alias("base_sha256"), _joined("x_all").alias("spans"))


def op4_pii(spark, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents with each run of overlapping spans replaced by the first one's kind in brackets.

    All columns stay, whatever their names; texts without spans, null ones too, stay as they are. The text is
    cut once for each block of runs, then within the block's part, so the work stays linear.
    """
    plain, name = positional(docs)
    text = name["text"]
    found = _reached(find(plain, text, model or train(docs.sparkSession), "x"), "x_all", "x_r")
    kinds = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    # a run begins where no span before it reaches; what lies between is the text from p on
    found = found.withColumn("x_r", F.filter("x_r", lambda y: y["x"]["s"] >= y["p"]))
    cut = F.transform(_blocks(F.col("x_r")), lambda b: F.struct(F.get(b, F.lit(0))["p"].alias("at"), b.alias("b"), F.substring(text, F.get(b, F.lit(0))["p"] + 1, F.element_at(b, -1)["x"]["s"] - F.get(b, F.lit(0))["p"]).alias("t")))
    piece = lambda c: lambda y: F.concat(F.substring(c["t"], y["p"] - c["at"] + 1, y["x"]["s"] - y["p"]), F.get(kinds, y["x"]["k"]))
    whole = F.array_join(F.transform(cut, lambda c: F.array_join(F.transform(c["b"], piece(c)), "")), "")
    end = F.array_max(F.transform("x_all", lambda x: x["e"]))
    cleaned = F.when(F.size("x_all") > 0, F.concat(whole, F.substring(text, end + 1, F.length(text)))).otherwise(F.col(text))
    return found.select(*(cleaned.alias(c) if c == text else F.col(c) for c in plain.columns)).toDF(*docs.columns)
