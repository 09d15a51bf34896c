"""Personal data by candidate gradient boosting; DataFrame functions only.

Strict patterns with checks give the base spans. Wide generators, whose spans overlap each other and the base, propose
candidates of five kinds. For each kind boosted trees learn from one view of a candidate what another view says of it: the
label is a check that the features do not see (a checksum, octets, a country prefix, a whole address; for secrets, a key
word before it), the features are format and context. Texts with one of five hash remainders are kept apart to calibrate a
threshold for each kind, which selects the candidates that are taken beside the base spans.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import bounded, fresh, text_or_empty, written

KINDS = ("email", "ip", "card", "phone")
#: The kinds of candidates.
ALL_KINDS = (*KINDS, "secret")
#: Signs of a private area that mark where matches begin and end, and that stand for a sign or span not to be read again.
MARK, BLANK = "\ue000", "\ue001"
#: The patterns of the kinds for Java's engine. Runs are possessive and begin where a run begins or the last match ended, so
#: that long runs are read once; neither changes what is matched.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: High-recall patterns for what is left beside the base spans.
WIDE = {
    "email": r"(?:(?<![^\s@<>()\[\],;:])|\G)[^\s@<>()\[\],;:]++@[^\s@<>()\[\],;:]++",
    "number": r"(?<![0-9])[+(]?[0-9](?:[\x20().-]{0,2}[0-9])++",
    "shaped": r"(?<![0-9])(?:\+?[0-9]{1,3}[\x20.-]?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|[0-9]{4}(?:[\x20-]?[0-9]{4}){3}|[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9])",
    "secret": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}+",
}
#: Words before a candidate that speak for personal data, and those that tell a secret: a key word and a sign of assignment.
CONTEXT = r"(?i)(?:e-?mail|contact|tel|phone|call|fax|mobile|card|visa|iban|account|host|address|\bip\b)"
TELLING = r"(?i)(?:token|secret|passw(?:or)?d|pwd|api.?key|access.?key|private.?key|auth|bearer|credential)[\"']?\s*[=:]?\s*[\"']?\z"
#: Rounds of boosting, step, and the share of true candidates that a threshold must reach on at least SUPPORT rows kept apart.
ROUNDS, RATE, PRECISION, SUPPORT = 24, 0.3, 0.9, 5
#: One of so many texts is kept apart for calibration.
APART = 5
#: Digits of a wide number at least.
LEAST_DIGITS = 7
#: Escapes of the two signs in a text that is redacted.
ESCAPES = ((BLANK, BLANK + "\ue003"), (MARK, BLANK + "\ue002"))


def parts_of(text: Column, pattern: str) -> Column:
    """The text cut at matches: even places lie between matches, odd places are matches. Lengths stay as they are."""
    clean = F.translate(text, MARK, BLANK)
    return F.split(F.regexp_replace(clean, pattern, f"{MARK}$0{MARK}"), MARK, -1)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def holds(kind: str, x: Column) -> Column:
    """Whether a match of a kind's pattern passes its check."""
    n = F.length(digits(x))
    if kind == "ip":
        return x.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}\z")
    if kind == "card":
        return n.between(16, 19) & F.call_function("luhn_check", digits(x))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _before(parts: Column, j: Column) -> Column:
    """What stands before a part: up to 24 characters, of the match before it too."""
    return F.right(F.concat(*[F.coalesce(F.right(F.get(parts, j - k), F.lit(24)), F.lit("")) for k in (4, 3, 2, 1)]), F.lit(24))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, b: a + b)


def spans(parts: Column, check) -> Column:
    """Structs (start, end, value, before, after) of the odd parts that pass ``check``; ends exclusive, in characters.

    Starts are sums over runs of about the square root of the number of parts, so that a text with very many matches costs
    little more than its length.
    """
    n = F.size(parts)
    run = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("int"), F.lit(1))
    lengths = F.transform(parts, F.length)
    runs = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / run).cast("int")), lambda c: F.slice(lengths, c * run + 1, run))
    state = F.struct(parts.alias("p"), runs.alias("r"), run.alias("m"))

    def placed(s: Column) -> Column:
        sums = F.transform(s["r"], _total)
        before = F.transform(s["r"], lambda _, i: _total(F.slice(sums, F.lit(1), i)))
        return F.struct(s["p"].alias("p"), s["r"].alias("r"), s["m"].alias("m"), before.alias("b"))

    def found(s: Column) -> Column:
        def one(j: Column) -> Column:
            c = F.floor(j / s["m"]).cast("int")
            start = F.get(s["b"], c) + _total(F.slice(F.get(s["r"], c), F.lit(1), j - c * s["m"]))
            value = F.get(s["p"], j)
            return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), _before(s["p"], j).alias("before"), F.left(F.get(s["p"], j + 1), F.lit(2)).alias("after"))

        odd = F.filter(F.sequence(F.lit(0), F.size(s["p"]) - 1), lambda j: (j % 2 == 1) & check(F.get(s["p"], j)))
        return F.transform(odd, one)

    at = F.transform(F.transform(F.array(state), placed), found)[0]
    return F.when(n > 1, at)


def replaced(parts: Column, check, by) -> Column:
    """The text with the odd parts that pass ``check`` replaced by ``by(part)``."""
    return F.when(F.size(parts) > 1, F.array_join(F.transform(parts, lambda x, i: F.when((i % 2 == 1) & check(x), by(x)).otherwise(x)), "")).otherwise(F.get(parts, F.lit(0)))


def wide_kind(x: Column) -> Column:
    """The kind that a wide number would be; null if its format is none of them."""
    n = F.length(digits(x))
    return F.when(x.rlike(r"^[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++\z"), "ip").when(n.between(12, 19) & ~x.rlike(r"[+().]"), "card").when(n.between(LEAST_DIGITS, 15), "phone")


def secret_kind(x: Column) -> Column:
    """``secret`` for a run with digits and letters; null otherwise."""
    return F.when(x.rlike("[0-9]") & x.rlike("[A-Za-z]"), "secret")


#: The kind of each generator's match.
GENERATORS = {"email": lambda x: F.lit("email"), "number": wide_kind, "shaped": wide_kind, "secret": secret_kind}


def _proposed(df: DataFrame, source: str, to: str, apart: bool) -> DataFrame:
    """``df`` with ``to``: the candidates of all generators in the text of column ``source``; null where there are none.

    ``apart``: shaped numbers, which stand in longer runs of numbers, are looked for only where no wide number has a kind.
    """
    for name in GENERATORS:
        at = F.col(source)
        if apart and name == "shaped":
            at = replaced(F.col("_number"), lambda x: wide_kind(x).isNotNull(), _blank)
        df = df.withColumn(f"_{name}", F.when(F.col("any"), parts_of(at, WIDE[name])))
    for name, kind in GENERATORS.items():
        df = df.withColumn(f"_{name}", spans(F.col(f"_{name}"), lambda x, k=kind: k(x).isNotNull()))
    every = F.concat(*[_of_kind(F.col(f"_{name}"), kind) for name, kind in GENERATORS.items()])
    return df.withColumn(to, F.when(F.size(every) > 0, every)).drop(*(f"_{name}" for name in GENERATORS))


def candidates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, apart, email, ip, card, phone, every, more) of every whole text, with spans as structs.

    The base spans of each kind; ``every`` candidate, base spans among them; and ``more``, the candidates that overlap no
    base span. Columns are null where a text has no such span, as for null and empty texts. Rows stay one for one,
    repeated ones too, and equal texts get equal spans; other columns of ``docs`` play no part.
    """
    bounded(docs.sparkSession)
    t = text_or_empty(text)
    df = docs.select(F.col(key).cast("long").alias(key), t.alias("t")).withColumn("any", F.col("t").rlike("[0-9@]"))
    df = df.withColumn("apart", F.pmod(F.xxhash64("t"), F.lit(APART)) == 0)
    for kind in KINDS:
        df = df.withColumn(f"_{kind}", F.when(F.col("any"), parts_of(F.col("t"), PATTERNS[kind])))
    for kind in KINDS:
        df = df.withColumn(kind, spans(F.col(f"_{kind}"), lambda x, k=kind: holds(k, x)))
    df = df.withColumn("rest", replaced(F.col("_email"), lambda x: holds("email", x), _blank)).drop(*(f"_{k}" for k in KINDS))
    for kind in ("phone", "card", "ip"):
        df = df.withColumn("p", parts_of(F.col("rest"), PATTERNS[kind]))
        df = df.withColumn("rest", replaced(F.col("p"), lambda x, k=kind: holds(k, x), _blank))
    df = _proposed(_proposed(df, "t", "every", False), "rest", "more", True)
    return df.select(key, "apart", *KINDS, "every", "more")


def training_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(apart, every) of every whole text, as ``candidates`` has them."""
    bounded(docs.sparkSession)
    df = docs.select(text_or_empty(text).alias("t")).withColumn("any", F.col("t").rlike("[0-9@]")).filter("any")
    return _proposed(df.withColumn("apart", F.pmod(F.xxhash64("t"), F.lit(APART)) == 0), "t", "every", False).select("apart", "every")


def _blank(x: Column) -> Column:
    return F.repeat(F.lit(BLANK), F.length(x))


def _no_spans(kind: bool = False) -> Column:
    return F.expr(f"cast(array() as array<struct<{'kind: string, ' * kind}start: int, end: int, value: string, before: string, after: string>>)")


_FIELDS = ("start", "end", "value", "before", "after")


def _of_kind(x: Column, kind) -> Column:
    return F.transform(F.coalesce(x, _no_spans()), lambda s: F.struct(kind(s["value"]).alias("kind"), *[s[f].alias(f) for f in _FIELDS]))


#: Features of a candidate, each a small whole number: format first, then context.
FEATURES = ("length", "digits", "capitals", "groups", "hex", "quoted", "told", "free_before", "free_after")


def features(c: Column) -> dict[str, Column]:
    """None of them shows what the label of the candidate's kind is made of."""
    value = c["value"]
    number = lambda x: x.cast("int")
    return {
        "length": F.least(F.floor(F.length(value) / 4), F.lit(16)).cast("int"),
        "digits": F.least(F.length(digits(value)), F.lit(20)),
        "capitals": F.least(F.length(F.regexp_replace(value, "[^A-Z]", "")), F.lit(4)),
        "groups": F.least(F.length(F.regexp_replace(value, r"[^\x20()-]", "")), F.lit(5)),
        "hex": F.least(F.length(value) - F.length(F.regexp_replace(value, r"(?i)[0-9a-f]", "")), F.lit(40)),
        "quoted": number(c["before"].rlike(r"[\"'`]\z") & c["after"].rlike(r"^[\"'`]")),
        "told": number((c["kind"] != "secret") & c["before"].rlike(CONTEXT)),
        "free_before": number(c["before"].rlike(r"(?:^|[\s(<\[\"'])\z")),
        "free_after": number(c["after"].rlike(r"^(?:\z|[\s.,;:!?)>\]\"'])")),
    }


def label(c: Column) -> Column:
    """Whether the check of a candidate's kind, which its features do not see, holds."""
    value = c["value"]
    checks = {
        "email": value.rlike(r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++\z"),
        "ip": holds("ip", value),
        "card": F.call_function("luhn_check", digits(value)),
        "phone": value.startswith("+"),
        "secret": c["before"].rlike(TELLING),
    }
    return reduce(lambda a, k: a.when(c["kind"] == k, checks[k]), ALL_KINDS[1:], F.when(c["kind"] == ALL_KINDS[0], checks[ALL_KINDS[0]])).cast("int")


@dataclass(frozen=True)
class Tree:
    """A split into two, each split again: (feature, greatest value to the left), and a value for each of four leaves."""

    first: tuple[str, int]
    then: tuple[tuple[str, int], tuple[str, int]]
    leaves: tuple[float, float, float, float]

    def value(self, row: dict[str, int]) -> float:
        side = int(row[self.first[0]] > self.first[1])
        f, cut = self.then[side]
        return self.leaves[2 * side + int(row[f] > cut)]

    def column(self, x: dict[str, Column]) -> Column:
        def split(at: tuple[str, int], low: Column, high: Column) -> Column:
            return F.when(x[at[0]] > at[1], high).otherwise(low)

        a, b, c, d = map(F.lit, self.leaves)
        return split(self.first, split(self.then[0], a, b), split(self.then[1], c, d))


@dataclass(frozen=True)
class Model:
    """The trees of one kind, the threshold that its candidates must reach, and what that gave on the rows kept apart."""

    bias: float
    trees: tuple[Tree, ...]
    threshold: float = math.inf
    precision: float = 0.0
    recall: float = 0.0

    def logit(self, x: dict[str, Column]) -> Column:
        return reduce(lambda a, b: a + b, (t.column(x) for t in self.trees), F.lit(self.bias))

    def value(self, row: dict[str, int]) -> float:
        return self.bias + sum(t.value(row) for t in self.trees)


#: (features, true, all): counts of equal feature rows, whose number is bounded by the features' values and not by the data.
Counts = list[tuple[dict[str, int], int, int]]


def calibrated(model: Model, rows: Counts) -> Model:
    """``model`` with the lowest threshold from which on PRECISION of ``rows`` are true; no candidate reaches it if there is none."""
    found = sorted(((model.value(r), k, n) for r, k, n in rows), key=lambda x: -x[0])
    positive = sum(k for _, k, _ in found)
    best, true, seen = model, 0, 0
    for j, (z, k, n) in enumerate(found):
        true, seen = true + k, seen + n
        if true >= PRECISION * seen and seen >= SUPPORT and (j + 1 == len(found) or found[j + 1][0] < z):
            best = Model(model.bias, model.trees, z - 1e-6, true / seen, true / positive)
    return best


def boost(rows: Counts, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """Boosted trees by logistic loss; each split takes the largest gain, then the first."""
    total = sum(n for _, _, n in rows) or 1
    share = (sum(k for _, k, _ in rows) + 1) / (total + 2)
    bias = math.log(share / (1 - share))
    logits = [bias] * len(rows)
    order = {f: sorted(range(len(rows)), key=lambda i, f=f: rows[i][0][f]) for f in FEATURES}

    def leaf(at: list[int], g: list[float], h: list[float]) -> tuple[float, float]:
        a, b = sum(g[i] for i in at), sum(h[i] for i in at) + 1.0
        return a * a / b, rate * a / b

    def best(at: list[int], g: list[float], h: list[float]) -> tuple[float, tuple[str, int]]:
        found, inside = (leaf(at, g, h)[0], (FEATURES[0], 1 << 30)), {*at}
        every = sum(g[i] for i in at), sum(h[i] for i in at)
        for f in FEATURES:
            # one pass over sorted rows for all cuts of a feature
            own, a, b = [i for i in order[f] if i in inside], 0.0, 0.0
            for i, j in zip(own, own[1:], strict=False):
                a, b = a + g[i], b + h[i]
                if rows[i][0][f] < rows[j][0][f]:
                    c, d = every[0] - a, every[1] - b
                    gain = a * a / (b + 1.0) + c * c / (d + 1.0)
                    if gain > found[0] + 1e-9:
                        found = gain, (f, rows[i][0][f])
        return found

    trees = []
    for _ in range(rounds if rows else 0):
        p = [1 / (1 + math.exp(-z)) for z in logits]
        g = [k - n * q for (_, k, n), q in zip(rows, p, strict=True)]
        h = [n * q * (1 - q) for (_, _, n), q in zip(rows, p, strict=True)]
        every = list(range(len(rows)))
        first = best(every, g, h)[1]
        sides = [[i for i in every if (rows[i][0][first[0]] > first[1]) == s] for s in (False, True)]
        then = tuple(best(s, g, h)[1] for s in sides)
        leaves = []
        for s, (f, cut) in zip(sides, then, strict=True):
            for high in (False, True):
                own = [i for i in s if (rows[i][0][f] > cut) == high]
                leaves.append(round(leaf(own, g, h)[1], 6))
        tree = Tree(first, then, tuple(leaves))
        trees.append(tree)
        logits = [z + tree.value(r) for z, (r, _, _) in zip(logits, rows, strict=True)]
    return Model(bias, tuple(trees))


def train(found: DataFrame) -> dict[str, Model]:
    """A model for each kind from every candidate of ``candidates``; only counts of equal feature rows reach the driver."""
    rows = found.select("apart", F.explode("every").alias("c"))
    x = features(F.col("c"))
    counts = rows.select("apart", F.col("c.kind").alias("kind"), *[v.alias(k) for k, v in x.items()], label(F.col("c")).alias("true"))
    counts = counts.groupBy("apart", "kind", *FEATURES).agg(F.sum("true").alias("true"), F.count(F.lit(1)).alias("all")).orderBy("apart", "kind", *FEATURES).collect()
    by: dict[tuple[bool, str], Counts] = {}
    for r in counts:
        by.setdefault((r["apart"], r["kind"]), []).append(({f: r[f] for f in FEATURES}, r["true"] or 0, r["all"]))
    return {k: calibrated(boost(by.get((False, k), [])), by.get((True, k), [])) for k in ALL_KINDS}


def taken(models: dict[str, Model], c: Column) -> Column:
    """Whether a candidate (struct with kind) reaches the threshold of its kind."""
    # a struct of one row, so that features are computed once and not for each tree
    x = features(c)
    row = F.struct(c["kind"].alias("kind"), *[v.alias(f) for f, v in x.items()])

    def reaches(r: Column) -> Column:
        own = {f: r[f] for f in FEATURES}
        limits = [(k, m) for k, m in models.items() if m.threshold < math.inf]
        return reduce(lambda a, km: a | ((r["kind"] == km[0]) & (km[1].logit(own) >= km[1].threshold)), limits, F.lit(False))

    return F.exists(F.array(row), reaches)


def document_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (with the further ones) and n_spans of every document.

    Null and empty texts have no spans, an empty string and the digest of an empty list.
    """
    found = written(candidates(docs), "pii")
    models = train(found)

    def texts(spans_: Column, kind: str) -> Column:
        return F.transform(spans_, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    def all_of(kind: str) -> Column:
        more = F.filter(F.col("taken"), lambda s: s["kind"] == kind)
        places = [F.transform(x, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for x in (*([F.coalesce(F.col(kind), _no_spans())] if kind in KINDS else []), more)]
        return texts(F.array_sort(F.concat(*places)), kind)

    base = F.array_join(F.concat(*[texts(F.coalesce(F.col(k), _no_spans()), k) for k in KINDS]), ",")
    out = found.withColumn("taken", F.coalesce(F.filter("more", lambda c: taken(models, c)), _no_spans(True)))
    joined = F.concat(*[all_of(k) for k in ALL_KINDS])
    counts = [F.when(F.col(k).isNull(), F.lit(0)).otherwise(F.size(F.col(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.withColumn("joined", joined).select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join("joined", ",").alias("spans"), F.size("joined").cast("long").alias("n_spans"))


def _each(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), pairs, text)


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every base span and every selected further one replaced by its kind in brackets; its n_chars follows.

    All columns and rows stay; null texts stay null, and texts without a span stay as they are, whatever signs they hold.
    Kinds are replaced one after another, the widest patterns first, so that of overlapping spans nothing is left. Other
    columns may have any name.
    """
    models = train(written(training_candidates(docs, text), "candidates"))
    names = docs.columns
    t, p, any_ = fresh(docs, "t", "p", "any")
    df = docs.withColumn(t, F.when(F.col(text).rlike("[0-9@]"), _each(text_or_empty(text), ESCAPES))).withColumn(any_, F.col(t).isNotNull())
    for kind in ("email", "phone", "card", "ip"):
        tag = F.lit(f"[{kind.upper()}]")
        df = df.withColumn(p, F.when(F.col(any_), parts_of(F.col(t), PATTERNS[kind]))).withColumn(t, F.coalesce(replaced(F.col(p), lambda x, k=kind: holds(k, x), lambda x, own=tag: own), F.col(t)))
    for name, kind_of in GENERATORS.items():
        df = df.withColumn(p, F.when(F.col(any_), parts_of(F.col(t), WIDE[name])))

        def piece(parts: Column, i: Column, kind_of=kind_of) -> Column:
            x = F.get(parts, i)
            c = F.struct(kind_of(x).alias("kind"), x.alias("value"), _before(parts, i).alias("before"), F.left(F.get(parts, i + 1), F.lit(2)).alias("after"))
            hit = F.transform(F.array(c), lambda s: F.when((i % 2 == 1) & s["kind"].isNotNull() & taken(models, s), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(s["value"]))
            return hit[0]

        df = df.withColumn(t, F.coalesce(F.when(F.size(p) > 1, F.array_join(F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: piece(F.col(p), i)), "")), F.col(t)))
    df = df.withColumn(t, _each(F.col(t), tuple((b, a) for a, b in reversed(ESCAPES))))
    changed = F.col(any_) & (F.col(t) != F.col(text))
    if "n_chars" in names:
        df = df.withColumn("n_chars", F.when(changed, F.length(t).cast("long")).otherwise(F.col("n_chars")))
    df = df.withColumn(text, F.when(changed, F.col(t)).otherwise(F.col(text)))
    return df.select(*names)
