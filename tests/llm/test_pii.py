"""Candidates, trees and thresholds against plain versions; what is added and what is refused."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabulens.llm import pii

NAMES = "doc_id long, text string, t string, p string, _t string, _p string, n_chars long"
WIDE = {"email": r"[^\s@<>()\[\],;:]+@[^\s@<>()\[\],;:]+", "number": r"(?<![0-9])[+(]?[0-9](?:[\x20().-]{0,2}[0-9])+", "shaped": r"(?<![0-9])(?:\+?[0-9]{1,3}[\x20.-]?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|[0-9]{4}(?:[\x20-]?[0-9]{4}){3}|[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9])", "secret": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}"}


def luhn(x):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(x))) % 10 == 0


def kind_of(generator, x):
    if generator == "email":
        return "email"
    if generator == "secret":
        return "secret" if re.search("[0-9]", x) and re.search("[A-Za-z]", x) else None
    n = len(re.sub("[^0-9]", "", x))
    if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", x):
        return "ip"
    if 12 <= n <= 19 and not re.search(r"[+().]", x):
        return "card"
    return "phone" if 7 <= n <= 15 else None


def proposed(text):
    """(kind, start, end, label) of every candidate of a text."""
    out = []
    for name, pattern in WIDE.items():
        for m in re.finditer(pattern, text):
            x, kind = m.group(), kind_of(name, m.group())
            if kind:
                d = re.sub("[^0-9]", "", x)
                label = {
                    "email": bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)),
                    "ip": kind == "ip" and all(len(y.lstrip("0")) <= 3 and int(y) <= 255 for y in x.split(".")),
                    "card": luhn(d),
                    "phone": x.startswith("+"),
                    "secret": bool(re.search(r"(?i)(token|secret|passw(or)?d|pwd|api.?key|access.?key|private.?key|auth|bearer|credential)[\"']?\s*[=:]?\s*[\"']?$", text[max(0, m.start() - 24) : m.start()])),
                }[kind]
                out.append((kind, m.start(), m.end(), int(label)))
    return sorted(out)


def corpus(rng):
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        while not luhn(x := digits(16)):
            pass
        return x

    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    out = []
    for i in range(600):
        extra = []
        if i % 2:
            extra += [f'token = "{hexes(40)}"', f"id {word()}{digits(2)}_{word()}_{word()}"]
        if i % 3 == 0:
            extra += [f"call +1 ({digits(3)}) 555-{digits(4)}", f"card {card()}"]
        if i % 5 == 0:
            extra += [f"{word()}@{word()}.example.com", f"{digits(3)} 16 {digits(9)}", "10.20.30.40"]
        words = [word() for _ in range(20)]
        for x in extra:
            words.insert(rng.randrange(len(words)), x)
        out.append(" ".join(words))
    return out, hexes


def test_candidates_are_those_of_plain_patterns(spark):
    rng = random.Random(4)
    signs = list("0123456789") + list(".@+- ()abZé_=/\"',\n") + ["token = ", "password: ", "deadbeef0123", "4111111111111111", "1.2.3.4", "a@b.c", "+49 30 1234567", "😀", "\ue000", "\ue001"]
    texts = [None, "", *("".join(rng.choice(signs) for _ in range(rng.randint(0, 50))) for _ in range(400))]
    df = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in enumerate(texts)], NAMES)
    labelled = pii.candidates(df).select("doc_id", F.explode("every").alias("c")).select("doc_id", "c.kind", "c.start", "c.end", pii.label(F.col("c")).alias("label"))
    got = {}
    for r in labelled.collect():
        got.setdefault(r["doc_id"], []).append((r["kind"], r["start"], r["end"], r["label"]))
    for i, t in enumerate(texts):
        want = proposed((t or "").replace("\ue000", "\ue001")) if re.search("[0-9@]", t or "") else []
        assert sorted(got.get(i, [])) == want, repr(t)


def test_trees_are_those_of_exhaustive_search():
    rng = random.Random(5)
    rows = [({f: rng.randrange(4) for f in pii.FEATURES}, 0, rng.randint(1, 9)) for _ in range(60)]
    rows = [(r, min(n, round(n * (0.9 if r["digits"] > 1 and r["quoted"] else 0.1))), n) for r, _, n in rows]
    model = pii.boost(rows, rounds=1)
    share = (sum(k for _, k, _ in rows) + 1) / (sum(n for _, _, n in rows) + 2)

    def gain(at):
        a, b = sum(k - n * share for _, k, n in at), sum(n * share * (1 - share) for _, _, n in at) + 1
        return a * a / b

    best = max(gain([r for r in rows if r[0][f] <= c]) + gain([r for r in rows if r[0][f] > c]) for f in pii.FEATURES for c in range(3))
    f, cut = model.trees[0].first
    assert gain([r for r in rows if r[0][f] <= cut]) + gain([r for r in rows if r[0][f] > cut]) == pytest.approx(best)
    full = pii.boost(rows)
    right = sum(n - k if full.value(r) < 0 else k for r, k, n in rows)
    assert right >= 0.88 * sum(n for _, _, n in rows)
    model = pii.calibrated(full, rows)
    at = [(k, n) for r, k, n in rows if full.value(r) >= model.threshold]
    assert sum(k for k, _ in at) >= pii.PRECISION * sum(n for _, n in at)
    assert model.recall == pytest.approx(sum(k for k, _ in at) / sum(k for _, k, _ in rows))
    assert pii.calibrated(full, []).threshold == pii.calibrated(full, [(r, 0, n) for r, _, n in rows]).threshold == float("inf")


def test_untold_secrets_are_added_and_ordinary_runs_refused(spark):
    rng = random.Random(6)
    texts, hexes = corpus(rng)
    untold = f'see "{hexes(40)}" there'
    plain = f"the file part_{'abc' * 4}_12 and 20231101-20231102x stay"
    texts += [untold, plain, None, "", untold]
    df = spark.createDataFrame([(i, t, "own", "own", "own", "own", len(t or "")) for i, t in enumerate(texts)], NAMES)
    models = pii.train(pii.candidates(df))
    assert models["secret"].precision >= pii.PRECISION and models["secret"].recall >= 0.9
    # the result is that of the plain candidates, judged by the trees in plain Python
    taken = pii.candidates(df).select("doc_id", F.explode("more").alias("c")).select("doc_id", "c.kind", "c.start", "c.end", F.struct(*[v.alias(f) for f, v in pii.features(F.col("c")).items()]).alias("x"))
    want = Counter()
    for r in taken.collect():
        if models[r["kind"]].value(r["x"].asDict()) >= models[r["kind"]].threshold:
            want[r["doc_id"], f"{r['kind']}:{r['start']}:{r['end']}"] += 1
    got = pii.document_spans(df).collect()
    base = {r["doc_id"]: set(r["spans"].split(",")) for r in got}
    assert all(x in base[i] for i, x in want)
    assert sum(r["n_spans"] for r in got) == sum(want.values()) + sum(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in got)
    assert base[600] == base[604] == {"secret:5:45"} and base[601] == base[602] == base[603] == {""}
    out = {r["doc_id"]: r for r in pii.redacted(df).collect()}
    assert out[600]["text"] == 'see "[SECRET]" there' and out[600]["n_chars"] == len(out[600]["text"])
    assert out[601]["text"] == plain and out[602]["text"] is None and out[603]["text"] == ""
    assert all((r["t"], r["p"], r["_t"], r["_p"]) == ("own",) * 4 for r in out.values())
    assert not any("555-" in (r["text"] or "") or "example.com" in (r["text"] or "") for r in out.values())


def test_strange_signs_survive_redaction(spark):
    odd = ["a \ue000 1", "\ue001\ue002 2 \ue000\ue001\ue003", "\ue000x@y.zz\ue001 \ue003", "no sign \ue000"]
    df = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in enumerate(odd)], NAMES)
    out = {r["doc_id"]: r["text"] for r in pii.redacted(df).collect()}
    assert out == {0: odd[0], 1: odd[1], 2: "\ue000[EMAIL]\ue001 \ue003", 3: odd[3]}
    assert pii.redacted(df.limit(0)).collect() == []
