"""The license join against all windows of every text."""

import random

import pytest

from tabulens.llm import licenses

DOCS = "doc_id long, text string, n_words string, label string, matches string"


def best_block(template, words, share):
    """(containment, first word) of the best run of half again as many words as the template has, by trying all."""
    own = [w.encode() for w in template.split()]
    width, members = len(own) * 3 // 2, {*own}
    best, where = 0, None
    for i in range(len(words)):
        n = len(members & {*words[i : i + width]})
        if n > best:
            best, where = n, i
    return (best / len(members), where) if best + 1e-9 >= share * len(members) else None


def test_every_block_above_the_threshold_is_found():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    for trial in range(60):
        templates = {}
        for size in (5, 6, 12, 40, 90, 200):
            templates[" ".join(rng.choice(vocabulary[: max(4, size)]) for _ in range(size))] = f"label{size}"
        known = licenses.Templates(templates, {w.encode(): rng.randint(0, 50) for w in vocabulary}, rng.choice([0.5, 0.8, 1.0]))
        words = [rng.choice(["filler", "other", *vocabulary[:: rng.randint(1, 9)]]) for _ in range(rng.randint(0, 400))]
        for t in rng.sample(list(templates), 3):  # parts of templates, some words lost or strange
            at = rng.randint(0, len(words))
            words[at:at] = [w if rng.random() < 0.9 else "strange" for w in t.split() if rng.random() < 0.95]
        words = [w.encode() for w in words]
        got = {t: share for t, share, _ in known.matches(words)}
        want = {k: b[0] for k, t in enumerate(templates) if (b := best_block(t, words, known.containment))}
        assert got == want


def test_templates_from_a_table_and_wrapped_text(spark):
    long = " ".join(f"clause{i} of the" for i in range(60))
    table = spark.createDataFrame([(long, "long"), ("Short Notice, here", "b"), ("Short Notice, here", "a"), (None, "x"), ("...", "x"), ("no label", None)], "text string, label string")
    made = ["x " * 70 + "\n * ".join(long.upper().split()) + " y" * 50, "short\n\nnotice\n# here", "short notice", None, ""]
    df = spark.createDataFrame([(i, t, "own", "own", "own") for i, t in enumerate([*made, made[0]])] + [(None, made[1], None, None, None)], DOCS)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["labels"], r["score"], [(m["containment"], m["first_word"]) for m in r["matches"]]) for r in licenses.scan(df, templates=table).collect()))
    assert [x[2:] for x in got] == [("long", 1.0, [(1.0, 70)]), ("a", 1.0, [(1.0, 0)]), ("", 0.0, []), ("", 0.0, []), ("", 0.0, []), ("long", 1.0, [(1.0, 70)]), ("a", 1.0, [(1.0, 0)])]
    assert licenses.scan(df, templates=table.limit(0)).filter("score > 0").count() == 0
    assert licenses.scan(df.limit(0), templates=table).collect() == []


def test_too_many_templates(spark, monkeypatch):
    monkeypatch.setattr(licenses, "TEMPLATE_BYTES", 10)
    with pytest.raises(ValueError):
        licenses.template_table(spark.createDataFrame([("a template of words", "x")], "text string, label string"))
