"""Benchmark matching with several groups of items, clashing names, nulls and long texts."""

import random
from collections import Counter

from tabulens.llm import decontam

NAMES = "doc_id long, text string, item_id string, distance string, text_ string"


def made(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_several_groups_give_what_one_gives(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, made(rng, 14)) for i in range(20)] + [(20, None), (21, ""), (22, "a b"), (3, made(rng, 9)), (None, made(rng, 11))]
    texts = [None, "", *(f"{made(rng, 30)} {t[1:-1]} {made(rng, 20)}" if t else "nothing" for _, t in items), made(rng, 30_000) + " " + items[5][1], *(made(rng, 40) for _ in range(10))]
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[3], (None, texts[4], None, None, None)], NAMES)
    bench = spark.createDataFrame([(i, t, "own") for i, t in items], "item_id long, text string, distance string").repartition(3)
    kept = {}
    for chars in (1 << 22, 300):
        monkeypatch.setattr(decontam, "GROUP_CHARS", chars)
        groups = len(list(decontam._groups(bench)))
        assert groups == 1 if chars > 300 else groups > 3
        clean = decontam.decontaminated(docs, bench)
        assert clean.columns == docs.columns
        kept[chars] = Counter(map(tuple, decontam.find_leaks(docs, bench).collect())), Counter(map(tuple, clean.collect()))
    assert kept[300] == kept[1 << 22]
    leaks, clean = kept[300]
    found = {(d, i) for d, i, _, _, _ in leaks}
    assert {(k + 2, i) for k, (i, t) in enumerate(items) if t and len(t) > 24} <= found and any(i == 5 and d == len(items) + 2 for d, i in found)
    assert Counter({r: n for r, n in Counter(map(tuple, docs.collect())).items() if r[0] is not None and r[0] not in {d for d, _ in found}}) == clean


def test_no_budget_is_lowered_above_the_short_items():
    assert all(decontam.pieces("x" * n)[0] == int(n * decontam.BUDGET) for n in range(decontam.SHORT, 3000))
