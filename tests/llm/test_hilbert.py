"""Sharding along the curve: cells, plain indices, and what readers can skip."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabulens.llm import hilbert

SF = "/root/testdata/sf0.01"


def plain_index(point, bits):
    """The place of a point by a walk in plain Python; test_operators holds that the curve visits neighbours only."""
    table, size = hilbert.curve_states(len(point))
    state = place = 0
    for level in range(bits - 1, -1, -1):
        found = table[state * size + sum((c >> level & 1) << i for i, c in enumerate(point))]
        state, place = found // size, place * size + found % size
    return place


def test_index_of_rows_is_that_of_the_plain_walk(spark):
    rng = random.Random(1)
    points = [tuple(rng.randrange(32) for _ in range(3)) for _ in range(500)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, a int, b int, c int")
    got = {r["i"]: r["h"] for r in df.select("i", hilbert.hilbert_index([F.col(x) for x in "abc"], 5).alias("h")).collect()}
    assert got == {i: plain_index(p, 5) for i, p in enumerate(points)}


@pytest.mark.parametrize("kinds", [0, 1, 5, 32, 33, 400])
def test_label_cells_keep_order_and_fill_evenly(spark, kinds):
    rng = random.Random(2)
    labels = [None, *(f"s{i:03d}" for i in range(kinds))][: max(1, kinds)]
    rows = [(i, rng.choice(labels), "x") for i in range(2000)] if kinds else []
    df = spark.createDataFrame(rows, "i int, label string, n string")
    out = hilbert.label_cells(df, "label", 5, "cell").collect()
    assert Counter((r["i"], r["label"], r["n"]) for r in out) == Counter(rows)
    by = {}
    for r in out:
        assert by.setdefault(r["label"], r["cell"]) == r["cell"] and 0 <= r["cell"] < 32
    cells = [by[x] for x in sorted(by, key=lambda x: (x is not None, x or ""))]
    assert cells == sorted(cells) and (kinds > 32 or len({*cells}) == len(cells))
    if kinds > 32:
        assert max(Counter(r["cell"] for r in out).values()) < 2000 / 32 * 2.5


def test_no_dimension_is_in_a_few_cells_and_all_of_them_prune(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    meta = hilbert.document_metadata(docs)
    n = docs.count()
    sizes = Counter(r["size_cell"] for r in meta.select("size_cell").collect())
    assert len(sizes) > 20 and max(sizes.values()) < 0.2 * n
    dims = [hilbert.Dimension(c, F.col(c)) for c in ("lang_cell", "source_cell", "size_cell")]
    out = hilbert.hilbert_shards(meta, dims, hilbert.BITS, 40, ["doc_id"])
    table = hilbert.pruning_table(out, ["lang", "source", "size"]).collect()
    counts = [r["rows"] for r in table]
    assert sum(counts) == n and max(counts) - min(counts) <= 1
    for column, least in (("lang", 0.4), ("source", 0.3), ("size", 0.3)):
        rng = random.Random(3)
        values = [r[0] for r in out.filter(F.col(column).isNotNull()).select(column).collect()]
        skipped = [sum(not (r[f"min_{column}"] is not None and r[f"min_{column}"] <= v <= r[f"max_{column}"]) for r in table) / 40 for v in rng.sample(values, 60)]
        assert sum(skipped) / 60 > least, column


def test_written_shards_hold_every_row(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t" * i, None if i % 3 else "en", "s", 1, 2) for i in range(50)] * 2, "doc_id long, text string, lang string, source string, shard int, rank int")
    out = hilbert.document_shards(docs, 4)
    hilbert.write_shards(out, f"file://{tmp_path}/shards", ["slot"])
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert Counter(r["doc_id"] for r in back.collect()) == Counter({i: 2 for i in range(50)})
    assert all(len(list((tmp_path / "shards" / f"shard={i}").glob("*.parquet"))) == 1 for i in range(4))
