"""Every operator and every stage of the pipeline: clashing column names, nulls, empty tables, repeated rows, long texts, ties."""

import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabulens.llm import bpe, decontam, hilbert, licenses, lm_mix, minhash, ogg, pii, toxicity, warc

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for columns of their own.
CLASHES = ("score", "predicted", "held_out", "family", "unit", "node", "mark", "own", "bands", "comp", "key", "n", "uid", "block", "stamp", "places", "owner", "words", "ids", "decoded", "model", "lengths", "keys", "rank", "rows", "part", "at", "before", "cell", "curve", "shard", "slot", "size", "text_", "t", "p", "any", "rest", "every", "more", "apart", "_t", "_p", "_any", "_score", "_own", "_mark", "_id", "_part", "labels", "matches", "item_id", "distance", "content", "media", "html_", "_sha", "_last", "_n", "archive", "url_key", "captured")


def made():
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ren", "tos") for b in ("da", "fe", "gul", "x", "yo")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(90)
    texts = [None, "", " \n\t", base, base, base.replace("lo", "LO"), " ".join(base.split()[:-1]), "one", 'mail a.b@c.de token = "0123456789abcdef0123456789abcdef01234567" +1 (743) 555-3824', "released under the mit license", text(20_000), *(text(60) for _ in range(12)), *(text(50) + " idiot worthless " + text(10) for _ in range(6))]
    rows = [(i, t, ("en", None, "de")[i % 3], f"s{i % 5}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[8], (None, "no id at all", None, None, None), (None, None, None, None, None)]


def labels(spark):
    return spark.createDataFrame([(i, 1, int(i >= 23)) for i in range(29)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def benchmark(spark, rows):
    return spark.createDataFrame([(1, rows[11][1][40:200]), (None, rows[12][1][10:150]), (2, None), (3, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The rows as two tables: plain, and with columns whose names the operators use; and both without rows."""
    top = tmp_path_factory.mktemp("edges")
    plain = spark.createDataFrame(made(), DOCS).repartition(2)
    clash = plain.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])
    out = []
    for name, df in (("plain", plain), ("clash", clash)):
        df.write.parquet(f"file://{top}/{name}")
        out.append(spark.read.parquet(f"file://{top}/{name}"))
    return out


OPERATORS = {
    "op1": lambda s, d, r: lm_mix.document_scores(d).withColumn("score", F.round("score", 6)),
    "op2": lambda s, d, r: hilbert.document_shards(d, 5).drop("slot", "shard"),
    "op3": lambda s, d, r: bpe.digests(d, PATH),
    "op4": lambda s, d, r: decontam.find_leaks(d, benchmark(s, r)),
    "op5": lambda s, d, r: pii.document_spans(d),
    "op6": lambda s, d, r: licenses.scan(d).drop("matches"),
    "op7": lambda s, d, r: ogg.digests(ogg.load(ogg.store(d))),
    "op8": lambda s, d, r: minhash.near_duplicates(d, minhash.QUERY),
    "op9": lambda s, d, r: toxicity.document_scores(d, labels(s)),
    "op10": lambda s, d, r: warc.page_records(d.withColumnsRenamed({"doc_id": "page_id", "text": "html", "source": "url"})).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"),
}


def counted(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(spark, tables, name):
    rows, run = made(), OPERATORS[name]
    plain, clash = (run(spark, d, rows) for d in tables)
    a = counted(plain)
    assert a == counted(clash.select(*plain.columns))
    if name == "op4":
        assert {r[0] for r in a} == {11, 12}
    else:
        assert a.total() == len(rows)  # nulls, empty texts and repeated rows each have their row
    for d in tables:
        assert run(spark, d.limit(0), rows).collect() == []


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    top = f"file://{tmp_path_factory.mktemp('stages')}"
    labels(spark).write.parquet(f"{top}/labels.parquet")
    benchmark(spark, made()).write.parquet(f"{top}/benchmark.parquet")
    return top


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, tables, sf_dir, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    plain, clash = (run(spark, d, sf_dir) for d in tables)
    if stage != "tokens":
        assert plain.columns == tables[0].columns and clash.columns == tables[1].columns
        assert all(r[c] == f"own {c}" for r in clash.collect() for c in CLASHES)
    a, b = (Counter(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in x.select(*plain.columns).collect()) for x in (plain, clash))
    assert a == b
    want = Counter(made())
    if stage == "toxicity":
        assert not a - want and all(r in a for r in want if r[0] is None or r[0] < 23)
    elif stage == "near_duplicates":
        assert not a - want and {r[0] for r in a} == {*range(29), None} - {4, 5, 6} and max(a.values()) == 1
    elif stage == "decontamination":
        assert a == Counter({r: n for r, n in want.items() if r[0] not in (11, 12)})
    else:
        assert a.total() == len(made())
    if stage == "pii":
        mended = {r[0]: r for r in a}
        assert mended[8][1] == 'mail [EMAIL] token = "' + mended[8][1].split('"')[1] + '" [PHONE]' and mended[8][4] == len(mended[8][1])
        assert all(a[r] == n for r, n in want.items() if r[0] != 8)
    assert run(spark, tables[1].limit(0), sf_dir).collect() == []
