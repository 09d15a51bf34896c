import datetime as dt
import json
import zipfile

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import tabulens.operators.profile as P
import tabulens.operators.reports as R
import tabulens.operators.transforms as T
from tabulens.functions.expressions import ExpressionError, canonical, compile_expression, parse
from tabulens.functions.shape import as_boolean, as_moment, as_number
from tabulens.operators.registry import TOOLS
from tabulens.operators.stats import infer_schema, override
from tabulens.plans.planner import Cascade, ClientError, Proposal, ask, complaints, probe
from tabulens.plans.runner import Runner, Store, open_results
from tabulens.sources import sniff
from tabulens.sources.normalise import ingest, page, preview
from tabulens.types import Logical, Relation, TabulensError


def test_number_shapes(spark):
    cases = {"42": 42.0, "007": None, "+5": 5.0, "1.": 1.0, ".5": 0.5, "1e5": None, "0x1F": None, "1_000": None, "inf": None, "1d": None, "42\n": None, "1" * 19: None, "-0": 0.0}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r["v"]: r["x"] for r in df.withColumn("x", as_number(F.col("v"))).collect()} == cases


def test_moments_and_flags(spark):
    full = dt.datetime(2024, 3, 1, 10, 0, 5)
    cases = {"2024-03-01": dt.datetime(2024, 3, 1), "2024-13-45": None, "2024-03-01 10:00": full.replace(second=0), "2024-03-01T10:00:05Z": full, "2024-03-01 10:00:05 junk": full, "2024-03-01 25:00": None, "inf": None}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r["v"]: r["x"] for r in df.withColumn("x", as_moment(F.col("v"))).collect()} == cases
    flags = {"true": True, "T": True, "Yes": True, "y": True, "1": True, "0": False, "No": False, "maybe": None, None: None}
    df = spark.createDataFrame([(k,) for k in flags], "v string")
    assert {r["v"]: r["x"] for r in df.withColumn("x", as_boolean(F.col("v"))).collect()} == flags


def test_grouping_is_raw_and_counting_trimmed(spark):
    r = Relation.of(spark.createDataFrame([("Jakarta",), ("jakarta",), ("Jakarta ",), (" ",), (None,)], "region string"))
    assert T.aggregate(r, group_by=["region"], measures=["count()"]).relation.df.count() == 5
    assert {x["value"]: x["count"] for x in P.top_values(r, "region").collect()} == {"Jakarta": 2, "jakarta": 1}


@pytest.mark.parametrize("text", ["[a] +", "nope([a])", "[a", "1 ; 2", "[a] not 3", '"open', "((" * 50 + "1" + "))" * 50, "not " * 60 + "true", "- " * 60 + "1", "x" * 5000])
def test_bad_expressions_are_refused(text):
    with pytest.raises(ExpressionError):
        parse(text)


def test_canonical_is_one_spelling():
    assert canonical(parse("[qty]>4 AND not [b] in [1,2]")) == canonical(parse("([qty]  > 4.0) and (not [b] in [1, 2])"))
    assert canonical(parse("""'a"b'""")) == '"a\\"b"'


@given(st.text(alphabet="[]()ab12+-*/<>=\"' ,.andorit", max_size=40))
def test_parsing_never_breaks_otherwise(text):
    try:
        canonical(parse(text))
    except ExpressionError:
        pass


def test_types_are_checked(spark):
    r = Relation.of(spark.createDataFrame([(1.0, "x", True)], "a double, b string, c boolean"))
    for bad in ("[a] + [b]", "[b] > 1", "not [a]", "[zz] = 1", "round([a], [a])", 'if([a], 1, 2)', 'coalesce([a], "x")', "abs([a], 1)"):
        with pytest.raises(ExpressionError):
            compile_expression(bad, r.columns)


def test_expression_values(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (7.5,), (None,)], "a double")
    r = Relation.of(df)

    def value(e):
        return [x["v"] for x in df.select(compile_expression(e, r.columns)[1].alias("v")).collect()]

    assert value("1 / [a]") == [None, -1.0, 1 / 7.5, None]
    assert value("[a] % 0") == [None] * 4
    assert value("[a] in [7.5, null]") == [None, None, True, None]
    assert value("log([a])")[0] == float("-inf")
    assert value("[a] is null") == [False, False, False, True]


def test_bins(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(None,)], "v double")
    r = Relation.of(df)
    rows = T.bin_column(r, column="v", n_bins=3, include_nulls=True).relation.df.orderBy("bin").collect()
    assert [(x["bin"], x["count"]) for x in rows] == [(None, 1), (0, 3), (1, 3), (2, 4)]
    rows = T.bin_column(r, column="v", strategy="equal_count", n_bins=4).relation.df.orderBy("bin").collect()
    assert [x["count"] for x in rows] == [3, 3, 2, 2]
    with pytest.raises(TabulensError):
        T.bin_column(Relation.of(df.filter("v = 1")), column="v")
    clash = Relation.of(df.withColumn("count", F.lit(1)))
    assert "count_" in T.bin_column(clash, column="v").relation.names


def test_sampling_is_exact_and_the_same(spark):
    r = Relation.of(spark.range(500).toDF("i"), ["i"])
    a, b = (sorted(x["i"] for x in T.sample_rows(s, n=20).relation.df.collect()) for s in (r, r.step(r.df.repartition(7))))
    assert a == b and len(a) == 20
    with pytest.raises(TabulensError):
        T.sample_rows(T.sort_rows(r, by=["i"]).relation, n=3)


def test_order_survives_filters(spark):
    r = Relation.of(spark.range(100).toDF("i"), ["i"])
    s = T.filter_rows(T.sort_rows(r, by=["i"]).relation, expression="[i] % 2 = 0").relation
    assert [x["i"] for x in T.limit_rows(s, n=3).relation.rows(3).collect()] == [98, 96, 94]


def test_inference(spark):
    df = spark.createDataFrame([(str(i), "yes" if i % 2 else "no", f"2024-01-{i % 28 + 1:02d}", "ab"[i % 2], f"text {i}", "x1" if i == 5 else str(i)) for i in range(120)], "n string, b string, d string, c string, t string, near string")
    contract = infer_schema(Relation.of(df))
    assert [str(c.logical) for c in contract.columns] == ["numerical", "boolean", "date", "categorical", "text", "text"]
    assert contract["near"].confidence == 0.5
    later = override(contract, "near", Logical.NUMERICAL, "owner")
    assert later.version == 2 and later["near"].overridden_by == "owner" and contract["near"].logical == Logical.TEXT


def test_small_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "v double, e string")
    r = Relation.of(df)
    m = P.moments(r, "v").first()
    assert m["skewness"] is None and m["kurtosis"] is None and m["mode"] == 1.0
    assert TOOLS["profile_column"](r, column="e").values["completeness"]["present"] == 0
    assert {x["subject"]: x["reason"] for x in R.cardinality_report(r).table.collect()} == {"e": "no values"}
    assert P.concentration(r, "e").collect() == []


def test_reports_and_plot(spark):
    df = spark.createDataFrame([(float(i), None if i % 3 else "a", "x") for i in range(30)] + [(1000.0, "b", "y")], "v double, s string, k string")
    r = Relation.of(df)
    assert R.outlier_scan(r, column="v").values["findings"][0][2]["outliers"] == 1.0
    assert R.missingness_report(r).values["findings"][0][0] == "s"
    assert R.duplicate_report(r, subset=["k"]).values["findings"][0][2]["redundant"] == 29.0
    cells = R.crosstab(r, a="s", b="k", normalize="row").values
    assert cells["counted"] == 11 and sum(c["count"] for c in cells["cells"]) == 11
    made = T.aggregate(r, group_by=["k"], measures=["mean(v)"]).relation
    spec = R.plot(made, mark="bar", x="k", y="mean_v", transform="sort").values
    assert spec["encoding"]["y"] == {"field": "k", "type": "nominal", "sort": "-x"}
    with pytest.raises(TabulensError):
        R.plot(Relation.of(spark.range(6000).toDF("i")), mark="point", x="i")


def test_csv_with_short_and_long_rows(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('name;amount\n"a;b";1\nshort\n')
    d = ingest(spark, f"file://{f}", f"file://{tmp_path}/store")
    assert d.row_count == 2 and [tuple(x) for x in page(spark.read.parquet(d.path), 0, 10).collect()] == [("a;b", "1"), ("short", None)]
    f.write_text("a,b\n1,2\n1,2,3\n")
    with pytest.raises(Exception, match="more cells"):
        ingest(spark, f"file://{f}", f"file://{tmp_path}/store")
    assert preview(spark, f"file://{f}")[2]


def test_encodings_formats_and_refusals(tmp_path):
    # one byte may be a sign that the prefix cuts; where it is the whole file it is not
    assert sniff.encoding_of("é".encode()[:1]) == "utf-8" and sniff.encoding_of("é".encode("cp1252"), whole=True) == "cp1252"
    assert sniff.encoding_of("é b".encode("cp1252")) == "cp1252" and sniff.encoding_of(b"\x81 a") == "latin-1"
    assert sniff.encoding_of("a".encode("utf-16")) == "utf-16"
    assert sniff.sniff_format(b'[{"a": 1}]') == "json" and sniff.sniff_format(b"PAR1") == "parquet" and sniff.sniff_format(b"a\tb", "x.tsv") == "tsv"
    assert sniff.delimiter_of("a;b\n1;2\n")[0] == ";" and sniff.delimiter_of("a\nb\n") == (",", 1.0)
    assert not sniff.has_header([["1", "2"], ["3", "4"]]) and sniff.has_header([["a", "b"], ["3", "4"]])
    for bad in (lambda: sniff.check_names(["a", "a"]), lambda: sniff.check_delimiter(["a;b"], [["1;2"]], ","), lambda: sniff.check_size(0)):
        with pytest.raises(sniff.IngestError):
            bad()


def test_json_and_xlsx(spark, tmp_path):
    f = tmp_path / "a.json"
    f.write_text(json.dumps([{"a": 1, "b": True}, {"c": 2.0}]))
    d = ingest(spark, f"file://{f}", f"file://{tmp_path}/store")
    assert [tuple(x) for x in page(spark.read.parquet(d.path), 0, 5).collect()] == [("1", "true", None), (None, None, "2")]
    f.write_text(json.dumps([{"a": [1]}]))
    with pytest.raises(sniff.IngestError):
        ingest(spark, f"file://{f}", f"file://{tmp_path}/store")
    x = tmp_path / "a.xlsx"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(x, "w") as z:
        z.writestr("xl/workbook.xml", "<workbook/>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="inlineStr"><is><t>k</t></is></c></row><row><c r="A2"><v>3</v></c><c r="B2" t="b"><v>1</v></c></row></sheetData></worksheet>')
    d = ingest(spark, f"file://{x}", f"file://{tmp_path}/store")
    assert [tuple(r) for r in page(spark.read.parquet(d.path), 0, 5).collect()] == [("3", "true")] and [c.name for c in d.contract.columns] == ["k", "column_2"]


class Script:
    def __init__(self, *answers):
        self.answers = list(answers)

    def propose(self, messages, tools):
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a(messages) if callable(a) else a


def runner(spark):
    return Runner("d", 1, Relation.of(spark.createDataFrame([(i, "a" if i < 8 else "b") for i in range(10)], "i long, k string"), ["i"]))


def test_chains_are_cached_and_replayed(spark):
    r = runner(spark)
    a = r.run("filter_rows", expression="[i]>1")
    assert r.run("filter_rows", expression="[i]  >  1").id == a.id
    b = r.run("aggregate", table=a.id, group_by=["k"], measures=["count()"])
    again = Runner("d", 1, r.relation, Store.load(r.store.dump()))
    assert again.resolve(b.id).df.count() == 2
    assert open_results([{"ref": a.id, "table": "dataset"}, {"ref": b.id, "table": a.id}]) == [b.id]
    for bad in (lambda: r.run("filter_rows", expression="[i]"), lambda: r.run("nope"), lambda: r.run("limit_rows", n=0), lambda: r.run("limit_rows", m=1), lambda: r.run("limit_rows", table="x")):
        with pytest.raises(TabulensError):
            bad()


def test_planner(spark):
    def answer(messages):
        found = json.loads(messages[-1]["content"])
        assert found["rows"] == [{"k": "a", "count": 8}] and found["held_back"] == 1
        return Proposal(text=f"There are 8 rows of a [{found['id']}]. And 99 others.")

    turn = ask("how many?", runner(spark), Script(Proposal("nope"), Proposal("aggregate", json.dumps({"group_by": ["k"], "measures": ["count()"]})), answer))
    assert turn.narrative.startswith("There are 8 rows of a.") and turn.complaints == [("uncited", "99")] and not turn.grounded
    assert ask("x", runner(spark), Script(*[Proposal("nope")] * 3)).stopped == "too many rejected proposals"
    assert complaints("It is 3 [" + "0" * 32 + "].", {}) == [("unknown", "0" * 32), ("uncited", "3")]
    waits = []
    c = Cascade([Script(ClientError("busy", 5)), Script(Proposal(text="ok"))], waits.append)
    c.clients[0].answers.append(ClientError("busy", 5))
    assert c.propose([], []).text == "ok" and waits == [5] and c.pinned == 1
    assert probe(Script(Proposal("add", '{"a": 2, "b": 3}'))) and not probe(Script(Proposal(text="5")))


def test_seventeen_tools():
    assert len(TOOLS) == 17 and all(t.schema()["additionalProperties"] is False for t in TOOLS.values())
    assert "nulls" not in TOOLS["sort_rows"].schema()["properties"]
