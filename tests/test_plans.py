import pytest
from pyspark.sql import functions as F

from docketspark.operators import relational as R
from docketspark.plans import coverage, fanout, report
from docketspark.plans.reconcile import Adapter, reconcile, reconcile_all, states
from docketspark.plans.spec import Parameter, QueryError, Spec, plan, run

ROWS = [(1, "a", "2024-01-01", 10.0), (2, "b", "2024-02-01", 30.0), (3, "a", "2024-03-01", None), (4, "a", "2024-03-01", 5.0)]
SPEC = Spec(
    table="t",
    key="id",
    parameters={
        "id": Parameter(lambda v: F.col("id") == v, int, point=True),
        "name": Parameter(lambda v: F.col("name") == v, choices=("a", "b")),
        "min_value": Parameter(lambda v: F.col("value") >= v, float, least=0),
        "double_at_least": Parameter(lambda v: F.col("double") >= v, float),
    },
    sorts={"day": "day", "value": "value"},
    default_sort="day",
    numeric_sorts=frozenset({"value"}),
    derive=lambda df: df.withColumn("double", F.col("value") * 2),
)


@pytest.fixture
def table(spark):
    return spark.createDataFrame(ROWS, "id long, name string, day string, value double")


def ids(df):
    return [r.id for r in df.orderBy("rn").collect()]


def test_sort_limit_and_has_more(table):
    page, more = run(SPEC, table, {"limit": 2})
    assert ids(page) == [3, 4] and more
    assert run(SPEC, table, {})[1] is False


def test_nulls_come_last_in_both_orders(table):
    assert ids(plan(SPEC, table, {"sort_by": "value"})[0])[-1] == 3
    assert ids(plan(SPEC, table, {"sort_by": "value", "sort_order": "asc"})[0])[-1] == 3


def test_point_lookup_ignores_other_filters(table):
    assert ids(plan(SPEC, table, {"id": 2, "name": "a"})[0]) == [2]


def test_derived_filter_comes_before_the_limit(table):
    assert ids(plan(SPEC, table, {"double_at_least": 15.0, "limit": 1})[0]) == [2, 1]


def test_window_is_inclusive(table):
    assert ids(plan(SPEC, table, {"since": "2024-02-01", "until": "2024-03-01", "name": "a"})[0]) == [3, 4]


@pytest.mark.parametrize(
    ("arguments", "code"),
    [
        ({"nonsense": 1}, "UNKNOWN_PARAMETER"),
        ({"name": "z"}, "INVALID_ARGUMENT"),
        ({"min_value": -1.0}, "INVALID_ARGUMENT"),
        ({"min_value": "x"}, "INVALID_ARGUMENT"),
        ({"limit": 501}, "INVALID_ARGUMENT"),
        ({"limit": True}, "INVALID_ARGUMENT"),
        ({"sort_by": "id"}, "INVALID_ARGUMENT"),
        ({"sort_by": "value", "since": "2024-01-01"}, "INVALID_QUERY"),
    ],
)
def test_guards(table, arguments, code):
    with pytest.raises(QueryError) as error:
        plan(SPEC, table, arguments)
    assert error.value.code == code


def test_coverage_floor(table, spark):
    odd = table.union(spark.createDataFrame([(9, "a", "0012-02-17", 1.0)], table.schema))
    assert coverage.of(odd, "day") == coverage.Coverage("2024-01-01", "2024-03-01")


@pytest.mark.parametrize(
    ("n", "truncated", "since", "until", "words"),
    [
        (0, False, [], [], "no rows match; the table holds"),
        (3, False, [], [], None),
        (0, False, ["1990-01-01"], ["1991-01-01"], "entirely outside"),
        (0, False, ["2023-01-01"], [], "older"),
        (5, True, ["2023-01-01"], [], "partial coverage on the older side"),
        (5, True, [], ["2030-01-01"], "partial coverage on the newer side"),
        (5, False, ["2023-01-01"], [], None),
        (5, True, ["2024-02-01"], ["2024-02-02"], None),
    ],
)
def test_coverage_notice(n, truncated, since, until, words):
    text = coverage.notice(coverage.Coverage("2024-01-01", "2024-03-01"), n, truncated, since, until)
    assert text is None if words is None else words in text


def test_known_gap_comes_first():
    assert coverage.notice(coverage.Coverage(None, None), 0, False, known_gap="gap", shallow="shallow") == "gap"


def test_notices_add_up():
    assert coverage.joined(None, None) is None and coverage.joined("a", None, "b") == "a; b"
    assert "'Ann'" in coverage.unanchored("Ann", None, "") and coverage.unanchored("Ann", None, "17") is None and coverage.unanchored(None) is None
    assert "2024-03-01" in coverage.beyond(["2024-01-01", "2024-03-02"], "2024-03-01")
    assert coverage.beyond(["2024-03-01"], "2024-03-01") is None and coverage.beyond([], "2024-03-01") is None and coverage.beyond(["2024-03-02"], None) is None
    assert "class" in coverage.narrowed("class", "II", "recalls of goods") and coverage.narrowed("class", None, "recalls of goods") is None


def test_fan_out_isolates_a_broken_source(spark, table):
    good = fanout.Source("good", lambda: table, lambda i: F.col("name") == i["name"], (F.desc("day"), F.asc("id")), F.to_json(F.struct("*")), F.col("id"))
    bad = fanout.Source("bad", lambda: table, lambda i: F.col("nothing") == 1, (F.asc("id"),), F.lit(""), F.col("id"))
    silent = fanout.Source("silent", lambda: table, lambda i: None, (F.asc("id"),), F.lit(""), F.col("id"))
    found = fanout.fan_out([good, bad, silent], {"name": "a"}, 2, ["good", "bad", "silent", "unheard of"])
    got = {r.source: r for r in fanout.summary(found, 2).collect()}
    assert set(got) == {"good", "bad"} and got["good"].n == 2 and got["good"].has_more and got["bad"]["keys"] == "error"


def test_reconcile(spark):
    source = spark.createDataFrame([(1, "x"), (2, ""), (2, "y"), (3, None)], "k long, kind string")
    held = spark.createDataFrame([(2, "y"), (9, "")], "k long, kind string")
    report = reconcile(source, held, "k", "kind", ["x", "y"])
    assert {r.k for r in report.missing.collect()} == {1, 3} and [r.k for r in report.extra.collect()] == [9]
    total = report.totals.first()
    assert (total.source, total.present, total.missing, total.extra) == (3, 1, 2, 1) and abs(total.coverage_pct - 100 / 3) < 1e-9
    assert {r.kind: r.n for r in report.census.collect()} == {"x": 0, "y": 1, "(none)": 1}


def test_merge_fields(spark):
    base = spark.createDataFrame([(1, "a", "b", 1)], "k long, x string, y string, seq int")
    changes = spark.createDataFrame([(1, None, "new", 2, ["y"]), (1, None, None, 3, ["x"]), (2, "z", None, 1, ["x"])], "k long, x string, y string, seq int, present array<string>")
    got = {r.k: (r.x, r.y) for r in R.merge_fields(base, changes, ["k"], "seq", "present").collect()}
    assert got == {1: (None, "new"), 2: ("z", None)}


def test_guarded_prune(spark):
    have = spark.range(10).withColumnRenamed("id", "k")
    assert {r.k for r in R.guarded_prune(have, have.where("k < 7"), "k").collect()} == {7, 8, 9}
    assert R.guarded_prune(have, have.where("k < 4"), "k").isEmpty()
    assert R.guarded_prune(have.where("k > 99"), have, "k").isEmpty()


def test_position_changes_say_what_is_unknown(spark):
    now = [("whole", "a", 5, True), ("whole", "b", 2, True), ("whole", "c", 3, True), ("cut", "a", 5, False), ("first", "a", 5, True), ("none", "a", 1, None)]
    before = [("whole", "a", 4), ("whole", "b", 2), ("whole", "d", 9), ("whole", "e", 0), ("cut", "a", 4), ("cut", "z", 4), ("gone", "a", 4), ("none", "a", 1)]
    rows = R.position_changes(spark.createDataFrame(now, "h string, k string, v long, ok boolean"), spark.createDataFrame(before, "h string, k string, v long"), "h", "k", "v", "ok")
    unknown = (None, None, "INSUFFICIENT_DATA")
    assert {(r.h, r.k): (r.now, r.change, r.pct, r.position_change) for r in rows.collect()} == {
        ("whole", "a"): (5, 1, 25.0, "increased"),
        ("whole", "b"): (2, 0, 0.0, "unchanged"),
        ("whole", "c"): (3, 3, None, "new"),
        ("whole", "d"): (0, -9, -100.0, "closed"),
        ("cut", "a"): (5, *unknown),
        ("first", "a"): (5, *unknown),
        ("none", "a"): (1, *unknown),
    }


def adapters(spark):
    first = Adapter(
        "a|b <x>", spark.createDataFrame([(1, 2020, "1"), (1, 2019, "0"), (2, 2021, "2"), (3, None, "3"), (None, 2020, "4")], "key long, year int, seq string"),
        spark.createDataFrame([(1, "x"), (1, ""), (9, None), (None, "x")], "key long, kind string"), ("x", "never"), lambda: F.when(F.col("key") == "2", "nil").otherwise("odd"),
    )
    return [first, Adapter("none", spark.createDataFrame([], "key long, year int, seq string"), spark.createDataFrame([(5, "k")], "key long, kind string"))]


def test_reconcile_all(spark):
    got = {(r.collection, r.part, r["name"]): (r.n, r.share) for r in reconcile_all(adapters(spark)).collect()}
    one = {k[1:]: v for k, v in got.items() if k[0] == "a|b <x>"}
    assert one[("total", "source")][0] == 3 and abs(one[("total", "source")][1] - 100 / 3) < 1e-9
    assert [one[("total", x)][0] for x in ("present", "missing", "extra")] == [1, 2, 1]
    assert {k[1]: v[0] for k, v in one.items() if k[0] == "source"} == {"2019": 1, "2021": 1, "-": 1}
    assert {k[1]: v[0] for k, v in one.items() if k[0] == "kind"} == {"x": 2, "(none)": 2, "never": 0}
    assert {k[1]: v[0] for k, v in one.items() if k[0] == "class"} == {"recoverable": 0, "nil": 1, "unreadable": 0, "gone": 0, "unclassified": 1}
    assert one[("unexplained", "unexplained")] == (1, None)
    assert got[("none", "total", "source")] == (0, 0.0) and got[("none", "total", "extra")] == (1, None)
    some = {(r.collection, r.part, r["name"]): r.n for r in reconcile_all(adapters(spark), first=1).collect()}
    assert some[("a|b <x>", "class", "unclassified")] == 1 and ("a|b <x>", "unexplained", "unexplained") not in some


def test_reports(spark, tmp_path):
    tallies, keys = reconcile_all(adapters(spark)), states(adapters(spark))
    report.write(tallies, keys, str(tmp_path))
    text, page = (tmp_path / "report.md").read_text(), (tmp_path / "report.html").read_text()
    assert "# a\\|b <x>" in text and "| never | 0 | READS ZERO |" in text and "| 2021 | 1 | 0 | 1 | 0.00 % |" in text and "| unexplained (should be 0) | 1 |" in text
    assert "<h1>a|b &lt;x&gt;</h1>" in page and "<td>33.33 %</td>" in page and "<h1>none</h1>" in page
    listed = spark.read.option("header", True).csv(f"{tmp_path}/missing")
    assert sorted(tuple(r) for r in listed.collect()) == [("a|b <x>", "2", "2021"), ("a|b <x>", "3", "-")]
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        report.write(tallies, keys, str(tmp_path))
