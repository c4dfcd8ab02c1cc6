"""The tool registry over a small warehouse: verdicts that follow upserts, defaults that depend on others, refusals."""

import pytest
from pyspark.sql import functions as F

from docketspark.operators import relational as R
from docketspark.plans.spec import Parameter, Spec
from docketspark.plans.tools import Registry, Warehouse
from docketspark.queries.tools import QUERIES

SCHEMA = "id long, name string, kind string, day string, seq int"


@pytest.fixture
def warehouse(spark, tmp_path):
    held = Warehouse(spark, str(tmp_path))
    store = held.collection("things", SCHEMA, ["id"], "seq", "day")
    store.upsert(spark.createDataFrame([(1, "a", "x", "2024-01-05", 1), (2, "b", "y", "2024-03-01", 1), (3, "a", "x", "0012-01-01", 1), (4, "c", None, None, 1)], SCHEMA))
    return held


@pytest.fixture
def tools():
    registry = Registry()
    one_of_each = Parameter(lambda v: F.lit(True), bool, shape=lambda df, v: R.rank_one(df, ["name"], [F.desc("day")]) if v else df)
    registry.add(
        "get_things",
        Spec(
            "things", "id", {"name": Parameter(lambda v: F.col("name") == v), "with_y": Parameter(lambda v: F.lit(True) if v else F.coalesce("kind", F.lit("")) != "y", bool), "latest": one_of_each},
            {"day": "day", "name": "name"}, "day", complete=lambda a: {"with_y": "name" in a, **a}, gap=lambda a: "not kept before 2000" if a.get("name") == "old" else None,
        ),
    )
    return registry


def asked(tools, warehouse, **arguments):
    return [(r.rn, r.key, r.has_more, r.verdict) for r in tools.answer("get_things", warehouse, arguments).orderBy("rn").collect()]


def test_pages_defaults_and_shapes(tools, warehouse):
    assert [k for _, k, _, _ in asked(tools, warehouse)] == ["1", "3", "4"]
    assert [k for _, k, _, _ in asked(tools, warehouse, name="b")] == ["2"]
    assert [k for _, k, _, _ in asked(tools, warehouse, latest=True)] == ["1", "4"]
    assert asked(tools, warehouse, limit=1, with_y=True) == [(1, "2", True, None)]


def test_verdicts_follow_the_batches(spark, tools, warehouse):
    assert asked(tools, warehouse, name="z") == [(None, None, False, "no rows match; the table holds 2024-01-05 to 2024-03-01")]
    assert "entirely outside" in asked(tools, warehouse, since="2025-01-01")[0][3]
    warehouse.collection("things", SCHEMA, ["id"], "seq", "day").upsert(spark.createDataFrame([(9, "q", "x", "2025-06-01", 1), (1, "a", "x", "2024-02-01", 2)], SCHEMA))
    assert asked(tools, warehouse, since="2025-01-01") == [(1, "9", False, None)]
    assert asked(tools, warehouse, name="z")[0][3].endswith("2024-02-01 to 2025-06-01")
    assert asked(tools, warehouse, name="old") == [(None, None, False, "not kept before 2000")]
    assert "partial coverage on the newer side" in asked(tools, warehouse, since="2024-02-01", until="2030-01-01", limit=1)[0][3]


def test_coverage_is_not_scanned_for(tools, warehouse):
    plan = tools.answer("get_things", warehouse, {"since": "2024-01-01"})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "min(" not in plan


def test_refusals(tools, warehouse):
    assert "UNKNOWN_PARAMETER" in asked(tools, warehouse, nonsense=1)[0][3]
    assert "sort_order" in asked(tools, warehouse, sort_order="up")[0][3]
    assert tools.answer("get_nothing", warehouse, {}).first().verdict == "UNKNOWN_TOOL: get_nothing"
    with pytest.raises(ValueError, match="registered already"):
        tools.add("get_things", tools.specs["get_things"])


def test_register_documents_of_long_numbers_stay_apart(spark, tmp_path):
    day = "timestamp_ntz'2024-01-10 00:00:00'"
    events = spark.range(1, 13).selectExpr("id * 1000000 + id % 2 as event_id", "3L as user_id", "'click' as event_type", "'' as props", f"{day} as ts")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["q_tool_get_federal_register_documents"](spark, str(tmp_path)).where("request = 2").collect()
    wanted = sorted(f"2024-{k * 1000000 + k % 2}" for k in range(1, 13))
    assert [r.key for r in sorted(got, key=lambda r: r.rn)] == wanted
