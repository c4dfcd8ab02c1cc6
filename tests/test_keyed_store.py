"""The keyed store under replays, lost runs, two writers and growth; the manifest under lost runs."""

import os
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docketspark.streaming import keyed_store, manifest
from docketspark.streaming.keyed_store import Conflict, KeyedStore

SCHEMA = "k long, v string, seq int, day string"


def store(spark, path, **more):
    return KeyedStore(spark, str(path), SCHEMA, ["k"], "seq", date="day", **more)


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(s, pointer=None):
    return sorted(tuple(r) for r in s.read(pointer).select("k", "v", "seq").collect())


def files_of(folder):
    return {p: os.path.getsize(p) for top, _, names in os.walk(f"{folder}/data") for n in names if n.endswith(".parquet") for p in [f"{top}/{n}"]}


def test_upserts_replace_by_sequence(spark, tmp_path):
    s = store(spark, tmp_path)
    assert s.read().count() == 0 and s.coverage() == (None, None) and s.pointer().batch == -1
    s.upsert(batch(spark, [(1, "a", 1, "2020-05-01"), (2, "b", 5, None), (None, "n", 1, "0012-01-01"), (1, "x", 0, "2030-01-01")]))
    s.upsert(batch(spark, [(2, "old", 4, "2019-01-01"), (1, "c", 1, "2021-01-01"), (3, "d", None, "2018-02-03")]))
    rows = sorted(((r.k is None, r.k or 0), r.v) for r in s.read().collect())
    assert [v for _, v in rows] == ["c", "b", "d", "n"]
    assert s.coverage() == ("2018-02-03", "2021-01-01") and s.count() == 4
    before = s.pointer()
    s.upsert(batch(spark, []))
    assert s.pointer().number == before.number + 1 and s.pointer().buckets == before.buckets


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    s = store(spark, tmp_path)
    s.upsert(batch(spark, [(1, "a", 1, None)]), 0)
    first = s.upsert(batch(spark, [(1, "b", 2, None)]), 1)
    assert s.upsert(batch(spark, [(1, "c", 3, None)]), 1) == first
    assert s.upsert(batch(spark, [(1, "c", 3, None)]), 0) == first
    assert held(s) == [(1, "b", 2)]


def test_a_run_lost_between_write_and_pointer_leaves_the_last_table(spark, tmp_path, monkeypatch):
    s = store(spark, tmp_path)
    s.upsert(batch(spark, [(k, "a", 1, None) for k in range(20)]), 0)
    monkeypatch.setattr(s, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        s.upsert(batch(spark, [(1, "b", 2, None), (50, "b", 2, None)]), 1)
    again = store(spark, tmp_path)
    assert held(again) == [(k, "a", 1) for k in range(20)]
    again.upsert(batch(spark, [(1, "b", 2, None), (50, "b", 2, None)]), 1)
    assert held(again) == sorted([(k, "b" if k == 1 else "a", 2 if k == 1 else 1) for k in range(20)] + [(50, "b", 2)])
    assert again.retire(1) > 0
    assert len(held(again)) == 21
    assert {b.version for b in again.pointer().buckets} == set(os.listdir(f"{tmp_path}/data"))


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    one, two = store(spark, tmp_path), store(spark, tmp_path)
    stale = one.pointer()
    two.upsert(batch(spark, [(1, "two", 1, None)]))
    monkeypatch.setattr(one, "pointer", lambda: stale)
    with pytest.raises(Conflict):
        one.upsert(batch(spark, [(1, "one", 2, None)]))
    assert held(two) == [(1, "two", 1)]
    assert all(name.isdigit() or name.endswith(".crc") for name in os.listdir(f"{tmp_path}/pointers"))


def test_what_a_batch_writes_follows_its_keys_and_not_the_table(spark, tmp_path):
    written = {}
    for n in (500, 2_000, 8_000):
        s = store(spark, tmp_path / str(n), rows_per_bucket=100)
        s.upsert(spark.range(n).select(F.col("id").alias("k"), F.lit("a").alias("v"), F.lit(1).alias("seq"), F.lit("2020-01-01").alias("day")))
        buckets = s.pointer().buckets
        assert sum(b.rows for b in buckets) == n and max(b.rows for b in buckets) <= 100
        old, before = files_of(tmp_path / str(n)), s.pointer()
        s.upsert(batch(spark, [(3, "b", 2, "2021-01-01"), (n, "new", 1, None)]))
        new = {p for p in files_of(tmp_path / str(n)) if p not in old}
        written[n] = spark.read.schema(SCHEMA).parquet(*new).count()
        assert s.read().count() == n + 1 and s.count() == n + 1
        assert s.read(before).where("v <> 'a'").count() == 0  # the older pointer still reads the older table
        assert held(s)[3] == (3, "b", 2)
    assert max(written.values()) <= 203


def test_hot_key_and_splits_keep_all_rows(spark, tmp_path):
    s = store(spark, tmp_path, rows_per_bucket=3)
    for number in range(4):
        rows = [(7, f"v{number}-{i}", number * 100 + i, None) for i in range(90)] + [(100 * number + i, "x", 1, None) for i in range(30)]
        s.upsert(batch(spark, rows), number)
    got = held(s)
    assert Counter(k for k, _, _ in got).most_common(1)[0][1] == 1
    assert (7, "v3-89", 389) in got and len(got) == 120


def test_fields_that_a_batch_leaves_out_stay(spark, tmp_path):
    s = KeyedStore(spark, str(tmp_path), "k long, a string, b string, seq int", ["k"], "seq", present="fields")
    shape = "k long, a string, b string, seq int, fields array<string>"
    s.upsert(spark.createDataFrame([(1, "a1", "b1", 1, ["a", "b"]), (2, "a2", "b2", 1, ["a", "b"])], shape))
    s.upsert(spark.createDataFrame([(1, None, "ignored", 2, ["a"]), (2, "ignored", "b9", 3, ["b"])], shape))
    assert sorted(tuple(r) for r in s.read().collect()) == [(1, None, "b1", 2), (2, "a2", "b9", 3)]


@pytest.fixture
def load():
    return manifest.quarters("2006q3", "2007q2")


def test_quarters(load):
    assert load == ["2006q3", "2006q4", "2007q1", "2007q2"]


def test_a_lost_run_resumes_where_it_was(spark, tmp_path, load):
    ticks = iter(range(1000))
    kept = manifest.Manifest(spark, str(tmp_path), clock=lambda: f"t{next(ticks):03}")
    loaded = []

    def lost(unit):
        if unit == "2007q1":
            raise KeyboardInterrupt
        loaded.append(unit)
        return 10

    with pytest.raises(KeyboardInterrupt):
        kept.run(load, lost)
    states = {r.unit: (r.state, r.attempts) for r in kept.states().collect()}
    assert states == {"2006q3": ("completed", 1), "2006q4": ("completed", 1), "2007q1": ("in_progress", 1)}

    def partly(unit):
        loaded.append(unit)
        if unit == "2007q2":
            raise manifest.NotPublished("HTTP 404")
        raise RuntimeError("boom\nat line 1")

    summary = manifest.Manifest(spark, str(tmp_path)).run(load, partly)
    assert (summary.planned, summary.attempted, summary.skipped, summary.failed, summary.not_published) == (4, 2, 2, 1, 1)
    assert kept.states().where("unit = '2007q1'").first().error == "boom"
    kept.mark_terminal("2007q1", "holds nothing")
    kept.mark_terminal("2007q1", "holds nothing")
    assert kept.run(load, lambda unit: loaded.append(unit) or 5, most=1).rows == 5
    assert loaded == ["2006q3", "2006q4", "2007q1", "2007q2", "2007q2"]
    assert {r.unit: (r.state, r.attempts) for r in kept.states().collect()} == {"2006q3": ("completed", 1), "2006q4": ("completed", 1), "2007q1": ("terminal", 2), "2007q2": ("completed", 2)}
    assert kept.run(load, lambda unit: 1).attempted == 0
    assert kept.run(["2006q3"], lambda unit: 1, force=True, dry=True).completed == 1
    assert kept.states().where("unit = '2006q3'").first().state == "in_progress"


def test_transitions_that_can_not_follow_are_refused(spark, tmp_path):
    kept = manifest.Manifest(spark, str(tmp_path))
    with pytest.raises(ValueError, match="completed can't follow None"):
        kept.move("u", "completed")
    kept.move("u", "in_progress")
    kept.move("u", "completed", rows=1)
    with pytest.raises(ValueError, match="in_progress can't follow completed"):
        kept.move("u", "in_progress")
    assert manifest.due(spark.createDataFrame([("u",), ("v",)], "unit string"), kept.states()).collect() == [("v", None, 0)]


def test_no_task_writes_more_than_its_share_of_a_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed_store, "ROWS_PER_TASK", 200)
    s = store(spark, tmp_path, rows_per_bucket=1000)
    rows = spark.range(6000).selectExpr("id as k", "'a' as v", "1 as seq", "cast(null as string) as day")
    s.upsert(rows, 0)
    counts = [pq.read_metadata(p).num_rows for p in files_of(tmp_path)]
    assert max(counts) < 600 and s.count() == 6000 and held(s) == [(k, "a", 1) for k in range(6000)]
    assert len({p.split("/data/")[1].split("/")[0] for p in files_of(tmp_path)}) <= 3  # parted at once, not in halves of halves
    s.upsert(rows.where("k % 3 = 0").selectExpr("k", "'b' as v", "2 as seq", "day"), 1)
    assert held(s) == [(k, "a" if k % 3 else "b", 1 if k % 3 else 2) for k in range(6000)]
