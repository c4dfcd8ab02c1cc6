import json
import time
import uuid
import zipfile
from datetime import datetime, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docketspark.sources import bulk, readers
from docketspark.streaming import jobs, telemetry
from docketspark.streaming.keyed_store import KeyedStore


def test_tab_separated_keeps_quotes_and_blanks(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('ID\tNAME\tNOTE\n1\t"x"\t\n2\ty\tz\n')
    got = readers.tab_separated(spark, str(tmp_path), "ID string, NAME string, NOTE string").orderBy("ID").collect()
    assert [tuple(r) for r in got] == [("1", '"x"', ""), ("2", "y", "z")]


def test_quoted_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"a ""b"", c"\n')
    assert readers.quoted_csv(spark, str(tmp_path), "id int, name string").first().name == 'a "b", c'


def test_settlements(spark, tmp_path):
    (tmp_path / "f.txt").write_text("SETTLEMENT DATE|CUSIP|SYMBOL|QUANTITY (FAILS)|DESCRIPTION|PRICE\n20240105|0001|AB|10|X|2.5\n20240106|0002|CD|10|Y|.\nshort|line\n")
    got = readers.settlements(spark, str(tmp_path)).orderBy("instrument").collect()
    assert [(r.settlement_date, r.quantity, r.fail_value) for r in got] == [("2024-01-05", 10, 25.0), ("2024-01-06", 10, 0.0)]


def test_xml_rows(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><f><id>1</id><o>x</o><o>y</o></f><f><id>2</id><o>z</o></f></r>")
    got = readers.xml_rows(spark, str(tmp_path / "a.xml"), "f", "id long, o array<string>").orderBy("id").collect()
    assert [list(r.o) for r in got] == [["x", "y"], ["z"]]


@pytest.fixture
def remote(spark, tmp_path):
    """A folder that only Spark's file systems reach."""
    mount = f"m{uuid.uuid4().hex}"
    spark._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{mount}.link./in", f"file://{tmp_path}")
    return f"viewfs://{mount}/in", tmp_path


def test_json_pages(spark, remote):
    path, folder = remote
    for k in range(3):
        (folder / f"{k}.json").write_text(json.dumps({"results": [{"id": k, "name": f"n{k}"}, {"id": k + 10}], "next": None}, indent=1))
    (folder / "odd.json").write_text("not json")
    (folder / "none.json").write_text('{"count": 0}')
    got = readers.json_pages(spark, f"{path}/*.json", "id long, name string")
    assert sorted((r.id, r.name) for r in got.collect()) == [(0, "n0"), (1, "n1"), (2, "n2"), (10, None), (11, None), (12, None)]
    assert readers.json_pages(spark, f"{path}/none.json", "id long", "records").count() == 0


def test_rss_items(spark, remote):
    path, folder = remote
    items = "".join(f"<item><title>T{k} &amp; x</title><link>http://h/{k}</link><guid isPermaLink='false'>g{k}</guid><pubDate>{d}</pubDate></item>" for k, d in enumerate(["Tue, 05 Nov 2024 14:30:00 -0500", "6 Nov 24 01:02 GMT", "soon"]))
    (folder / "feed.xml").write_text(f"<?xml version='1.0'?><rss><channel><title>all</title>{items}</channel></rss>")
    got = [tuple(r) for r in readers.rss_items(spark, f"{path}/feed.xml").orderBy("link").collect()]
    assert [(r[0], r[2], r[4]) for r in got] == [("T0 & x", "g0", "2024-11-05T19:30:00Z"), ("T1 & x", "g1", "2024-11-06T01:02:00Z"), ("T2 & x", "g2", None)]


def bundle(path, tables, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as out:
        for name, rows in tables.items():
            out.writestr(f"q/{name}.tsv", "\n".join("\t".join(x) for x in rows) + "\n")
        out.writestr("q/readme.htm", "<p>")


def test_zip_bundle(spark, remote):
    path, folder = remote
    many = [("ID", "NOTE")] + [(str(k), f'say "{k}"') for k in range(25_001)]
    tables = {name: [("ID", "NOTE"), ("1", ""), ("x",)] for name in readers.BUNDLE} | {"FOOTNOTES": many}
    bundle(folder / "2024q1.zip", tables)
    bundle(folder / "2024q2.zip", tables | {"FOOTNOTES": [("ID", "NOTE"), ("7", "é")]}, zipfile.ZIP_STORED)
    members = readers.zip_members(spark, f"{path}/*.zip")
    assert members.count() == 18
    got = readers.zip_bundle(spark, f"{path}/*.zip", {"FOOTNOTES": "id int, note string", "SUBMISSION": "id int, note string"})
    notes = got["FOOTNOTES"]
    assert notes.count() == 25_002 and notes.agg(F.sum("id")).first()[0] == 25_000 * 25_001 // 2 + 7
    assert notes.where("id = 24999").first().note == 'say "24999"' and notes.where("id = 7 and note = 'é'").count() == 1
    assert sorted(((r.id is None, r.id), r.note) for r in got["SUBMISSION"].collect()) == [((False, 1), "")] * 2 + [((True, None), "")] * 2
    bundle(folder / "2024q3.zip", {x: tables[x] for x in readers.BUNDLE[:6]})
    with pytest.raises(ValueError, match="2024q3.zip lacks FOOTNOTES, OWNER_SIGNATURE"):
        readers.zip_bundle(spark, f"{path}/*.zip", {"FOOTNOTES": "id int, note string"})


CLIENT = """
import json, os, uuid

class Client:
    def __init__(self, options):
        self.folder, self.wrong = options["folder"], options.get("wrong", "")

    def send(self, records):
        assert len(records) <= 400
        mark = os.path.join(self.folder, f"tries-{records[0]['id']}")
        tries = int(open(mark).read()) if os.path.exists(mark) else 0
        open(mark, "w").write(str(tries + 1))
        if records[0]["id"] % 3 == 0 and tries < 2:
            self.put(records[:5])
            raise RuntimeError("HTTP 503 UNAVAILABLE")
        if self.wrong and any(x["name"] == self.wrong for x in records):
            raise RuntimeError("permission denied")
        self.put(records)

    def put(self, records):
        for x in records:
            open(os.path.join(self.folder, f"doc-{x['id']}"), "w").write(json.dumps(x))

    def done(self, totals):
        open(os.path.join(self.folder, "done"), "w").write(json.dumps(totals))

    def failed(self, totals):
        open(os.path.join(self.folder, "failed"), "w").write(json.dumps(totals))
"""


def test_bulk_sink_retries_and_may_run_again(spark, tmp_path):
    (tmp_path / "bulk_client.py").write_text(CLIENT)
    spark.sparkContext.addPyFile(str(tmp_path / "bulk_client.py"))
    bulk.register(spark)
    docs = spark.range(0, 3001, 1, 2).select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))

    def write(**options):
        docs.write.format("bulk").options(client="bulk_client:Client", folder=str(tmp_path), pause="0.01", **options).mode("append").save()

    with pytest.raises(Exception, match="permission denied"):
        write(wrong="n2999")
    assert (tmp_path / "failed").exists() and not (tmp_path / "done").exists()
    write()
    totals = json.loads((tmp_path / "done").read_text())
    assert totals["records"] == 3001 and totals["batches"] == 8
    kept = {p.name: json.loads(p.read_text()) for p in tmp_path.glob("doc-*")}
    assert len(kept) == 3001 and kept["doc-17"] == {"id": 17, "name": "n17"}
    with pytest.raises(ValueError, match="append"):
        bulk.Bulk({}).writer(docs.schema, True)


def test_bulk_gives_up_on_other_errors_and_after_all_tries():
    class Busy:
        tries = 0

        def send(self, records):
            self.tries += 1
            raise RuntimeError(records[0])

    busy = Busy()
    with pytest.raises(RuntimeError):
        bulk.deliver(busy, ["429 slow down"], 3, 0.001)
    assert busy.tries == 3
    with pytest.raises(RuntimeError):
        bulk.deliver(busy, ["403"], 3, 0.001)
    assert busy.tries == 4


def test_telemetry_of_streams_and_jobs(spark, landing):
    seen = telemetry.Telemetry(spark, str(landing / "meta"))
    spark.streams.addListener(seen.listener)
    try:
        for name, folder in (("good", "in"), ("good", "in"), ("bad", "in")):
            rows = jobs.follow(spark, str(landing / folder), "k long, v string, seq int", files_per_batch=1)
            work = lambda batch, n: batch.count() if name == "good" else 1 / 0  # noqa: E731, B023
            query = rows.writeStream.queryName(name).foreachBatch(work).trigger(availableNow=True).option("checkpointLocation", str(landing / f"check-{name}")).start()
            try:
                query.awaitTermination()
            except Exception:  # noqa: BLE001  the bad one
                assert name == "bad"
        deadline = time.time() + 30
        while time.time() < deadline and len(seen.listener._heard) < 2:
            time.sleep(0.2)
        time.sleep(1)
        assert seen.flush() == 2 and seen.flush() == 0
    finally:
        spark.streams.removeListener(seen.listener)
    got = {r.job: r for r in seen.rows().collect()}
    assert got["good"].docs_written == 5 and got["good"].errors == 0 and got["good"].last_synced_at > "2020" and got["bad"].errors == 1
    started = datetime.now(timezone.utc)
    seen.record("load", started, docs_written=7, errors=2)
    seen.record("load", started, docs_written=9, stats={"quarters": 1})
    row = seen.rows().where("job = 'load'").first()
    assert (row.docs_written, row.errors, row.stats) == (9, 2, '{"quarters": 1}')


def test_live_first(spark):
    cached = lambda: spark.range(2)
    rows, warning = readers.live_first(lambda: spark.range(3), cached)
    assert warning is None and {r.source for r in rows.collect()} == {"live"}
    rows, warning = readers.live_first(lambda: spark.read.parquet("/nowhere"), cached)
    assert "live source failed" in warning and {r.source for r in rows.collect()} == {"cache"}


@pytest.fixture
def landing(spark, tmp_path):
    for k, rows in enumerate([[(1, "a", 1), (2, "b", 1)], [(2, "c", 2), (3, "d", 2)], [(2, "old", 0)]]):
        spark.createDataFrame(rows, "k long, v string, seq int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del k
    return tmp_path


def test_upsert_stream_is_idempotent(spark, landing):
    stream = jobs.follow(spark, str(landing / "in"), "k long, v string, seq int", files_per_batch=1)
    sink = jobs.upsert_into(str(landing / "out"), "k long, v string, seq int", ["k"], "seq")
    jobs.replay(stream, sink, str(landing / "check")).awaitTermination()
    store = KeyedStore(spark, str(landing / "out"), "k long, v string, seq int", ["k"], "seq")
    assert {r.k: r.v for r in store.read().collect()} == {1: "a", 2: "c", 3: "d"}
    last = store.pointer()
    jobs.replay(stream, sink, str(landing / "check")).awaitTermination()
    assert store.pointer() == last


def test_deduplicated_and_windowed_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", "x"), (1, "2024-01-01 00:10:00", "x"), (2, "2024-01-01 01:10:00", "x")]
    df = spark.createDataFrame(rows, "event_id long, at string, kind string").withColumn("ts", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = jobs.deduplicated(jobs.follow(spark, str(tmp_path / "in"), df.schema), "event_id", "ts")
    stream.writeStream.format("memory").queryName("once").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == 2
    counts = jobs.windowed(jobs.follow(spark, str(tmp_path / "in"), df.schema), "ts", "1 hour", "kind")
    counts.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.n for r in spark.table("hours").collect()) == [1, 2]


def test_sliding_limiter(spark, tmp_path):
    hits = pd.DataFrame({"client": ["a"] * 5 + ["b"], "hit": range(6), "at": [0.0, 1.0, 2.0, 10.5, 11.5, 0.0]})
    spark.createDataFrame(hits).write.parquet(str(tmp_path / "in"))
    stream = jobs.limited(jobs.follow(spark, str(tmp_path / "in"), "client string, hit long, at double"), limit=2, seconds=10.0)
    stream.writeStream.format("memory").queryName("hits").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert {r.hit: r.admitted for r in spark.table("hits").collect()} == {0: True, 1: True, 2: False, 3: True, 4: True, 5: True}
