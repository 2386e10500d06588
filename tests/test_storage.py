"""What ingest keeps: key filters, retirement and removal of files, stored issues behind the engine, retries, the log index."""

import threading
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from sparkscope import api
from sparkscope.operators import issues, log_index, log_search
from sparkscope.sources import views
from sparkscope.streaming import delivery, keys, metrics
from sparkscope.streaming.ingest import Ingest

SF = "/root/testdata/sf0.001"


def shown(df):
    return sorted(map(str, df.collect()))


def test_few_keys_are_read_of_many(spark, tmp_path):
    rows = spark.range(60_000).select((F.col("id") % 3).cast("int").alias("project_id"), F.col("id").cast("string").alias("transaction_id"))
    key = ["project_id", "transaction_id"]
    parts = {}
    for k in range(2):
        parts[f"p{k}"] = str(tmp_path / f"p{k}")
        keys.write(rows.filter(F.col("transaction_id").cast("long") % 2 == k), key, parts[f"p{k}"])
        assert keys.exists(spark, parts[f"p{k}"])
    new = spark.range(60_000, 60_300).select((F.col("id") % 3).cast("int").alias("project_id"), F.col("id").cast("string").alias("transaction_id"))
    held, read = keys.stored_among(new, key, parts)
    assert (held is None or held.count() == 0) and read.keys == 60_000 and read.read_keys < 6_000
    again = new.unionByName(rows.filter("transaction_id IN ('7', '8')"))
    held, read = keys.stored_among(again, key, parts)
    assert shown(held.select(*key)) == shown(rows.filter("transaction_id IN ('7', '8')"))
    assert {r["part"] for r in held.collect()} == {"p0", "p1"} and 2 <= read.read_blocks and read.read_keys < 10_000
    held, read = keys.stored_among(rows, key, parts)
    assert held.count() == 60_000 and read.read_keys == 60_000


def test_keys_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "project_id int, event_id string")
    keys.write(none, ["project_id", "event_id"], str(tmp_path / "a"))
    held, read = keys.stored_among(none, ["project_id", "event_id"], {"a": str(tmp_path / "a")})
    assert held is None and read.keys == 0
    assert keys.stored_among(none, ["project_id", "event_id"], {})[0] is None


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    pipeline, source = Ingest(spark, str(tmp_path_factory.mktemp("store") / "t")), views.envelopes(spark, SF)
    pipeline.process(source.filter("day(received_at) < 12"), 0)
    pipeline.process(source.filter("day(received_at) >= 10"), 1)
    return pipeline


def test_stored_issues_are_those_of_the_events(spark, stored):
    events = stored.read("events")
    plain = issues.group_issues(events.drop("message").withColumn("arrival", F.struct("received_at", "event_id")), "arrival")
    assert shown(stored.issues()) == shown(plain.select(*stored.issues().columns))
    assert shown(stored.partial("issue_facets")) == shown(issues.issue_facets(events))
    assert stored.looked["transactions"].keys > 0
    tables = dict(transactions=views.transactions(spark, SF), logs=views.logs(spark, SF), projects=views.projects(spark))
    as_of = views.as_of(spark, SF)
    raw = api.Engine(api.Tables(events=events.withColumn("id", F.struct("received_at", "event_id")), **tables), as_of)
    kept = api.Engine(api.Tables(events=events, issues=stored.issues(), issue_facets=stored.partial("issue_facets"), **tables), as_of)
    for asked in ({}, {"query": "value 3"}, {"environment": "staging", "release": "v1"}, {"project": 2, "limit": 100}):
        found = kept.search_issues(**asked)
        assert shown(found) == shown(raw.search_issues(**asked).select(*found.columns)) != []
    assert "payload" not in kept.search_issues()._jdf.queryExecution().optimizedPlan().toString()


def test_what_retires_goes_once_and_may_come_again(spark, tmp_path):
    pipeline, source = Ingest(spark, str(tmp_path / "t")), views.envelopes(spark, SF)
    as_of = views.as_of(spark, SF)
    days = {"transactions": 10, "events": 10, "spans": 5, "histograms": 20}
    first = (as_of - timedelta(days=10)).date()
    pipeline.process(source, 0)
    whole, counts = pipeline.read("transactions").count(), pipeline.issues().agg(F.sum("count")).first()[0]
    kept = pipeline.read("transactions").filter(F.col("day") >= F.lit(first)).count()
    left = pipeline.read("events").filter(F.col("day") >= F.lit(first)).count()
    assert 0 < kept < whole and 0 < left < counts
    for _ in range(2):  # a second time changes nothing
        pipeline.retire(as_of, 0, days)
        assert pipeline.read("transactions").count() == kept and pipeline.issues().agg(F.sum("count")).first()[0] == left
        assert pipeline.issues().count() > 0 and pipeline.hourly().count() > 0
    assert pipeline.vacuum() > 0
    assert pipeline.vacuum() == 0 and pipeline.read("transactions").count() == kept
    assert pipeline.read("transactions").filter((F.size("spans") > 0) & (F.col("day") < F.lit((as_of - timedelta(days=5)).date()))).count() == 0
    # Delivered again, what is stored stays and what was retired comes back, until it retires with its batch.
    pipeline.process(source, 1)
    assert pipeline.read("transactions").count() == whole and pipeline.issues().agg(F.sum("count")).first()[0] == counts
    pipeline.retire(as_of, 1, days)
    pipeline.compact(1)
    assert pipeline.vacuum() > 0
    assert pipeline.read("transactions").count() == kept and pipeline.issues().agg(F.sum("count")).first()[0] == left
    assert pipeline.read("transactions").select("project_id", "transaction_id").distinct().count() == kept


class Flaky:
    """Writes rows but for some values, and fails where one of these is among them."""

    def __init__(self, spark, out, bad, broken=0):
        self.spark, self.out, self.bad, self.broken, self.lock = spark, out, bad, broken, threading.Lock()

    def check(self, rows):
        bad = [r["v"] for r in rows.select("v").collect() if r["v"] in self.bad]
        if bad:
            raise ValueError(f"unreadable {bad[0]}")

    def process(self, rows, batch_id):
        with self.lock:
            self.broken -= 1
            if self.broken >= 0:
                raise OSError("disk")
        self.check(rows)
        rows.write.mode("overwrite").parquet(f"{self.out}/batch_id={batch_id}")


def test_poison_is_found_retried_buried_and_replayed(spark, tmp_path):
    flaky = Flaky(spark, str(tmp_path / "out"), {3, 17, 40})
    deliver = delivery.Delivery(spark, str(tmp_path / "d"), flaky.process, flaky.check, retries=2)
    batch = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("v"), (F.col("id") % 2).alias("w"))
    deliver(batch(0, 30), 0)
    told = {r["v"]: (r["attempts"], r["error"]) for r in deliver.table("waiting").collect()}
    assert set(told) == {3, 17} and all(n == 1 and "unreadable" in e for n, e in told.values())
    deliver(batch(30, 50), 1)
    assert sorted((r["v"], r["attempts"]) for r in deliver.table("waiting").collect()) == [(3, 2), (17, 2), (40, 1)]
    flaky.bad.discard(17)
    deliver(batch(50, 51), 2)
    deliver(batch(50, 51), 2)  # the same batch again
    assert sorted((r["v"], r["attempts"]) for r in deliver.table("buried").collect()) == [(3, 3)]
    assert sorted((r["v"], r["attempts"]) for r in deliver.table("waiting").collect()) == [(40, 2)]
    assert sorted(map(tuple, metrics.ledger(deliver).collect())) == [(0, 2, 2, 0), (1, 3, 3, 0), (2, 2, 1, 1)]
    flaky.bad.clear()
    assert deliver.replay(2) == 1 and deliver.table("buried").count() == 0
    deliver(batch(51, 52), 3)
    stored = [r["v"] for r in spark.read.parquet(flaky.out).select("v").collect()]
    assert sorted(stored) == list(range(52)) and deliver.table("waiting").count() == deliver.table("buried").count() == 0


def test_judged_items_are_any_number_and_are_not_searched_for(spark, tmp_path):
    tried, broken = [], F.col("v") % 3 == 0

    def check(rows):
        tried.append("check")
        rows.select(F.when(broken, F.raise_error(F.lit("unreadable"))).otherwise(F.lit(1))).write.format("noop").mode("overwrite").save()

    def process(rows, batch_id):
        tried.append("process")
        rows.withColumn("read", F.when(broken, F.raise_error(F.lit("unreadable"))).otherwise(F.lit(1))).write.mode("overwrite").parquet(f"{tmp_path}/out/batch_id={batch_id}")

    deliver = delivery.Delivery(spark, str(tmp_path / "d"), process, check, retries=1, judge=lambda rows: rows.withColumn("error", F.when(broken, "unreadable")))
    deliver(spark.range(6000).select(F.col("id").alias("v")), 0)
    # Twice as many as splitting may find, in one attempt.
    assert tried == ["process"] and deliver.table("waiting").count() == 2000 and spark.read.parquet(f"{tmp_path}/out").count() == 4000
    deliver(spark.range(6000, 6003).select(F.col("id").alias("v")), 1)
    assert (deliver.table("buried").count(), deliver.table("waiting").count(), tried) == (2000, 1, ["process", "process"])


def test_what_is_not_judged_is_found_by_splitting(spark, tmp_path):
    flaky = Flaky(spark, str(tmp_path / "out"), {3, 17})
    deliver = delivery.Delivery(spark, str(tmp_path / "d"), flaky.process, flaky.check, judge=lambda rows: rows.withColumn("error", F.when(F.col("v") == 3, "judged")))
    deliver(spark.range(30).select(F.col("id").alias("v")), 0)
    told = {r["v"]: r["error"] for r in deliver.table("waiting").collect()}
    assert set(told) == {3, 17} and told[3] == "judged" and "unreadable" in told[17]
    assert spark.read.parquet(flaky.out).count() == 28


def test_a_failure_of_the_system_is_no_items(spark, tmp_path):
    flaky = Flaky(spark, str(tmp_path / "out"), set(), broken=1)
    deliver = delivery.Delivery(spark, str(tmp_path / "d"), flaky.process, flaky.check)
    rows = spark.range(5).select(F.col("id").alias("v"))
    deliver(rows, 0)  # passes the second time
    assert spark.read.parquet(flaky.out).count() == 5 and deliver.table("waiting").count() == 0
    flaky.broken = 9
    with pytest.raises(OSError, match="disk"):
        deliver(rows, 1)


def test_ingest_behind_delivery(spark, tmp_path):
    pipeline = Ingest(spark, str(tmp_path / "t"))
    deliver = delivery.Delivery(spark, str(tmp_path / "d"), pipeline.process, pipeline.check)
    source = views.envelopes(spark, SF)
    deliver(source, 0)
    assert deliver.table("waiting").count() == 0 and pipeline.read("transactions").count() == pipeline.read("transactions").select("transaction_id").distinct().count() > 0


def test_index_gives_what_a_scan_gives(spark, tmp_path):
    logs = views.logs(spark, SF).withColumn("body", F.when(F.col("id") % 10 == 0, F.lit("to be or not to be, that: to_be")).when(F.col("id") % 10 == 1, F.lit("Be to or")).when(F.col("id") % 10 == 2, F.lit(None)).otherwise(F.col("body")))
    path = str(tmp_path / "index")
    log_index.write(logs.filter("id < 90"), path)
    log_index.write(logs.filter("id >= 90"), path)
    newest = logs.agg(F.max("timestamp")).first()[0]
    from sparkscope.plans.window import TimeWindow

    window = TimeWindow(newest - timedelta(minutes=60), newest)
    for query in ("to:be:or", "to_be", "to:be", "be to", "be:to", "status:3", "user_id", "missing", "status missing", "", None, "!!", "the", "to:be:or:not:to:be:that:to:be", "not:be", "status:3 to"):
        for wanted, within in ((log_search.LogFilter(), None), (log_search.LogFilter(level="error"), None), (log_search.LogFilter(project_id=2), window)):
            scan = log_search.search_logs(logs, query, within, wanted, 40).select("id").collect()
            assert log_index.search(logs, path, query, within, wanted, 40).select("id").collect() == scan, (query, wanted)
    asked, all_ = log_index.read_bytes(spark, path, "status:3")
    assert 0 < asked < all_ / 5


def test_quiet_issues_leave_no_state(spark, tmp_path):
    from datetime import datetime

    from sparkscope.streaming import bursts

    start = datetime(2024, 1, 1)
    schema = "project_id int, fingerprint string, timestamp timestamp"
    batches = [[(1, "a", 0), (1, "a", 1), (1, "b", 2)], [(1, "c", 300)], [(1, "c", 301), (1, "a", 302), (1, "a", 303)], [(1, "c", 900)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame([(p, f, start + timedelta(minutes=m)) for p, f, m in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = bursts.burst_alerts(stream, 2).writeStream.format("memory").queryName("quiet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert sorted((r["fingerprint"], r["alert_at"]) for r in spark.table("quiet").collect()) == [("a", start + timedelta(minutes=1)), ("a", start + timedelta(minutes=303)), ("c", start + timedelta(minutes=301))]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    # Two of three issues were quiet for too long.
    assert max(held) == 3 and held[-1] == 1, held


def test_only_items_of_repeated_keys_move(spark, tmp_path, monkeypatch):
    from sparkscope.streaming import ingest

    pipeline = Ingest(spark, str(tmp_path / "t"))
    rows = [(1, "a", 0), (1, "b", 1), (2, "a", 2), (None, "a", 3), (None, "a", 4), (1, "b", 5), (2, "c", 6)]
    items = spark.createDataFrame(rows, "project_id int, event_id string, item_index int")
    single = items.filter("item_index IN (0, 2, 3)")
    assert pipeline._once(single) is single
    for few in (100, 1):
        monkeypatch.setattr(ingest, "FEW_KEYS", few)
        once = pipeline._once(items).select("project_id", "event_id", "item_index").collect()
        assert sorted((str(r["project_id"]), r["event_id"]) for r in once) == [("1", "a"), ("1", "b"), ("2", "a"), ("2", "c"), ("None", "a")]
        assert {r["item_index"] for r in once} <= {r[2] for r in rows}


def test_envelopes_are_spread_over_tasks(spark, monkeypatch):
    rows = views.envelopes(spark, SF)
    n = rows.count()
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    monkeypatch.setattr(views, "PART_ROWS", n // 20)
    assert views.envelopes(spark, SF).rdd.getNumPartitions() >= 20


def test_bodies_are_decompressed_some_rows_at_a_time(spark, monkeypatch):
    """A batch's values are never Python objects all at once."""
    import gzip

    from sparkscope.sources import envelope

    monkeypatch.setattr(envelope, "SLICE_ROWS", 3)
    bodies = [None, b"", b"plain", gzip.compress(b"zipped"), gzip.compress(b"cut")[:-9], "é".encode(), b"\xff\xfe"] * 3
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i long, b binary").coalesce(1)
    found = rows.select("i", envelope.decompress(F.col("b")).alias("text"))
    assert "pandas" not in envelope.__dict__ and envelope.by_slices
    assert [r["text"] for r in found.orderBy("i").collect()] == [None, "", "plain", "zipped", None, "é", None] * 3


def test_postings_move_once(spark):
    """A text's tokens are grouped where the text is: only what is written moves, a row for each text and bucket."""
    logs = spark.createDataFrame([(1, 5, "a b a c", "b x"), (2, 6, None, "a")], "id long, at long, body string, attrs_text string").select("id", F.timestamp_seconds("at").alias("timestamp"), "body", "attrs_text")
    found = log_index.postings(logs)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    places = {}
    for r in found.collect():
        for i, token in enumerate(r["tokens"].split(" ")):
            places[r["id"], r["field"], token] = r["positions"][r["starts"][i] - 1 : r["starts"][i + 1] - 1]
    assert places == {(1, 0, "a"): [0, 2], (1, 0, "b"): [1], (1, 0, "c"): [3], (1, 1, "b"): [0], (1, 1, "x"): [1], (2, 1, "a"): [0]}


def test_rows_of_large_batches_do_not_move(spark, tmp_path, monkeypatch):
    """Facts are written from where a batch's items were, whatever was stored before, and folded day by day; of what is folded and
    of a batch's items no file is left."""
    from sparkscope.streaming import ingest

    monkeypatch.setattr(ingest, "MOVED_BYTES", 0, raising=False)
    monkeypatch.setattr(ingest, "FEW_KEYS", 3)
    pipeline, source, plans, put = Ingest(spark, str(tmp_path / "t")), views.envelopes(spark, "/root/testdata/sf0.001"), {}, Ingest._put

    def told(self, rows, table, batch_id, *by):
        plans[table, batch_id] = rows._jdf.queryExecution().executedPlan().toString()
        put(self, rows, table, batch_id, *by)

    def moved():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    monkeypatch.setattr(Ingest, "_put", told)
    early = F.dayofmonth("received_at") < 12
    pipeline.process(source.filter(early), 0)
    pipeline.compact(0)
    assert pipeline.vacuum() > 0
    pipeline.process(source.filter(~early | (F.second("received_at") < 30)), 1)
    for table in ("transactions", "events"):
        for batch_id in (0, 1):
            assert not any(x in plans[table, batch_id] for x in ("hashpartitioning", "rangepartitioning", "REBALANCE")), plans[table, batch_id]
    assert "BroadcastExchange" in plans["transactions", 1]  # what came again was told
    before, rows = moved(), pipeline.read("transactions").count()
    between = moved()
    pipeline._fold("transactions", 1)
    assert moved() - between < 100 + between - before  # counting moves a few bytes, folding none
    folded = spark.read.parquet(str(tmp_path / "t" / "transactions_compacted" / "upto=1"))
    wanted = spark.read.parquet("/root/testdata/sf0.001/events.parquet").filter("event_id % 37 != 0 AND event_id % 31 != 0")
    assert folded.count() == rows == wanted.count() == folded.select("project_id", "transaction_id").distinct().count()
    assert folded.filter("day != to_date(timestamp)").count() == 0 and folded.select("day").distinct().count() > 5
    assert pipeline.vacuum() > 0 and pipeline.read("transactions").count() == rows
    assert not list((tmp_path / "t" / "staged").glob("*")) and not list((tmp_path / "t" / "transactions").glob("batch_id=*"))


def test_rows_are_told_from_many_held_keys_by_filters(spark, tmp_path):
    """The filters' mistakes are put right, keys with nulls stay, and nothing but keys moves."""
    rows = spark.range(6000).select((F.col("id") % 5).cast("int").alias("a"), F.col("id").cast("string").alias("b"), F.lit("text").alias("text"))
    rows = rows.unionByName(rows.limit(3).withColumn("a", F.lit(None).cast("int")))
    rows.filter("a IS NOT NULL AND cast(b AS int) % 2 = 0").select("a", "b").write.parquet(str(tmp_path / "held"))
    held = spark.read.parquet(str(tmp_path / "held"))
    wanted = sorted(map(str, rows.join(held, ["a", "b"], "left_anti").collect()))
    for few in (1000, 0, 10_000):  # by filters, with more mistakes than are named, and by the keys themselves
        found = keys.without(rows, ["a", "b"], held, str(tmp_path / f"few={few}"), few)
        assert sorted(map(str, found.collect())) == wanted, few
    plan = keys.without(rows, ["a", "b"], held, str(tmp_path / "again"), 1000)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "bits" in plan
    assert keys.without(rows, ["a", "b"], held.filter("a < 0"), str(tmp_path / "none"), 1000) is rows
