"""Stores, sinks and keyed state: what is lost, late or repeated changes nothing."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from codequarry.operators import delivering
from codequarry.sources import stored, vectors
from codequarry.streaming import heartbeat, sinks, state


def test_vector_store_reads_and_clears_single_namespaces(spark, tmp_path):
    path = f"file://{tmp_path}/vectors"
    row = lambda i, v, n, seq=1: (i, v, None, "m", seq, n)
    df = lambda rows: spark.createDataFrame(rows, vectors.SCHEMA)
    vectors.upsert(df([row("a", [1.0, 0.0], "x/1"), row("b", [0.0, 1.0], "x/1"), row("a", [1.0, 1.0], "y"), row("c", [2.0, 0.0], "y", 1), row("c", [0.0, 2.0], "y", 2)]), path, 2)
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "vectors").glob("namespace=*/*.parquet")}
    vectors.upsert(df([row("c", [9.0, 0.0], "y", 1), row("d", [3.0, 3.0], "z")]), path, 2)
    after = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "vectors").glob("namespace=x*/*.parquet")}
    assert after and all(before[k] == v for k, v in after.items())
    got = {(r["namespace"], r["id"]): list(r["embedding"]) for r in vectors.read(spark, path).collect()}
    assert got == {("x/1", "a"): [1, 0], ("x/1", "b"): [0, 1], ("y", "a"): [1, 1], ("y", "c"): [0, 2], ("z", "d"): [3, 3]}
    plan = vectors.read(spark, path, "x/1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(namespace" in plan and vectors.read(spark, path, "x/1").count() == 2
    assert [r["chunk_id"] for r in vectors.nearest(spark, path, "x/1", [1.0, 0.1], 1).collect()] == ["a"]
    vectors.clear(spark, path, "x/1")
    vectors.clear(spark, path, "never there")
    assert {r["namespace"]: r["n"] for r in vectors.counts(spark, path).collect()} == {"y": 2, "z": 1}
    with pytest.raises(Exception, match="instead of 2"):
        vectors.upsert(df([row("e", [1.0], "y")]), path, 2)
    assert vectors.read(spark, path, "y").count() == 2 and vectors.read(spark, f"{path}-none").count() == 0


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(next(iter(state.ROCKSDB)))
    for k, v in state.ROCKSDB.items():
        spark.conf.set(k, v)
    yield spark
    spark.conf.set(next(iter(state.ROCKSDB)), before)


def feed(spark, folder, schema, rows):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def run(stream, folder, mode="append"):
    out = []
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", str(folder)).foreachBatch(lambda df, _: out.extend(df.collect())).trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def test_client_list_latches_at_the_end(rocksdb, tmp_path):
    spark, schema = rocksdb, "scan_id string, id long, event_type string"
    folder = tmp_path / "events"
    feed(spark, folder, schema, [("s", 2, "B"), ("s", 1, "A"), ("s", 2, "B"), ("t", 5, "A")])
    stream = lambda: state.client(spark.readStream.schema(schema).parquet(str(folder)))
    ids = lambda rows: sorted((r["scan_id"], r["id"]) for r in rows)
    assert ids(run(stream(), tmp_path / "c")) == [("s", 1), ("s", 2), ("t", 5)]
    feed(spark, folder, schema, [("s", 1, "A"), ("s", 3, "SCAN_COMPLETED"), ("s", 4, "after"), ("t", 4, "late"), ("t", 6, "B")])
    assert ids(run(stream(), tmp_path / "c")) == [("s", 3), ("t", 6)]
    feed(spark, folder, schema, [("s", 9, "after"), ("s", 3, "SCAN_COMPLETED"), ("t", 6, "B")])
    assert run(stream(), tmp_path / "c") == []
    size = spark.read.format("statestore").option("stateVarName", "mark").load(str(tmp_path / "c"))
    assert size.count() == 2


def test_client_list_state_goes_after_its_timer(rocksdb, tmp_path):
    spark, schema = rocksdb, "scan_id string, id long, event_type string"
    feed(spark, tmp_path / "events", schema, [("s", 1, "A"), ("s", 2, "SCAN_FAILED"), ("t", 1, "A")])
    seen = []
    q = state.client(spark.readStream.schema(schema).parquet(str(tmp_path / "events")), keep_ms=1).writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, _: seen.extend(df.collect())).start()
    try:
        until, left = time.time() + 60, 2
        while left > 1 and time.time() < until:
            time.sleep(0.5)
            if len(seen) == 3:
                left = spark.read.format("statestore").option("stateVarName", "mark").load(str(tmp_path / "c")).count()
    finally:
        q.stop()
    assert len(seen) == 3 and left == 1


def test_threads_go_on_behind_their_last_step(rocksdb, tmp_path):
    spark, schema, steps = rocksdb, "thread_id string, step string, result string", ["map", "find", "verify", "report"]
    folder = tmp_path / "steps"
    feed(spark, folder, schema, [("a", "map", "m"), ("a", "verify", "early"), ("b", "map", "m"), ("b", "noise", "x")])
    stream = lambda: state.threads(spark.readStream.schema(schema).parquet(str(folder)), steps)
    first = {r["thread_id"]: (r["done"], r["next"], r["finished"]) for r in run(stream(), tmp_path / "c", "update")}
    assert first == {"a": (1, "find", False), "b": (1, "find", False)}
    feed(spark, folder, schema, [("a", "map", "again"), ("a", "find", "f"), ("b", "map", "again")])  # the run before was ended; this one takes up its state
    second = {r["thread_id"]: (r["done"], r["next"], json.loads(r["result"])) for r in run(stream(), tmp_path / "c", "update")}
    assert second == {"a": (3, "report", {"map": "m", "find": "f", "verify": "early"})}
    feed(spark, folder, schema, [("a", "report", "r"), ("a", "report", "twice")])
    assert [(r["thread_id"], r["finished"], r["next"]) for r in run(stream(), tmp_path / "c", "update")] == [("a", True, None)]
    feed(spark, folder, schema, [("a", "report", "late"), ("a", "find", "late")])
    assert run(stream(), tmp_path / "c", "update") == []


def test_heartbeats_of_a_stopped_source(spark, tmp_path):
    sent = []
    beat = heartbeat.Heartbeats(lambda ident, frame: sent.append((ident, frame)), polls=3)
    feed(spark, tmp_path / "in", "x long", [(1,)])
    before = spark.conf.get("spark.sql.streaming.noDataProgressEventInterval")
    spark.conf.set("spark.sql.streaming.noDataProgressEventInterval", "0")
    spark.streams.addListener(beat)
    q = spark.readStream.schema("x long").parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="50 milliseconds").start()
    try:
        until = time.time() + 30
        while len(sent) < 2 and time.time() < until:
            time.sleep(0.1)
    finally:
        q.stop()
        spark.streams.removeListener(beat)
        spark.conf.set("spark.sql.streaming.noDataProgressEventInterval", before)
    assert len(sent) >= 2 and set(sent) == {(str(q.id), ": heartbeat\n\n")}
    one = heartbeat.Heartbeats(lambda *x: sent.append(x))
    del sent[:]
    for rows in [0] * 14 + [3] + [0] * 15:
        one._poll("q", rows)
    assert sent == [("q", ": heartbeat\n\n")] and heartbeat.POLLS == 15


def test_event_sink_stores_a_batch_once_and_whole(spark, tmp_path):
    schema = "id long, scan_id string, event_type string, metadata_payload string"
    path = f"file://{tmp_path}/log"
    write = sinks.writer(path, lambda b: b.select("id", "scan_id", F.lit("APPROVED").alias("status")))
    one = spark.createDataFrame([(1, "s", "STAGE_STARTED", None), (2, "s", "PATCH_APPROVED", '{"a": 1}'), (3, None, "STAGE_COMPLETED", None), (4, "s", "TOOL_FAILED", "{broken")], schema)
    write(one, 0)
    write(one, 0)
    with pytest.raises(ValueError, match="critical"):
        write(spark.createDataFrame([(5, "s", "STAGE_STARTED", None), (6, None, "HUMAN_REJECTED", None)], schema), 1)
    ids = lambda name: sorted((r["id"], r["batch_id"]) for r in sinks.stored(spark, path, name).collect())
    assert ids("events") == [(1, 0), (2, 0)] and ids("rows") == [(1, 0), (2, 0), (3, 0), (4, 0)]
    assert {r["id"]: r["refusal"] for r in sinks.stored(spark, path, "refused").collect()} == {3: "no scan", 4: "metadata is no JSON"}
    # a batch whose list entry was lost is written again, over itself
    spark.createDataFrame([(9, "s", "X", None)], schema).write.parquet(f"{path}/events/batch_id=1")
    assert ids("events") == [(1, 0), (2, 0)]
    write(spark.createDataFrame([(7, "s", "X", None)], schema), 1)
    assert ids("events") == [(1, 0), (2, 0), (7, 1)]


def test_deliveries_in_any_order(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for p in range(40):
        own = [(f"p{p}", "O", "r", "main", "s", rng.choice([None, "ann", "bo"]), 100 * p + i, rng.randrange(5), rng.random() < 0.7, rng.choice([None, "BLOCKED_BASE_DRIFT", "X"]), rng.choice([None, 7])) for i in range(rng.randrange(1, 6))]
        rows += own
        d = None
        for *_, who, _, _, ok, code, pr in sorted(own, key=lambda r: (r[7], r[6])):
            if d and (d[2] == "PR_CREATED" or d[3] == "BLOCKED_BASE_DRIFT"):
                break
            why = (code or "VALIDATION_FAILED") if not ok else (code or "DELIVERY_FAILED") if pr is None else None
            d = (who or (d[0] if d else "user"), d[1] + 1 if d else 1, "BLOCKED" if why == "BLOCKED_BASE_DRIFT" else "FAILED" if why else "PR_CREATED", why, None if why else pr)
        want[f"p{p}"] = d
    schema = "patch_id string, owner string, repo string, base_branch string, base_sha string, requested_by string, attempt_id long, requested_at int, eligible boolean, failure_code string, pr_number int"
    for _ in range(2):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows + rows[:20], schema)
        got = {r["patch_id"]: (r["requested_by"], r["attempt_count"], r["status"], r["failure_code"], r["pr_number"]) for r in delivering.deliveries(df).collect()}
        assert got == want


def test_reports_of_bucketed_tables_shuffle_nothing(spark):
    database = "stored_reports_test"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    before = {k: spark.conf.get(k) for k in [*stored.SETTINGS, "spark.sql.autoBroadcastJoinThreshold"]}
    try:
        for k, v in {**stored.SETTINGS, "spark.sql.autoBroadcastJoinThreshold": "-1"}.items():
            spark.conf.set(k, v)
        n = spark.range(60)
        s = lambda c: F.concat(F.lit("s"), (F.col(c) % 7).cast("string")).alias("scan_id")
        tables = {
            "scans": spark.range(9).select(F.concat(F.lit("s"), "id").alias("scan_id"), F.lit("COMPLETED").alias("status")), "findings": n.select(s("id"), "id", F.lit("t").alias("title")), "evidences": n.select(s("id"), (F.col("id") + 100).alias("id"), F.col("id").alias("finding_id")),
            "patches": n.where("id % 2 = 0").select(s("id"), (F.col("id") + 200).alias("id"), F.col("id").alias("finding_id")), "deliveries": n.where("id % 4 = 0").select(s("id"), (F.col("id") + 300).alias("id"), (F.col("id") + 200).alias("patch_id")), "events": n.select(s("id"), "id", F.lit("E").alias("event_type")),
        }
        for name, df in tables.items():
            stored.save(df, name, database, 4)
        r = stored.reports(spark, database)
        rows = {x["scan_id"]: x for x in r.collect()}
        assert len(rows) == 9 and rows["s8"]["findings"] == [] and rows["s8"]["events"] == []
        for k, x in rows.items():
            own = [i for i in range(60) if f"s{i % 7}" == k]
            assert [f["finding_id"] for f in x["findings"]] == own and len(x["events"]) == len(own)
            for f in x["findings"]:
                i = f["finding_id"]
                assert [e["id"] for e in f["evidences"]] == [i + 100] and [p["patch_id"] for p in f["patches"] or []] == ([i + 200] if i % 2 == 0 else [])
                assert [d["id"] for p in f["patches"] or [] for d in p["deliveries"] or []] == ([i + 300] if i % 4 == 0 else [])
        assert "Exchange" not in r._jdf.queryExecution().executedPlan().toString()
        one = stored.reports(spark, database, scan_id="s3")
        assert [x["scan_id"] for x in one.collect()] == ["s3"] and "SelectedBucketsCount: 1 out of 4" in one._jdf.queryExecution().executedPlan().toString()
        with pytest.raises(ValueError, match="none of"):
            stored.save(tables["scans"], "others", database, 4)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")
