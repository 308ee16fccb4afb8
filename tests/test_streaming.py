"""Streams over files give what the batch forms give."""

import pytest
from pyspark.sql import functions as F

from waymark import plans
from waymark.operators import stateful as Q
from waymark.streaming import jobs

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture()
def stream(spark, tmp_path):
    """Events in five files, read in order of time, one file per trigger."""
    events = plans.table(spark, FOLDER, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "src")
    for k, part in enumerate(events.orderBy("ts").randomSplit([1.0])):
        part.orderBy("ts").coalesce(1).write.mode("append").parquet(src)
        assert k == 0
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)


def test_hourly_counts(spark, stream, tmp_path):
    jobs.run_available(jobs.hourly_counts(stream, "ts", "user_id", 2), "memory", str(tmp_path / "c"), "complete", "hourly")
    got = {(r["user_id"], r["hour"]): (r["n"], r["over_budget"]) for r in spark.table("hourly").collect()}
    batch = plans.table(spark, FOLDER, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("h")).count().collect()
    assert got == {(r["user_id"], r["h"]): (r["count"], r["count"] > 2) for r in batch}


def test_first_requests(spark, stream, tmp_path):
    jobs.run_available(jobs.deduplicated_requests(stream, "ts", ["user_id", "event_type"], "365 days"), "memory", str(tmp_path / "c"), "append", "firsts")
    want = plans.table(spark, FOLDER, "events").select("user_id", "event_type").distinct().count()
    assert spark.table("firsts").count() == want


def test_sliding_limiter(spark, stream, tmp_path):
    jobs.run_available(jobs.sliding_limiter(stream, "user_id", "ts", "event_id", 2, 7200.0), "memory", str(tmp_path / "c"), "append", "limited")
    got = {r["event_id"]: r["allowed"] for r in spark.table("limited").collect()}
    want = {r["event_id"]: r["allowed"] for r in Q.sliding_limit(plans.table(spark, FOLDER, "events"), "user_id", "ts", "event_id", 2, 7200.0).collect()}
    assert got == want


def test_sessions_and_ledger(spark, stream, tmp_path):
    jobs.run_available(jobs.sessions(stream, "ts", "user_id", "1 hour"), "memory", str(tmp_path / "a"), "complete", "spans")
    assert spark.table("spans").agg(F.sum("events")).first()[0] == plans.table(spark, FOLDER, "events").count()
    jobs.run_available(jobs.page_ledger(stream, "user_id", "event_type"), "memory", str(tmp_path / "b"), "update", "ledger")
    last = spark.table("ledger").groupBy("user_id", "bucket").agg(F.max("raw").alias("raw"), F.max("distinct_rows").alias("n"))
    got = {r["user_id"]: r["n"] for r in last.groupBy("user_id").agg(F.sum("n").alias("n")).collect()}
    want = plans.table(spark, FOLDER, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("n")).collect()
    assert got == {r["user_id"]: r["n"] for r in want}


def test_replayed_pages_add_nothing(spark, tmp_path):
    pages = spark.createDataFrame([(1, 0, "x"), (1, 10, "y"), (1, 10, "y")], "root long, off long, rows string")
    path = str(tmp_path / "pages")
    write = jobs.exactly_once(path, ["root", "off"])
    write(pages, 0)
    write(pages, 0)
    assert spark.read.parquet(path).count() == 2
    write(pages.unionByName(spark.createDataFrame([(2, 0, "z")], pages.schema)), 1)
    assert sorted((r["root"], r["off"]) for r in spark.read.parquet(path).collect()) == [(1, 0), (1, 10), (2, 0)]


def in_files(spark, df, path, parts):
    """A stream of df's rows by time, in so many files, one a trigger."""
    import os
    import time

    rows = df.orderBy("at", "id").collect()
    for k in range(parts):
        some = rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]
        spark.createDataFrame(some, df.schema).coalesce(1).write.mode("append").parquet(path)
        for name in os.listdir(path):  # files are taken in order of their times
            if not hasattr(in_files, "seen") or (path, name) not in in_files.seen:
                in_files.seen = {*getattr(in_files, "seen", ()), (path, name)}
                os.utime(f"{path}/{name}", (time.time() - 1000 + k, time.time() - 1000 + k))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def lease_events(spark):
    import random

    rng = random.Random(11)
    rows = [(i, rng.choice("abc"), 1_700_000_000 + i * 7, rng.choice(["claim", "claim", "heartbeat", "heartbeat", "completed"]), rng.choice("xy")) for i in range(300)]
    rows += [(300, "d", 1_700_002_000, "claim", "x"), (301, "e", 1_700_002_050, "claim", "y"), (302, "z", 1_700_009_000, "heartbeat", "x")]
    return rows, spark.createDataFrame(rows, "id long, task string, s long, kind string, token string").withColumn("at", F.col("s").cast("timestamp"))


def test_leases_run_out_without_a_further_event(spark, tmp_path):
    rows, df = lease_events(spark)
    want, held = [], {}
    for i, task, s, kind, token in rows:
        if task in held and held[task][1] < s:
            want.append((None, task, held[task][0], "expired", held.pop(task)[1]))
        mine = task in held and held[task][0] == token
        if (kind == "claim" and task in held) or (kind != "claim" and not mine):
            want.append((i, task, token, "refused", s))
            continue
        effect = {"claim": "granted", "heartbeat": "renewed"}.get(kind, "released")
        want.append((i, task, token, effect, s))
        held.pop(task, None)
        if effect != "released":
            held[task] = (token, s + 60)
    want += [(None, task, token, "expired", until) for task, (token, until) in held.items()]
    stream = in_files(spark, df, str(tmp_path / "src"), 6)
    jobs.run_available(jobs.leases(stream, "task", "at", "id", "kind", "token", 60), "memory", str(tmp_path / "c"), "append", "leased")
    got = [(r["id"], r["task"], r["token"], r["effect"], int(r["at"].timestamp())) for r in spark.table("leased").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {t for i, t, *_ in got if i is None} >= {"d", "e"}  # which have no other event


def test_presence_ends_by_a_timer(spark, tmp_path):
    rows, df = lease_events(spark)
    want, open_ = [], {}
    for _, task, s, *_ in rows:
        if task in open_ and open_[task][1] < s:
            want.append((task, *open_.pop(task)))
        begin, _, n = open_.get(task, (s, s, 0))
        open_[task] = (begin, s + 20, n + 1)
    want += [(task, *v) for task, v in open_.items() if task != "z"]  # the watermark doesn't pass the last event
    stream = in_files(spark, df, str(tmp_path / "src"), 4)
    jobs.run_available(jobs.presence(stream, "task", "at", 20), "memory", str(tmp_path / "c"), "append", "present")
    got = [(r["task"], int(r["begin"].timestamp()), int(r["end"].timestamp()), r["events"]) for r in spark.table("present").collect()]
    assert sorted(got) == sorted(want)
