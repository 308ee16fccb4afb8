"""Queues, budgets, ledgers, presence and recurrence over events and orders as logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, numbers
from ..operators import relational as R
from ..operators import stateful as Q
from . import query, table

NOW = "1996-01-02 00:00:00"


def _tasks(spark, d):
    """Orders as tasks: the priority is the source, and the key says the state."""
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    runs = (F.col("o_orderstatus") == "P") & (at <= NOW)
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("export", "catalog", "results")]), (k % 3 + 1).cast("int"))
    return table(spark, d, "orders").select(
        k.alias("id"), F.col("o_orderpriority").alias("source"), kinds.alias("kind"), F.when(runs, "running").otherwise("queued").alias("status"), at.alias("created"),
        at.alias("available"), ((k % 10 == 0) & ~runs).alias("hold"), (k % 4).cast("int").alias("attempt"), F.lit(3).alias("max_attempts"), F.when(runs, at + F.expr("interval 90 seconds")).alias("lease_until"), F.concat(F.lit("t"), k.cast("string")).alias("token"),
    )


RUNS = f"(o_orderstatus = 'P' AND o_orderdate <= TIMESTAMP '{NOW}')"
TASKS = f"""SELECT o_orderkey AS id, o_orderpriority AS source, ['export','catalog','results'][o_orderkey % 3 + 1] AS kind, CASE WHEN {RUNS} THEN 'running' ELSE 'queued' END AS status, o_orderdate AS created,
o_orderkey % 10 = 0 AND NOT {RUNS} AS hold, o_orderkey % 4 AS attempt, CASE WHEN {RUNS} THEN o_orderdate + INTERVAL 90 SECOND END AS lease_until FROM orders"""


@query("""SELECT user_id, event_type, min_by(event_id, event_id) AS event_id, count(*) AS requests, count(DISTINCT sha256(props)) = 1 AS consistent FROM events GROUP BY 1, 2""")
def q1_enqueue(spark, d):
    """Q1: the first request of each key, and whether all asked for the same."""
    return Q.enqueued(table(spark, d, "events"), "user_id", "event_type", F.col("props"), [F.asc("event_id")]).select("user_id", "event_type", "event_id", "requests", "consistent")


@query(f"""WITH t AS (SELECT *, status = 'running' AND lease_until < TIMESTAMP '{NOW}' AND NOT hold AS expired FROM ({TASKS}))
SELECT id, CASE WHEN expired AND attempt >= 3 THEN 'failed' WHEN expired THEN 'queued' ELSE status END AS status, expired FROM t""")
def q2_lease_recovery(spark, d):
    """Expired leases go back to the queue or fail."""
    return Q.recovered(_tasks(spark, d), F.lit(NOW).cast("timestamp")).select("id", "status", "expired")


@query(f"""WITH t AS (SELECT id, source, kind, created, hold, CASE WHEN status = 'running' AND lease_until < TIMESTAMP '{NOW}' AND NOT hold THEN CASE WHEN attempt >= 3 THEN 'failed' ELSE 'queued' END ELSE status END AS status, attempt FROM ({TASKS})),
p AS (SELECT *, CASE WHEN created <= TIMESTAMP '{NOW}' - INTERVAL 15 MINUTE THEN 0 WHEN kind = 'export' THEN 0 WHEN kind = 'catalog' THEN 2 ELSE 1 END AS priority FROM t WHERE status = 'queued' AND created <= TIMESTAMP '{NOW}' AND NOT hold AND source <> '5-LOW'
AND source NOT IN (SELECT source FROM t WHERE status = 'running'))
SELECT id, source, priority, CAST(attempt + 1 AS INTEGER) AS attempt FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY priority, created, id) AS n FROM p) WHERE n = 1""")
def q2_claim(spark, d):
    """The next task of each free source; blocked ones give none."""
    blocked = table(spark, d, "orders").filter("o_orderpriority = '5-LOW'").select(F.col("o_orderpriority").alias("source")).distinct()
    return Q.claimed(_tasks(spark, d), F.lit(NOW).cast("timestamp"), blocked).select("id", "source", "priority", "attempt")


@query(f"""SELECT id, CASE WHEN NOT holder THEN status WHEN outcome = 'completed' THEN 'completed' WHEN outcome = 'failed' AND attempt >= 3 THEN 'failed' WHEN outcome IN ('failed', 'deferred') THEN 'queued' ELSE status END AS new_status,
CAST(CASE WHEN holder AND outcome = 'deferred' THEN greatest(attempt - 1, 0) ELSE attempt END AS INTEGER) AS new_attempt, CAST(CASE WHEN holder AND outcome = 'failed' AND attempt < 3 THEN least(1800, 30 * pow(2, attempt)) END AS INTEGER) AS retry_seconds, outcome IS NOT NULL AND NOT holder AS refused
FROM (SELECT *, id % 7 <> 0 AND outcome IS NOT NULL AND status = 'running' AND lease_until >= TIMESTAMP '1995-06-01' AS holder FROM (SELECT *, ['completed','failed','deferred','heartbeat'][id // 2 % 4 + 1] AS outcome FROM ({TASKS})))""")
def q3_transitions(spark, d):
    """Q3 Q4: reports change a task only while their lease is live."""
    t = _tasks(spark, d)
    outcome = F.element_at(F.array(*[F.lit(x) for x in ("completed", "failed", "deferred", "heartbeat")]), (F.expr("id div 2") % 4 + 1).cast("int"))
    reports = t.select("id", F.when(F.col("id") % 7 == 0, "stale").otherwise(F.col("token")).alias("token"), outcome.alias("outcome"))
    return Q.transitions(t, reports, F.lit("1995-06-01").cast("timestamp"))


def _with_one_key(spark, d):
    """Events by user, and all of them once more under one key."""
    events = table(spark, d, "events").select("user_id", "event_id", "ts")
    return events.union(events.withColumn("user_id", F.lit(-1).cast("long")))


BOTH = "(SELECT user_id, event_id, ts FROM events UNION ALL SELECT -1, event_id, ts FROM events)"


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, event_id % 7 = 0 AS closes, CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 3 HOUR END AS til, event_id % 10 = 3 AS resumes, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {BOTH}),
g AS (SELECT DISTINCT user_id, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS n, TIMESTAMP '1970-01-01' AS win, 0 AS used, TIMESTAMP '1970-01-01' AS ready, false AS shut, CAST(NULL AS TIMESTAMP) AS til, '' AS decision, CAST(NULL AS TIMESTAMP) AS retry_at FROM e
UNION ALL SELECT user_id, event_id, n, win, CASE WHEN decision = 'allowed' THEN used + 1 ELSE used END, CASE WHEN decision = 'allowed' THEN ts + INTERVAL 20 MINUTE ELSE ready END, CASE decision WHEN 'resumed' THEN false WHEN 'allowed' THEN closes ELSE shut END,
CASE WHEN decision = 'resumed' THEN NULL WHEN decision = 'allowed' THEN CASE WHEN closes THEN next_til END ELSE til END, decision, CASE WHEN decision = 'budget' THEN win + INTERVAL 1 HOUR WHEN decision = 'spacing' THEN ready WHEN decision IN ('blocked', 'refused') THEN til END
FROM (SELECT *, CASE WHEN resumes AND shut AND coalesce(til > ts, false) THEN 'refused' WHEN resumes THEN 'resumed' WHEN shut THEN 'blocked' WHEN used >= 2 THEN 'budget' WHEN ready > ts THEN 'spacing' ELSE 'allowed' END AS decision
FROM (SELECT e.user_id, e.event_id, e.ts, e.n, e.closes, e.til AS next_til, e.resumes, g.ready, g.shut, g.til, greatest(g.win, date_trunc('hour', e.ts)) AS win, CASE WHEN g.win < date_trunc('hour', e.ts) THEN 0 ELSE g.used END AS used FROM g JOIN e ON e.user_id = g.user_id AND e.n = g.n + 1)))
SELECT user_id, event_id, decision, retry_at FROM g WHERE n > 0""")
def q5_request_gate(spark, d):
    """Q5: an hourly budget, a least spacing, and a breaker that a person opens again, not before the time that the source named; only allowed requests count."""
    k = F.col("event_id")
    out = Q.request_gate(_with_one_key(spark, d), "user_id", "ts", "event_id", 2, 1_200_000, k % 7 == 0, F.when(k % 2 == 0, F.col("ts") + F.expr("interval 3 hours")), k % 10 == 3)
    return out.withColumn("retry_at", F.col("retry_at").cast("timestamp_ntz"))


@query("""SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n, count(*) > 3 AS over_budget FROM events GROUP BY 1, 2""")
def q6_client_quota(spark, d):
    """Q6: tumbling quotas of clients."""
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    out = table(spark, d, "events").groupBy(w.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("hour"), "n", (F.col("n") > 3).alias("over_budget"))


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS mom, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {BOTH}),
g AS (SELECT user_id, event_id, n, [mom] AS held, true AS allowed, CAST(0 AS BIGINT) AS retry_after FROM e WHERE n = 1
UNION ALL SELECT user_id, event_id, n, CASE WHEN len(live) < 2 THEN list_append(live, mom) ELSE live END, len(live) < 2, CASE WHEN len(live) < 2 THEN 0 ELSE greatest(1, (live[1] + 7200000000 - mom) // 1000000 + 1) END
FROM (SELECT e.user_id, e.event_id, e.n, e.mom, list_filter(g.held, lambda x: x > e.mom - 7200000000) AS live FROM g JOIN e ON e.user_id = g.user_id AND e.n = g.n + 1))
SELECT user_id, event_id, allowed, retry_after FROM g""")
def q7_sliding_window(spark, d):
    """Q7: a sliding limiter whose refused requests don't count."""
    return Q.sliding_limit(_with_one_key(spark, d), "user_id", "ts", "event_id", 2, 7200.0)


@query("""WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
g AS (SELECT o_custkey, count(*) AS raw, list(o_orderpriority) AS ids FROM orders GROUP BY 1)
SELECT o_custkey, raw, CASE WHEN bad THEN 'blocked' WHEN raw > asked THEN 'blocked' WHEN raw < asked THEN 'completed' WHEN known THEN 'limited' WHEN asked >= 10 THEN 'limited' ELSE 'ready' END AS status,
CASE WHEN bad THEN 'catalog_invalid_candidates' WHEN raw > asked THEN 'catalog_quantity_ignored' WHEN raw < asked THEN 'official_load_more_end' WHEN known THEN 'catalog_not_advancing' WHEN asked >= 10 THEN 'catalog_safety_ceiling' ELSE 'prefix_expansion' END AS reason,
CASE WHEN NOT bad AND raw = asked AND NOT known AND asked < 10 THEN least(10, asked + 3) ELSE asked END AS quantity
FROM (SELECT o_custkey, raw, raw + o_custkey % 3 - CASE WHEN o_custkey % 7 = 0 THEN 2 ELSE 0 END AS asked, o_custkey % 11 = 0 AS bad, len(list_filter(ids, lambda x: x NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))) = 0 AS known FROM g)""")
def q9_prefix_step(spark, d):
    """Q9: what a prefix of a list says about the next one."""
    k = F.col("o_custkey")
    pages = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("raw"), F.collect_set("o_orderpriority").alias("ids"))
    pages = pages.select("o_custkey", "raw", "ids", (F.col("raw") + k % 3 - F.when(k % 7 == 0, 2).otherwise(0)).alias("asked"), (k % 11 == 0).cast("int").alias("bad"), F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM")]).alias("seen"))
    return Q.prefix_step(pages, "asked", "raw", "bad", "ids", "seen", 10, 3).select("o_custkey", "raw", "status", "reason", "quantity")


@query("""WITH p AS (SELECT l_orderkey, l_linenumber // 3 AS page, l_partkey % 4 AS url, 3 + l_orderkey % 2 AS total, l_linenumber // 3 < 2 AS more FROM lineitem),
f AS (SELECT l_orderkey, url, min(page) AS page FROM p GROUP BY 1, 2),
g AS (SELECT l_orderkey, page, count(*) AS raw, max(total) AS total, max(more) AS more, (SELECT count(*) FROM f WHERE f.l_orderkey = p.l_orderkey AND f.page = p.page) AS fresh FROM p GROUP BY 1, 2),
w AS (SELECT l_orderkey, count(*) AS pages, CAST(sum(raw) AS BIGINT) AS raw, CAST(sum(fresh) AS BIGINT) AS distinct_rows, max_by(total, page) AS total, max_by(more, page) AS more, bool_or(fresh = 0) AS repeated FROM g GROUP BY 1)
SELECT l_orderkey, pages, raw, distinct_rows, raw - distinct_rows AS duplicates, CASE WHEN repeated THEN 'not_advancing' WHEN total = distinct_rows AND more THEN 'pagination_conflict' WHEN total <> distinct_rows THEN 'total_mismatch' WHEN NOT more THEN 'end_confirmed' ELSE 'total_reconciled' END AS reason FROM w""")
def q8_page_ledger(spark, d):
    """Q8: what a sequence of pages brought, and how it ended."""
    pages = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber div 3 AS page", "l_partkey % 4 AS url", "3 + l_orderkey % 2 AS total", "l_linenumber div 3 < 2 AS more")
    return Q.ledger(pages, "l_orderkey", "page", "url", "total", "more")


@query("""WITH RECURSIVE f AS (SELECT o_orderkey AS node, 0 AS depth FROM orders WHERE o_orderkey <= 3 UNION SELECT o_orderkey * 2, depth + 1 FROM f JOIN orders ON o_orderkey = node WHERE node > 0) SELECT node, min(depth) AS depth FROM f GROUP BY 1""")
def q10_frontier(spark, d):
    """Q10: all that can be reached from a start, by distinct steps."""
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), (F.col("o_orderkey") * 2).alias("to"))
    start = table(spark, d, "orders").filter("o_orderkey <= 3").select(F.col("o_orderkey").alias("node"))
    return Q.frontier(start, e)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' WHEN o_orderkey % 5 = 0 THEN 'mismatch' ELSE 'replay' END AS effect FROM orders""")
def q11_checkpoint_effect(spark, d):
    """Q11: replayed pages do nothing, changed ones are refused."""
    stored = table(spark, d, "orders").filter("o_orderkey % 3 != 0").select("o_orderkey", F.sha2("o_orderpriority", 256).alias("h"))
    incoming = table(spark, d, "orders").select("o_orderkey", F.sha2(F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise("")), 256).alias("h"))
    return Q.checkpointed(stored, incoming, ["o_orderkey"], "h")


@query("""SELECT o_custkey, count(*) AS groups, bool_and(o_orderstatus <> 'P') AS complete FROM orders GROUP BY 1""")
def q12_publishable(spark, d):
    """Q12: roots all of whose groups are complete."""
    return Q.publishable(table(spark, d, "orders").withColumn("done", F.col("o_orderstatus") != "P"), "o_custkey", "done")


@query("""SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-02-01' - INTERVAL 7 DAY AND event_type <> 'purchase'""")
def q13_expired(spark, d):
    """What has outlived its time and isn't kept."""
    return Q.expired(table(spark, d, "events"), "ts", F.lit("2024-02-01").cast("timestamp_ntz"), "7 days", F.col("event_type") == "purchase").select("event_id")


@query("""SELECT user_id, last_at, CAST(floor((epoch_us(TIMESTAMP '2024-02-01') // 1000 - epoch_us(last_at) // 1000) / 1000) AS BIGINT) AS age_seconds, CASE WHEN kind = 'error' OR floor((epoch_us(TIMESTAMP '2024-02-01') // 1000 - epoch_us(last_at) // 1000) / 1000) > 86400 THEN 'disconnected' ELSE 'connected' END AS state
FROM (SELECT user_id, max(ts) AS last_at, max_by(event_type, ts) AS kind FROM events GROUP BY 1)""")
def q14_presence(spark, d):
    """Q14: who is there."""
    e = table(spark, d, "events").withColumn("kind", F.when(F.col("event_type") == "error", "stopped").otherwise(F.col("event_type")))
    return Q.presence(e, "user_id", "ts", "kind", F.lit("2024-02-01").cast("timestamp"), 86400).select("user_id", "last_at", "age_seconds", "state")


@query("""SELECT o_orderkey, CAST(first + 7 * weeks AS DATE) AS latest, weeks, CAST(first + 7 * weeks + 7 AS DATE) AS next FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS first, CAST(floor(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31') / 7) AS INTEGER) AS weeks FROM orders) WHERE weeks >= 0""")
def q15_weekly(spark, d):
    """Q15: missed weeks as one occurrence."""
    w = dates.weekly_coalesced(F.col("o_orderdate").cast("date"), F.lit("1998-12-31"))
    return table(spark, d, "orders").select("o_orderkey", w.alias("w")).filter("w is not null").select("o_orderkey", "w.latest", F.col("w.coalesced_weeks").alias("weeks"), "w.next")


@query("""SELECT o_custkey, CASE WHEN count(*) FILTER (open AND stage = 0) > 0 THEN 'discovery' WHEN count(*) FILTER (open AND stage = 1) > 0 THEN 'enrichment' WHEN count(*) FILTER (open AND stage = 2) > 0 THEN 'reconciliation'
WHEN count(*) FILTER (failed) > 0 THEN 'completed_with_failures' ELSE 'completed' END AS phase FROM (SELECT o_custkey, o_orderkey % 3 AS stage, o_orderstatus = 'P' AND o_orderkey % 2 = 0 AS open, o_orderpriority = '5-LOW' AND NOT (o_orderstatus = 'P' AND o_orderkey % 2 = 0) AS failed FROM orders) GROUP BY 1""")
def q16_phase(spark, d):
    """The phase of a cycle, rolled up from its tasks."""
    k = F.col("o_orderkey")
    status = F.when((F.col("o_orderstatus") == "P") & (k % 2 == 0), "queued").when(F.col("o_orderpriority") == "5-LOW", "failed").otherwise("completed")
    stage = F.element_at(F.array(*[F.lit(s) for s in Q.STAGES]), (k % 3 + 1).cast("int"))
    return Q.rollup(table(spark, d, "orders").withColumn("status", status), "o_custkey", stage).select("o_custkey", Q.phase().alias("phase"))


@query("""WITH RECURSIVE c AS (SELECT o_custkey AS run, o_orderdate AS "at", o_orderkey % 5 AS command_id, ['pause', 'resume', 'cancel', 'pause'][o_orderkey % 4 + 1] AS action FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY "at", command_id, action) AS n FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY run, command_id ORDER BY n) > 1 AS seen, first(action) OVER (PARTITION BY run, command_id ORDER BY n) AS first_action FROM n),
g AS (SELECT c_custkey AS run, CAST(0 AS BIGINT) AS n, CAST(NULL AS TIMESTAMP) AS "at", CAST(NULL AS BIGINT) AS command_id, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS VARCHAR) AS effect, CASE WHEN c_custkey % 10 = 0 THEN 'completed' ELSE 'ready' END AS state FROM customer
UNION ALL SELECT run, n, "at", command_id, action, effect, CASE WHEN effect <> 'applied' THEN state WHEN action = 'pause' THEN 'paused' WHEN action = 'cancel' THEN 'cancelled' ELSE 'ready' END FROM (
SELECT o.run, o.n, o."at", o.command_id, o.action, g.state, CASE WHEN o.seen AND o.first_action = o.action THEN 'replayed' WHEN o.seen THEN 'key_conflict' WHEN g.state IN ('cancelled', 'completed') THEN 'refused' ELSE 'applied' END AS effect FROM g JOIN o ON o.run = g.run AND o.n = g.n + 1))
SELECT run, "at", command_id, action, effect, state FROM g WHERE n > 0""")
def q17_controls(spark, d):
    """Q17: pause, resume and cancel, with replays of a command told apart from conflicts."""
    k = F.col("o_orderkey")
    action = F.element_at(F.array(*[F.lit(a) for a in ("pause", "resume", "cancel", "pause")]), (k % 4 + 1).cast("int"))
    commands = table(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderdate").alias("at"), (k % 5).alias("command_id"), action.alias("action"))
    runs = table(spark, d, "customer").select(F.col("c_custkey").alias("run"), F.when(F.col("c_custkey") % 10 == 0, "completed").otherwise("ready").alias("state"))
    return Q.controlled(runs, commands).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("""SELECT o_custkey, o_orderkey, begins_after FROM (SELECT o_custkey, o_orderkey, row_number() OVER w AS n, coalesce(sum(o_orderkey % 50) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins_after
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE n <= 6 AND begins_after < 90""")
def q21_run_limits(spark, d):
    """Q21: the tasks that a batch run with a limit of tasks and of seconds works through."""
    tasks = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", (F.col("o_orderkey") % 50).alias("seconds"))
    return Q.run_limited(tasks, "o_custkey", [F.asc("o_orderdate"), F.asc("o_orderkey")], 6, "seconds", 90).select("o_custkey", "o_orderkey", "begins_after")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 OR p_size = 13 THEN 'local_resource_measurement_unavailable' WHEN p_size * 20 < 512 OR p_partkey % 2000 >= 1024 THEN 'local_memory_limit' WHEN p_size * 40 < 1024 THEN 'local_disk_limit' END AS reason FROM part""")
def q22_local_admission(spark, d):
    """Q22: whether a worker's memory and disk allow another task."""
    mb, k = 1 << 20, F.col("p_partkey")
    workers = table(spark, d, "part").select("p_partkey", F.when(k % 9 != 0, F.col("p_size").cast("long") * 20 * mb).alias("memory"), F.when(F.col("p_size") == 13, -1).otherwise(F.col("p_size").cast("long") * 40 * mb).alias("disk"), (k % 2000 * mb).alias("resident"))
    return workers.select("p_partkey", Q.local_admission("memory", "disk", "resident").alias("reason"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN 'unconfigured' WHEN 1000 * 0.5 - s_suppkey - 10 < s_acctbal / 20 THEN 'refused' ELSE 'admitted' END AS admission FROM supplier""")
def q18_capacity(spark, d):
    """Q18: whether growth still fits."""
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").cast("double").alias("used"), F.when(F.col("s_suppkey") % 6 != 0, F.lit(1000.0)).alias("limit"), F.lit(10.0).alias("reserved"), (F.col("s_acctbal") / 20).alias("growth"))
    return Q.admission(s, "used", "limit", "reserved", "growth", 0.5).select("s_suppkey", "admission")


@query("""SELECT user_id, event_id, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type, false) AS stuck FROM events""")
def q19_not_advancing(spark, d):
    """Q19: steps whose checkpoint didn't change."""
    return Q.not_advancing(table(spark, d, "events").withColumn("h", F.sha2("event_type", 256)), "user_id", "event_id", "h").select("user_id", "event_id", "stuck")


@query("""SELECT 'orphan_order' AS rule, count(*) AS rows FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'negative_balance', count(*) FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'zero_quantity', count(*) FROM lineitem WHERE l_quantity <= 0""")
def q20_violations(spark, d):
    """Q20: rules asked before a write."""
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    orphans = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    return Q.violations({"orphan_order": orphans, "negative_balance": customer.filter("c_acctbal < 0"), "zero_quantity": table(spark, d, "lineitem").filter("l_quantity <= 0")})


@query("""SELECT 'identity' AS rule, c_custkey AS id, CASE WHEN c_custkey IN (SELECT s_suppkey * 7 FROM supplier) OR c_name IN (SELECT 'Customer#' || lpad(s_suppkey::VARCHAR, 9, '0') FROM supplier WHERE s_acctbal > 0) THEN 'event_alias_identity_reserved' END AS effect FROM customer
UNION ALL SELECT 'history', o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem JOIN orders a ON a.o_orderkey = l_partkey WHERE l_orderkey = orders.o_orderkey AND a.o_orderstatus = 'O') OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = orders.o_orderkey AND l_returnflag = 'N' AND l_shipdate > TIMESTAMP '1997-06-01') THEN 'checkpoint_in_use' END FROM orders
UNION ALL SELECT 'campaign', event_id, CASE state WHEN 'cancelled' THEN 'campaign_cancelled' WHEN 'pausing' THEN CASE WHEN event_type = 'click' THEN 'catalog_campaign_paused' END END FROM
(SELECT event_id, event_type, min_by(CASE WHEN p_size % 5 = 0 THEN 'cancelled' WHEN p_size % 5 = 1 THEN 'pausing' ELSE 'running' END, p_partkey) AS state FROM events LEFT JOIN part ON (event_type = ['click', 'view', 'error'][p_partkey % 3 + 1] AND user_id = p_partkey AND p_partkey % 2 = 0) OR event_id = p_partkey * 3 GROUP BY 1, 2)""")
def q20_refusals(spark, d):
    """Q20: what the guards do to each row: identities that aliases hold, histories in use, tasks of a cancelled or pausing campaign."""
    c, s, o, p, e = (table(spark, d, n) for n in ("customer", "supplier", "orders", "part", "events"))
    aliases = s.select((F.col("s_suppkey") * 7).alias("alias"), F.when(F.col("s_acctbal") > 0, F.concat(F.lit("Customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))).alias("old_slug"))
    identity = Q.identity_refused(c.select("c_custkey", "c_name"), aliases, "c_custkey", "c_name").select(F.lit("identity").alias("rule"), F.col("c_custkey").alias("id"), F.col("refused").alias("effect"))
    checkpoints = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("root"), F.col("l_partkey").alias("active"), F.when(F.col("l_returnflag") == "N", "ready").otherwise("done").alias("status"), F.col("l_shipdate").alias("expires"))
    tasks = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("completed").alias("status"))
    history = Q.history_refused(tasks.select("id"), checkpoints, tasks, F.lit("1997-06-01").cast("timestamp_ntz")).select(F.lit("history").alias("rule"), "id", F.col("refused").alias("effect"))
    k = F.col("p_partkey")
    kind = F.element_at(F.array(F.lit("click"), F.lit("view"), F.lit("error")), (k % 3 + 1).cast("int"))
    campaigns = p.select(k.alias("campaign"), kind.alias("source"), F.when(k % 2 == 0, k).alias("sync"), (k * 3).alias("run"), F.when(F.col("p_size") % 5 == 0, "cancelled").otherwise("running").alias("status"), (F.col("p_size") % 5 == 1).alias("pausing"))
    own = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("source"), F.col("user_id").alias("sync"), F.col("event_id").alias("run"), F.when(F.col("event_type") == "click", "queued").otherwise("running").alias("status"), F.lit(False).alias("held"))
    campaign = Q.campaign_guarded(own, campaigns).select(F.lit("campaign").alias("rule"), "id", F.coalesce("refused", "hold").alias("effect"))
    return identity.union(history).union(campaign)


@query("""SELECT user_id, CASE WHEN max(ts) >= TIMESTAMP '2024-01-20' THEN count(*) ELSE 0 END AS used_now, greatest(40 - CASE WHEN max(ts) >= TIMESTAMP '2024-01-20' THEN count(*) ELSE 0 END, 0) AS "left" FROM events GROUP BY 1""")
def b23_rate_window(spark, d):
    """A budget as shown; an old window counts as unused."""
    w = table(spark, d, "events").groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("started"), F.count(F.lit(1)).alias("used")).withColumn("limit", F.lit(40))
    return Q.window_view(w, "started", "used", "limit", F.lit("2024-01-20").cast("timestamp")).select("user_id", "used_now", "left")


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'network' WHEN 'click' THEN 'timeout' ELSE 'unexpected' END AS code, event_type IN ('error', 'click') AS retryable, CAST(least(1800, 30 * pow(2, event_id % 8)) AS INTEGER) AS retry_seconds, CAST(least(15000, 1000 * pow(2, least(4, event_id % 8))) AS INTEGER) AS idle_ms FROM events""")
def b24_error_class(spark, d):
    """Errors by code, and delays."""
    codes = spark.createDataFrame([("error", "network", True), ("click", "timeout", True)], "event_type string, code string, retryable boolean")
    rows = table(spark, d, "events").join(codes, "event_type", "left")
    return rows.select("event_id", F.coalesce("code", F.lit("unexpected")).alias("code"), F.coalesce("retryable", F.lit(False)).alias("retryable"), numbers.retry_delay(F.col("event_id") % 8).alias("retry_seconds"), numbers.idle_delay(F.col("event_id") % 8).alias("idle_ms"))


@query("""SELECT DISTINCT o_orderkey, s_suppkey FROM orders JOIN supplier ON o_custkey % 100 = s_suppkey OR (o_orderkey % 1000 = s_suppkey) WHERE o_orderstatus = 'P'""")
def b25_touching_tasks(spark, d):
    """Running tasks that touch given records by any route."""
    tasks = table(spark, d, "orders").filter("o_orderstatus = 'P'")
    return R.by_any_key(tasks, table(spark, d, "supplier"), [F.col("o_custkey") % 100, F.col("o_orderkey") % 1000], [F.col("s_suppkey"), F.col("s_suppkey")], "o_orderkey", "s_suppkey")
