"""Runs, jobs and checkpoints over the tables as records, and the same rows by SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql
from ..operators import batches as B
from ..operators import extract as E
from ..operators import relational as R
from ..operators import resolve as M
from ..sources import sinks as K
from . import dealt, query, table


@query("""SELECT c_custkey FROM (SELECT c_custkey, c_name FROM customer WHERE c_nationkey % 4 < 3 AND (c_nationkey % 3 = 0 OR c_nationkey % 3 = 1) ORDER BY c_name LIMIT 40 OFFSET 10)""")
def b1_import_slice(spark, d):
    """B1: what a run takes on of what was found."""
    n = F.col("c_nationkey")
    found = table(spark, d, "customer").select("c_custkey", "c_name", F.when(n % 4 == 3, "PT").when(n % 4 == 2, F.lit(None)).otherwise("BR").alias("country"), F.when(n % 3 == 0, "SC").when(n % 3 == 2, "SP").alias("state"))
    return B.import_slice(found, [F.asc("c_name")], 10, 40, states=["SC"]).select("c_custkey")


@query("""SELECT o_custkey, count(*) AS discovered, count(*) FILTER (taken) AS processed, count(*) FILTER (taken AND r = 0) AS published, count(*) FILTER (taken AND r = 1) AS unchanged, count(*) FILTER (taken AND r = 2) AS manual_review, count(*) FILTER (taken AND r = 3) AS failed,
CASE WHEN count(*) FILTER (taken) < count(*) THEN 'time_limit_reached' WHEN count(*) FILTER (taken AND r = 3) > 0 THEN 'partial_success' ELSE 'success' END AS status, 5 + count(*) FILTER (taken) AS next_offset FROM (SELECT o_custkey, o_orderkey % 4 AS r, o_orderpriority <> '5-LOW' AS taken FROM orders) GROUP BY 1""")
def b2_run_summary(spark, d):
    """How runs ended, by what became of their records."""
    k = F.col("o_orderkey") % 4
    result = F.element_at(F.array(*[F.lit(x) for x in ("published", "unchanged", "manual_review", "failed")]), (k + 1).cast("int"))
    return B.run_summary(table(spark, d, "orders").select("o_custkey", F.lit(5).alias("offset"), (F.col("o_orderpriority") != "5-LOW").alias("taken"), result.alias("result")), "o_custkey")


STEPPED = """c AS (SELECT o_custkey % 40 AS run, o_orderkey AS id, o_orderdate AS created, CASE o_orderstatus WHEN 'F' THEN 'processed' WHEN 'P' THEN 'failed' ELSE 'pending' END AS status, o_orderkey % 9 AS k, o_totalprice FROM orders),
t AS (SELECT *, status = 'pending' AND row_number() OVER (PARTITION BY run, status ORDER BY created, id) <= 25 AND k <> 7 AS taken, k IN (0, 4, 5) AS bad, CASE WHEN k IN (1, 2, 3) THEN id * 10 END AS event, CASE WHEN k IN (2, 6) THEN id * 10 + 1 END AS prior FROM c),
s AS (SELECT run, id, CASE WHEN NOT taken THEN status WHEN bad THEN 'failed' ELSE 'processed' END AS status, CASE WHEN NOT taken THEN NULL WHEN bad THEN 'review' WHEN k = 6 THEN 'skip' WHEN event IS NULL THEN 'review' WHEN prior IS NOT NULL THEN 'update' WHEN o_totalprice > 150000 THEN 'create' ELSE 'link' END AS action,
CASE WHEN taken AND NOT bad THEN coalesce(event, prior) END AS match, CASE WHEN taken AND bad THEN CASE k WHEN 0 THEN 'source_processing_failed' WHEN 4 THEN 'timeout, gone' ELSE 'validation_failed' END END AS error, taken, k FROM t)"""


def _stepped(spark, d):
    """Orders as candidates of forty runs, of which some were done before, with checks of nearly all."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey") % 9
    state = F.when(F.col("o_orderstatus") == "F", "processed").when(F.col("o_orderstatus") == "P", "failed").otherwise("pending")
    candidates = o.select((F.col("o_custkey") % 40).alias("run"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created"), state.alias("status"))
    texts = lambda *x: F.array(*[F.lit(t) for t in x])
    status = F.when(k.isin(1, 2, 6, 7), "success").when(k == 4, "provider_failed").when(k == 5, "validation_failed").otherwise("manual_review")
    reasons = F.when(k == 4, texts("timeout", "gone")).when(k == 6, texts("unchanged_content")).when(k == 7, texts("source_access_blocked"))
    own = F.col("o_orderkey")
    checks = o.filter(k != 0).select(own.alias("id"), status.alias("status"), reasons.alias("reasons"), F.when(k.isin(1, 2, 3), own * 10).alias("event"), F.when(k.isin(2, 6), own * 10 + 1).alias("prior"), (F.col("o_totalprice") > 150000).alias("own"))
    return B.import_step(candidates, checks)


@query(f"WITH {STEPPED} SELECT run, id, status, action, match, error FROM s")
def b2_import_step(spark, d):
    """B2: the candidates of runs after a step of 25 each."""
    return _stepped(spark, d).select("run", "id", "status", "action", "match", "error")


@query(f"""WITH {STEPPED}, r AS (SELECT run, count(*) FILTER (status = 'pending') AS remaining, count(*) FILTER (status <> 'pending') AS processed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (taken AND k IN (1, 2, 6) AND match IS NOT NULL) AS published, count(*) FILTER (taken AND k IN (3, 8)) AS manual_review, count(*) FILTER (taken AND action = 'skip') AS unchanged FROM s GROUP BY 1)
SELECT *, CASE WHEN remaining > 0 THEN 'ready' WHEN failed > 0 THEN 'partial_success' ELSE 'success' END AS status FROM r""")
def b2_import_runs(spark, d):
    """B2: import runs behind a step."""
    return B.import_runs(_stepped(spark, d))


@query("""SELECT o_orderkey, c.cached, c.cached IS NULL AS needs_model FROM orders LEFT JOIN (SELECT user_id % 100 AS u, event_type AS e, max_by(event_id::VARCHAR, (ts, event_id::VARCHAR)) AS cached FROM events WHERE value > 40 AND event_id % 5 > 0 GROUP BY 1, 2) c ON o_custkey % 100 = c.u AND c.e = CASE WHEN o_orderstatus = 'F' THEN 'click' ELSE 'view' END""")
def b3_model_cache(spark, d):
    """What a model was asked before, by key; only the rest needs it."""
    e = table(spark, d, "events").select((F.col("user_id") % 100).alias("u"), F.col("event_type").alias("e"), F.col("event_id").cast("string").alias("answer"), "ts", F.when(F.col("value") > 40, "success").otherwise("failed").alias("status"), (F.col("event_id") % 5 == 0).alias("dry_run"))
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("u"), F.when(F.col("o_orderstatus") == "F", "click").otherwise("view").alias("e"))
    return B.with_cache(rows, e, ["u", "e"], "answer", "ts").select("o_orderkey", "cached", "needs_model")


@query("""WITH c AS (SELECT user_id % 200 AS u, max_by('{"name": "' || event_type || '"}', (ts, '{"name": "' || event_type || '"}')) AS cached FROM events WHERE value > 40 AND event_id % 5 > 0 GROUP BY 1),
t AS (SELECT *, coalesce(cached, CASE p_partkey % 4 WHEN 0 THEN '{"name": "' || p_brand || '", "city": "' || CASE WHEN p_size > 25 THEN p_type ELSE ' ' END || '"}' WHEN 1 THEN 'sorry, ' || p_name WHEN 2 THEN '{"city": "' || p_type || '"}' END) AS told FROM part LEFT JOIN c ON u = p_partkey % 300),
v AS (SELECT *, told IS NOT NULL AND json_valid(told) AS valid FROM t),
f AS (SELECT *, CASE WHEN cached IS NOT NULL AND valid THEN 'skipped_cached' WHEN valid THEN 'success' WHEN told IS NOT NULL THEN 'validation_failed' ELSE 'provider_failed' END AS job, coalesce(CASE WHEN valid THEN nullif(trim(json_extract_string(told, '$.name')), '') END, p_name) AS name, coalesce(CASE WHEN valid THEN nullif(trim(json_extract_string(told, '$.city')), '') END, CASE WHEN p_size % 2 = 0 THEN 'Garuva' END) AS city FROM v)
SELECT p_partkey, job, name, city, job IN ('validation_failed', 'provider_failed') AS held, array_to_string(list_filter([CASE WHEN name IS DISTINCT FROM p_brand THEN 'name' END, CASE WHEN city IS DISTINCT FROM 'Garuva' THEN 'city' END], lambda x: x IS NOT NULL), ',') AS changed FROM f""")
def b3_extraction(spark, d):
    """A model's answer, an older one of the same content, or the source's own fields, and what that changes in the stored record."""
    k = F.col("p_partkey")
    e = table(spark, d, "events").select((F.col("user_id") % 200).alias("u"), F.to_json(F.struct(F.col("event_type").alias("name"))).alias("answer"), "ts", F.when(F.col("value") > 40, "success").otherwise("failed").alias("status"), (F.col("event_id") % 5 == 0).alias("dry_run"))
    e = e.withColumn("answer", F.replace("answer", F.lit('":"'), F.lit('": "')))
    p = table(spark, d, "part")
    rows = p.select("p_partkey", (k % 300).alias("u"), F.struct(F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, "Garuva").alias("city")).alias("own"), F.struct(F.col("p_brand").alias("name"), F.lit("Garuva").alias("city")).alias("current"))
    told = F.when(k % 4 == 0, F.to_json(F.struct(F.col("p_brand").alias("name"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(" ").alias("city")))).when(k % 4 == 1, F.concat(F.lit("sorry, "), "p_name")).when(k % 4 == 2, F.to_json(F.struct(F.col("p_type").alias("city"))))
    out = B.extracted(rows, e, ["u"], p.select("p_partkey", told.alias("answer")), "p_partkey", ["name", "city"], required=True)
    return out.select("p_partkey", "job", "name", "city", "held", F.array_join("changes.field", ",").alias("changed"))


def _sometimes(text: str, attempt: int) -> str:
    """A model that has no answer for one text of four, and only at the second time for another."""
    n = int(text)
    if n % 4 == 0:
        raise TimeoutError(text)
    return '{"n": %d}' % n if n % 4 != 1 or attempt > 1 else "one moment"


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN '{"n": ' || o_orderkey || '}' END AS answer, CASE WHEN o_orderkey % 4 < 2 THEN 2 ELSE 1 END AS attempts, CASE WHEN o_orderkey % 4 = 0 THEN 'TimeoutError' END AS error FROM orders""")
def b4_isolated_failures(spark, d):
    """A batch in which some rows fail and the others go on, with a second try."""
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("text"))
    return E.model_extraction(rows, "text", "o_orderkey", _sometimes)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'published' ELSE 'pending_review' END AS publication FROM customer""")
def b5_curated(spark, d):
    """A source's records curated without a model: extracted (E16), made canonical (R7), judged."""
    k = F.col("c_custkey")
    record = F.to_json(F.struct(F.col("c_name").alias("title"), F.when(k % 2 == 0, "16/08/2026").alias("date"), F.when(k % 3 == 0, "Garuva, SC, Brasil").alias("address"), F.lit("https://x.example.com/1").alias("uri")))
    rows = dealt(spark, d, "customer").select("c_custkey", record.alias("record"), F.lit("Corrida de rua, 10 km.").alias("body"))
    e = E.source_extraction(rows, "record", "body", ["c_custkey"])
    flat = e.select("c_custkey", *[F.col(f"{c}.value").alias(c) for c in E.FIELD_SURE], F.lit(None).cast("string").alias("claimed_date"), F.lit("none").alias("country_status"), "modality", F.lit("unknown").alias("claimed_modality"), F.lit("https://x.example.com/").alias("url"), F.array().cast("array<string>").alias("warnings"), F.array("name.confidence", "confidence").alias("confidences"))
    c = M.canonical(flat, ["c_custkey"]).withColumn("official_url", F.lit(None).cast("string")).withColumn("has_reference", F.lit(True))
    return M.judged(c).select("c_custkey", "publication")


@query("""SELECT DISTINCT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey OR (o_orderkey % 1000) = c_custkey WHERE c_acctbal > 0 AND c_mktsegment <> 'BUILDING' AND c_nationkey % 2 = 0""")
def b6_up_to_date(spark, d):
    """Rows whose record was curated by this version already, found by any of its keys."""
    done = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.lit("2026-01-01")).alias("curated_at"), F.when(F.col("c_nationkey") % 2 == 0, "7").otherwise("6").alias("curation_version"), F.when(F.col("c_mktsegment") != "BUILDING", "done").alias("curation_status"))
    return B.up_to_date(table(spark, d, "orders"), done, [F.col("o_custkey"), F.col("o_orderkey") % 1000], [F.col("c_custkey"), F.col("c_custkey")], "o_orderkey", "c_custkey", "7")


@query("""WITH p AS (SELECT l_orderkey // 100 AS page, row_number() OVER (PARTITION BY l_orderkey // 100 ORDER BY l_orderkey, l_linenumber, l_partkey) AS position, 'u' || l_partkey AS url, CASE WHEN l_quantity > 10 THEN strftime(l_shipdate, '%Y-%m-%d') END AS day, l_returnflag || l_linestatus AS name FROM lineitem),
l AS (SELECT url, max_by({'d': day, 'n': name}, (page, position)) AS e FROM p WHERE day IS NULL OR (day >= '1994-01-01' AND day <= '1997-12-31') GROUP BY 1)
SELECT url, e.d AS day, e.n AS name, e.d IS NULL AS undated, lower(e.n) AS sort_name FROM l""")
def b7_discovered(spark, d):
    """The events of a catalogue's pages: the last listing of each address in a range of days, which is no sign of an end."""
    w = R.W.partitionBy(F.expr("l_orderkey div 100")).orderBy("l_orderkey", "l_linenumber", "l_partkey")
    p = table(spark, d, "lineitem").select(F.expr("l_orderkey div 100").alias("page"), F.row_number().over(w).alias("position"), F.concat(F.lit("u"), F.col("l_partkey").cast("string")).alias("url"), F.when(F.col("l_quantity") > 10, F.date_format("l_shipdate", "yyyy-MM-dd")).alias("day"), F.concat("l_returnflag", "l_linestatus").alias("name"))
    return B.discovered(p, "url", "day", "name", "1994-01-01", "1997-12-31")


@query("""WITH p AS (SELECT l_orderkey AS c, l_linenumber AS page, CASE WHEN l_orderkey % 13 = 1 AND l_linenumber > 4 THEN NULL WHEN l_orderkey % 13 = 2 AND l_linenumber > 3 THEN 'u1' ELSE 'u' || least(l_linenumber, l_partkey % 9) || '-' || l_linenumber % 5 END AS url,
CASE WHEN l_orderkey % 5 = 0 THEN 3 WHEN l_orderkey % 5 = 1 THEN CASE WHEN l_linenumber < 3 THEN 8 ELSE 9 END WHEN l_orderkey % 5 = 2 THEN 4 END AS total, CASE WHEN l_orderkey % 3 = 0 THEN l_linenumber < 5 WHEN l_orderkey % 3 = 1 THEN true END AS more FROM lineitem WHERE l_linenumber <= 6),
f AS (SELECT c, page, count(*) AS fresh FROM (SELECT c, url, min(page) AS page FROM p WHERE url IS NOT NULL GROUP BY 1, 2) GROUP BY 1, 2), t AS (SELECT c, page, count(*) AS n FROM (SELECT c, total, min(page) AS page FROM p WHERE total IS NOT NULL GROUP BY 1, 2) GROUP BY 1, 2),
e AS (SELECT c, page, count(url) AS listed, max(total) AS total, bool_or(more) AS more FROM p GROUP BY 1, 2),
r AS (SELECT e.*, coalesce(fresh, 0) AS fresh, sum(coalesce(fresh, 0)) OVER w AS observed, sum(coalesce(n, 0)) OVER w AS totals, last_value(total IGNORE NULLS) OVER w AS advertised FROM e LEFT JOIN f USING (c, page) LEFT JOIN t USING (c, page) WINDOW w AS (PARTITION BY c ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT *, CASE WHEN listed > 0 AND fresh = 0 THEN 'stuck' WHEN listed = 0 OR NOT coalesce(more, true) THEN 'end' WHEN totals = 1 AND advertised = observed THEN 'total' WHEN page = 6 THEN 'limit' END AS stop FROM r),
x AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY c ORDER BY stop IS NULL, CASE WHEN stop IS NULL THEN -page ELSE page END) = 1)
SELECT c AS l_orderkey, page AS pages, observed::BIGINT AS observed, advertised, array_to_string(list_filter([CASE WHEN stop = 'stuck' THEN 'catalog_pagination_not_advancing' END, CASE WHEN stop = 'end' THEN CASE WHEN totals > 1 THEN 'catalog_total_changed' WHEN advertised <> observed THEN 'catalog_total_mismatch' WHEN coalesce(more, true) AND advertised IS NULL THEN 'catalog_end_unconfirmed' END END,
CASE WHEN stop = 'end' AND more THEN 'catalog_empty_page_with_more' END, CASE WHEN stop = 'total' AND more THEN 'catalog_pagination_conflict' END, CASE WHEN stop = 'limit' THEN 'catalog_page_limit' END], lambda w: w IS NOT NULL), ',') AS warnings FROM x""")
def b7_discovery_ends(spark, d):
    """Where the reading of each catalogue ends, and the six codes of how."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    tag = F.concat(F.lit("u"), F.least(n.cast("long"), F.col("l_partkey") % 9).cast("string"), F.lit("-"), (n % 5).cast("string"))
    url = F.when((k % 13 == 1) & (n > 4), F.lit(None)).when((k % 13 == 2) & (n > 3), "u1").otherwise(tag)
    total = F.when(k % 5 == 0, 3).when(k % 5 == 1, F.when(n < 3, 8).otherwise(9)).when(k % 5 == 2, 4)
    more = F.when(k % 3 == 0, n < 5).when(k % 3 == 1, F.lit(True))
    pages = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", url.alias("url"), total.alias("total"), more.alias("more"))
    return B.discovery_ends(pages, "l_orderkey", "l_linenumber", "url", "total", "more", 6).withColumn("warnings", F.array_join("warnings", ","))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'x' || s_suppkey WHEN 1 THEN s_suppkey::VARCHAR ELSE '7' END AS external_id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'fetched' END AS name, CASE WHEN s_suppkey % 5 > 0 THEN 'Garuva' END AS city, (s_suppkey % 2 = 1 OR s_suppkey % 5 > 0) AS enriched FROM supplier""")
def b8_enriched(spark, d):
    """Records with fetched metadata in their gaps, and ids out of their addresses."""
    k = F.col("s_suppkey")
    url = F.when(k % 3 == 1, F.concat(F.lit("https://x.example.com/e/"), k.cast("string"), F.lit("/"))).otherwise("https://x.example.com/e?id=7")
    records = table(spark, d, "supplier").select("s_suppkey", url.alias("url"), F.when(k % 3 == 0, F.concat(F.lit("x"), k.cast("string"))).alias("external_id"), F.when(k % 2 == 0, F.col("s_name")).otherwise("").alias("name"), F.lit(None).cast("string").alias("city"))
    fetched = records.select("s_suppkey", F.lit("fetched").alias("name"), F.when(k % 5 > 0, "Garuva").otherwise("").alias("city"))
    return B.enriched(records, fetched, "s_suppkey", ["name", "city"]).drop("url")


@query("""WITH p AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderpriority AS digest, 10 AS n, CASE WHEN o_orderstatus = 'P' THEN 'network' END AS error FROM orders),
m AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, digest ORDER BY page) > 1 AS again, max(page) OVER (PARTITION BY o_custkey) AS last FROM p), b AS (SELECT *, CASE WHEN error IS NOT NULL THEN error WHEN again THEN 'pagination_cycle' END AS bad FROM m),
f AS (SELECT o_custkey, min(page) FILTER (bad IS NOT NULL) AS first_bad, min_by(bad, page) FILTER (bad IS NOT NULL) AS why, max(page) AS last FROM b GROUP BY 1)
SELECT o_custkey, coalesce(first_bad - 1, last) AS pages, CAST(10 * coalesce(first_bad - 1, last) AS BIGINT) AS rows, CASE WHEN why IS NOT NULL THEN CASE WHEN first_bad > 1 THEN 'partial' ELSE 'failed' END WHEN o_custkey % 2 = 0 THEN 'partial' ELSE 'completed' END AS status, coalesce(why, CASE WHEN o_custkey % 2 = 0 THEN 'end_not_reached' END) AS reason FROM f""")
def b9_scraped(spark, d):
    """Groups of result pages up to a cycle or an error; a failed group leaves the others alone."""
    n = F.row_number().over(R.W.partitionBy("o_custkey").orderBy("o_orderkey"))
    pages = table(spark, d, "orders").select("o_custkey", n.alias("page"), F.col("o_orderpriority").alias("digest"), F.lit(10).alias("rows"), (F.col("o_custkey") % 2 == 0).alias("more"), F.when(F.col("o_orderstatus") == "P", "network").alias("error"))
    return B.scraped(pages, "o_custkey", "page", "digest")


@query("""SELECT facet, value, n, filtered FROM (SELECT 'returnflag' AS facet, l_returnflag AS value FROM lineitem WHERE l_quantity > 30 UNION SELECT 'linestatus', l_linestatus FROM lineitem WHERE l_quantity > 30), (SELECT count(*) AS n, count(*) FILTER (l_quantity > 30) AS filtered FROM lineitem)""")
def b11_result_query(spark, d):
    """Facets of filtered results, with how many there are in all and after the filter."""
    items = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"), "l_quantity")
    rows = R.facets(items.filter("l_quantity > 30"), ["returnflag", "linestatus"])
    totals = items.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_quantity") > 30).alias("filtered"))
    return rows.withColumn("__one", F.lit(1)).join(totals.withColumn("__one", F.lit(1)), "__one").drop("__one")


@query("""SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')""")
def b14_resumable(spark, d):
    """What a resumed job takes up again."""
    state = F.when(F.col("o_orderpriority") == "1-URGENT", "completed").when(F.col("o_orderpriority") == "2-HIGH", "skipped").when(F.col("o_orderpriority") == "5-LOW", F.lit(None)).otherwise("failed")
    return B.resumable(table(spark, d, "orders").withColumn("state", state), "state").select("o_orderkey")


@query("""SELECT id FROM (SELECT o_orderkey AS id, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O') q LEFT JOIN (SELECT o_custkey, count(*) AS running FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) r USING (o_custkey) WHERE n <= 3 - coalesce(running, 0)""")
def b16_startable(spark, d):
    """Queued jobs that may start beside those that run."""
    status = F.when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderstatus") == "O", "queued").otherwise("completed")
    return B.startable(table(spark, d, "orders").withColumn("status", status), "o_custkey", "o_orderdate", "o_orderkey", 3).select(F.col("o_orderkey").alias("id"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 'unknown_mode' WHEN event_id % 7 = 0 THEN 'dates_reversed' WHEN event_id % 5 = 1 AND event_id % 2 = 0 THEN 'nothing_selected' WHEN event_id % 5 = 2 AND event_id % 3 > 0 THEN 'exactly_one_url' WHEN event_id % 5 IN (0, 3) AND event_id % 3 = 0 THEN 'all_takes_no_selection'
WHEN event_id % 5 IN (0, 3) AND event_id % 2 = 1 THEN 'all_needs_confirmation' END AS error FROM events""")
def b17_scopes(spark, d):
    """What is wrong with a run's scope."""
    k = F.col("event_id")
    mode = F.element_at(F.array(*[F.lit(m) for m in ("all", "selected", "single", "all", "some")]), (k % 5 + 1).cast("int"))
    rows = table(spark, d, "events").select(
        "event_id", mode.alias("mode"), F.lit("2026-02-01").alias("date_from"), F.when(k % 7 == 0, "2026-01-01").alias("date_to"), F.when((k % 5 == 1) & (k % 2 == 1), F.array(F.lit(" "), F.lit("9"))).alias("event_ids"),
        F.when((k % 5).isin(0, 2, 3) & (k % 3 == 0), F.array(F.lit("https://x.example.com/"))).alias("event_urls"), F.lit("").alias("url"), (k % 2 == 0).alias("confirm_all"),
    )
    return rows.select("event_id", B.scope_error().alias("error"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'result_groups_invalid' WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'result_checkpoint_incompatible' WHEN c_custkey % 2 = 0 AND c_custkey % 5 = 0 THEN 'result_checkpoint_in_use' WHEN c_custkey % 2 = 0 AND c_custkey % 7 = 0 THEN 'result_checkpoint_expired' WHEN c_custkey % 2 = 0 AND c_custkey % 13 = 0 THEN 'result_checkpoint_unavailable' WHEN c_custkey % 2 = 0 THEN 'restored' ELSE 'started' END AS outcome FROM customer""")
def b18_checkpoint_start(spark, d):
    """What a checkpoint that is there, or isn't, means for a task that begins."""
    k = F.col("c_custkey")
    base = [F.lit("r1").alias("record")]
    wanted = table(spark, d, "customer").select("c_custkey", *base, F.lit("https://x.example.com/e").alias("source_url"), F.lit("{}").alias("manifest"), F.when(k % 11 == 0, F.array(F.lit("5K|F"), F.lit("5K|F"))).otherwise(F.array(F.lit("5K|F"), F.lit("5K|M"))).alias("groups"), F.lit("t1").alias("task"))
    stored = table(spark, d, "customer").filter("c_custkey % 2 = 0").select("c_custkey", *base, F.lit("https://x.example.com/e/").alias("source_url"), F.when(k % 3 == 0, "1").otherwise("2").alias("parser"), F.sha2(F.lit("{}"), 256).alias("manifest_hash"), F.when(k % 5 == 0, "t0").otherwise("t1").alias("active_task"), F.when(k % 7 == 0, "2025-01-01").otherwise("2027-01-01").cast("date").alias("expires"), F.when(k % 13 == 0, "published").otherwise("ready").alias("status"))
    return B.checkpoint_start(wanted, stored, "c_custkey", F.lit("2026-01-01").cast("date"), "2")


@query("""WITH r AS (SELECT s_suppkey AS ref, s_suppkey % 20 AS record, CASE WHEN s_suppkey % 3 = 0 THEN 'a' ELSE 'b' END AS source FROM supplier), t AS (SELECT o_orderkey AS task, CASE WHEN o_orderstatus = 'F' THEN 'a' ELSE 'b' END AS source, o_custkey % 60 AS k1, o_orderkey % 400 AS k2 FROM orders WHERE o_orderstatus <> 'P'),
h AS (SELECT DISTINCT t.source, record FROM t JOIN r ON k1 = ref OR k2 = ref), n AS (SELECT record, count(DISTINCT source) > 1 AS several FROM r GROUP BY 1)
SELECT source, count(*) FILTER (record % 3 = 0) AS published, count(*) FILTER (several) AS associated, count(*) FILTER (record % 3 = 1) AS pending_review FROM h JOIN n USING (record) GROUP BY 1""")
def b20_touched_counts(spark, d):
    """What became of the records that a source's tasks touch by any key."""
    s = F.col("s_suppkey")
    refs = table(spark, d, "supplier").select(s.alias("ref"), (s % 20).alias("record"), F.when(s % 3 == 0, "a").otherwise("b").alias("source"))
    tasks = table(spark, d, "orders").filter("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("task"), F.when(F.col("o_orderstatus") == "F", "a").otherwise("b").alias("source"), "o_custkey")
    records = spark.range(20).select(F.col("id").alias("record"), F.when(F.col("id") % 3 == 0, "published").when(F.col("id") % 3 == 1, "pending_review").otherwise("hidden").alias("publication"), F.lit("BR").alias("country"))
    return B.touched_counts(tasks, refs, records, "source", [F.col("o_custkey") % 60, F.col("task") % 400], [F.col("ref"), F.col("ref")], "task", "ref", "record")


@query("""SELECT event_id FROM events WHERE event_id % 4 = 0 AND NOT EXISTS (SELECT 1 FROM events n WHERE n.event_id % 6 = 0 AND n.event_id // 6 = events.event_id)""")
def b26_failed_leaves(spark, d):
    """Failed tasks that nothing has followed, as new tasks with keys of their own."""
    e = table(spark, d, "events")
    k = F.col("event_id")
    tasks = e.select(k.alias("id"), F.when(k % 4 == 0, "failed").otherwise("completed").alias("status"), F.when(k % 6 == 0, F.expr("event_id div 6")).alias("retry_of"), F.col("event_type").alias("kind"), F.col("props").alias("payload"))
    wishes = e.select(k.alias("id"), F.lit("k1").alias("key"))
    return B.retries(tasks, wishes.union(wishes), "admin").select(F.col("retry_of").alias("event_id"))


CODES = ("SC", "SP", "PR", "RS", "RJ")


def _wishes(spark, d):
    """Customers' wishes: some out of bounds, some of a known actor's key, some the same again."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    states = F.when(k % 11 == 0, F.array(F.lit("XX"))).when(k % 11 == 1, F.array(F.lit("SC"), F.lit("SC"))).when(k % 2 == 0, F.array(F.lit("SP"), F.lit("SC"))).otherwise(F.array(F.lit("SC"), F.lit("SP")))
    batch = F.when(k % 13 == 0, 26).otherwise(k % 2 + 5)
    return table(spark, d, "customer").select("c_custkey", F.concat(F.lit("u"), n.cast("string")).alias("actor"), F.concat(F.lit("k"), (k % 7).cast("string")).alias("key"), F.when(k % 17 == 0, " x ").otherwise(F.col("c_mktsegment")).alias("reason"), states.alias("states"), batch.cast("int").alias("batch"), F.lit(250).alias("prefix"))


WISHES = """w AS (SELECT c_custkey, 'u' || c_nationkey AS actor, 'k' || c_custkey % 7 AS key, CASE WHEN c_custkey % 17 = 0 THEN 'x' ELSE c_mktsegment END AS reason, c_custkey % 11 > 1 AND c_custkey % 13 > 0 AND c_custkey % 17 > 0 AS fits, CASE WHEN c_custkey % 11 = 0 THEN 'XX' WHEN c_custkey % 11 = 1 THEN 'SC,SC' ELSE 'SC,SP' END AS states, CASE WHEN c_custkey % 13 = 0 THEN 26 ELSE c_custkey % 2 + 5 END AS batch FROM customer),
h AS (SELECT c_custkey, fits, 'campaign_' || substr(sha256(actor || '|' || key), 1, 32) AS id, sha256(reason || '|' || states || '|' || batch || '|250') AS request_hash FROM w),
s AS (SELECT id, request_hash AS known FROM h WHERE c_custkey IN (SELECT min(c_custkey) FROM w WHERE fits AND length(actor) = 2 GROUP BY actor, key)),
n AS (SELECT min({'o': c_custkey, 'id': h.id, 'hash': h.request_hash}) AS first FROM h LEFT JOIN s USING (id) WHERE fits AND known IS NULL)"""


@query(f"""WITH {WISHES} SELECT c_custkey, h.id, request_hash, CASE WHEN NOT fits THEN 'campaign_request_invalid' WHEN coalesce(known, CASE WHEN h.id = first.id AND c_custkey > first.o THEN first.hash END) = request_hash THEN 'replayed' WHEN known IS NOT NULL OR (h.id = first.id AND c_custkey > first.o) THEN 'idempotency_conflict' WHEN c_custkey = first.o THEN 'started' ELSE 'campaign_active' END AS outcome FROM h LEFT JOIN s USING (id), n""")
def b26_campaign_starts(spark, d):
    """What becomes of each wish to start a campaign, where some campaigns are known and have ended."""
    wishes = _wishes(spark, d)
    none = spark.createDataFrame([], "id string, request_hash string, status string")
    every = B.campaign_starts(wishes, none, "c_custkey", CODES)
    owned = wishes.filter(F.length("actor") == 2).join(every.filter("outcome != 'campaign_request_invalid'"), "c_custkey")
    stored = owned.groupBy("id").agg(F.min_by("request_hash", "c_custkey").alias("request_hash"))
    return B.campaign_starts(wishes, stored.withColumn("status", F.lit("cancelled")), "c_custkey", CODES)


@query("""SELECT o_orderkey AS id, o_orderdate AS created, o_orderstatus <> 'F' AS active, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10 OFFSET 20""")
def b26_campaign_page(spark, d):
    """The third page of campaigns, the newest first."""
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"))
    return B.campaign_page(c, 3).drop("status")


@query("""SELECT event_id AS retry_of, sha256('["retry","admin","' || event_id || '","k' || event_id % 3 || '"]') AS scoped_key FROM events WHERE event_id % 2 = 0""")
def b33_scoped_keys(spark, d):
    """One key for one wish of one person about one task."""
    k = F.col("event_id")
    tasks = table(spark, d, "events").select(k.alias("id"), F.when(k % 2 == 0, "cancelled").otherwise("queued").alias("status"), F.lit(None).cast("long").alias("retry_of"), F.lit("x").alias("kind"), F.lit("{}").alias("payload"))
    return B.retries(tasks, tasks.select("id", F.concat(F.lit("k"), (F.col("id") % 3).cast("string")).alias("key")), "admin").select("retry_of", "scoped_key")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'draft' ELSE 'published' END AS before, CASE WHEN c_custkey % 3 = 0 THEN 'hidden' WHEN c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'draft' ELSE 'published' END ELSE 'published' END AS publication, CASE WHEN c_custkey % 3 > 0 AND c_custkey % 5 = 0 THEN 'requires_country' END AS refused,
(c_custkey % 3 = 0 OR (c_custkey % 5 > 0 AND c_custkey % 2 = 0)) AS changed FROM customer""")
def b32_publication_changes(spark, d):
    """Wishes to change what is public, held against the rules; changes go to the log (K7)."""
    k = F.col("c_custkey")
    records = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.lit("2026-08-16").alias("date"), F.lit("Garuva").alias("city"), F.lit("SC").alias("state"), F.when(k % 5 == 0, "PT").otherwise("BR").alias("country"), F.lit("road").alias("modality"), F.lit(True).alias("has_reference"), F.when(k % 2 == 0, "draft").otherwise("published").alias("publication"))
    wishes = table(spark, d, "customer").select("c_custkey", F.when(k % 3 == 0, "hidden").otherwise("published").alias("wanted"))
    return B.publication_changes(records, wishes, "c_custkey", M.publication_error(("SC",)))


@query("""WITH o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'pending_review' ELSE 'draft' END AS before, CASE WHEN o_totalprice > 250000 THEN 'hidden' WHEN o_orderpriority < '3' THEN 'published' ELSE 'rejected' END AS after, n_name, c_acctbal FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
d AS (SELECT 'u1' AS actor, 'publication_status' AS action, '2026-01-01' AS moment, o_orderkey::VARCHAR AS subject, '{"before":"' || before || '","after":"' || after || '"}' AS details FROM o WHERE after <> 'published' OR c_acctbal >= 0)
SELECT actor, action, moment, subject, details, substr(sha256(actor || chr(31) || action || chr(31) || moment || chr(31) || subject || chr(31) || details), 1, 32) AS audit_id FROM d""")
def b32_publication_audit(spark, d):
    """The audit row of every wish to change what is public that the rules let through."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    state = F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "pending_review").otherwise("draft")
    wanted = F.when(F.col("o_totalprice") > 250000, "hidden").when(F.col("o_orderpriority") < "3", "published").otherwise("rejected")
    records = o.select("o_orderkey", F.col("c_name").alias("name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("n_name").alias("city"), F.lit("SC").alias("state"), F.when(F.col("c_acctbal") < 0, "PT").otherwise("BR").alias("country"), F.lit("road").alias("modality"), F.lit(True).alias("has_reference"), state.alias("publication"))
    changes = B.publication_changes(records, o.select("o_orderkey", wanted.alias("wanted")), "o_orderkey", M.publication_error(("SC",)))
    return K.publication_audit(changes, "o_orderkey", F.lit("u1"), F.lit("2026-01-01")).withColumnRenamed("at", "moment")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'unsafe_url' WHEN p_partkey % 7 = 0 THEN 'too_many_redirects' WHEN p_partkey % 11 = 0 THEN 'body_too_large' END AS error FROM part""")
def s23_fetches(spark, d):
    """Recorded fetches by the rules for addresses, redirects and length."""
    k = F.col("p_partkey")
    one = F.lit("https://x.example.com/")
    hops = F.when(k % 5 == 0, F.array(one, F.lit("http://169.254.169.254/"))).when(k % 7 == 0, F.array_repeat(one, 5)).otherwise(F.array(one, one))
    return table(spark, d, "part").select("p_partkey", B.fetch_error(hops, F.when(k % 11 == 0, (10 << 20) + 1).otherwise(5)).alias("error"))


@query("""SELECT o_orderkey, CASE WHEN o_orderdate <= TIMESTAMP '1996-01-02 00:00:00' - INTERVAL 15 MINUTE THEN 0 WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 3 = 1 THEN 2 ELSE 1 END AS priority, CASE WHEN o_orderkey % 2 = 0 THEN 'c' ELSE o_orderkey::VARCHAR END AS id FROM orders""")
def u4_sql_functions(spark, d):
    """U4: the functions that programs share, in SQL."""
    sql.register(spark)
    kind = F.element_at(F.array(*[F.lit(x) for x in ("export", "catalog", "results")]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = table(spark, d, "orders").select("o_orderkey", kind.alias("kind"), F.col("o_orderdate").cast("timestamp").alias("created"), F.when(F.col("o_orderkey") % 2 == 0, "c").alias("canonical"))
    return rows.select("o_orderkey", F.expr("task_queue_priority(kind, created, timestamp'1996-01-02 00:00:00')").alias("priority"), F.expr("resolve_id(cast(o_orderkey as string), canonical)").alias("id"))
