"""Merging into tables, and exports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text
from ..operators import relational as R
from ..sources import sinks as K
from ..sources import workbooks
from . import query, table


def _old_new(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    new = o.filter("o_orderkey % 3 != 0").select((F.col("o_orderkey") + 1).alias("o_orderkey"), F.lower("o_orderstatus").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") + 1).alias("o_totalprice"), "o_orderpriority")
    return o, new


NEW = "SELECT o_orderkey + 1 AS o_orderkey, lower(o_orderstatus) AS o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 END AS o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 3 <> 0"


@query(f"WITH n AS ({NEW}) SELECT o_orderkey, o_orderstatus, o_totalprice FROM n UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n)")
def k1_upsert(spark, d):
    """K1: insert or replace by key."""
    old, new = _old_new(spark, d)
    return K.upserted(old, new, ["o_orderkey"]).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(f"""WITH n AS ({NEW}) SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderstatus = 'F' THEN o.o_orderstatus ELSE coalesce(n.o_orderstatus, o.o_orderstatus) END AS o_orderstatus,
coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice, coalesce(o.o_orderpriority, n.o_orderpriority) AS o_orderpriority FROM orders o FULL JOIN n ON o.o_orderkey = n.o_orderkey""")
def k2_upsert_policy(spark, d):
    """A policy for each column, in one full join."""
    old, new = _old_new(spark, d)
    status = F.when(F.col("t.o_orderstatus") == "F", F.col("t.o_orderstatus")).otherwise(F.coalesce("i.o_orderstatus", "t.o_orderstatus"))
    return K.upserted_by_policy(old, new, ["o_orderkey"], {"o_orderstatus": status, "o_totalprice": "coalesce", "o_orderpriority": "keep"})


@query("""SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'O' AND (o_custkey, o_orderpriority) NOT IN (SELECT (o_custkey, o_orderpriority) FROM orders WHERE o_orderstatus = 'F') GROUP BY 1, 2""")
def k3_insert_ignore(spark, d):
    """K3: rows whose keys aren't there yet, one of each."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus")
    return K.inserted(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), ["o_custkey", "o_orderpriority"], [F.asc("o_orderkey")]).select("o_custkey", "o_orderpriority", "o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 4 <> 0 UNION ALL SELECT l_orderkey, l_linenumber, l_quantity + 1 FROM lineitem WHERE l_orderkey % 4 = 0 AND l_linenumber <= 2""")
def k4_replace_children(spark, d):
    """K4: all children of the parents that come in are replaced."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    whose = items.filter("l_orderkey % 4 = 0")
    return K.replaced_children(items, whose.filter("l_linenumber <= 2").withColumn("l_quantity", F.col("l_quantity") + 1), "l_orderkey", whose)


@query("""SELECT s_suppkey, 1 AS version, '{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || '}' AS snapshot, substr(sha256(s_suppkey || chr(31) || s_name), 1, 32) AS row_id FROM supplier""")
def k6_snapshot(spark, d):
    """K6: records as JSON versions, with deterministic ids."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    rows = K.snapshots(s, "s_suppkey", F.lit(1)).join(K.with_row_ids(s, ["s_suppkey", "s_name"]).select("s_suppkey", "row_id"), "s_suppkey")
    return rows


@query("""SELECT p_partkey AS "Part", CASE WHEN p_partkey % 4 = 0 THEN '''=' || p_name WHEN p_partkey % 4 = 1 THEN ''' +' || p_name ELSE p_name END AS "Name" FROM part""")
def k9_formula_guard(spark, d):
    """K9: labelled export columns, guarded against formulas."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").withColumn("p_name", F.when(k % 4 == 0, F.concat(F.lit("="), "p_name")).when(k % 4 == 1, F.concat(F.lit(" +"), "p_name")).otherwise(F.col("p_name")))
    return K.export_columns(rows, {"p_partkey": "Part", "p_name": "Name"})


@query("""SELECT l_returnflag, l_orderkey, l_linenumber, CAST((row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) - 1) // 500 + 1 AS INTEGER) AS part FROM lineitem""")
def k10_export_parts(spark, d):
    """Numbered parts of a bounded number of rows."""
    return R.parts_by_rows(table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], 500, ["l_returnflag"])


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def k15_retention(spark, d):
    """What is past its time and held by no lease."""
    live = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return K.expired_rows(table(spark, d, "orders"), "o_orderdate", F.lit("1996-01-01").cast("timestamp_ntz"), live, "o_custkey").select("o_orderkey")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 2 = 0 OR c_custkey % 3 > 0 THEN c_name ELSE upper(c_name) END AS name, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 5 = 0 THEN 'new' ELSE c_mktsegment END AS segment FROM customer""")
def b19_record_update(spark, d):
    """A primary source overwrites, others only fill gaps; protected fields stay, and empty values never overwrite."""
    k = F.col("c_custkey")
    now = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.when(k % 5 == 0, "").otherwise(F.col("c_mktsegment")).alias("segment"))
    new = now.select("c_custkey", F.when(k % 2 == 0, "").otherwise(F.upper("name")).alias("name"), F.lit("new").alias("segment"), (k % 3 == 0).alias("is_primary"), F.when(k % 7 == 0, F.array(F.lit("name"))).otherwise(F.array().cast("array<string>")).alias("protected"))
    return K.updated_record(now, new, "c_custkey", ["name", "segment"], "is_primary", "protected")


@query("""SELECT n_name, row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) AS row_in_part, s_suppkey::VARCHAR AS key, CASE WHEN s_suppkey % 3 = 0 THEN chr(39) || '=' || s_name ELSE s_name END AS name, s_acctbal AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def k8_workbooks(spark, d):
    """K8: workbooks by nation, read back: ids as text, guarded text, numbers as numbers."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = s.select("n_name", F.col("s_suppkey").alias("event_id"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("="), "s_name")).otherwise(F.col("s_name")).alias("name"), F.col("s_acctbal").alias("balance"))
    files = workbooks.workbooks(rows, "n_name", ["event_id"], {"event_id": "ID", "name": "Nome", "balance": "Saldo"})

    def back(batches):
        for batch in batches:
            for name, data in zip(batch["n_name"], batch["content"], strict=True):
                cells = workbooks.sheet_rows(data)[1:]
                yield pd.DataFrame({"n_name": [name] * len(cells), "row_in_part": range(1, len(cells) + 1), "key": [c[0] for c in cells], "name": [c[1] for c in cells], "balance": [float(c[2]) for c in cells]})

    return files.mapInPandas(back, "n_name string, row_in_part long, key string, name string, balance double")


@query("""WITH RECURSIVE i AS (SELECT l_orderkey, l_linenumber, l_partkey, length(l_orderkey::VARCHAR || l_linenumber || l_partkey) AS size, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem),
s AS (SELECT k, sum(size) OVER (ORDER BY k) - size AS before, sum(size) OVER (ORDER BY k) AS total FROM i), n AS (SELECT count(*) AS n FROM i),
p AS (SELECT 1::BIGINT AS begin, 1 AS part UNION ALL SELECT nxt, part + 1 FROM (SELECT part, least(begin + 700, coalesce((SELECT min(k) FROM s WHERE total > q.before + 6000), CAST(1e15 AS BIGINT))) AS nxt FROM (SELECT begin, part, before FROM p JOIN s ON k = begin) q), n WHERE nxt <= n.n)
SELECT l_orderkey, l_linenumber, l_partkey, part FROM i ASOF JOIN p ON i.k >= p.begin""")
def k10_selection(spark, d):
    """Parts of an export, all rows of one table, by rows and by bytes of text, refused whole beyond its bound."""
    items = table(spark, d, "lineitem").select(F.lit("all").alias("selection"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return K.selection_parts(items, "selection", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], 700, 6000, 1 << 40).drop("selection", "l_suppkey")


@query("""SELECT 'Customer' AS kind, c_custkey AS id, c_mktsegment AS a_segment, NULL::DOUBLE AS z_price FROM customer UNION ALL SELECT 'Part', p_partkey, NULL, p_retailprice FROM part""")
def k11_union_parts(spark, d):
    """Parts with different columns as one, the known ones first."""
    c = table(spark, d, "customer").select(F.lit("Customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("a_segment"), F.lit(1).alias("row_number"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("z_price"), F.lit("Part").alias("kind"))
    return K.union_parts([c, p], ["kind", "id"], ("row_number",))


@query("""SELECT o_orderkey, CAST((n - 1) // 1000 AS INTEGER) AS sheet, CAST((n - 1) % 1000 AS INTEGER) AS row FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders)""")
def k12_sheets(spark, d):
    """A new sheet behind each full one, numbered without one task that sees all rows."""
    rows = R.chunked(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), [F.asc("o_orderdate"), F.asc("o_orderkey")], 1, "n")
    return rows.select("o_orderkey", F.floor(F.col("n") / 1000).cast("int").alias("sheet"), (F.col("n") % 1000).alias("row"))


@query("""SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","items":' || coalesce((SELECT '[' || string_agg('{"l_linenumber":' || l_linenumber || ',"l_partkey":' || l_partkey || '}', ',' ORDER BY l_linenumber, l_partkey) || ']' FROM lineitem WHERE l_orderkey = o_orderkey), '[]') || '}' AS json
FROM (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100)""")
def k13_nested_json(spark, d):
    """Published records as JSON with their children inside, the newest ones."""
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    out = K.nested_json(o.select("o_orderkey", "o_orderstatus", "o_orderdate"), "o_orderkey", {"items": (table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey"])}, [F.desc("o_orderdate"), F.asc("o_orderkey")], 100)
    return out.withColumn("json", F.regexp_replace("json", r',"o_orderdate":"[^"]*"', ""))


@query("""SELECT c_custkey::VARCHAR AS "ID interno", 'c' || c_custkey AS "ID na fonte", c_name AS "Nome", DATE '2026-08-16' AS "Data", n_name AS "Cidade", 'SC' AS "UF", 'tickets' AS "Fonte", chr(39) || '=x' AS "URL de origem", 'published' AS "Publicação" FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def k14_simple_export(spark, d):
    """The columns of a simple export under their labels; nothing else leaves."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select(F.col("c_custkey").cast("string").alias("internal_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("event_id"), F.col("c_name").alias("name"), F.lit("2026-08-16").cast("date").alias("event_date"), F.col("n_name").alias("city"), F.lit("SC").alias("state"), F.lit("tickets").alias("source"), F.lit("=x").alias("url"), F.lit("published").alias("publication"), "c_acctbal")
    return K.export_columns(rows, workbooks.SIMPLE)


@query("""WITH i AS (SELECT o_custkey, o_orderkey, o_orderstatus, substr(sha256(o_custkey || chr(31) || o_orderkey), 1, 32) AS row_id FROM orders WHERE o_custkey % 3 = 0),
h AS (SELECT o_custkey, sha256(string_agg(x, chr(10) ORDER BY x)) AS content_hash FROM (SELECT o_custkey, sha256(o_orderkey || chr(31) || o_orderstatus) AS x FROM i) GROUP BY 1)
SELECT o_custkey, o_orderkey, o_orderstatus, row_id, content_hash FROM i JOIN h USING (o_custkey) UNION ALL SELECT o_custkey, o_orderkey, lower(o_orderstatus), NULL, NULL FROM orders WHERE o_custkey % 3 > 0""")
def k5_replaced_set(spark, d):
    """K5: whole result sets replaced, with deterministic ids and a content hash."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return K.replaced_set(o.withColumn("o_orderstatus", F.lower("o_orderstatus")), o.filter("o_custkey % 3 = 0"), "o_custkey", ["o_orderkey"], ["o_orderkey", "o_orderstatus"])


@query("""SELECT 'u' || user_id AS actor, event_type AS action, event_id::VARCHAR AS subject, '{"value":' || event_id || '}' AS details, substr(sha256('u' || user_id || chr(31) || event_type || chr(31) || '2026-01-01' || chr(31) || event_id || chr(31) || '{"value":' || event_id || '}'), 1, 32) AS audit_id FROM events""")
def k7_audit(spark, d):
    """K7: audit rows for an append-only log."""
    e = table(spark, d, "events").withColumn("value", F.col("event_id"))
    return K.audit_rows(e, F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("event_type"), F.lit("2026-01-01"), "event_id", ["value"]).drop("at")


@query("""SELECT event_type, user_id, count(*) AS n, max(value) AS top FROM events WHERE contains(event_type, 'c') GROUP BY GROUPING SETS ((event_type), (event_type, user_id))""")
def b10_job_summary(spark, d):
    """Totals and groups in one pass."""
    rows = R.matching(table(spark, d, "events"), contains={"event_type": "c"})
    return rows.groupingSets([[F.col("event_type")], [F.col("event_type"), F.col("user_id")]], "event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))


@query("""SELECT c_custkey, sha256(array_to_string(list_filter([trim(c_name), trim(c_mktsegment)], lambda x: x <> ''), chr(10))) AS content_hash, sha256(c_name) = sha256(CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_name || ' ' END) AS unchanged FROM customer""")
def d10_content_skip(spark, d):
    """Unchanged content is skipped by its hash."""
    return table(spark, d, "customer").select("c_custkey", text.parts_hash("c_name", "c_mktsegment").alias("content_hash"), text.sha256("c_name").eqNullSafe(text.sha256(F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit(" "))))).alias("unchanged"))
