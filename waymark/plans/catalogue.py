"""Catalogue queries: filters, joins, aggregates, windows, paging, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import parts as P
from ..operators import relational as R
from ..operators.lineage import tasks_over
from . import query, table

#: The date up to which orders count as past.
TODAY = "1997-01-01"


def _listing(spark, d):
    orders, customer, nation = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    base = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return R.matching(base, equal={"o_orderstatus": "O"}, contains={"c_name": "customer"}, between={"o_orderdate": ("1996-01-01", "1998-12-31")}, any_of={"n_name": None})


LISTING = """orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderstatus = 'O' AND contains(lower(c_name), 'customer') AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1998-12-31'"""


@query(f"""WITH page AS (SELECT o_orderkey, o_orderdate, o_totalprice, c_name, n_name FROM {LISTING} ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 20)
SELECT page.*, string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS items
FROM page JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def listing_page(spark, d):
    """A filtered, ordered page, with each row's children nested."""
    page = R.page(_listing(spark, d).select("o_orderkey", "o_orderdate", "o_totalprice", "c_name", "n_name"), [F.col("o_orderdate"), F.col("o_orderkey")], number=2)
    items = table(spark, d, "lineitem").join(F.broadcast(page.select(F.col("o_orderkey").alias("l_orderkey"))), "l_orderkey", "left_semi")
    nested = R.with_children(page, items, "o_orderkey", "l_orderkey", "items", ["l_linenumber", "l_returnflag"])
    return nested.withColumn("items", F.array_join(F.transform("items", lambda i: F.concat_ws(":", i["l_linenumber"].cast("string"), i["l_returnflag"])), ",")).filter("items != ''")


@query(f"SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS INTEGER) AS pages FROM {LISTING}")
def listing_total(spark, d):
    """Rows and pages of the listing."""
    return R.page_total(_listing(spark, d))


@query("""SELECT o_orderkey FROM orders WHERE o_orderpriority IS NULL OR o_orderpriority = '' OR o_orderstatus NOT IN ('O', 'F')
OR o_orderpriority = '4-NOT SPECIFIED' OR o_orderpriority LIKE '5-%'""")
def p3_incomplete(spark, d):
    """Rows with anything missing, unknown or not allowed."""
    bad = R.incomplete(["o_orderpriority"], {"o_orderstatus": ["O", "F"]}, {"o_orderpriority": "4-NOT SPECIFIED"}, {"o_orderpriority": "5-"})
    return table(spark, d, "orders").filter(bad).select("o_orderkey")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#1', 'Brand#2', 'Brand#3')")
def p4_source_list(spark, d):
    """A comma list of sources, unknown ones ignored."""
    parts = table(spark, d, "part")
    known = ["brand#11", "brand#12", "brand#1", "brand#2", "brand#3"]
    wanted = R.allowed_sources("Brand#11, brand#12,Brand#1,BRAND#2,brand#3,other", known)
    return parts.filter(F.lower("p_brand").isin(*wanted)).select("p_partkey", "p_brand")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31'
AND (o_custkey IN (1, 2, 3, 5, 8, 13) OR o_orderpriority IN ('1-URGENT'))""")
def p6_scope(spark, d):
    """A date range and any of several keys."""
    return R.in_scope(table(spark, d, "orders"), "o_orderdate", "1995-01-01", "1996-12-31", {"o_custkey": [1, 2, 3, 5, 8, 13], "o_orderpriority": ["1-URGENT"]}).select("o_orderkey", "o_custkey")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 IN (0, 3) AS wanted FROM events
WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50 AND event_type IN ('click', 'purchase', 'view')""")
def p9_json_filter(spark, d):
    """Filters on values inside JSON."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = table(spark, d, "events").filter((k >= 50) & F.col("event_type").isin("click", "purchase", "view"))
    return rows.select("event_id", k.alias("k"), (k % 5).isin(0, 3).alias("wanted"))


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_name), '00') OR contains(lower(c_mktsegment), 'auto')")
def p10_text_mask(spark, d):
    """P10: a literal search over several columns."""
    own = R.any_contains(["c_name"], "00") | R.any_contains(["c_mktsegment"], "AUTO")
    return table(spark, d, "customer").filter(own).select("c_custkey")


@query("""SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') IS NOT DISTINCT FROM nullif(CASE WHEN o_orderstatus = 'F' THEN '5-LOW' ELSE o_orderpriority END, '5-LOW') AS same FROM orders""")
def p11_null_safe(spark, d):
    """Equality where null equals null."""
    a = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    b = F.nullif(F.when(F.col("o_orderstatus") == "F", "5-LOW").otherwise(F.col("o_orderpriority")), F.lit("5-LOW"))
    return table(spark, d, "orders").select("o_orderkey", a.eqNullSafe(b).alias("same"))


@query("""SELECT l_orderkey, count(*) FILTER (l_quantity > 0 AND l_quantity <= 30 AND l_discount >= 0.05) AS kept,
coalesce(min(l_extendedprice) FILTER (l_quantity > 0 AND l_quantity <= 30 AND l_discount >= 0.05), -1) AS lowest FROM lineitem GROUP BY l_orderkey""")
def p12_child_policy(spark, d):
    """A policy on nested children by lambda, and their lowest price."""
    nested = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity", "l_discount", "l_extendedprice")).alias("items"))
    kept = F.filter("items", lambda i: (i["l_quantity"] > 0) & (i["l_quantity"] <= 30) & (i["l_discount"] >= 0.05))
    return nested.select("l_orderkey", F.size(kept).cast("long").alias("kept"), F.coalesce(F.array_min(F.transform(kept, lambda i: i["l_extendedprice"])), F.lit(-1.0)).alias("lowest"))


@query("""SELECT c_custkey, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS label,
CASE WHEN c_acctbal < 0 THEN 'overdrawn' WHEN c_acctbal > 9000 THEN 'prime' ELSE 'regular' END AS badge,
c_name || ' / ' || n_name AS location_label FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def p14_display(spark, d):
    """A display view: labels and badges by precedence."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    badge = F.when(F.col("c_acctbal") < 0, "overdrawn").when(F.col("c_acctbal") > 9000, "prime").otherwise("regular")
    return rows.select("c_custkey", F.initcap("c_mktsegment").alias("label"), badge.alias("badge"), F.concat_ws(" / ", "c_name", "n_name").alias("location_label"))


@query("SELECT event_id FROM events WHERE regexp_matches(props, '^\\{\"k\": ?[0-9]{1,2}\\}$') AND value > 0")
def p16_receipts(spark, d):
    """Only rows whose JSON has the expected form."""
    return table(spark, d, "events").filter(F.col("props").rlike(r'^\{"k": ?[0-9]{1,2}\}$') & (F.col("value") > 0)).select("event_id")


@query("SELECT event_id, ts FROM events WHERE user_id = 7")
def p17_owner(spark, d):
    """A user's own rows."""
    return R.owned_by(table(spark, d, "events"), "user_id", 7).select("event_id", "ts")


@query("""SELECT n_name, count(*) AS items, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def j1_join_chain(spark, d):
    """Detail to header to owner, grouped; filters and columns reach the scans."""
    items, orders, customers, nations = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    per_order = items.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    rows = per_order.join(orders, per_order.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.sum("n").alias("items"), F.round(F.sum("r"), 2).alias("revenue"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def j4_some(spark, d):
    """Parents with some child that satisfies a condition."""
    return R.having_some(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey", "o_totalprice > 200000").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j5_none(spark, d):
    """Parents without a child."""
    return R.having_none(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey").select("c_custkey")


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')
AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def j6_both(spark, d):
    """In both sources."""
    orders = table(spark, d, "orders")
    once = R.having_some(table(spark, d, "customer"), orders, "c_custkey", "o_custkey", "o_orderstatus = 'O'")
    return R.having_some(once, orders, "c_custkey", "o_custkey", "o_orderstatus = 'F'").select("c_custkey")


@query("SELECT n_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def j7_zero_counts(spark, d):
    """Counts that include zero."""
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_name", F.coalesce("n", F.lit(0)).cast("long").alias("suppliers"))


@query("""SELECT DISTINCT s_suppkey, c_custkey FROM supplier JOIN customer ON (s_nationkey * 100000 + floor(s_acctbal / 500) = c_nationkey * 100000 + floor(c_acctbal / 500))
OR round(s_acctbal / 10) = round(c_acctbal / 10) OR substr(s_name, -4) = substr(c_name, -4)""")
def j8_any_key(spark, d):
    """An OR join over three keys, as one equi-join."""
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    both = lambda p: F.struct(F.col(f"{p}_nationkey"), F.floor(F.col(f"{p}_acctbal") / 500)).cast("string")
    left = [both("s"), F.round(F.col("s_acctbal") / 10).cast("long"), F.expr("right(s_name, 4)")]
    right = [both("c"), F.round(F.col("c_acctbal") / 10).cast("long"), F.expr("right(c_name, 4)")]
    return R.by_any_key(s, c, left, right, "s_suppkey", "c_custkey")


ALIASES = "SELECT c_custkey AS alias, c_custkey - c_custkey % 10 AS canonical FROM customer WHERE c_custkey % 10 IN (1, 2) AND c_custkey > 10"


@query(f"SELECT coalesce(canonical, o_custkey) AS o_custkey, count(*) AS orders FROM orders LEFT JOIN ({ALIASES}) ON o_custkey = alias GROUP BY 1")
def j11_alias(spark, d):
    """Ids replaced by what they're aliases of."""
    aliases = table(spark, d, "customer").filter("c_custkey % 10 IN (1, 2) AND c_custkey > 10").select(F.col("c_custkey").alias("alias"), (F.col("c_custkey") - F.col("c_custkey") % 10).alias("canonical"))
    return R.resolve_alias(table(spark, d, "orders"), aliases, "o_custkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))


@query("SELECT o_orderkey FROM orders WHERE (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_orderkey = o_orderkey) > 3")
def j13_distinct_sources(spark, d):
    """A correlated distinct count, aggregated before the join."""
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("n")).filter("n > 3")
    return table(spark, d, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def j15_latest_child(spark, d):
    """The latest child of each parent."""
    return R.latest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("""SELECT c_mktsegment, n_regionkey, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS nations FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def j16_exploded(spark, d):
    """Rows regrouped as distinct lists."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("c_mktsegment", "n_regionkey").agg(F.array_join(F.sort_array(F.collect_set("n_name")), ",").alias("nations"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def a2_status_counts(spark, d):
    """A2: counts by one key, by way of the map of counts."""
    m = R.counts_map(table(spark, d, "orders"), "o_orderstatus")
    return m.select(F.explode("counts").alias("status", "n"))


@query("SELECT event_type, hour(ts) AS h, count(*) AS n FROM events GROUP BY ALL")
def a3_multi_key_counts(spark, d):
    """Counts by several keys."""
    return table(spark, d, "events").groupBy("event_type", F.hour("ts").cast("long").alias("h")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (value > 50) AS high, count(*) AS total, min(ts) AS first_ts, max(ts) AS last_ts,
CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS views FROM events GROUP BY user_id""")
def a4_filtered_counts(spark, d):
    """A4 A5: conditional counts, bounds and sums in one pass."""
    is_ = lambda t: F.col("event_type") == t
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(is_("click")).alias("clicks"), F.count_if(F.col("value") > 50).alias("high"), F.count(F.lit(1)).alias("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum(F.when(is_("view"), 1).otherwise(0)).alias("views"))


@query("""WITH t AS (SELECT count(*) AS total, count(*) FILTER (c_acctbal > 0) AS positive, count(*) FILTER (c_mktsegment = 'BUILDING') AS building,
count(*) FILTER (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS with_orders FROM customer)
SELECT flag, n, total, round(100.0 * n / total, 1) AS percent FROM (
SELECT 'positive' AS flag, positive AS n, total FROM t UNION ALL SELECT 'building', building, total FROM t UNION ALL SELECT 'with_orders', with_orders, total FROM t)""")
def a8_catalogue_summary(spark, d):
    """Counts and coverage of several flags in one aggregation after one semi-join flag."""
    buyers = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("buys", F.lit(True))
    rows = table(spark, d, "customer").join(buyers, "c_custkey", "left")
    return R.covered(rows, {"positive": F.col("c_acctbal") > 0, "building": F.col("c_mktsegment") == "BUILDING", "with_orders": F.coalesce("buys", F.lit(False))})


@query("""SELECT o_orderkey, expected, actual, CASE WHEN expected <> actual THEN 'expected ' || expected || ' got ' || actual END AS warning FROM (
SELECT coalesce(o_orderkey, l_orderkey) AS o_orderkey, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual
FROM (SELECT o_orderkey, 1 + o_orderkey % 7 AS expected FROM orders) FULL JOIN (SELECT l_orderkey, count(*) AS actual FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)""")
def a10_expected_vs_actual(spark, d):
    """A10: expected counts against actual ones, with a message where they differ."""
    expected = table(spark, d, "orders").select("o_orderkey", (1 + F.col("o_orderkey") % 7).alias("expected"))
    actual = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("actual"))
    return R.reconciled(expected, actual, "o_orderkey")


@query("""SELECT c_mktsegment, CAST(coalesce(sum(CASE WHEN c_acctbal > 0 THEN length(c_name) END), 0) AS BIGINT) AS name_bytes,
count(*) FILTER (NOT regexp_matches(c_name, '[13579]$')) AS unparsable FROM customer GROUP BY 1""")
def a12_conditional_sums(spark, d):
    """Sums of conditional sizes with a default, and counts of what doesn't parse."""
    size = F.coalesce(F.sum(F.when(F.col("c_acctbal") > 0, F.octet_length("c_name"))), F.lit(0)).cast("long")
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(size.alias("name_bytes"), F.count_if(~F.col("c_name").rlike("[13579]$")).alias("unparsable"))


@query("""SELECT o_orderkey, round(least(avg(l_discount * 10) FILTER (l_discount > 0), 0.95), 4) AS confidence FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
HAVING count(*) FILTER (l_discount > 0) > 0""")
def a15_confidence(spark, d):
    """The average of an array's positive values, capped, by a higher-order function."""
    nested = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.col("l_discount") * 10).alias("c"))
    own = F.filter("c", lambda x: x > 0)
    mean = F.aggregate(own, F.lit(0.0), lambda a, x: a + x) / F.size(own)
    return nested.filter(F.size(own) > 0).select("o_orderkey", F.round(F.least(mean, F.lit(0.95)), 4).alias("confidence"))


SUMMED = " || ".join(f"',' || sum(CAST('0x' || substr(h, {k}, 4) AS INTEGER))" for k in range(1, 65, 4))


@query(f"""WITH r AS (SELECT l_orderkey, sha256(l_linenumber || '|' || l_partkey || '|' || l_returnflag) AS h FROM lineitem)
SELECT l_orderkey, sha256(count(*) || {SUMMED}) AS content_hash FROM r GROUP BY 1 UNION ALL SELECT -1, sha256(count(*) || {SUMMED}) FROM r""")
def a17_content_hash(spark, d):
    """A hash of each group, and of all rows as one, that doesn't depend on row order."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    text = F.concat_ws("|", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), "l_returnflag")
    return R.content_hash(rows, ["l_orderkey"], text).union(R.content_hash(rows.withColumn("l_orderkey", F.lit(-1).cast("long")), ["l_orderkey"], text))


@query("""SELECT n_name, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers, coalesce(s.balance, 0) AS balance FROM nation
LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey
LEFT JOIN (SELECT s_nationkey, count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey""")
def a18_rollup(spark, d):
    """Two aggregates joined."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))
    rows = table(spark, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return rows.select("n_name", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("customers", "suppliers")], F.coalesce("balance", F.lit(0.0)).alias("balance"))


@query("""SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, coalesce(user_id, -1) ORDER BY value DESC, ts DESC, event_id) AS n FROM events) WHERE n = 1""")
def w1_distinct_on(spark, d):
    """The first row of a composite key in a three-level order."""
    return R.latest(table(spark, d, "events"), ["event_type", F.coalesce("user_id", F.lit(-1))], [F.desc("value"), F.desc("ts"), F.asc("event_id")]).select("event_type", "user_id", "event_id")


@query("SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events s WHERE s.event_id % 3 = 0 AND s.event_id // 3 = e.event_id)")
def w3_leaves(spark, d):
    """Rows that no other names as its parent."""
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.expr("event_id div 3")).alias("parent"))
    return R.leaves(e, "event_id", "parent").select("event_id")


@query("""SELECT s_nationkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_acctbal > 5000 THEN 100 WHEN s_acctbal > 0 THEN 50 ELSE 10 END DESC, s_suppkey) AS n FROM supplier) WHERE n = 1""")
def w4_primary(spark, d):
    """The first of a group by priority."""
    p = F.when(F.col("s_acctbal") > 5000, 100).when(F.col("s_acctbal") > 0, 50).otherwise(10)
    return R.latest(table(spark, d, "supplier"), ["s_nationkey"], [p.desc(), F.asc("s_suppkey")]).select("s_nationkey", "s_suppkey")


@query("""WITH RECURSIVE i AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem),
p AS (SELECT l_orderkey, l_linenumber, l_partkey, size, k, 1 AS part, 1 AS n, size AS total FROM i WHERE k = 1
UNION ALL SELECT i.l_orderkey, i.l_linenumber, i.l_partkey, i.size, i.k, CASE WHEN p.n + 1 > 3 OR p.total + i.size > 100 THEN p.part + 1 ELSE p.part END, CASE WHEN p.n + 1 > 3 OR p.total + i.size > 100 THEN 1 ELSE p.n + 1 END, CASE WHEN p.n + 1 > 3 OR p.total + i.size > 100 THEN i.size ELSE p.total + i.size END FROM p JOIN i ON i.l_orderkey = p.l_orderkey AND i.k = p.k + 1)
SELECT l_orderkey, l_linenumber, l_partkey, size, part FROM p""")
def w5_byte_parts(spark, d):
    """Parts of at most 3 rows or 100 units, begun anew at each limit."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("size"))
    return P.accumulated_parts(items, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "size", 3, 100).drop("l_suppkey")


PAGES = "SELECT l_orderkey, l_linenumber * 10 - CASE WHEN l_linenumber % 4 = 0 THEN 3 ELSE 10 END AS off, CAST(10 AS INTEGER) AS rows_, l_returnflag || CAST(l_quantity AS BIGINT) % 3 AS digest FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2)"


@query(f"""SELECT l_orderkey, off, rows_, CASE WHEN seen > 1 THEN 'repeated' WHEN off > expected THEN 'gap' WHEN off < expected THEN 'overlap' ELSE 'ok' END AS state FROM (
SELECT *, coalesce(lag(off + rows_) OVER (PARTITION BY l_orderkey ORDER BY off), 0) AS expected, row_number() OVER (PARTITION BY l_orderkey, digest ORDER BY off) AS seen FROM ({PAGES}))""")
def w6_page_gaps(spark, d):
    """Gaps, overlaps and repetitions among pages."""
    pages = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_quantity").alias("l_quantity")).selectExpr("l_orderkey", "l_linenumber * 10 - CASE WHEN l_linenumber % 4 = 0 THEN 3 ELSE 10 END AS off", "10 AS rows_", "concat(l_returnflag, cast(l_quantity as bigint) % 3) AS digest")
    return R.gaps(pages, "l_orderkey", "off", "rows_", "digest")


@query("""SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY nullif(l_tax, 0) ASC NULLS LAST, lower(l_returnflag), CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END, l_linenumber) AS INTEGER) AS place FROM lineitem""")
def t5_result_order(spark, d):
    """T4 T5: an order by several expressions, nulls last, as a place."""
    from pyspark.sql import Window

    order = [F.asc_nulls_last(F.nullif(F.col("l_tax"), F.lit(0.0))), F.lower("l_returnflag"), F.when(F.col("l_linestatus") == "F", 0).otherwise(1), F.col("l_linenumber")]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).alias("place"))


@query("SELECT event_id, ts FROM events WHERE (ts > TIMESTAMP '2024-01-05' OR (ts = TIMESTAMP '2024-01-05' AND event_id > 100)) AND ts <= TIMESTAMP '2024-02-01' ORDER BY ts, event_id LIMIT 50")
def t7_keyset_page(spark, d):
    """The next page behind a place, none newer than the snapshot."""
    from datetime import datetime

    return R.after(table(spark, d, "events"), "ts", "event_id", datetime(2024, 1, 5), 100, 50, datetime(2024, 2, 1)).select("event_id", "ts")


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_acctbal DESC NULLS LAST, s_suppkey LIMIT 15")
def t3_allowed_sort(spark, d):
    """Sorted by an allowed column, ties by key, bounded."""
    return R.sorted_by(table(spark, d, "supplier"), "s_acctbal", ["s_acctbal", "s_name"], "s_suppkey", True).limit(15).select("s_suppkey", "s_name")


@query("SELECT p_partkey FROM part WHERE p_size > 45")
def t10_limit_guard(spark, d):
    """A result that is refused beyond a limit."""
    return R.refused_beyond(table(spark, d, "part").filter("p_size > 45").select("p_partkey"), 1_000_000)


@query("""SELECT DISTINCT 'p_brand' AS facet, p_brand AS value FROM part UNION SELECT DISTINCT 'p_type', p_type FROM part WHERE p_type <> '' UNION SELECT DISTINCT 'p_size', CAST(p_size AS VARCHAR) FROM part""")
def t11_facets(spark, d):
    """Distinct values of several columns in one pass."""
    return R.facets(table(spark, d, "part"), ["p_brand", "p_type", "p_size"])


@query("""SELECT l_orderkey, l_linenumber, copies FROM (SELECT l_orderkey, l_linenumber, row_number() OVER w AS n, count(*) OVER (PARTITION BY l_orderkey, k, lower(l_returnflag)) AS copies
FROM (SELECT *, CASE WHEN l_partkey % 3 <> 0 THEN 'bib:' || l_partkey % 3 ELSE 'pos:' || l_linenumber % 2 END AS k FROM lineitem)
WINDOW w AS (PARTITION BY l_orderkey, k, lower(l_returnflag) ORDER BY l_linenumber)) WHERE n = 1""")
def d1_dedupe_results(spark, d):
    """One row per bib, else per position, with how many there were."""
    items = table(spark, d, "lineitem")
    bib = F.when(F.col("l_partkey") % 3 != 0, (F.col("l_partkey") % 3).cast("string"))
    key = R.result_key([F.col("l_orderkey")], bib, F.col("l_linenumber") % 2, F.col("l_returnflag"))
    return R.deduplicated(items, key, [F.asc("l_linenumber")]).select("l_orderkey", "l_linenumber", "copies")


@query("""SELECT l_orderkey, string_agg(l_linenumber, ',' ORDER BY l_linenumber) AS kept FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, round(l_tax, 2) ORDER BY l_linenumber) AS n FROM lineitem) WHERE n = 1 GROUP BY 1""")
def d5_dedupe_array(spark, d):
    """The first of each key inside an array."""
    nested = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_tax"))).alias("items"))
    kept = R.first_by(F.col("items"), lambda i: F.round(i["l_tax"], 2))
    return nested.select("l_orderkey", F.array_join(F.transform(kept, lambda i: i["l_linenumber"].cast("string")), ",").alias("kept"))


@query("""WITH lots AS (SELECT l_orderkey, l_returnflag AS name, round(l_discount, 2) AS value, 'BRL' AS currency, CASE WHEN l_tax > 0.04 THEN '2026-01-01' END AS begins, CASE WHEN l_linestatus = 'F' THEN '2026-02-01' END AS ends, l_quantity > 45 AS cur, l_linenumber AS pos, l_quantity, l_partkey FROM lineitem),
one AS (SELECT l_orderkey, name, value, currency, begins, ends, bool_or(cur) AS cur, min((pos, l_partkey, l_quantity)) AS pos FROM lots GROUP BY l_orderkey, name, value, currency, begins, ends)
SELECT l_orderkey, name, value, currency, begins, ends, CASE WHEN bool_or(cur) OVER (PARTITION BY l_orderkey) THEN cur ELSE row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) = 1 END AS current FROM one""")
def d6_lot_merge(spark, d):
    """Lots of several lists merged by their five parts, with one current at least."""
    cents = F.col("l_discount") * 100  # the product is rounded, not the decimal digits, as in SQL: 0.285 gives 0.28
    value = F.when(F.abs(cents) < float("inf"), F.round(cents) / 100).otherwise(F.col("l_discount"))
    lot = F.struct(F.col("l_returnflag").alias("name"), value.alias("value"), F.lit("BRL").alias("currency"), F.when(F.col("l_tax") > 0.04, "2026-01-01").alias("begins"), F.when(F.col("l_linestatus") == "F", "2026-02-01").alias("ends"), (F.col("l_quantity") > 45).alias("current"))
    place = [c for k in ("l_linenumber", "l_partkey", "l_quantity") for c in (F.col(k).isNull().alias(f"no_{k}"), F.col(k))]  # nulls last
    items = table(spark, d, "lineitem")
    nested = items.repartition(tasks_over(items), "l_orderkey").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(*place, lot.alias("lot")))), lambda x: x["lot"]).alias("lots"))
    rest = F.greatest(F.size("lots") - 4, F.lit(0))
    split = nested.select("l_orderkey", F.slice("lots", 1, 2).alias("a"), F.slice("lots", 3, 2).alias("b"), F.slice("lots", F.lit(5), rest).alias("c"))
    return R.merged_lots(split, "l_orderkey", ["a", "b", "c"], ["name", "value", "currency", "begins", "ends"])


@query("""SELECT o_custkey, o_orderpriority FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first_ FROM orders GROUP BY 1, 2) WHERE first_ % 3 > 0""")
def d7_page_minus_seen(spark, d):
    """What a page has that wasn't seen before."""
    o = table(spark, d, "orders")
    first = o.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("first_"))
    seen = first.filter("first_ % 3 = 0").select("o_custkey", "o_orderpriority")
    return R.minus_seen(o.select("o_custkey", "o_orderpriority"), seen, ["o_custkey", "o_orderpriority"])


@query("SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier WHERE s_acctbal < 0")
def d8_union_sources(spark, d):
    """Candidates of several sources as one set."""
    c = table(spark, d, "customer").filter("c_acctbal < 0").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = table(spark, d, "supplier").filter("s_acctbal < 0").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return c.unionByName(s)


@query("""SELECT n_name, 2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians(lat - 10) / 2), 2) + cos(radians(10)) * cos(radians(lat)) * pow(sin(radians(lng - 20) / 2), 2)))) < 9000 AS near,
CAST(round(2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians(lat - 10) / 2), 2) + cos(radians(10)) * cos(radians(lat)) * pow(sin(radians(lng - 20) / 2), 2)))) * 1000) AS BIGINT) AS metres
FROM (SELECT n_name, n_nationkey * 6.0 - 70 AS lat, n_nationkey * 13.0 - 160 AS lng FROM nation)""")
def x36_nearby(spark, d):
    """Distance on the globe and a radius."""
    n = table(spark, d, "nation").select("n_name", (F.col("n_nationkey") * 6.0 - 70).alias("lat"), (F.col("n_nationkey") * 13.0 - 160).alias("lng"))
    km = numbers.haversine_km(F.lit(10.0), F.lit(20.0), "lat", "lng")
    return n.select("n_name", (km < 9000).alias("near"), F.round(km * 1000).cast("long").alias("metres"))


@query("""SELECT l_orderkey, c_name, n FROM (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_shipdate > TIMESTAMP '1997-06-01' GROUP BY 1) JOIN orders ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'""")
def p15_results(spark, d):
    """Result rows of chosen parents."""
    items = table(spark, d, "lineitem").filter("l_shipdate > '1997-06-01'").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    own = table(spark, d, "orders").join(table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"))
    return items.join(own, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "c_name", "n")




@query("""SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 AND c_acctbal > 0 AND c_mktsegment <> 'BUILDING'""")
def p2_admin_filter(spark, d):
    """Records with a warning in a JSON array, that are published, of any segment but one."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").withColumn("warnings", F.when(k % 3 == 0, '["low_confidence", "missing_date"]').when(k % 3 == 1, '["missing_city"]').otherwise("null")).withColumn("publication", F.when(F.col("c_acctbal") > 0, "published").otherwise("hidden"))
    return R.admin_filter(rows, warnings="warnings", has=["missing_date", "no_prices_found"], equal={"publication": "published", "c_mktsegment": None}, without={"c_mktsegment": ["BUILDING"]}).select("c_custkey")


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND (contains(lower(o_orderpriority), 'high') OR contains(lower(o_orderstatus), 'high') OR contains(o_orderkey::VARCHAR, 'high')) AND o_orderstatus = 'O'""")
def p5_dynamic_filter(spark, d):
    """P5: a range, a text in any of three columns, and an equality; what isn't asked for doesn't count."""
    rows = R.matching(table(spark, d, "orders"), equal={"o_orderstatus": "O", "o_custkey": None}, between={"o_orderdate": ("1995-01-01", None)}, text="HIGH", columns=["o_orderpriority", "o_orderstatus", "o_orderkey"])
    return rows.select("o_orderkey")


@query("""SELECT event_id FROM events WHERE event_type IN ('error') AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AND user_id % 2 = 1""")
def p7_job_filter(spark, d):
    """Jobs by status, provider and time."""
    jobs = table(spark, d, "events").withColumn("provider", F.when(F.col("user_id") % 2 == 1, "mock").otherwise("other"))
    return R.matching(jobs, equal={"event_type": "error", "provider": "mock"}, between={"ts": ("2024-01-10", None)}).filter("ts < '2024-01-20'").select("event_id")


@query("""SELECT mode, id FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY moment DESC, id) AS n FROM (
SELECT 'published' AS mode, o_orderkey AS id, o_orderdate AS moment FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'failed', o_orderkey, o_orderdate FROM orders WHERE o_orderpriority = '5-LOW' UNION ALL SELECT 'any', o_orderkey, o_orderdate FROM orders)) WHERE n <= CASE mode WHEN 'published' THEN 100 WHEN 'failed' THEN 1 ELSE 7 END""")
def p8_curation_selector(spark, d):
    """Records to curate by mode, newest first, 1 to 100 of them."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.when(F.col("o_orderstatus") == "F", "published").otherwise("draft").alias("publication"), F.when(F.col("o_orderpriority") == "5-LOW", "failed").otherwise("curated").alias("curation"))
    out = None
    for mode, only, limit in (("published", "published", 5000), ("failed", "failed", -3), ("any", None, 7)):
        own = R.for_curation(rows, only, limit, "at", "id").select(F.lit(mode).alias("mode"), "id")
        out = own if out is None else out.unionByName(own)
    return out


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE (event_id % 1000) * 7 END AS duration_ms, event_type AS status, CASE WHEN value > 50 THEN round(value, 1) END AS top, json_extract_string(props, '$.k') AS k FROM events""")
def p13_job_projection(spark, d):
    """A job as it's listed: its status, how long it took, and picked fields of its JSON."""
    begin = F.col("ts").cast("timestamp")
    jobs = table(spark, d, "events").select("event_id", "event_type", "value", "props", begin.alias("started"), F.when(F.col("event_type") != "error", F.timestamp_millis(F.unix_millis(begin) + F.col("event_id") % 1000 * 7)).alias("finished"))
    return R.job_list(jobs, "started", "finished", {"event_type": "status"}, "props", {"k": "$.k"}).select("event_id", "duration_ms", "status", F.when(F.col("value") > 50, F.round("value", 1)).alias("top"), "k")


@query("""SELECT o_orderkey, CASE WHEN s_suppkey IS NOT NULL THEN s_suppkey ELSE canonical END AS id FROM (SELECT o_orderkey, 'Supplier#' || o_orderkey % 40 AS slug, CASE WHEN o_orderkey % 40 >= 10 AND o_orderkey % 40 < 20 THEN o_orderkey % 40 - 10 END AS canonical FROM orders) LEFT JOIN (SELECT s_suppkey, 'Supplier#' || s_suppkey AS slug FROM supplier) USING (slug)""")
def j12_slug_lookup(spark, d):
    """A slug's record, else that of the alias it once was."""
    wanted = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("Supplier#"), (F.col("o_orderkey") % 40).cast("string")).alias("slug"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Supplier#"), F.col("s_suppkey").cast("string")).alias("slug"))
    aliases = spark.range(10, 20).select(F.concat(F.lit("Supplier#"), F.col("id").cast("string")).alias("alias"), (F.col("id") - 10).alias("canonical"))
    return R.by_slug(wanted, s, aliases, "slug", "id").select("o_orderkey", "id")


@query("""SELECT c_custkey, coalesce(status, 'none') AS status FROM customer LEFT JOIN (SELECT o_custkey, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def j14_side_lookup(spark, d):
    """A status looked up in another table, by its latest row."""
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))
    return R.looked_up(table(spark, d, "customer").select("c_custkey"), last, "c_custkey", {"status": "none"})


@query("""SELECT l_orderkey, count(*) AS groups, count(*) FILTER (done) AS complete, CAST(sum(rows) AS BIGINT) AS rows, CAST(coalesce(sum(expected), 0) AS BIGINT) AS expected, round(100.0 * coalesce(sum(rows) FILTER (done), 0) / sum(rows), 1) AS percent FROM (
SELECT l_orderkey, l_returnflag, count(*) AS rows, bool_and(l_linestatus = 'F') AS done, CASE WHEN l_returnflag <> 'N' THEN count(*) + 1 END AS expected FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def a16_progress(spark, d):
    """What the groups of a root have brought, of how many, and how far."""
    groups = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("rows"), F.bool_and(F.col("l_linestatus") == "F").alias("done")).withColumn("expected", F.when(F.col("l_returnflag") != "N", F.col("rows") + 1))
    return R.progress(groups, "l_orderkey", "rows", "expected", "done")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST((row_number() OVER (ORDER BY l_returnflag, l_linestatus, nullif(l_tax, 0) NULLS LAST, l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1) // 1000 AS INTEGER) AS chunk FROM lineitem""")
def t6_export_order(spark, d):
    """Rows in an order of seven keys, in chunks; places come from the counts of ranges, not from one task."""
    order = [F.asc("l_returnflag"), F.asc("l_linestatus"), F.asc_nulls_last(F.nullif(F.col("l_tax"), F.lit(0.0))), F.asc("l_shipdate"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    return R.chunked(table(spark, d, "lineitem"), order, 1000, "chunk").select("l_orderkey", "l_linenumber", "l_partkey", "chunk")


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END AS moment FROM orders WHERE o_orderstatus = 'P') ORDER BY coalesce(moment, TIMESTAMP '9999-12-31'), o_orderkey LIMIT 40""")
def t8_candidates(spark, d):
    """Candidates by date, those without one last, bounded."""
    rows = table(spark, d, "orders").filter("o_orderstatus = 'P'").select("o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderdate")).alias("at"))
    return R.by_date(rows, "at", "o_orderkey", 40).select("o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, sha256(length(a) || ':' || a || '|' || length(b) || ':' || b || '|' || length(c) || ':' || c || '|0:|' || length(e) || ':' || e || '|' || length(f) || ':' || f) AS record_key FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey::VARCHAR AS a, l_linenumber::VARCHAR AS b, l_partkey::VARCHAR AS c, l_returnflag AS e, l_linestatus AS f FROM lineitem)""")
def d2_record_key(spark, d):
    """A record's key, a hash of six fields; no two lists of fields have the same text."""
    key = R.record_key(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.lit(None), F.col("l_returnflag"), F.col("l_linestatus"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", key.alias("record_key"))
