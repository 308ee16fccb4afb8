"""Entity resolution and data quality over suppliers, customers and parts as records of several sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import relational as R
from ..operators import resolve as M
from ..operators import similar as S
from . import query, table


def _records(spark, d, name, prefix, source):
    """A table's rows as records: those of a nation share places, those of a day may be one."""
    t = table(spark, d, name).join(table(spark, d, "nation"), F.col(f"{prefix}_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey" if prefix == "s" else "c_custkey")
    text_of = lambda base, n: F.concat(F.lit(base), n.cast("string"))
    where = lambda city: F.struct(day.alias("date"), city.alias("city"), F.lit("sc").alias("state"), F.lit("BR").alias("country"))
    day = F.concat(F.lit("2026-08-"), F.lpad((key % 9 + 10).cast("string"), 2, "0"))
    own, other = where(F.upper("n_name")), where(F.lit("Elsewhere"))
    observed = F.when(key % 4 == 0, F.array().cast("array<struct<date:string,city:string,state:string,country:string>>")).when(key % 4 == 1, F.array(other)).when(key % 4 == 2, F.array(own, other)).otherwise(F.array(own))
    return t.select(
        key.alias("id"), F.lit(source).alias("source") if prefix == "c" else F.when(key % 2 == 0, "tickets").otherwise(source).alias("source"), (key % 40).cast("string").alias("external_id"),
        F.when(key % 3 != 0, F.array(text_of("https://x.example.com/", key % 55))).otherwise(F.array().cast("array<string>")).alias("links"), F.array(text_of("https://org.example.com/", key % 35)).alias("urls"),
        day.alias("date"), F.col("n_name").alias("city"), F.lit("SC").alias("state"), F.lit("BR").alias("country"),
        F.concat(F.lit("Corrida de "), F.col("n_name"), F.lit(" "), (key % 4).cast("string")).alias("name"), F.when(key % 10 == 0, "rejected").when(key % 10 == 1, "hidden").otherwise("published").alias("status"), observed.alias("observed"),
    ).withColumn("fingerprint", text.fingerprint("name", "date", "city", "state", "country"))


def _sql(t, prefix, key, source):
    of = f"'{source}'" if prefix == "c" else f"CASE WHEN {key} % 2 = 0 THEN 'tickets' ELSE '{source}' END"
    return f"""SELECT {key} AS id, {of} AS source, {key} % 40 AS ext, CASE WHEN {key} % 3 <> 0 THEN {key} % 55 END AS link, {key} % 35 AS url, {key} % 9 AS day,
n_name AS city, 'Corrida de ' || n_name || ' ' || {key} % 4 AS name, {key} % 10 AS st, {key} % 4 AS obs FROM {t} JOIN nation ON {prefix}_nationkey = n_nationkey"""


WORDS = "list_distinct(list_filter(string_split(lower({0}.name), ' '), lambda x: x NOT IN ('de', '')))"
SIM = f"round(len(list_intersect({WORDS.format('a')}, {WORDS.format('b')})) / len(list_distinct({WORDS.format('a')} || {WORDS.format('b')})), 4)"
WHY = """CASE WHEN a.source = b.source AND a.ext <> b.ext THEN 'source_identity_conflict' WHEN b.st IN (0, 1) THEN 'restricted' WHEN a.city <> b.city THEN 'location_conflict' WHEN b.obs IN (0, 1) THEN 'observation_unconfirmed' WHEN b.obs = 2 THEN 'location_conflict' END"""


@query(f"""WITH a AS ({_sql('customer', 'c', 'c_custkey', 'tickets')}), b AS ({_sql('supplier', 's', 's_suppkey', 'results')}),
hits AS (SELECT a.id, b.id AS match, 1 AS rank, 1.0::DOUBLE AS score, true AS automatic, 'same_source' AS reason FROM a JOIN b ON a.source = b.source AND a.ext = b.ext
UNION ALL SELECT id, match, 2, 1.0, n = 1 AND why IS NULL, CASE WHEN n > 1 THEN 'link_ambiguous' ELSE coalesce(why, 'link_confirmed') END FROM (SELECT a.id, b.id AS match, count(*) OVER (PARTITION BY a.id) AS n, {WHY} AS why FROM a JOIN b ON a.link = b.link AND a.day = b.day)
UNION ALL SELECT a.id, b.id, 3, 1.0, false, 'link_unconfirmed' FROM a JOIN b ON a.url = b.url AND a.day = b.day WHERE b.st <> 0
UNION ALL SELECT a.id, b.id, 4, 1.0, false, 'fingerprint_review' FROM a JOIN b ON a.name = b.name AND a.day = b.day AND a.city = b.city WHERE b.st <> 0
UNION ALL SELECT a.id, b.id, 5, {SIM}, false, 'similar_review' FROM a JOIN b ON a.day = b.day AND a.city = b.city WHERE b.st <> 0 AND {SIM} >= 0.8),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, score DESC, match) AS n FROM hits) WHERE n = 1)
SELECT id, match, rank, score, automatic, reason FROM best UNION ALL SELECT id, NULL, 9, 0.0, false, 'none' FROM a WHERE id NOT IN (SELECT id FROM best)""")
def r1_match_cascade(spark, d):
    """The first kind of match that a record has, with ambiguity seen before the choice; a link is automatic only if nothing speaks against it."""
    return M.match_cascade(_records(spark, d, "customer", "c", "tickets"), _records(spark, d, "supplier", "s", "results"))


@query("""SELECT id, match, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, match) AS n FROM (
SELECT a.p_partkey AS id, b.p_partkey AS match, round(len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t)), 4) AS score FROM w a JOIN w b ON a.p_size = b.p_size AND a.p_partkey <> b.p_partkey) WHERE score >= 0.3) WHERE n = 1""".replace("FROM w a JOIN w b", "FROM (SELECT p_partkey, p_size, list_distinct(string_split(lower(p_name), ' ')) AS t FROM part) a JOIN (SELECT p_partkey, p_size, list_distinct(string_split(lower(p_name), ' ')) AS t FROM part) b"))
def w2_best_match(spark, d):
    """The most similar record of each block, from a least similarity on."""
    p = table(spark, d, "part").select("p_partkey", text.name_words("p_name").alias("words"), "p_size")
    return S.best_similar(p.withColumnRenamed("p_partkey", "id"), p.withColumnRenamed("p_partkey", "match"), "id", "match", "words", ["p_size"], 0.3, same=True)


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 = 0 AND l_quantity <= 25 THEN 'source_identity_conflict' WHEN l_linestatus = 'F' THEN 'restricted' WHEN l_discount > 0.08 THEN 'date_mismatch' WHEN l_returnflag = 'R' THEN 'location_conflict' WHEN l_tax > 0.06 THEN 'link_unconfirmed'
WHEN l_partkey % 3 = 0 THEN 'observation_unconfirmed' WHEN l_partkey % 3 = 1 THEN 'date_mismatch' END AS reason FROM lineitem""")
def r4_cross_source(spark, d):
    """Why a record of one source isn't taken for one of another by itself."""
    of = lambda source, id_, status, day, city: F.struct(source.alias("source"), id_.alias("external_id"), status.alias("status"), day.alias("date"), city.alias("city"), F.lit("SC").alias("state"), F.lit("BR").alias("country"))
    a = of(F.lit("tickets"), F.lit("1"), F.lit("published"), F.lit("2026-08-16"), F.lit("São José"))
    b = of(F.when(F.col("l_linenumber") % 5 == 0, "tickets").otherwise("results"), F.when(F.col("l_quantity") > 25, "1").otherwise("2"), F.when(F.col("l_linestatus") == "F", "hidden").otherwise("published"), F.when(F.col("l_discount") > 0.08, "2026-08-17").otherwise("2026-08-16"), F.when(F.col("l_returnflag") == "R", "Garuva").otherwise("sao  jose"))
    see = lambda day: F.struct(day.alias("date"), b["city"].alias("city"), F.lit("SC").alias("state"), F.lit("BR").alias("country"))
    k = F.col("l_partkey") % 3
    observed = F.when(k == 0, F.array(see(F.lit("2020-01-01")))).when(k == 1, F.array(see(b["date"]), see(F.lit("2020-01-01")))).otherwise(F.array(see(b["date"])))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", M.cross_source_reason(a, b, F.col("l_tax") <= 0.06, observed).alias("reason"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'date_unconfirmed' WHEN o_orderkey % 7 = 0 THEN 'date_mismatch' WHEN o_orderkey % 5 = 0 THEN 'location_unconfirmed' WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'location_conflict' END AS reason FROM orders""")
def r3_identity_reason(spark, d):
    """Why metadata can't enrich a record; fields that a person set aren't compared."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    of = lambda when, city: F.struct(when.alias("date"), city.alias("city"), F.lit("SC").alias("state"), F.lit(None).cast("string").alias("country"))
    seen = of(F.when(k % 11 != 0, F.when(k % 7 == 0, F.date_add(day, 1)).otherwise(day)), F.when(k % 3 == 0, "Joinville").otherwise("GARUVA"))
    status = F.when(k % 5 == 0, "unrecognized").otherwise("confirmed")
    protected = F.when(k % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("city")))
    return table(spark, d, "orders").select("o_orderkey", M.identity_reason(of(day, F.lit("Garuva")), seen, status, protected).alias("reason"))


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'BR' WHEN 1 THEN 'BR' WHEN 5 THEN 'PT' END AS country, ['confirmed', 'confirmed', 'conflicting', 'unrecognized', 'none', 'confirmed'][c_custkey % 6 + 1] AS status FROM customer""")
def r6_country_evidence(spark, d):
    """The country that a source's own fields and a location's end agree on."""
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("c_custkey") % 6 + 1).cast("int"))
    e = M.country_evidence([pick("Brasil", "", "Brasil", "Atlantis", "", "pt"), pick("BR", "", "", "", "", "Portugal")], pick("Garuva, SC", "Garuva, SC, Brasil", "Porto, Portugal", "Garuva", "Lisboa", "Porto, Portugal."))
    return table(spark, d, "customer").select("c_custkey", e["country"].alias("country"), e["status"].alias("status"))


@query(r"""SELECT c_custkey, replace(trim(regexp_replace(lower(c_name || ' ' || coalesce(n_name, '') || ' ' || day), '[^a-z0-9]+', ' ', 'g')), ' ', '-') AS slug, replace(trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')), ' ', '-') || '|' || day || '|' || regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g') || '|sc|' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'br' END AS fingerprint,
array_to_string(list_filter(['kept', CASE WHEN c_custkey % 2 = 0 THEN 'date_evidence_mismatch' END, CASE WHEN c_custkey % 5 = 0 THEN 'modality_unconfirmed' END, CASE WHEN c_custkey % 7 = 0 THEN 'modality_evidence_mismatch' END, CASE WHEN c_custkey % 3 = 0 THEN 'country_unconfirmed' END], lambda x: x IS NOT NULL), ',') AS warnings,
CAST(round(greatest(0, least(0.95, CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE 0.9 + 0.02 * (c_custkey % 4) END) - 0.1), 4) AS DOUBLE) AS confidence FROM (SELECT c_custkey, c_name, n_name, '2026-08-' || lpad(CAST(c_custkey % 20 + 1 AS VARCHAR), 2, '0') AS day FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def r7_canonical(spark, d):
    """An extraction in canonical form: slug, fingerprint, warnings from what was observed, a capped confidence."""
    k = F.col("c_custkey")
    day = F.concat(F.lpad((k % 20 + 1).cast("string"), 2, "0"), F.lit("/08/2026"))
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("c_name").alias("name"), day.alias("date"), F.when(k % 2 == 0, "2026-01-01").otherwise(day).alias("claimed_date"), F.col("n_name").alias("city"), F.lit("SC").alias("state"), F.when(k % 3 == 0, F.lit(None)).otherwise("BR").alias("country"), F.lit("none").alias("country_status"),
        F.when(k % 5 == 0, "unknown").otherwise("road").alias("modality"), F.when(k % 7 == 0, "trail").otherwise("unknown").alias("claimed_modality"), F.lit("/r").alias("registration_url"), F.lit("https://x.example.com/e").alias("url"),
        F.array(F.lit("kept"), F.lit("missing_city")).alias("warnings"), F.when(k % 4 == 0, F.array(F.lit(0.0))).otherwise(F.array(F.lit(0.0), 0.9 + 0.02 * (k % 4))).alias("confidences"),
    )
    return M.canonical(rows, ["c_custkey"]).select("c_custkey", "slug", "fingerprint", F.array_join("warnings", ",").alias("warnings"), "confidence")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN a IS NULL THEN 'date_unconfirmed' WHEN a <> b THEN 'date_mismatch' WHEN c1 <> c2 THEN 'location_conflict' WHEN c1 IS NULL OR c2 IS NULL THEN 'location_unconfirmed' END AS evidence FROM (
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 6 <> 0 THEN CAST(l_shipdate AS DATE) END AS a, CASE WHEN l_quantity > 40 THEN CAST(l_shipdate AS DATE) + 1 ELSE CAST(l_shipdate AS DATE) END AS b,
lower(nullif(l_returnflag, 'R')) AS c1, lower(CASE WHEN l_quantity < 10 THEN 'N' ELSE l_returnflag END) AS c2 FROM lineitem)""")
def r2_location_evidence(spark, d):
    """R2: what date and place say about two records."""
    day = F.col("l_shipdate").cast("date")
    left = F.struct(F.when(F.col("l_linenumber") % 6 != 0, day).alias("date"), F.nullif(F.col("l_returnflag"), F.lit("R")).alias("city"), F.lit("SC").alias("state"), F.lit("BR").alias("country"))
    right = F.struct(F.when(F.col("l_quantity") > 40, F.date_add(day, 1)).otherwise(day).alias("date"), F.when(F.col("l_quantity") < 10, "n").otherwise(F.lower("l_returnflag")).alias("city"), F.lit("sc").alias("state"), F.lit("Br").alias("country"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", left.alias("a"), right.alias("b")).select("l_orderkey", "l_linenumber", M.location_evidence("a", "b").alias("evidence"))


QUALITY = """SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 7 = 0 THEN '2026-02-30' ELSE '2026-03-01' END AS date, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'PT' ELSE 'BR' END AS country,
CASE c_custkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'kids' ELSE 'road' END AS modality, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'Garuva' END AS city, c_acctbal FROM customer"""


def _quality(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        "c_custkey", F.when(k % 11 == 0, "").otherwise(F.col("c_name")).alias("name"), F.when(k % 7 == 0, "2026-02-30").otherwise("2026-03-01").alias("date"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "PT").otherwise("BR").alias("country"), F.when(k % 4 == 0, "unknown").when(k % 4 == 1, "kids").otherwise("road").alias("modality"),
        F.when(k % 3 != 0, "Garuva").alias("city"), F.lit("SC").alias("state"), F.when(F.col("c_acctbal") > 0, "https://x.example.com").alias("registration_url"), F.lit(None).cast("string").alias("official_url"),
        (k % 13 != 0).alias("has_reference"), F.when(F.col("c_acctbal") > 3000, 0.9).otherwise(0.7).alias("confidence"), F.when(k % 17 == 0, F.array(F.lit("suspicious_city"))).otherwise(F.array(F.lit("minor"))).alias("warnings"),
    )


@query(f"""SELECT c_custkey, array_to_string(list_filter([CASE WHEN name = '' THEN 'missing_name' END, CASE WHEN date = '2026-02-30' THEN 'missing_date' END,
CASE WHEN country IS NULL THEN 'country_unconfirmed' WHEN country <> 'BR' THEN 'foreign' END, CASE modality WHEN 'unknown' THEN 'modality_unconfirmed' WHEN 'kids' THEN 'modality_requires_review' END,
CASE WHEN city IS NULL THEN 'missing_location' END, CASE WHEN c_acctbal <= 0 THEN 'missing_registration_or_official_url' END, CASE WHEN c_custkey % 13 = 0 THEN 'invalid_source_reference' END,
CASE WHEN c_acctbal <= 3000 THEN 'low_confidence' END, CASE WHEN c_custkey % 17 = 0 THEN 'critical_warning' END], lambda x: x IS NOT NULL), ',') AS reasons FROM ({QUALITY})""")
def r8_quality_reasons(spark, d):
    """All reasons not to publish."""
    return M.judged(_quality(spark, d)).select("c_custkey", F.array_join("reasons", ",").alias("reasons"))


@query(f"""SELECT c_custkey, CASE WHEN name = '' THEN 'requires_name' WHEN date = '2026-02-30' OR city IS NULL THEN 'requires_date_city_state' WHEN country IS DISTINCT FROM 'BR' THEN 'requires_country'
WHEN modality = 'unknown' THEN 'requires_modality' WHEN c_custkey % 13 = 0 THEN 'requires_reference' END AS error FROM ({QUALITY})""")
def r9_publication_error(spark, d):
    """The first structural rule that is broken."""
    return _quality(spark, d).select("c_custkey", M.publication_error(("SC",)).alias("error"))


@query("""WITH r AS (SELECT c_nationkey AS nation, nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END, '') AS name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS balance, c_acctbal AS confidence,
row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE c_mktsegment WHEN 'BUILDING' THEN 100 WHEN 'MACHINERY' THEN 80 WHEN 'FURNITURE' THEN 50 ELSE 10 END DESC, c_custkey) AS n FROM customer)
SELECT nation, min_by(name, n) FILTER (name IS NOT NULL) AS name, min_by(balance, n) FILTER (balance IS NOT NULL) AS balance, max(confidence) AS confidence FROM r GROUP BY nation""")
def r10_survivorship(spark, d):
    """One record of many by source priority, field by field."""
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("balance"), F.col("c_acctbal").alias("confidence"), "c_mktsegment", "c_custkey")
    order = [M.priority("c_mktsegment", {"BUILDING": 100, "MACHINERY": 80, "FURNITURE": 50, "AUTOMOBILE": 10, "HOUSEHOLD": 10}).desc(), F.asc("c_custkey")]
    return M.survivors(rows, "nation", order, ["name", "balance"], greatest=["confidence"])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE upper(c_name) END AS c_name, CASE WHEN c_custkey % 6 = 0 THEN c_acctbal ELSE c_acctbal + 1 END AS c_acctbal FROM customer""")
def r11_preserve_reviewed(spark, d):
    """Reviewed fields stay as they are."""
    now = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    incoming = now.withColumn("c_name", F.upper("c_name")).withColumn("c_acctbal", F.col("c_acctbal") + 1)
    reviewed = now.filter("c_custkey % 4 = 0").select("c_custkey", F.lit("c_name").alias("field")).unionByName(now.filter("c_custkey % 6 = 0").select("c_custkey", F.lit("c_acctbal").alias("field")))
    return M.preserved(now, incoming, reviewed, "c_custkey", ["c_name", "c_acctbal"])


@query("""WITH o AS (SELECT s_nationkey AS id, lower(CASE WHEN s_suppkey % 3 = 0 THEN 'Garuva' ELSE 'Joinville' END) AS city, nullif(CASE WHEN s_suppkey % 2 = 0 THEN 'unknown' ELSE 'road' END, 'unknown') AS modality FROM supplier WHERE s_suppkey % 4 <> 0),
f AS (SELECT id, 'city' AS field, city AS value FROM o UNION ALL SELECT id, 'modality', modality FROM o),
c AS (SELECT n_nationkey AS id, 'city' AS field, 'garuva' AS own FROM nation UNION ALL SELECT n_nationkey, 'modality', 'road' FROM nation)
SELECT c.id, c.field, count(value) AS evidence, count(DISTINCT value) > 1 OR coalesce(bool_or(value <> own), false) AS conflict, count(value) = 0 AS missing FROM c LEFT JOIN f ON c.id = f.id AND c.field = f.field GROUP BY c.id, c.field""")
def r12_source_comparison(spark, d):
    """What validated sources say about each field."""
    k = F.col("s_suppkey")
    obs = table(spark, d, "supplier").select(F.col("s_nationkey").alias("id"), (k % 4 != 0).alias("validated"), F.when(k % 3 == 0, "GARUVA ").otherwise("Joinville").alias("city"), F.when(k % 2 == 0, "unknown").otherwise("Road").alias("modality"))
    own = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.lit("Garuva").alias("city"), F.lit("road").alias("modality"))
    return M.source_comparison(obs, own, "id", ("city", "modality"))


@query("""SELECT c_custkey, field, "from", "to" FROM (SELECT c_custkey, 'c_name' AS field, c_name AS "from", CASE WHEN c_custkey % 5 = 0 THEN upper(c_name) ELSE c_name END AS "to" FROM customer
UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END FROM customer) WHERE "from" IS DISTINCT FROM "to" """)
def x42_record_diff(spark, d):
    """Fields that differ between two snapshots."""
    rows = table(spark, d, "customer").select("c_custkey", F.struct("c_name", "c_mktsegment").alias("a"), F.struct(F.when(F.col("c_custkey") % 5 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("c_mktsegment")).alias("b"))
    return rows.select("c_custkey", F.inline(M.record_diff("a", "b", ["c_name", "c_mktsegment"])))


@query("""WITH RECURSIVE g AS (SELECT page_id AS id, page_id AS label FROM pages WHERE page_id % 10 = 0 UNION ALL SELECT id + 1, label FROM g WHERE (id + 1) % 10 <> 0 AND id + 1 <= (SELECT max(page_id) FROM pages) AND (id + 1) % 10 < 4)
SELECT page_id, coalesce(g.label, page_id) AS "group", CASE WHEN g.label IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY g.label) END AS size, CASE WHEN g.label IS NULL THEN false ELSE count(*) OVER (PARTITION BY g.label) > 3 END AS ambiguous FROM pages LEFT JOIN g ON g.id = page_id""")
def r14_linked_groups(spark, d):
    """Records that hang together by links (here a chain of up to four, each linked with the next)."""
    pages = table(spark, d, "pages").select("page_id")
    k = F.col("page_id")
    links = F.array_compact(F.array(F.when(k % 10 < 3, F.concat(F.lit("next:"), k.cast("string"))), F.when((k % 10).between(1, 3), F.concat(F.lit("next:"), (k - 1).cast("string")))))
    return M.linked_groups(pages.select("page_id", F.explode_outer(links).alias("link")), "page_id", "link").select("page_id", "group", "size", "ambiguous")


@query("""SELECT n_regionkey AS region, count(*) AS members, min_by(n_nationkey, n_name) AS target, count(*) <= 5 AND count(DISTINCT length(n_name) % 2) <= 1 AS compatible FROM nation GROUP BY 1""")
def r15_group_merge(spark, d):
    """Whether a group may be merged, and into what."""
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("region"), "n_nationkey", "n_name", (F.length("n_name") % 2).alias("part"))
    return M.group_merge(n, "region", "n_nationkey", "n_name", ["part"], most=5)


def _linked_pages(spark, d):
    """Pages of which 0-1, 2-3-4 and 5-6-7-8 of each ten are linked in chains; 9 is alone."""
    k = F.col("page_id")
    last = k % 10
    on = last.isin(0, 2, 3, 5, 6, 7)
    links = F.array_compact(F.array(F.when(on, F.concat(F.lit("next:"), k.cast("string"))), F.when(last.isin(1, 3, 4, 6, 7, 8), F.concat(F.lit("next:"), (k - 1).cast("string")))))
    pages = table(spark, d, "pages").select("page_id")
    return pages, M.linked_groups(pages.select("page_id", F.explode_outer(links).alias("link")), "page_id", "link")


@query("""WITH p AS (SELECT page_id, page_id % 10 AS k, page_id // 10 AS t FROM pages), g AS (SELECT *, t * 10 + CASE WHEN k < 2 THEN 0 WHEN k < 5 THEN 2 WHEN k < 9 THEN 5 ELSE 9 END AS grp FROM p),
m AS (SELECT grp, count(*) AS members, count(DISTINCT CASE WHEN page_id % 20 = 13 THEN 1 ELSE 0 END) <= 1 AS same FROM g GROUP BY 1),
w AS (SELECT page_id, (SELECT count(*) FROM pages o WHERE o.page_id <> pages.page_id AND o.page_id % 17 = pages.page_id % 17 AND o.page_id % 2 = pages.page_id % 2) > 0 AS weak FROM pages)
SELECT page_id, CASE WHEN page_id % 12 = 5 THEN 'foreign' WHEN page_id % 15 = 1 THEN 'waiting' WHEN members > 1 AND members <= 3 AND same THEN 'merged' WHEN members > 1 OR weak THEN 'review' ELSE 'unmatched' END AS decision FROM g JOIN m USING (grp) JOIN w USING (page_id)""")
def r16_decision(spark, d):
    """The outcome of each record from its group of links, or from hints if it is alone."""
    pages, groups = _linked_pages(spark, d)
    k = F.col("page_id")
    rows = groups.withColumn("part", (k % 20 == 13).cast("int"))
    merge = M.group_merge(rows, "group", "page_id", "page_id", ["part"], "group")
    weak = M.weak_candidates(pages.withColumn("day", k % 2), "page_id", "day", [k % 17])
    both = rows.select("page_id", "group", "ambiguous").join(merge, "group").join(weak, "page_id")
    facts = both.withColumn("country", F.when(k % 12 == 5, "PT").otherwise("BR")).withColumn("busy", k % 15 == 1)
    return facts.select("page_id", M.decision().alias("decision"))


@query("""WITH n AS (SELECT c_custkey AS a, c_custkey + 1 AS b FROM customer WHERE c_custkey % 2 = 0 AND c_custkey + 1 IN (SELECT c_custkey FROM customer)),
f AS (SELECT a, b, array_to_string(list_filter([CASE WHEN a % 3 = 0 THEN 'date_mismatch' END, CASE WHEN a % 5 = 0 THEN 'restricted' END, CASE WHEN a % 7 = 0 THEN 'link_unconfirmed' END, CASE WHEN a % 11 = 0 THEN 'source_identity_conflict' END, CASE WHEN a % 13 = 0 THEN 'manual_conflict' END, CASE WHEN a % 17 = 0 THEN 'in_use' END], lambda x: x IS NOT NULL), ',') AS reasons FROM n)
SELECT a AS a_id, b AS b_id, reasons, reasons = '' AS can_merge, reasons = '' AND a % 4 = 0 AS automatic, CASE WHEN a % 13 = 0 OR a % 6 = 0 OR a % 11 = 0 THEN 'A' || a ELSE 'B' || b END AS name FROM f""")
def r13_merge_preview(spark, d):
    """Whether two records may be one, why not, and what the merged one would hold."""
    c = table(spark, d, "customer").select("c_custkey").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"))
    pairs = c.join(table(spark, d, "customer").select((F.col("c_custkey") - 1).alias("k")), "k", "left_semi")
    k = F.col("k")
    text_ = lambda p, n: F.concat(F.lit(p), n.cast("string"))

    def side(p, n, source, id_):
        seen = F.struct(F.lit("2026-08-16").alias("date"), F.lit("x").alias("city"), F.lit("SC").alias("state"), F.lit("BR").alias("country"))
        return F.struct(
            n.alias("id"), source.alias("source"), id_.alias("external_id"), (F.when(k % 5 == 0, "hidden").otherwise("published") if p == "A" else F.lit("published")).alias("status"), (F.when(k % 3 == 0, "2026-08-15").otherwise("2026-08-16") if p == "B" else F.lit("2026-08-16")).alias("date"),
            F.lit("SC").alias("state"), F.lit("BR").alias("country"), (k % 7 != 0 if p == "A" else F.lit(True)).alias("linked"), (k % 17 == 0 if p == "B" else F.lit(False)).alias("busy"), F.when(k % 4 == 0, F.array(F.lit("u"))).otherwise(F.array(F.lit(p))).alias("links"), F.array(seen).alias("observed"), text_(p, n).alias("name"), F.lit("x").alias("city"),
        )

    a = side("A", k, F.lit("calendar"), F.lit("1"))
    b = side("B", k + 1, F.when(k % 11 == 0, "calendar").otherwise("tickets"), F.lit("2"))
    none = F.array().cast("array<string>")
    protected_a = F.when((k % 13 == 0) | (k % 6 == 0), F.array(F.lit("name"))).otherwise(none)
    rows = pairs.select(a.alias("a"), b.alias("b"), protected_a.alias("a_protected"), F.when(k % 13 == 0, F.array(F.lit("name"))).otherwise(none).alias("b_protected"))
    out = M.merge_preview(rows, ["name"])
    return out.select("a_id", "b_id", F.array_join("reasons", ",").alias("reasons"), "can_merge", "automatic", "name")


@query("""WITH s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 10 END AS event_id, CASE WHEN c_custkey % 4 = 0 THEN 'resolved' ELSE 'pending' END AS status, CASE WHEN c_custkey % 4 = 0 THEN 'person' END AS by_, 'BR' AS country FROM customer WHERE c_custkey % 3 > 0),
o AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'Joinville' ELSE 'garuva' END AS city, CASE WHEN c_custkey % 8 = 0 THEN '' ELSE 'BR' END AS country FROM customer WHERE c_custkey % 2 = 0), r AS (SELECT c_custkey AS id, c_custkey % 10 AS ref FROM customer WHERE c_custkey % 7 > 0),
j AS (SELECT id, s.event_id, s.status, s.by_, s.country AS old, o.city, o.country, o.id IS NOT NULL AS seen, r.ref, s.id IS NOT NULL AS stored FROM s FULL JOIN o USING (id) LEFT JOIN r USING (id)),
f AS (SELECT *, seen AND ref IS NOT NULL AND city = 'garuva' AND country = 'BR' AS fits FROM j)
SELECT id AS external_id, CASE WHEN NOT seen THEN event_id WHEN fits THEN ref WHEN ref IS NOT NULL THEN NULL ELSE event_id END AS event_id, CASE WHEN NOT seen THEN status WHEN fits THEN 'resolved' WHEN ref IS NOT NULL THEN 'pending' ELSE coalesce(status, 'pending') END AS status,
CASE WHEN NOT seen THEN by_ WHEN fits AND status = 'resolved' AND event_id = ref THEN by_ WHEN fits THEN 'exact_reference' WHEN ref IS NOT NULL THEN NULL ELSE by_ END AS resolved_by, coalesce(nullif(country, ''), old) AS country FROM f""")
def r17_source_matches(spark, d):
    """Matches resolved, registered, or opened again by what was observed."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    stored = c.filter("c_custkey % 3 > 0").select(k.alias("external_id"), F.when(k % 4 == 0, k % 10).alias("event_id"), F.when(k % 4 == 0, "resolved").otherwise("pending").alias("status"), F.when(k % 4 == 0, "person").alias("resolved_by"), F.lit("BR").alias("country"))
    rest = [F.lit("2026-08-16").alias("date"), F.lit("SC").alias("state")]
    observed = c.filter("c_custkey % 2 = 0").select(k.alias("external_id"), *rest, F.when(k % 5 == 0, "Joinville").otherwise("garuva").alias("city"), F.when(k % 8 == 0, "").otherwise("BR").alias("country"))
    references = c.filter("c_custkey % 7 > 0").select(k.alias("external_id"), (k % 10).alias("event_id"), *rest, F.lit("Garuva").alias("city"), F.lit("br").alias("country"))
    return M.source_matches(stored, observed, references)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'missing' WHEN o_orderkey % 5 = 0 THEN 'date_mismatch' WHEN o_orderkey % 3 = 0 THEN 'location_conflict' WHEN o_orderkey % 4 = 1 THEN 'already_associated' WHEN o_orderkey % 4 = 2 AND o_orderstatus = 'F' THEN 'unchanged' ELSE 'resolved' END AS outcome FROM orders""")
def r17_resolve_request(spark, d):
    """What becomes of a person's wish to tie a match to a record."""
    k = F.col("o_orderkey")
    of = lambda day, city: F.struct(day.alias("date"), city.alias("city"), F.lit("SC").alias("state"), F.lit("BR").alias("country"))
    match = F.when(k % 7 != 0, of(F.lit("2026-08-16"), F.lit("Garuva")))
    event = of(F.when(k % 5 == 0, F.lit(None)).otherwise("2026-08-16"), F.when(k % 3 == 0, "Joinville").otherwise("garuva"))
    rows = table(spark, d, "orders").select("o_orderkey", match.alias("match"), event.alias("event"), F.lit(1).alias("wanted"), F.when(k % 4 == 1, 2).when(k % 4 == 2, 1).alias("referenced"), F.when(F.col("o_orderstatus") == "F", "resolved").otherwise("pending").alias("status"), F.lit(1).alias("event_id"))
    return M.resolve_request(rows).select("o_orderkey", "outcome")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE 'y' END AS url, CASE WHEN c_custkey % 4 = 0 THEN 'kept' WHEN c_custkey % 4 = 1 THEN 'kept,no_distances_found' WHEN c_custkey % 4 = 2 THEN 'kept,no_prices_found' ELSE 'kept,no_distances_found,no_prices_found' END AS warnings FROM customer""")
def r18_fallback(spark, d):
    """Each field from the first extraction, else from the second; warnings that no longer hold go."""
    k = F.col("c_custkey")
    a = F.struct(F.when(k % 3 == 0, "").otherwise(F.col("c_name")).alias("name"), F.when(k % 2 == 0, "x").alias("url"))
    b = F.struct(F.col("c_mktsegment").alias("name"), F.lit("y").alias("url"))
    given = F.array(F.lit("kept"), F.lit("no_distances_found"), F.lit("no_prices_found"))
    rows = table(spark, d, "customer").select("c_custkey", a.alias("a"), b.alias("b"), given.alias("w"))
    left = M.without_contradicted("w", {"no_distances_found": k % 2 == 0, "no_prices_found": k % 4 < 2})
    return rows.select("c_custkey", *M.fallback_merge("a", "b", ["name", "url"]), F.array_join(left, ",").alias("warnings"))


@query("""SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 4 > 0 THEN 'BR' END AS country, CASE p_partkey % 3 WHEN 0 THEN 'road' WHEN 1 THEN 'trail' END AS modality, CASE WHEN p_partkey % 2 = 0 THEN 'https://x.example.com/about' ELSE 'https://x.example.com/src' END AS official_url FROM part""")
def r20_observation(spark, d):
    """Only the listed fields of a source's metadata, in their own form."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        "p_partkey", F.col("p_name").alias("name"), F.lit("2026-08-16").alias("date"), F.lit("").alias("city"), F.lit("SC").alias("state"), F.lit("Brasil").alias("country"), F.when(k % 4 == 0, "conflicting").otherwise("confirmed").alias("country_status"), F.when(k % 3 == 0, "Corrida de Rua").when(k % 3 == 1, "corrida de montanha").otherwise("bike").alias("kind"),
        F.lit("").alias("registration_url"), F.when(k % 2 == 0, "https://x.example.com/about").otherwise("").alias("about_url"), F.lit("https://x.example.com/src").alias("source_url"), F.lit("secret").alias("athletes"),
    )
    out = M.observation(rows, ["p_partkey"])
    assert "athletes" not in out.columns
    return out.select("p_partkey", "name", "country", "modality", "official_url")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'skip' WHEN c_custkey % 5 = 0 AND c_custkey % 2 = 0 THEN 'skip' WHEN c_custkey % 5 = 0 THEN 'update' WHEN c_custkey % 3 = 0 THEN 'link' WHEN c_custkey % 4 = 0 THEN 'review' ELSE 'create' END AS action FROM customer""")
def r19_candidate_action(spark, d):
    """What to do with each candidate."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select("c_custkey", (k % 7 == 0).alias("foreign"), (k % 5 == 0).alias("same_source"), (k % 2 == 0).alias("current"), (k % 3 == 0).alias("automatic"), F.when(k % 4 == 0, k).alias("match"))
    return rows.select("c_custkey", M.candidate_action().alias("action"))


@query("""SELECT o_orderkey, year(o_orderdate) <> year(o_orderdate + INTERVAL 30 DAY) AS reused FROM orders""")
def r21_identity_reuse(spark, d):
    """An id that stands for another year."""
    return table(spark, d, "orders").select("o_orderkey", M.identity_reused(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("interval 30 days")).alias("reused"))


@query("""SELECT 'customer' AS table_name, (SELECT count(*) FROM customer) AS rows, (SELECT sha256(string_agg(k::VARCHAR, chr(10) ORDER BY k)) FROM (SELECT c_custkey AS k FROM customer ORDER BY 1 LIMIT 100)) AS sample_hash, (SELECT count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)) AS orphans
UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem), (SELECT sha256(string_agg(a || '|' || b, chr(10) ORDER BY a, b)) FROM (SELECT l_orderkey AS a, l_linenumber AS b FROM lineitem ORDER BY 1, 2 LIMIT 100)), (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), (SELECT sha256(string_agg(k::VARCHAR, chr(10) ORDER BY k)) FROM (SELECT o_orderkey AS k FROM orders ORDER BY 1 LIMIT 100)), (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))""")
def r22_manifest(spark, d):
    """Rows, a hash of the first keys, and orphans of tables."""
    t = {n: table(spark, d, n) for n in ("orders", "customer", "lineitem", "nation")}
    return M.manifest({"customer": (t["customer"], ["c_custkey"], t["nation"], "c_nationkey", "n_nationkey"), "orders": (t["orders"], ["o_orderkey"], t["customer"], "o_custkey", "c_custkey"), "lineitem": (t["lineitem"], ["l_orderkey", "l_linenumber"], t["orders"], "l_orderkey", "o_orderkey")})


@query(r"""WITH b AS (SELECT p_partkey AS id, replace(trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')), ' ', '-') || CASE WHEN p_partkey % 50 = 1 THEN '-' || (2 + p_size % 4) ELSE '' END AS base FROM part),
t AS (SELECT DISTINCT replace(lower(p_type), ' ', '-') || CASE WHEN p_size % 3 = 0 THEN '' ELSE '-' || p_size END AS slug FROM part WHERE p_size < 8),
used AS (SELECT slug FROM t UNION SELECT base FROM b), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) - CASE WHEN base IN (SELECT slug FROM t) THEN 0 ELSE 1 END AS m FROM b),
free AS (SELECT base, k, row_number() OVER (PARTITION BY base ORDER BY k) AS m FROM (SELECT DISTINCT base FROM b) x, (SELECT unnest(range(2, (SELECT count(*) FROM b) + 60)) AS k) y WHERE base || '-' || k NOT IN (SELECT slug FROM used))
SELECT id AS p_partkey, base || CASE WHEN n.m = 0 THEN '' ELSE '-' || k END AS slug FROM n LEFT JOIN free USING (base, m)""")
def b27_unique_slug(spark, d):
    """Slugs made unique by the least free numbers, where some bases end in a number and some slugs are in use."""
    p = table(spark, d, "part")
    tail = lambda n: F.concat(F.lit("-"), n.cast("string"))
    base = F.concat(text.slugify("p_type"), F.when(F.col("p_partkey") % 50 == 1, tail(F.col("p_size") % 4 + 2)).otherwise(""))
    used = p.filter("p_size < 8").select(F.concat(text.slugify("p_type"), F.when(F.col("p_size") % 3 == 0, "").otherwise(tail(F.col("p_size")))).alias("slug"))
    return M.unique_slugs(p.select("p_partkey", base.alias("base")), "p_partkey", "base", used)


@query("""SELECT s_suppkey, coalesce(c.candidates, 0) AS candidates, coalesce(c.ambiguous, false) AS ambiguous FROM supplier LEFT JOIN (
SELECT s_suppkey, count(DISTINCT c_custkey) AS candidates, count(DISTINCT c_custkey) > 1 AS ambiguous FROM supplier JOIN customer ON c_custkey % 200 = s_suppkey % 200 GROUP BY 1) c USING (s_suppkey)""")
def j9_variants_lookup(spark, d):
    """Candidates by any of many spellings of an address; several are ambiguous."""
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("https://x.example.com/"), (F.col("s_suppkey") % 200).cast("string")).alias("u"))
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("http://www.x.example.com/"), (F.col("c_custkey") % 200).cast("string")).alias("v"))
    hits = R.by_variants(s, c, "s_suppkey", urls.variants("u"), "c_custkey", "v")
    return s.select("s_suppkey").join(hits, "s_suppkey", "left").select("s_suppkey", F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))
