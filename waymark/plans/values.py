"""Single values: text in odd encodings, spellings, dates, numbers, addresses and loose JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, jsons, numbers, text, urls
from ..operators import resolve as M
from . import query, table

KEY = "trim(regexp_replace(lower(strip_accents(trim(regexp_replace({0}, '\\s+', ' ', 'g')))), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT doc_id, coalesce(nullif(substr(replace({KEY.format('text')}, ' ', '-'), 1, 120), ''), 'resultados') AS slug FROM documents")
def x5_file_names(spark, d):
    """Names of files, 120 characters long at most."""
    return table(spark, d, "documents").select("doc_id", text.slugify("text", 120, "resultados").alias("slug"))


@query("""SELECT c_custkey, c_custkey % 6 AS n, substr('🙂a🙂b', 1, CASE c_custkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 2 ELSE 3 END) AS part,
substr(c_name, 3, 5) AS plain FROM customer""")
def x6_utf16_slice(spark, d):
    """Slices counted in UTF-16 units, without half a character."""
    n = F.col("c_custkey") % 6
    parts = F.array(*[text.utf16_slice(F.lit("🙂a🙂b"), 0, k) for k in range(6)])
    return table(spark, d, "customer").select("c_custkey", n.alias("n"), F.element_at(parts, (n + 1).cast("int")).alias("part"), text.utf16_slice("c_name", 2, 7).alias("plain"))


@query("""SELECT doc_id, sha256(array_to_string(list_transform(string_split(w, ' '), lambda x: x), ' ')) AS h FROM (SELECT doc_id, regexp_replace(text, '[^\\x{20}-\\x{7E}\\x{C0}-\\x{FF}]', ' ', 'g') AS w FROM documents)""")
def x7_mojibake(spark, d):
    """Words that were read in the wrong charset are read again; every other one stays."""
    plain = F.regexp_replace("text", r"[^\x{20}-\x{7E}\x{C0}-\x{FF}]", " ")
    # every third word is UTF-8 read as Latin-1; one that isn't ASCII then has a marker letter
    broken = F.array_join(F.transform(F.split(plain, " "), lambda w, i: F.when(i % 3 == 0, F.decode(F.encode(w, "UTF-8"), "ISO-8859-1")).otherwise(w)), " ")
    return table(spark, d, "documents").select("doc_id", F.sha2(text.repair_mojibake(broken), 256).alias("h"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 9 < 4 THEN 'Feminino' WHEN c_custkey % 9 < 8 THEN 'Masculino' END AS gender FROM customer""")
def x10_gender(spark, d):
    """Spellings of a gender; null for any other."""
    given = [" f", "Fem.", "FEMININO", "feminina", "M", "masc", "Masculino", "MASCULINA", "open"]
    return table(spark, d, "customer").select("c_custkey", text.gender(F.element_at(F.array(*[F.lit(g) for g in given]), (F.col("c_custkey") % 9 + 1).cast("int"))).alias("gender"))


@query("""SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS title, replace(lower(p_type), ' ', '_') AS header FROM part""")
def x13_headers(spark, d):
    """Headers as keys and as titles."""
    key = text.header_key("p_type")
    return table(spark, d, "part").select("p_partkey", text.title_header(key).alias("title"), key.alias("header"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def x17_explicit_date(spark, d):
    """Labels that are one whole day; labels of several days and mere years aren't."""
    at = F.col("o_orderdate")
    iso, local = F.date_format(at, "yyyy-MM-dd"), F.date_format(at, "dd/MM/yyyy")
    label = F.element_at(F.array(iso, F.concat(iso, F.lit("T08:00:00.000Z")), local, F.concat(F.lit("1 e "), local), F.concat(F.lit("Run "), F.year(at).cast("string"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", dates.explicit_date(label).alias("day"))


@query("""SELECT o_orderkey, CAST(day AS TIMESTAMP) + CASE WHEN gap THEN INTERVAL 3 HOUR WHEN summer THEN INTERVAL 2 HOUR ELSE INTERVAL 3 HOUR END AS instant, CASE WHEN gap THEN 60 ELSE 0 END AS shifted
FROM (SELECT o_orderkey, day, day = DATE '2018-11-04' AS gap, day > DATE '2018-11-04' AND day < DATE '2019-02-17' AS summer FROM (SELECT o_orderkey, DATE '2018-10-20' + CAST(o_orderkey % 150 AS INTEGER) AS day FROM orders))""")
def x20_wall_clock(spark, d):
    """Midnight in São Paulo over a winter with a gap (2018-11-04) and a fold; what doesn't exist moves on an hour."""
    day = F.date_add(F.lit("2018-10-20").cast("date"), (F.col("o_orderkey") % 150).cast("int"))
    w = dates.wall_clock(day, "00:00", "America/Sao_Paulo")
    return table(spark, d, "orders").select("o_orderkey", w.alias("w")).select("o_orderkey", F.col("w.instant").cast("timestamp_ntz").alias("instant"), F.col("w.shifted_minutes").alias("shifted"))


@query("""SELECT p_partkey, nullif(p_size % 4, 0)::BIGINT AS place, CASE WHEN p_partkey % 2 = 0 THEN p_size::BIGINT END AS whole FROM part""")
def x25_whole_numbers(spark, d):
    """A place is positive or null; 52.0 is a whole number and 52.5 isn't."""
    n = F.col("p_size").cast("string")
    written = F.concat(n, F.when(F.col("p_partkey") % 2 == 0, ".0").otherwise(".5"))
    return table(spark, d, "part").select("p_partkey", numbers.position(F.concat((F.col("p_size") % 4).cast("string"), F.lit("º"))).alias("place"), numbers.whole_number(written).alias("whole"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN base || '/a/b' WHEN 1 THEN base || '/x/c?d=1' WHEN 2 THEN 'https://other.example.com/z' END AS url FROM (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+') AS base FROM pages)""")
def x29_absolute(spark, d):
    """Addresses made whole against a base; only those of the web."""
    base = F.concat(F.regexp_extract("url", "^https?://[^/?#]+", 0), F.lit("/x/y"))
    given = F.element_at(F.array(F.lit("/a/b"), F.lit("c?d=1"), F.lit("https://other.example.com/z"), F.lit("mailto:x@example.com")), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", urls.absolute(given, base).alias("url"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'https://site.example.com/p?q=' || page_id || '&r=a b' END AS target FROM pages""")
def x30_redirects(spark, d):
    """The decoded target of a redirecting address, if it is one of the web."""
    k = F.col("page_id").cast("string")
    inner = F.when(F.col("page_id") % 3 == 0, F.lit("javascript:void(0)")).otherwise(F.concat(F.lit("https://site.example.com/p?q="), k, F.lit("&r=a b")))
    return table(spark, d, "pages").select("page_id", urls.redirect_target(F.concat(F.lit("https://go.example.com/r?a=1&c="), F.url_encode(inner)), "c").alias("target"))


HOSTS = ["https://tickets.example.com/a", "https://a.tickets.example.com/", "http://127.0.0.1/x", "https://10.1.2.3/", "https://user:pw@tickets.example.com/", "https://tickets.example.com:8443/", "ftp://tickets.example.com/", "https://tickets.example.com.evil.org/", "https://192.168.0.9/", "https://printer.local/"]


@query(f"""SELECT c_custkey, c_custkey % 10 AS n, c_custkey % 10 IN (0, 1, 7) AS safe, c_custkey % 10 IN (0, 1) AS listed FROM customer""")
def x31_safe_urls(spark, d):
    """Plain addresses of the web outside private ranges, and those of allowed hosts."""
    n = F.col("c_custkey") % 10
    url = F.element_at(F.array(*[F.lit(h) for h in HOSTS]), (n + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", n.alias("n"), urls.is_safe(url).alias("safe"), urls.is_safe(url, ("tickets.example.com",)).alias("listed"))


PLACES = ["https://tickets.example.com/", "https://x.example.com/inscricao/1", "https://x.example.com/event/2", "https://x.example.com/blog", "https://x.example.com/img/logo.png", "https://x.example.com/a_banner-ad.jpg", "https://x.example.com/catalogo.png"]


@query("""SELECT s_suppkey, s_suppkey % 7 AS n, s_suppkey % 7 IN (0, 1, 2) AS registration, s_suppkey % 7 IN (4, 5) AS decoration FROM supplier""")
def x32_url_kinds(spark, d):
    """Addresses that look like a registration, and pictures that aren't of the event."""
    n = F.col("s_suppkey") % 7
    url = F.element_at(F.array(*[F.lit(p) for p in PLACES]), (n + 1).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", n.alias("n"), urls.looks_like_registration(url).alias("registration"), urls.looks_like_decoration(url).alias("decoration"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE event_type END AS value, CAST(CASE event_id % 4 WHEN 1 THEN 0.75 WHEN 2 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS confidence, CASE event_id % 4 WHEN 1 THEN 'seen' WHEN 2 THEN NULL WHEN 0 THEN event_type END AS source_text,
CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'a,b' ELSE '' END AS list FROM events""")
def x40_loose_json(spark, d):
    """Bare values taken for evidence and for arrays of one; confidences clamped."""
    t, k = F.col("event_type"), F.col("event_id") % 4
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    evidence = F.when(k == 0, quote(t)).when(k == 1, F.concat(F.lit('{"value": '), quote(t), F.lit(', "confidence": 0.75, "sourceText": "seen"}'))).when(k == 2, F.concat(F.lit('{"value": '), quote(t), F.lit(', "confidence": 7}'))).otherwise("null")
    many = F.when(k == 0, quote(t)).when(k == 1, '["a", "b", 3]').otherwise("5")
    j = F.concat(F.lit('{"e": '), evidence, F.lit(', "l": '), many, F.lit("}"))
    e = jsons.as_evidence(j, "$.e")
    return table(spark, d, "events").select("event_id", e["value"].alias("value"), e["confidence"].alias("confidence"), e["source_text"].alias("source_text"), F.array_join(jsons.as_array(j, "$.l"), ",").alias("list"))


@query("""SELECT s_suppkey, 65536 + 8 * octet_length(encode('{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"}')) AS bytes FROM supplier""")
def b36_growth(spark, d):
    """What storing a record may add."""
    return table(spark, d, "supplier").select("s_suppkey", numbers.growth_estimate(F.struct("s_suppkey", "s_name")).cast("long").alias("bytes"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'none' WHEN c_custkey % 4 = 1 THEN 'confirmed' WHEN c_custkey % 4 = 2 THEN 'conflict' ELSE 'confirmed' END AS evidence FROM customer""")
def r5_evidence_class(spark, d):
    """Whether the values that sources give for a field are none, one or several."""
    k, none = F.col("c_custkey") % 4, F.lit(None).cast("string")
    values = F.when(k == 0, F.array(none, none)).when(k == 1, F.array(F.lit("2026-01-01"), none)).when(k == 2, F.array(F.lit("2026-01-01"), F.lit("2026-01-02"))).otherwise(F.array(F.lit("2026-01-01"), F.lit("2026-01-01")))
    return table(spark, d, "customer").select("c_custkey", M.evidence_class(values).alias("evidence"))


@query("""SELECT c_custkey, least(greatest(c_acctbal, 0.0), 5000.0)::DOUBLE AS clamped, CASE WHEN c_custkey % 4 = 0 THEN c_custkey ELSE 20 END AS size FROM customer WHERE c_custkey > 0""")
def x26_bounds(spark, d):
    """Numbers held between bounds, and positive whole ones with a fallback."""
    k = F.col("c_custkey")
    given = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, "-3").when(k % 4 == 2, "many")
    return table(spark, d, "customer").filter(k > 0).select("c_custkey", numbers.clamp("c_acctbal", 0.0, 5000.0).alias("clamped"), numbers.positive_or(given, 20).alias("size"))
