"""Payloads and pages of sources read back as rows: the pages are made from the tables, and SQL says what must come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as E
from ..sources import readers
from . import dealt, query, table


def _text(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


@query("""SELECT page_id, CASE WHEN regexp_matches(host, '(^|\\.)example\\.com$') THEN 'com' WHEN regexp_matches(host, '(^|\\.)example\\.org$') THEN 'org' ELSE 'generic' END AS adapter FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '') AS host FROM pages)""".replace("\\\\", "\\"))
def s1_adapters(spark, d):
    """The first adapter that reads a page's host."""
    known = [readers.Adapter("com", ("example.com",)), readers.Adapter("org", ("example.org",))]
    return readers.dispatched(table(spark, d, "pages"), "url", known).select("page_id", "adapter")


@query("""SELECT user_id, CAST(event_id AS VARCHAR) AS "eventId", event_type AS title FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0""")
def s2_json_list(spark, d):
    """A JSON list as rows; those without an id, a title or a web address, and those of other countries, are dropped."""
    k = F.col("event_id")
    e = F.struct(F.when(k % 5 != 0, k.cast("string")).alias("eventId"), F.when(k % 7 != 0, F.col("event_type")).otherwise(" ").alias("title"), F.when(k % 11 != 0, _text("https://x.example.com/", k.cast("string"))).otherwise("x").alias("uri"), F.when(k % 13 == 0, "Porto, Portugal").otherwise("Garuva, SC, Brasil").alias("address"))
    lists = table(spark, d, "events").groupBy("user_id").agg(F.to_json(F.collect_list(e)).alias("payload"))
    rows = readers.json_list(lists, "payload", ["user_id"])
    country = E.country_in_location("address")["country"]
    return rows.filter(F.coalesce(country, F.lit("BR")) == "BR").select("user_id", "eventId", "title")


@query("""SELECT c_custkey, n, 'Run ' || n AS title, CASE n WHEN 1 THEN '2026-08-' || lpad(CAST(c_custkey % 27 + 1 AS VARCHAR), 2, '0') WHEN 3 THEN '2026-09-01' END AS date, '/show?id=' || n AS href FROM customer, (VALUES (1), (2), (3)) t(n)""")
def s5_calendar(spark, d):
    """Events of a calendar page; the day stands one or two rows before, but not beyond another event."""
    link = lambda n: f"<tr><td><a href='/show?id={n}'>Run {n}</a></td></tr>"
    day = F.lpad((F.col("c_custkey") % 27 + 1).cast("string"), 2, "0")
    html = _text("<table><tr><th>Calendar</th></tr><tr><td>", day, "/08/2026</td></tr>", link(1), link(2), "<tr><td>01/09/2026</td></tr><tr><td>Garuva</td></tr>", link(3), "</table>")
    out = readers.calendar_rows(dealt(spark, d, "customer").select("c_custkey", html.alias("html")), "c_custkey", "html", r"^/show\?")
    n = F.row_number().over(readers.W.partitionBy("c_custkey").orderBy("row"))
    return out.withColumn("n", n).select("c_custkey", "n", "title", "date", "href")


@query("""SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS external_id, trim(p_name) AS title, p_name || chr(10) || '2026-08-16' || chr(10) || 'About' || chr(10) || p_type || ' and more' AS text,
'https://x.example.com/' || p_partkey || ',/more?p=' || p_size AS links, sha256(trim(p_name) || chr(10) || trim(regexp_replace(p_name || ' 2026-08-16 About ' || p_type || ' and more', '\\s+', ' ', 'g'))) AS content_hash FROM part""".replace("\\\\", "\\"))
def s7_json_detail(spark, d):
    """A JSON record with sections of HTML: title, text, links and a hash."""
    section = F.struct(F.lit("About").alias("title"), _text("<p>", F.col("p_type"), " <a href='/more?p=", F.col("p_size").cast("string"), "'>and more</a></p>").alias("description"))
    payload = F.to_json(F.struct(F.col("p_partkey").cast("string").alias("eventId"), F.col("p_name").alias("title"), F.lit("2026-08-16").alias("date"), _text("https://x.example.com/", F.col("p_partkey").cast("string")).alias("uri"), F.array(section).alias("eventContents")))
    out = readers.json_detail(table(spark, d, "part").select("p_partkey", payload.alias("payload")), "payload", ["p_partkey"])
    return out.select("p_partkey", "external_id", "title", "text", F.array_join("links", ",").alias("links"), "content_hash")


def _json_ld(rows, key, records):
    return rows.select(key, _text("<html><script type='application/ld+json'>", records, "</script><p>x</p><script type=\"application/ld+json\">not json</script></html>").alias("html"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS records, CASE o_orderkey % 4 WHEN 3 THEN '' ELSE 'R' || o_orderkey END AS first_name, false AS names_people FROM orders""")
def s9_json_ld(spark, d):
    """Objects of a type on a page, out of arrays, graphs and lists, without those who take part."""
    k = F.col("o_orderkey")
    event = _text('{"@type": "Event", "name": "R', k.cast("string"), '", "competitor": {"name": "z"}, "subEvent": {"performer": [1]}}')
    of = F.when(k % 4 == 0, event).when(k % 4 == 1, _text('[{"@type": ["Thing", "Event"], "name": "R', k.cast("string"), '"}, {"@graph": [{"@type": "Event", "name": "b", "Athlete": 1}, {"@type": "Place"}]}]')).when(k % 4 == 2, _text('{"@type": "ItemList", "itemListElement": [{"item": ', event, "}]}")).otherwise('{"@type": "Place"}')
    found = _json_ld(table(spark, d, "orders"), "o_orderkey", of).select("o_orderkey", readers.json_ld_records("html").alias("r"))
    return found.select("o_orderkey", F.size("r").alias("records"), F.coalesce(F.get_json_object(F.get("r", F.lit(0)), "$.name"), F.lit("")).alias("first_name"), F.array_join("r", " ").rlike("(?i)competitor|performer|athlete").alias("names_people"))


@query("""SELECT c_custkey, ['absent', 'unique_match', 'ambiguous', 'url_mismatch', 'single'][c_custkey % 5 + 1] AS selection, CASE c_custkey % 5 WHEN 1 THEN 'own' WHEN 4 THEN 'only' END AS name FROM customer""")
def s10_selected_record(spark, d):
    """How the records of a page relate to its address."""
    k = F.col("c_custkey")
    own = _text("https://www.x.example.com/e/", k.cast("string"), "/?utm_source=y")
    record = lambda name, url: _text(f'{{"name": "{name}", "url": "', url, '"}')
    other = record("other", F.lit("https://x.example.com/other"))
    bare = F.lit('{"name": "only"}')
    same = _text("https://x.example.com/e/", k.cast("string"))
    records = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 5 == 1, F.array(other, record("own", same))).when(k % 5 == 2, F.array(record("a", same), record("b", same))).when(k % 5 == 3, F.array(other)).otherwise(F.array(bare))
    out = readers.selected_record(table(spark, d, "customer").select("c_custkey", own.alias("url"), records.alias("records")), "c_custkey", "records", "url")
    return out.select("c_custkey", "selection", F.get_json_object("record", "$.name").alias("name"))


@query("""SELECT n_nationkey, k AS position, 'Run ' || k AS title, '/e/' || n_nationkey || '-' || k AS href, CASE k WHEN 1 THEN '2026-08-16' WHEN 2 THEN '2026-08-' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') ELSE NULL END AS date, CASE WHEN k = 3 THEN NULL ELSE 'Garuva - SC' END AS place, CASE WHEN k = 2 THEN 1234 END AS finishers FROM nation, (VALUES (1), (2), (3)) t(k)""")
def s11_cards(spark, d):
    """Cards of a catalogue page as rows."""
    k = F.col("n_nationkey").cast("string")
    card = lambda n, rest: _text(f"<div class='card event-card'><h3>Run <b>{n}</b></h3><a href='/e/", k, f"-{n}'>see</a> ", rest, "</div>")
    day = _text(F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0"), ".08.2026")
    html = _text("<main>", card(1, F.lit("<span>2026-08-16</span> <p>Garuva - SC</p>")), card(2, _text("<span>", day, "</span><p>Garuva - SC</p><i>1.234 concluintes</i>")), card(3, F.lit("soon")), "</main>")
    out = readers.cards(table(spark, d, "nation").select("n_nationkey", html.alias("html")), "n_nationkey", "html", "event-card")
    return out.select("n_nationkey", (F.col("position") + 1).alias("position"), "title", "href", "date", "place", "finishers")


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN '<p>raw</p>' WHEN 2 THEN NULL ELSE '<p>' || event_type || '</p>' END AS html, CASE event_id % 4 WHEN 0 THEN CAST(user_id AS INTEGER) END AS total, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS has_more FROM events""")
def s12_payloads(spark, d):
    """A payload as text or object, keys in any case, numbers and flags strictly."""
    k = F.col("event_id") % 4
    body = _text('"<p>', F.col("event_type"), '</p>"')
    payload = F.when(k == 0, _text('{"HTML": ', body, ', "recordsTotal": ', F.col("user_id").cast("string"), ', "hasMore": "true"}')).when(k == 1, _text('{"html": ', body, ', "RECORDSTOTAL": "1.5", "HasMore": false}')).when(k == 2, '{"recordstotal": "many", "hasmore": "maybe"}').otherwise("<p>raw</p>")
    return readers.normalized_payload(table(spark, d, "events").select("event_id", payload.alias("payload")), "payload", ["event_id"])


@query("""SELECT p_partkey, p_name AS name, '2026-08-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') AS day, 'Garuva' AS city, 'SC' AS state, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 1000 + p_size END AS finishers,
'5K:F=' || p_size || ',M=' || (p_size + 1) || ';10K:F=0,M=2' AS modalities, 'https://x.example.com/results/' || p_partkey AS endpoint, 'Pos.|Nome' AS headers FROM part""")
def s13_event_page(spark, d):
    """An event page: name, day, place, finishers, modalities with totals by gender, endpoint and headers; results needn't be there."""
    k, n = F.col("p_partkey"), F.col("p_size")
    day = F.lpad((n % 28 + 1).cast("string"), 2, "0")
    finishers = F.when(k % 3 == 0, "").otherwise(_text("<b>", F.format_string("1.%03d", n), " concluintes</b>"))
    card = lambda name, f, m: _text(f"<div class='modality' data-name='{name}'><h4>{name}</h4><span class='total' data-gender='F'>Feminino ", f, "</span><span class='total' data-gender='M'>Masculino ", m, "</span></div>")
    html = _text("<h1>", F.col("p_name"), "</h1><span class='day'>", day, "</span><span class='month'>AGO</span><span class='year'>2026</span><p class='place'>Garuva - SC</p>", finishers, card("5K", n.cast("string"), (n + 1).cast("string")), card("10K", F.lit("0"), F.lit("2")), "<table data-url='https://x.example.com/results/", k.cast("string"), "'><tr><th>Pos.</th><th> Nome </th></tr></table>")
    out = readers.event_page(dealt(spark, d, "part").select("p_partkey", html.alias("html")), "html", ["p_partkey"])
    one = F.transform("modalities", lambda m: F.concat(m["name"], F.lit(":"), F.array_join(F.transform(m["totals"], lambda t: F.concat(t["gender"], F.lit("="), t["total"].cast("string"))), ",")))
    return out.select("p_partkey", "name", "day", "city", "state", "finishers", F.array_join(one, ";").alias("modalities"), "endpoint", F.array_join("headers", "|").alias("headers"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, (l_linenumber - 1) * 10 AS off, CASE WHEN l_orderkey % 9 = 0 AND l_linenumber = 2 THEN -1 ELSE 10 END AS n, CASE WHEN l_orderkey % 7 = 0 THEN l_linenumber ELSE 10 * max(l_linenumber) OVER (PARTITION BY l_orderkey) END AS total, l_linenumber < max(l_linenumber) OVER (PARTITION BY l_orderkey) AS more FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
t AS (SELECT *, min(total) OVER (PARTITION BY l_orderkey) <> max(total) OVER (PARTITION BY l_orderkey) AS changed FROM p)
SELECT l_orderkey, off, CASE WHEN n < 0 THEN 'negative' WHEN changed THEN 'total_changed' WHEN more AND l_orderkey % 5 = 0 THEN 'next_mismatch' WHEN NOT more AND off + n <> total THEN 'end_not_evidenced' END AS error FROM t""")
def s15_strict_pages(spark, d):
    """What is wrong with the pages of a result: totals, where the next one begins, and whether the end is shown."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    last = F.max("l_linenumber").over(readers.W.partitionBy("l_orderkey"))
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    pages = items.select("l_orderkey", ((n - 1) * 10).alias("off"), F.when((k % 9 == 0) & (n == 2), -1).otherwise(10).alias("n"), F.when(k % 7 == 0, n).otherwise(10 * last).alias("total"), (n < last).alias("more"))
    pages = pages.withColumn("next", F.when(k % 5 != 0, F.col("off") + F.col("n")))
    return readers.strict_pages(pages, "l_orderkey", "off", "n", "total", "next", "more")


@query("""SELECT page_id, page_id % 4 = 0 AS challenge FROM pages""")
def e18_challenge(spark, d):
    """Pages that ask for proof of a person."""
    page = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("<html>Verifíque que você  é humano</html>"), F.col("html"))).otherwise(F.col("html"))
    return table(spark, d, "pages").select("page_id", E.is_challenge(page).alias("challenge"))


BROKEN = (
    ("<p>ok</p><img src=x onerror=alert(1)", "<p>ok</p>"), ("<p title=\"a>b\" onclick=\"x()\">hi</p>", "<p>hi</p>"), ("<p title='a>b' x=it's>hi</P>", "<p>hi</P>"), ("1 < 2 <<script>x</script>img src=x onerror=y()>", "1 &lt; 2 &lt;img src=x onerror=y()>"),
    ("<p-x a>t</p-x><h1 a=\"", "t"), ("a<!-- <p> -- > <b> -->c<script src=x", "ac"), ("<LI/onclick=x()>d<svg><p>e</svg >f", "<LI>df"),
)


@query(r"""SELECT page_id, '<ul><li>' || page_id || '</li></ul><p>b</p>c<br>d' || """ + f"[{', '.join(chr(39) + safe.replace(chr(39), chr(39) * 2) + chr(39) for _, safe in BROKEN)}][page_id % {len(BROKEN)} + 1] AS safe FROM pages")
def e2_sanitized(spark, d):
    """Only allowed tags, no attributes, no scripts, styles or comments, whatever is quoted, left open or broken."""
    k = F.col("page_id").cast("string")
    broken = F.element_at(F.array(*[F.lit(x) for x, _ in BROKEN]), (F.col("page_id") % len(BROKEN) + 1).cast("int"))
    html = _text("<div class='a'><ul id=x><li onclick='y()'>", k, "</li></ul><script>z()</script><!-- note --><p style='c'>b</p><span>c</span><style>q</style><br clear=all>d</div>", broken)
    return table(spark, d, "pages").select("page_id", E.html_sanitized(html).alias("safe"))


@query("""SELECT n_regionkey, 'https://www.cal.example.com/sc/list2.asp' AS next_urls, CASE WHEN n_regionkey = 3 THEN 'catalog_end_unconfirmed' WHEN n_regionkey = 4 THEN 'source_access_blocked' END AS error, CASE WHEN n_regionkey IN (2, 3, 4) THEN 0 ELSE count(*) END AS events FROM nation GROUP BY 1""")
def b21_calendar_pages(spark, d):
    """A calendar page with the links to the next ones; an empty one counts as the end only with evidence."""
    nav = "<a href='list2.asp#top'>2</a><a href='/sc/list.asp'>1</a><a href='https://other.example.com/sc/list3.asp'>x</a><a href='/sp/list4.asp'>y</a>"
    n = F.col("n_regionkey")
    rows = F.array_join(F.collect_list(F.concat(F.lit("<tr><td>16/08/2026</td></tr><tr><td><a href='/show?id="), F.col("n_nationkey").cast("string"), F.lit("'>Run</a></td></tr>"))), "")
    pages = table(spark, d, "nation").groupBy("n_regionkey").agg(rows.alias("rows"))
    body = F.when(n.isin(2, 3), "").when(n == 4, "captcha").otherwise(F.col("rows"))
    head = F.when(n == 2, "<link rel='canonical' href='https://cal.example.com/sc/list.asp'><h1>Calendário</h1>").otherwise("")
    pages = pages.select("n_regionkey", F.lit("http://cal.example.com/SC/List.asp").alias("url"), _text(head, "<table>", body, "</table>", nav).alias("html"))
    out = readers.calendar_pages(pages, "n_regionkey", "html", "url", "cal.example.com", r"^/sc/list\d*\.asp$", r"^/show\?", r"calendario")
    return out.select("n_regionkey", F.array_join("next_urls", ",").alias("next_urls"), "error", F.col("events").cast("long").alias("events"))


@query("""SELECT 0::BIGINT AS page_id, 'https://mock.example.com/0' AS url, 'One' AS title UNION ALL SELECT 1, 'https://mock.example.com/1', NULL""")
def s21_mock_pages(spark, d):
    """A source with given texts, read as any other."""
    pages = readers.mock_pages(spark, ["<title>One</title>", "no title"])
    return pages.select("page_id", "url", E.html_title("html").alias("title"))
