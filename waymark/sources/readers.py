"""From raw payloads to typed rows."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import month_name_date, normalize_date
from ..functions.numbers import first_integer
from ..functions.text import Text, clean, normalize_key, parts_hash
from ..functions.urls import absolute, canonical, host, is_plain, part
from ..operators.extract import hrefs, html_text, html_title, is_challenge, json_ld, meta_content


class Adapter(NamedTuple):
    """A source and the hosts that it reads."""

    name: str
    hosts: tuple[str, ...]


def dispatched(df: DataFrame, url: str, adapters: list[Adapter], default: str = "generic") -> DataFrame:
    """df with adapter: the first one that reads the address's host."""
    out = F.lit(default)
    for a in reversed(adapters):
        match = F.lit(False)
        for h in a.hosts:
            match = match | (host(url) == h) | host(url).endswith("." + h)
        out = F.when(match, a.name).otherwise(out)
    return df.withColumn("adapter", F.coalesce(out, F.lit(default)))


LISTED = "array<struct<eventId:string,title:string,uri:string,address:string,date:string,status:string,organizer:string,isVirtualEvent:boolean>>"


def json_list(df: DataFrame, payload: str, carried: list[str] = ()) -> DataFrame:
    """A row for each object of a JSON array that has an id, a title and an address on the web."""
    rows = df.select(*carried, F.posexplode(F.from_json(payload, LISTED)).alias("position", "e")).select(*carried, "position", "e.*")
    return rows.filter((clean("eventId") != "") & (clean("title") != "") & F.col("uri").rlike("(?i)^https?://"))


def catalogue_page(df: DataFrame, key: str, payload: str, requested: Column, is_foreign: Column) -> DataFrame:
    """Counts of each JSON page: raw, invalid, distinct, foreign; terminal if it's short and all valid."""
    rows = df.select(key, requested.alias("requested"), F.explode_outer(F.from_json(payload, LISTED)).alias("e")).select(key, "requested", "e.*")
    there = F.col("eventId").isNotNull() | F.col("title").isNotNull()
    valid = F.coalesce(F.col("eventId").rlike(r"^\d+$") & (clean("title") != "") & F.col("uri").rlike("(?i)^https?://"), F.lit(False))
    marked = rows.select(key, "requested", "eventId", there.alias("there"), valid.alias("valid"), F.coalesce(is_foreign, F.lit(False)).alias("foreign"))
    out = marked.groupBy(key).agg(F.max("requested").alias("requested"), F.count_if("there").alias("raw"), F.count_if(F.col("there") & ~F.col("valid")).alias("invalid"), F.count_distinct(F.when(F.col("valid"), F.col("eventId"))).alias("distinct_ids"), F.count_distinct(F.when(F.col("valid") & F.col("foreign"), F.col("eventId"))).alias("foreign_ids"))
    return out.withColumn("terminal", (F.col("raw") < F.col("requested")) & (F.col("invalid") == 0))


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: that of the last partition (or page) that listed it."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")


class _Tables(HTMLParser):
    """Rows of cells with their links, and the text and links of anchors."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.row, self.cell, self.href, self.depth = [], None, None, None, 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "tr":
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.cell = {"text": "", "hrefs": [], "head": tag == "th"}
        elif tag == "a" and self.cell is not None and a.get("href"):
            self.cell["hrefs"].append(a["href"])
        elif tag == "br" and self.cell is not None:
            self.cell["text"] += " "

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.cell["text"] = " ".join(self.cell["text"].split())
            self.row.append(self.cell)
            self.cell = None
        elif tag == "tr" and self.row is not None:
            self.rows.append(self.row)
            self.row = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell["text"] += data


def tables_of(html: str | None) -> list[list[dict]]:
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    return parser.rows


CELL = T.StructType([T.StructField("text", T.StringType()), T.StructField("hrefs", T.ArrayType(T.StringType())), T.StructField("head", T.BooleanType())])
TABLE_ROWS = T.ArrayType(T.ArrayType(CELL))


@F.pandas_udf(TABLE_ROWS)
def table_rows(html: pd.Series) -> pd.Series:
    """All table rows of a page as cells; nested markup needs a parser, so this is Python in Arrow batches."""
    return html.map(tables_of)


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def label_values(html: pd.Series) -> pd.Series:
    """A two-column table as a map from label keys to values; the first of equal labels counts."""

    def one(page):
        out = {}
        for row in tables_of(page):
            if len(row) >= 2 and (key := normalize(row[0]["text"]).replace("_", " ")):
                out.setdefault(key, row[1]["text"])
        return out

    return html.map(one)


def field_by_labels(fields: Column, labels: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.element_at(fields, F.lit(x)), F.lit("")) for x in labels])


def calendar_rows(df: DataFrame, key: str, html: str, link_pattern: str) -> DataFrame:
    """Event rows of a calendar page: title and link, with day and place from up to two rows before, not beyond another event."""
    rows = df.select(key, F.posexplode(table_rows(F.col(html))).alias("row", "cells"))
    text = F.array_join(F.transform("cells", lambda c: c["text"]), " | ")
    href = F.get(F.filter(F.flatten(F.transform("cells", lambda c: c["hrefs"])), lambda h: h.rlike(link_pattern)), F.lit(0))
    flat = rows.select(key, "row", text.alias("text"), href.alias("href"))
    before = W.partitionBy(key).orderBy("row")
    event = flat.withColumn("is_event", F.col("href").isNotNull())
    one, two = F.lag("is_event", 1).over(before), F.lag("is_event", 2).over(before)
    meta1, meta2 = F.lag("text", 1).over(before), F.lag("text", 2).over(before)
    meta = F.when(one, F.lit(None)).when(normalize_date(meta1, 2000).isNotNull(), meta1).when(two, F.lit(None)).otherwise(meta2)
    out = event.withColumn("meta", meta).filter("is_event")
    return out.select(key, "row", F.col("text").alias("title"), "href", normalize_date("meta").alias("date"), "meta")


DETAIL = "struct<eventId:string,title:string,date:string,address:string,organizer:string,status:string,uri:string,eventContents:array<struct<title:string,description:string>>>"


def json_detail(df: DataFrame, payload: str, carried: list[str] = ()) -> DataFrame:
    """Title, text, links and hash of a JSON record with sections of HTML."""
    d = df.select(*carried, F.from_json(payload, DETAIL).alias("d"))
    section = F.transform(F.coalesce("d.eventContents", F.array().cast("array<struct<title:string,description:string>>")), lambda s: F.concat_ws("\n", clean(s["title"]), html_text(s["description"])))
    text = F.concat_ws("\n", F.col("d.title"), F.col("d.date"), F.col("d.address"), F.array_join(section, "\n"))
    html = F.array_join(F.transform("d.eventContents", lambda s: s["description"]), "\n")
    out = d.select(*carried, F.col("d.eventId").alias("external_id"), clean("d.title").alias("title"), text.alias("text"), F.array_distinct(F.concat(F.array_compact(F.array("d.uri")), F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)href=["']([^"']+)["']"""), F.lit(1)))).alias("links"))
    return out.withColumn("content_hash", parts_hash("title", "text"))


def generic_page(df: DataFrame, html: str, carried: list[str]) -> DataFrame:
    """Title, description, image, visible text, number of JSON-LD blocks and a content hash of any page."""
    h = F.col(html)
    out = df.select(*carried, html_title(h).alias("title"), F.coalesce(meta_content(h, "og:description"), meta_content(h, "description")).alias("description"), meta_content(h, "og:image").alias("image"), html_text(h).alias("text"), F.size(json_ld(h)).alias("json_ld_blocks"))
    return out.withColumn("content_hash", parts_hash("title", "text"))


def flattened(value) -> list[dict]:
    """All objects of JSON-LD: arrays, @graph and itemListElement opened up."""
    if isinstance(value, list):
        return [x for v in value for x in flattened(v)]
    if not isinstance(value, dict):
        return []
    inner = [x for name in ("@graph", "itemListElement", "item") if name in value for x in flattened(value[name])]
    return [value, *inner]


PEOPLE = ("performer", "competitor", "attendee", "athlete", "participant", "contestant")


def without_people(value):
    """JSON without what names participants, at every depth."""
    if isinstance(value, list):
        return [without_people(v) for v in value]
    if isinstance(value, dict):
        return {k: without_people(v) for k, v in value.items() if k.lower() not in PEOPLE}
    return value


def _typed(kind: str):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def udf(blocks: pd.Series) -> pd.Series:
        import json

        def one(texts):
            out = []
            for t in texts if texts is not None else ():
                try:
                    found = flattened(json.loads(t))
                except ValueError:
                    continue
                out += [json.dumps(without_people(o), sort_keys=True, ensure_ascii=False) for o in found if kind in (o.get("@type") if isinstance(o.get("@type"), list) else [o.get("@type")])]
            return out

        return blocks.map(one)

    return udf


def json_ld_records(html: Text, kind: str = "Event") -> Column:
    """The JSON-LD objects of a type on a page, without participants. JSON nests to any depth, so this is Python in Arrow batches."""
    return _typed(kind)(json_ld(html))


def selected_record(df: DataFrame, key: str, records: str, page_url: str) -> DataFrame:
    """How a page's records relate to its address: single, unique_match, ambiguous, url_mismatch or absent, and which one it is."""
    own = canonical(page_url)
    hits = F.filter(records, lambda r: canonical(F.get_json_object(r, "$.url")) == own)
    with_url = F.filter(records, lambda r: F.get_json_object(r, "$.url").isNotNull())
    n, m, u = F.size(records), F.size(hits), F.size(with_url)
    how = F.when(n == 0, "absent").when(m == 1, "unique_match").when(m > 1, "ambiguous").when((n == 1) & (u == 0), "single").when(u > 0, "url_mismatch").otherwise("ambiguous")
    return df.select(key, how.alias("selection"), F.when(how == "unique_match", F.get(hits, F.lit(0))).when(how == "single", F.get(F.col(records), F.lit(0))).alias("record"))


def normalized_payload(df: DataFrame, payload: str, carried: list[str] = ()) -> DataFrame:
    """html, total, has_more of a payload whose keys may be in any case; a total or flag of another type is null."""
    m = F.from_json(payload, "map<string,string>")
    low = F.map_from_entries(F.array_distinct(F.transform(F.map_entries(m), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))))
    get = lambda k: F.element_at("m", F.lit(k))
    out = df.select(*carried, F.when(F.col(payload).rlike(r"^\s*\{"), low).alias("m"), payload)
    more = F.lower(F.trim(get("hasmore")))
    return out.select(*carried, F.coalesce(get("html"), F.when(F.col("m").isNull(), F.col(payload))).alias("html"), F.when(get("recordstotal").rlike(r"^\d+$"), get("recordstotal").cast("int")).alias("total"), F.when(more == "true", True).when(more == "false", False).alias("has_more"))


def cards(df: DataFrame, key: str, html: str, card_class: str) -> DataFrame:
    """Blocks of a class with their first heading, link, day in any of three formats, place and total of finishers."""
    blocks = F.split(F.col(html), rf"""(?i)<(?:div|article|li)[^>]+class=["'][^"']*\b{card_class}\b[^>]*>""")
    rows = df.select(key, F.posexplode(F.slice(blocks, F.lit(2), F.size(blocks))).alias("position", "block"))
    text = html_text(F.col("block"))
    head = clean(F.regexp_replace(F.regexp_extract("block", r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>", 1), "<[^>]+>", " "))
    place = F.regexp_extract(text, r"([A-ZÀ-Ú][\p{L}' .-]{1,60}?)\s*[-/,]\s*([A-Z]{2})\b", 0)
    return rows.select(key, "position", head.alias("title"), F.nullif(F.regexp_extract("block", r"""(?i)href=["']([^"']+)["']""", 1), F.lit("")).alias("href"), normalize_date(text, 2000).alias("date"), F.nullif(clean(place), F.lit("")).alias("place"), _finishers(text).alias("finishers"))


def _finishers(text: Column) -> Column:
    return first_integer(F.regexp_extract(F.lower(text), r"(\d[\d.]*)\s*(?:finishers|concluintes)", 1)).cast("int")


def _inner(html: Text, tag: str, attributes: str = "") -> Column:
    """The text of the first element of a tag whose start holds the attributes (a pattern); null if there is none."""
    found = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*{attributes}[^>]*>(.*?)</{tag}>", 1)
    return F.nullif(clean(F.regexp_replace(found, "<[^>]+>", " ")), F.lit(""))


def event_page(df: DataFrame, html: str, carried: list[str] = ()) -> DataFrame:
    """name, day, city, state, finishers, modalities (name, totals by gender), endpoint and headers of a result page.

    A page without results has no endpoint and no headers, but the rest.
    """
    h = F.col(html)
    place = _inner(h, "p", """class=["'][^"']*place""")
    blocks = F.regexp_extract_all(h, F.lit(r"""(?is)(<div\b[^>]*class=["'][^"']*\bmodality\b.*?</div>)"""), F.lit(1))
    spans = lambda b: F.regexp_extract_all(b, F.lit(r"""(?is)(<span\b[^>]*data-gender=["'][^"']+["'][^>]*>.*?</span>)"""), F.lit(1))
    total = lambda x: F.struct(F.regexp_extract(x, r"""data-gender=["']([^"']+)["']""", 1).alias("gender"), first_integer(F.regexp_replace(x, "<[^>]+>", " ")).alias("total"))
    modalities = F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, r"""data-name=["']([^"']+)["']""", 1).alias("name"), F.transform(spans(b), total).alias("totals")))
    heads = F.transform(F.regexp_extract_all(h, F.lit(r"(?is)<th\b[^>]*>(.*?)</th>"), F.lit(1)), lambda x: clean(F.regexp_replace(x, "<[^>]+>", " ")))
    day = month_name_date(_inner(h, "span", """class=["']day"""), _inner(h, "span", """class=["']month"""), _inner(h, "span", """class=["']year"""))
    return df.select(
        *carried, _inner(h, "h1").alias("name"), day.alias("day"), F.nullif(F.regexp_extract(place, r"^(.*?)\s*[-/]\s*[A-Z]{2}$", 1), F.lit("")).alias("city"), F.nullif(F.regexp_extract(place, r"([A-Z]{2})$", 1), F.lit("")).alias("state"),
        _finishers(html_text(h)).alias("finishers"), modalities.alias("modalities"), F.nullif(F.regexp_extract(h, r"""(?i)<table\b[^>]*data-url=["']([^"']+)["']""", 1), F.lit("")).alias("endpoint"), heads.alias("headers"),
    )


def calendar_pages(df: DataFrame, key: str, html: str, url: str, site: str, path: str, link_pattern: str, words: str) -> DataFrame:
    """One row for each page of a calendar: url, events (how many), next_urls (other pages of it that it links to) and error.

    path: a pattern of the lower-cased paths that belong to the calendar. A page that asks
    for proof of a person is blocked; one without events ends the calendar only if it
    names itself as its own address and its text has one of the words.
    """
    def own(u: Column) -> Column:
        below = F.lower(part(u, "PATH"))
        return F.when(is_plain(u) & (host(u) == site) & below.rlike(path), F.concat(F.lit(f"https://www.{site}"), below))

    links = df.select(key, F.col(url).alias("__base"), F.explode(hrefs(html)).alias("__href"))
    here = own(F.col("__base"))
    onward = links.select(key, own(absolute("__href", "__base")).alias("to"), here.alias("here")).filter("to is not null and to != here")
    onward = onward.groupBy(key).agg(F.array_sort(F.collect_set("to")).alias("next_urls"))
    events = calendar_rows(df, key, html, link_pattern).groupBy(key).agg(F.count(F.lit(1)).alias("events"))
    both = df.join(events, key, "left").join(onward, key, "left")
    named = own(F.regexp_extract(html, r"""(?i)<link[^>]+rel=["']canonical["'][^>]+href=["']([^"']+)["']""", 1)) == own(F.col(url))
    shown = F.coalesce(named, F.lit(False)) & normalize_key(html_text(html)).rlike(words)
    n = F.coalesce("events", F.lit(0))
    error = F.when(own(F.col(url)).isNull(), "catalog_page_url_invalid").when(is_challenge(html), "source_access_blocked").when((n == 0) & ~shown, "catalog_end_unconfirmed")
    return both.select(key, own(F.col(url)).alias("url"), n.alias("events"), F.coalesce("next_urls", F.array().cast("array<string>")).alias("next_urls"), error.alias("error"))


def result_rows(df: DataFrame, key: str, html: str, headers: list[str], known: dict[str, str]) -> DataFrame:
    """Result table rows by their headers: known ones as columns, others in a map; a row with another number of cells is rejected."""
    rows = df.select(key, F.posexplode(table_rows(F.col(html))).alias("row", "cells")).filter(F.size("cells") > 0).filter(~F.exists("cells", lambda c: c["head"]))
    values = F.transform("cells", lambda c: c["text"])
    names = F.array(*[F.lit(normalize(h)) for h in headers])
    ok = F.size("cells") == len(headers)
    m = F.when(ok, F.map_from_arrays(names, values))
    out = rows.select(key, "row", ok.alias("valid"), m.alias("m"))
    wanted = {normalize(h): c for h, c in known.items()}
    rest = F.map_filter("m", lambda k, v: ~k.isin(*wanted)) if wanted else F.col("m")
    return out.select(key, "row", "valid", *[F.element_at("m", F.lit(h)).alias(c) for h, c in wanted.items()], rest.alias("other"))


def normalize(header: str) -> str:
    import re
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", header.lower()) if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", "_", plain).strip("_")


def strict_pages(df: DataFrame, group: str, offset: str, rows: str, total: str, next_: str, more: str) -> DataFrame:
    """Each result page and what is wrong with it: negative, total_changed, next_mismatch, end_not_evidenced or nothing."""
    w = W.partitionBy(group)
    end = F.col(offset) + F.col(rows)
    bad = (
        F.when((F.col(offset) < 0) | (F.col(rows) < 0) | (F.col(total) < 0), "negative")
        .when(F.min(total).over(w) != F.max(total).over(w), "total_changed")
        .when(F.col(more) & (F.coalesce(F.col(next_), F.lit(-1)) != end), "next_mismatch")
        .when(~F.col(more) & (end != F.col(total)), "end_not_evidenced")
    )
    return df.select(group, offset, bad.alias("error"))


#: Bytes 80 to 9F as Latin-1 reads them, and as windows-1252 does; five stand for nothing there and stay.
C1 = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
C1 = [(a, b) for a, b in C1 if b]


def decoded(raw: Column, declared: Column) -> Column:
    """Bytes as text: in the declared charset, else UTF-8 if valid, else windows-1252 (a Latin-1 reading with its 27 other characters)."""
    as_text, latin = raw.cast("string"), F.decode(raw, "ISO-8859-1")
    western = F.translate(latin, "".join(a for a, _ in C1), "".join(b for _, b in C1))
    return F.when(F.lower(declared).isin("iso-8859-1", "latin-1", "latin1"), latin).when(F.is_valid_utf8(as_text), as_text).otherwise(western)


def ordered_scan(df: DataFrame, order: list[Column]) -> Iterator[Row]:
    """The rows in order, one partition at a time on the driver: what a server-side cursor gives a program."""
    yield from df.orderBy(*order).toLocalIterator(prefetchPartitions=True)


def mock_pages(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Pages with given texts, for tests."""
    return spark.createDataFrame([(i, f"https://mock.example.com/{i}", t) for i, t in enumerate(texts)], "page_id long, url string, html string")
