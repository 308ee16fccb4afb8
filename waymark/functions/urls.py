"""URL identity, comparison and safety."""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import Text, _c, clean


class Route(NamedTuple):
    """A page that stands for a record: its source, host, path pattern and what the id is made of.

    The id is the pattern's group `group`, or the query parameter `parameter`, with
    `prefix` or the upper-cased group before it.
    """

    source: str
    host: str
    path: str
    group: int = 1
    parameter: str | None = None
    prefix: str = ""


#: Example routes; an application gives its own.
ROUTES = (
    Route("tickets", "tickets.example.com", r"(?i)^/e/[^/]*-(\d+)/?$"),
    Route("results", "results.example.com", r"^/event/([^/]+)/?$", prefix="url:"),
    Route("calendar", "calendar.example.com", r"(?i)^/([A-Za-z]{2})/show\.asp$", parameter="choice"),
)


def part(url: Text, name: str) -> Column:
    return F.try_parse_url(_c(url), F.lit(name))


def host(url: Text) -> Column:
    return F.regexp_replace(F.lower(part(url, "HOST")), r"^www\.", "")


def kept_query(url: Text) -> Column:
    """The query's parameters without utm_*, in order; null if none is left."""
    own = F.filter(F.split(part(url, "QUERY"), "&"), lambda p: ~p.startswith("utm_") & (p != ""))
    return F.nullif(F.array_join(F.array_sort(own), "&"), F.lit(""))


def is_plain(url: Text) -> Column:
    """http or https, no credentials, no port."""
    return F.lower(part(url, "PROTOCOL")).isin("http", "https") & part(url, "USERINFO").isNull() & ~F.coalesce(part(url, "AUTHORITY"), F.lit("")).rlike(r":\d*$")


def canonical(url: Text) -> Column:
    """https, no www., fragment, utm_* or closing slash, sorted parameters; null for what isn't a plain web address."""
    path = F.regexp_replace(F.coalesce(part(url, "PATH"), F.lit("")), "/$", "")
    query = kept_query(url)
    return F.when(is_plain(url), F.concat(F.lit("https://"), host(url), path, F.coalesce(F.concat(F.lit("?"), query), F.lit(""))))


def identity(url: Text, routes: tuple[Route, ...] = ROUTES) -> Column:
    """source, external_id and url of an address that some route knows; null for any other."""
    out = F.lit(None)
    kind = "struct<source:string,external_id:string,url:string>"
    for r in routes:
        path = part(url, "PATH")
        found = F.regexp_extract(path, r.path, r.group)
        if r.parameter:
            name = f"{r.parameter}="
            values = F.filter(F.split(F.coalesce(part(url, "QUERY"), F.lit("")), "&"), lambda p: p.startswith(name))  # noqa: B023
            value = F.regexp_extract(F.get(values, F.lit(0)), "=(.*)$", 1)
            ok = (F.size(values) == 1) & value.rlike(r"^\d+$")
            found = F.when(ok & (found != ""), F.concat(F.upper(found), F.lit(":"), value))
        else:
            found = F.concat(F.lit(r.prefix), F.nullif(found, F.lit("")))
        own = F.struct(F.lit(r.source).alias("source"), found.alias("external_id"), canonical(url).alias("url")).cast(kind)
        out = F.when(is_plain(url) & (host(url) == r.host) & found.isNotNull(), own).otherwise(out)
    return out


def variants(url: Text, original: Text | None = None) -> Column:
    """Spellings of a canonical address: protocol, www. and closing slash; the original one too."""
    rest = F.regexp_replace(_c(url), "^https://", "")
    bare, query = F.regexp_extract(rest, r"^([^?]*)", 1), F.regexp_extract(rest, r"(\?.*)?$", 0)
    all_ = [F.concat(F.lit(p + w), bare, F.lit(s), query) for p in ("http://", "https://") for w in ("", "www.") for s in ("", "/")]
    return F.array_distinct(F.array(*([_c(original)] if original is not None else []), _c(url), *all_))


def comparable(url: Text) -> Column:
    """Without fragment, utm_* and closing slash; what isn't an address stays as it is."""
    query = F.nullif(F.array_join(F.filter(F.split(part(url, "QUERY"), "&"), lambda p: ~p.startswith("utm_")), "&"), F.lit(""))
    whole = F.concat(part(url, "PROTOCOL"), F.lit("://"), part(url, "AUTHORITY"), F.coalesce(part(url, "PATH"), F.lit("")), F.coalesce(F.concat(F.lit("?"), query), F.lit("")))
    return F.coalesce(F.regexp_replace(whole, "/$", ""), _c(url))


@F.pandas_udf(T.StringType())
def _joined(value: pd.Series, base: pd.Series) -> pd.Series:
    from urllib.parse import urljoin, urlsplit

    def one(v, b):
        try:
            out = urljoin(b or "", v or "")
            return out if v and urlsplit(out).scheme in ("http", "https") and urlsplit(out).netloc else None
        except ValueError:
            return None

    return pd.Series([one(v, b) for v, b in zip(value, base, strict=True)], dtype=object)


def absolute(value: Text, base: Text) -> Column:
    """An address made whole against a base; null unless it's http(s). Relative paths take Python, in Arrow batches."""
    v = clean(value)
    return F.when(v.rlike("(?i)^https?://[^/]"), v).otherwise(_joined(v, _c(base)))


def redirect_target(url: Text, parameter: str) -> Column:
    """The decoded address in a query parameter, if it's http(s)."""
    raw = F.try_url_decode(F.try_parse_url(_c(url), F.lit("QUERY"), F.lit(parameter)))
    return F.when(raw.rlike("(?i)^https?://"), raw)


def is_safe(url: Text, hosts: tuple[str, ...] = ()) -> Column:
    """A plain web address whose host is allowed and isn't in a private range."""
    name = F.lower(part(url, "HOST"))
    private = name.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|0\.|\[)") | name.endswith(".local") | name.endswith(".internal")
    allowed = F.lit(not hosts)
    for h in hosts:
        allowed = allowed | (name == h) | name.endswith("." + h)
    return F.coalesce(is_plain(url) & ~private & allowed, F.lit(False))


def source_of_host(url: Text, sources: dict[str, str], default: str = "official") -> Column:
    """The source whose host a URL has, or one below it."""
    name = F.lower(part(url, "HOST"))
    out = F.lit(default)
    for h, source in reversed(list(sources.items())):
        out = F.when((name == h) | name.endswith("." + h), source).otherwise(out)
    return out


#: What stands in the path of a page to register on.
REGISTRATION = ("inscri", "evento", "event", "checkout", "ticket")


def looks_like_registration(url: Text, hosts: tuple[str, ...] = ("tickets", "register")) -> Column:
    """By words in its host or path."""
    has = lambda name, words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.lower(part(url, name)).contains(w))
    return F.coalesce(has("HOST", hosts), F.lit(False)) | F.coalesce(has("PATH", REGISTRATION), F.lit(False))


#: Names of pictures that aren't of the event.
DECORATION = ("logo", "favicon", "icon", "avatar", "pixel", "tracking", "banner-ad", "publicidade")


def looks_like_decoration(url: Text) -> Column:
    """An image that isn't of the event: a name in its address between marks (the last one may be a dot) is that of a logo, an icon, an advert or the like."""
    # a name may hold a mark itself, so it is looked for as that many parts
    parts = F.split(F.lower(_c(url)), "[/_-]")
    marks = F.regexp_extract_all(F.lower(_c(url)), F.lit("[/_-]"), F.lit(0))

    def at(k, name):
        own = name.split("-")
        last = F.get(parts, k + len(own) - 1)
        out = (F.substring_index(last, ".", 1) == own[-1]) & (last.contains(".") | (k + len(own) < F.size(parts)))
        for i, word in enumerate(own[:-1]):
            out = out & (F.get(parts, k + i) == word) & (F.get(marks, k + i) == "-")
        return F.coalesce(out, F.lit(False))

    def any_at(k):
        out = F.lit(False)
        for name in DECORATION:
            out = out | at(k, name)
        return out

    return F.coalesce(F.exists(F.sequence(F.lit(0), F.size(parts) - 1), any_at), F.lit(False))
