"""Known input/output pairs of the functions."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from waymark.functions import dates, jsons, numbers, text, urls
from waymark.operators import extract as E


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def s(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (text.clean, "  São  Paulo \n", "São Paulo"), (text.clean, None, ""), (text.strip_accents, "ÁÉÎõüçñ é", "AEIoucn e"), (text.normalize_key, " Água-Viva_2! ", "agua viva 2"),
        (text.compact_key, "São José", "sao-jose"), (text.slugify, "Meia Maratona de Florianopolis 2026", "meia-maratona-de-florianopolis-2026"), (text.slugify, "!!!", "evento"), (text.header_key, "Tempo Líquido", "tempo_liquido"),
        (text.title_header, "tempo_liquido", "Tempo Liquido"), (text.name_text, "Etapa da Corrida do Sol e Mar", "corrida sol mar"), (text.repair_mojibake, "SÃO FlorianÃ³polis", "SÃO Florianópolis"), (text.repair_mojibake, "漢 Ã³", "漢 ó"),
        (text.gender, "Fem", "Feminino"), (text.gender, "MASC", "Masculino"), (text.gender, "x", None), (text.html_escape, "<a href='x'>&\"", "&lt;a href=&#39;x&#39;&gt;&amp;&quot;"), (text.first_url, "see https://a.b/c?d=1). then", "https://a.b/c?d=1"),
        (text.formula_guard, " =1+1", "' =1+1"), (text.formula_guard, "a=1", "a=1"), (text.sha256, "x", hashlib.sha256(b"x").hexdigest()),
        (dates.normalize_date, "16/08/2026", "2026-08-16"), (dates.normalize_date, "2026-10-18T23:30:00-03:00", "2026-10-18"), (dates.normalize_date, "2026-02-30T07:00:00-03:00", None), (dates.normalize_date, "2026-10-18Tomorrow", None),
        (dates.normalize_date, "dia 5.3.26", "2026-03-05"), (dates.normalize_date, "31/02/2026", None), (dates.normalize_time, "às 7h", "07:00"), (dates.normalize_time, "7h30", "07:30"), (dates.normalize_time, "07:30", "07:30"), (dates.normalize_time, "25h", None),
        (dates.explicit_date, "16/08/2026", "2026-08-16"), (dates.explicit_date, "16 e 17/08/2026", None),
        (numbers.normalize_price, "R$ 120,50", 120.5), (numbers.normalize_price, "149.90", 149.9), (numbers.normalize_price, "R$ 1.499,90", 1499.9), (numbers.normalize_price, "BRL 1,499.90", 1499.9), (numbers.normalize_price, "1.500", 1500.0), (numbers.normalize_price, "free", None),
        (numbers.normalize_distance, "21,1 km", 21.1), (numbers.normalize_distance, "x", None), (numbers.strict_distance, "5k", 5.0), (numbers.strict_distance, "21 km", 21.0), (numbers.strict_distance, "Trail 7,5 km", 7.5), (numbers.strict_distance, "Kids", None),
        (numbers.first_integer, "1.234 atletas", 1234), (numbers.position, "0", None), (numbers.whole_number, "52.0", 52), (numbers.whole_number, "1.5", None), (numbers.whole_number, "-1", None), (numbers.whole_number, "inf", None),
        (urls.canonical, "http://www.tickets.example.com/e/run-12/?b=2&utm_source=x&a=1#top", "https://tickets.example.com/e/run-12?a=1&b=2"), (urls.canonical, "https://u:p@x.com/", None), (urls.canonical, "https://x.com:8080/a", None), (urls.canonical, "ftp://x.com/a", None),
        (urls.comparable, "https://x.com/a/?utm_a=1&b=2#c", "https://x.com/a/?b=2"), (urls.comparable, "https://x.com/a/", "https://x.com/a"), (urls.comparable, "not one", "not one"),
        (E.country_of, "Brasil.", "BR"), (E.country_of, "us", "US"), (E.country_of, "SC", None), (E.html_title, "<title> A &amp; B </title>", "A & B"), (E.html_text, "<p>a<script>x</script></p><!-- c --><b>b</b>&nbsp;c", "a\nb c"),
        (E.html_sanitized, '<div class="x"><p id="a">t</p><script>z</script></div>', "<p>t</p>"), (jsons.object_in, 'text ```json\n{"a": 1}\n``` more', '{"a": 1}'), (jsons.object_in, "none", None), (jsons.record_or_empty, "[1]", "{}"),
    ],
)
def test_pairs(spark, f, given, want):
    got = one(spark, f(s(given)))
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def test_fingerprint_and_similarity(spark):
    got = one(spark, text.fingerprint(s("Meia Maratona Florianopolis"), s("2026-08-16"), s("Florianópolis"), s("SC"), s("BR")))
    assert got == "meia-maratona-florianopolis|2026-08-16|florianopolis|sc|br"
    assert one(spark, text.token_similarity(s("Corrida do Sol"), s("corrida sol noturna"))) == pytest.approx(0.6667)
    assert one(spark, text.token_similarity(s(""), s("a"))) == 0


@pytest.mark.parametrize(("v", "floor", "want"), [("1.0.0", "1.2.0", "1.2.0"), ("1.3.0", "1.2.0", "1.3.0"), (None, "1.2.0", "1.2.0"), ("1.10.0", "1.9.9", "1.10.0"), ("x", "1.0.0", "1.0.0"), ("9", "x", "9")])
def test_semver(spark, v, floor, want):
    assert one(spark, text.semver_floor(s(v), s(floor))) == want


@pytest.mark.parametrize(("where", "country", "conflict"), [("Garuva, SC, Brasil", "BR", False), ("Porto, Portugal", "PT", False), ("Porto, Portugal, Brasil", None, True), ("Parque Brasil, Lisboa", None, False), (None, None, False)])
def test_country_in_location(spark, where, country, conflict):
    got = one(spark, E.country_in_location(s(where)))
    assert (got["country"], got["conflicting"]) == (country, conflict)


@pytest.mark.parametrize(
    ("title", "body", "want"),
    [("Corrida da Cidade", "corrida de rua", "road"), ("Corrida da Serra", "trail running", "trail"), ("X", "não é corrida de rua", "unknown"), ("X", "Veja também: trail running", "unknown"), ("X", "corrida de rua e trail run", "mixed"),
     ("Trail da Serra", "", "trail"), ("Kids Run", "", "kids"), ("Caminhada da Paz", "", "walk"), ("Caminhada e corrida", "", "unknown"), (None, None, "unknown"), ("X", "Não perca! Corrida de rua.", "road")],
)
def test_modality(spark, title, body, want):
    assert one(spark, E.modality(s(title), s(body))) == want


@pytest.mark.parametrize(("label", "body", "want"), [("Evento cancelado", "", "cancelled"), ("", "foi adiada", "postponed"), ("", "esgotado", "sold_out"), ("Finalizado", "inscrições abertas", "finished"), ("", "prova realizada", "unknown"), ("", "inscrições", "scheduled"), (None, None, "unknown")])
def test_status(spark, label, body, want):
    assert one(spark, E.status(s(label), s(body))) == want


def test_extractors(spark):
    body = "Inscrições: 1º lote R$ 89,90 até maio. PERCURSOS 5 km, 10km e 21,1 km. Raio de entrega 30 km. Retirada de kit entre 9h e 18h no dia do evento. Premiação para todos. Garuva/SC"
    assert one(spark, E.distances(s("Provas de 5 km, 10km e 21,1 km. Outra frase que separa bem as coisas e segue assim por aqui sem números por mais de cem letras, ao todo. Raio de 30 km"))) == [5.0, 10.0, 21.1]
    assert [(p["value"], p["current"]) for p in one(spark, E.prices(s(body)))] == [(89.9, True)]
    assert {r["category"] for r in one(spark, E.rules(s(body)))} == {"awards"}
    pickup = one(spark, E.kit_pickup(s(body)))
    assert pickup["same_day"] and (pickup["start"], pickup["end"]) == ("09:00", "18:00")
    place = one(spark, E.location(s("Rua A, 10 - Centro, Garuva/SC")))
    assert (place["city"], place["state"]) == ("Garuva", "SC")
    assert one(spark, E.sections_bounded(s("x PERCURSOS 5 km e 10 km MODALIDADES y"), r"(?:^|\s)PERCURSOS?\b", [r"\bMODALIDADES?\b"])) == "5 km e 10 km"
    assert one(spark, E.kit_items(s("Camiseta e medalha"), {"camis": "shirt", "medalha": "medal", "copo": "cup"})) == ["shirt", "medal"]
    assert one(spark, E.is_challenge(s("Please wait: Checking your browser")))


def test_identity(spark):
    get = lambda u: one(spark, urls.identity(s(u)))
    assert get("http://www.tickets.example.com/e/run-of-sun-123/?utm_x=1")["external_id"] == "123"
    assert get("https://results.example.com/event/abc")["external_id"] == "url:abc"
    assert get("https://calendar.example.com/sc/show.asp?choice=7")["external_id"] == "SC:7"
    for bad in ("https://tickets.example.com.evil.com/e/x-1", "https://tickets.example.com:99/e/x-1", "https://u@tickets.example.com/e/x-1", "https://tickets.example.com/other", "https://calendar.example.com/sc/show.asp?choice=7&choice=8", None):
        assert get(bad) is None
    assert len(one(spark, urls.variants(s("https://a.com/x"), s("http://a.com/x#y")))) == 9


def test_urls(spark):
    join = lambda v, b: one(spark, urls.absolute(s(v), s(b)))
    assert join("/b?c=1", "https://a.com/x/") == "https://a.com/b?c=1" and join("mailto:x@y", "https://a.com") is None and join(None, "https://a.com") is None
    assert one(spark, urls.redirect_target(s("https://a.com/r?to=https%3A%2F%2Fb.com%2Fx"), "to")) == "https://b.com/x"
    assert one(spark, urls.is_safe(s("https://a.example.com/x"), ("example.com",))) and not one(spark, urls.is_safe(s("http://127.0.0.1/x"))) and not one(spark, urls.is_safe(s("http://169.254.1.1/")))
    assert one(spark, urls.source_of_host(s("https://www.a.com/x"), {"a.com": "A"})) == "A"
    assert one(spark, urls.looks_like_registration(s("https://x.com/checkout/1"))) and one(spark, urls.looks_like_decoration(s("https://x.com/logo.png")))


def test_clock(spark):
    gap = one(spark, dates.wall_clock(F.lit("2018-11-04").cast("date"), "00:30:00", "America/Sao_Paulo"))
    assert str(gap["instant"]) == "2018-11-04 03:30:00" and gap["shifted_minutes"] == 60
    week = one(spark, dates.weekly_coalesced(F.lit("2026-01-05"), F.lit("2026-02-03")))
    assert (str(week["latest"]), week["coalesced_weeks"], str(week["next"])) == ("2026-02-02", 4, "2026-02-09")
    assert one(spark, dates.weekly_coalesced(F.lit("2026-01-05"), F.lit("2026-01-01"))) is None
    assert one(spark, dates.week_index(F.lit("1970-01-12").cast("date"))) == 1
    assert one(spark, dates.every_n_weeks(F.lit("1970-01-19").cast("date"), F.lit("1970-01-05").cast("date"), 2))
    assert one(spark, dates.month_name_date(s("7"), s("Março"), s("2026"))) == "2026-03-07" and one(spark, dates.month_name_date(s("31"), s("fev"), s("2026"))) is None


def test_numbers(spark):
    assert one(spark, numbers.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(math.pi * 6371)
    assert [one(spark, numbers.retry_delay(F.lit(n))) for n in (0, 3, 20)] == [30, 240, 1800]
    assert [one(spark, numbers.idle_delay(F.lit(n))) for n in (0, 9)] == [1000, 15000]
    assert one(spark, numbers.coverage(F.lit(1), F.lit(3))) == 33.3 and one(spark, numbers.coverage(F.lit(0), F.lit(0))) == 0.0
    assert one(spark, numbers.growth_estimate(F.struct(F.lit(1).alias("a")))) == 65_536 + 8 * 7
    assert one(spark, numbers.positive_or(s("x"), 5)) == 5 and one(spark, numbers.clamp(F.lit(7), 0, 5)) == 5


def test_json(spark):
    raw = s('{"b": [1, "x", {"d": 1, "c": 2}], "a": "t", "n": 3.5, "e": {"value": "v", "confidence": 2, "sourceText": "q"}}')
    assert one(spark, jsons.text_at(raw, "$.a")) == "t" and one(spark, jsons.text_at(raw, "$.n")) is None and one(spark, jsons.number_at(raw, "$.n")) == 3.5
    assert one(spark, jsons.texts_at(raw, "$.b")) == ["x"] and one(spark, jsons.as_array(raw, "$.a")) == ["t"] and one(spark, jsons.has_any(raw, "$.b", ["x"]))
    e = one(spark, jsons.as_evidence(raw, "$.e"))
    assert (e["value"], e["confidence"], e["source_text"]) == ("v", 1.0, "q")
    assert one(spark, jsons.as_evidence(raw, "$.a"))["confidence"] == 0.5
    assert one(spark, jsons.canonical_json(s('{"b": 1, "a": {"d": 1, "c": 2}}'))) == '{"a":{"c":2,"d":1},"b":1}'
    assert one(spark, jsons.canonical_map(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2)))) == '{"a":2,"b":1}'


def test_utf16_slice(spark):
    assert one(spark, text.utf16_slice(s("abcdef"), 1, 3)) == "bc"
    assert one(spark, text.utf16_slice(s("a🙂b"), 0, 2)) == "a" and one(spark, text.utf16_slice(s("a🙂b"), 0, 3)) == "a🙂" and one(spark, text.utf16_slice(s("a🙂b"), 2, 4)) == "b"
