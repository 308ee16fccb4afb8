"""Values read off prose: the texts are made from the tables' numbers, and SQL says what must be found."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsons
from ..operators import extract as E
from ..operators import resolve as M
from . import dealt, query, table

#: A sentence that says nothing, longer than any context that is looked at.
FILLER = " Este texto serve apenas para separar as frases umas das outras e nada diz sobre o evento em si mesmo, nem antes nem depois, por mais que se leia."


def _text(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def _one_of(n, *values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))


@query("""SELECT p_partkey, array_to_string(list_transform(list_sort(list_distinct([p_size::DOUBLE, CASE WHEN p_size % 7 = 0 THEN 5.0 ELSE p_size % 7 + 0.5 END::DOUBLE])), lambda x: CAST(x AS VARCHAR)), ',') AS km FROM part""")
def e5_distances(spark, d):
    """E5: distances of a route; radius and delivery don't count."""
    n = F.col("p_size")
    body = _text("Percursos de ", n.cast("string"), " km, ", (n % 7).cast("string"), ",5km e ", n.cast("string"), "K.", FILLER, " Entrega em um raio de 33 km.", FILLER, " Ultra de 160 milhas.")
    return dealt(spark, d, "part").select("p_partkey", F.array_join(F.transform(E.distances(body), lambda k: k.cast("string")), ",").alias("km"))


@query("""SELECT p_partkey, '2º lote' AS name, (p_size + 20.9)::DOUBLE AS value, 'open' AS status, true AS current FROM part
UNION ALL SELECT p_partkey, 'Lote 2', (1000 + p_size)::DOUBLE, 'unknown', false FROM part UNION ALL SELECT p_partkey, 'Lote 3', 5.0::DOUBLE, 'unknown', false FROM part WHERE p_partkey % 2 = 0""")
def e6_prices(spark, d):
    """Prices of the entry with the lots they're named by; those of a pickup don't count, equal ones count once."""
    n = F.col("p_size").cast("string")
    last = F.when(F.col("p_partkey") % 2 == 0, F.lit(" Valor: R$ 5,00")).otherwise(_text(" Valor: R$ 1.0", F.lpad(n, 2, "0"), ",00"))
    body = _text("Inscrições abertas, 2º lote R$ ", (F.col("p_size") + 20).cast("string"), ",90.", FILLER, " Taxa de retirada de kit R$ 15,00.", FILLER, " A partir de R$ 1.0", F.lpad(n, 2, "0"), ",00.", FILLER, last)
    return dealt(spark, d, "part").select("p_partkey", F.inline(E.prices(body))).select("p_partkey", "name", F.round("value", 2).alias("value"), "status", "current")


@query("""SELECT c_custkey, ['Medalha para concluintes,Chip de cronometragem', 'Camiseta', '', 'Numero de peito'][c_custkey % 4 + 1] AS items FROM customer""")
def e7_kit(spark, d):
    """What belongs to a kit, from its own section before any other."""
    body = _one_of(F.col("c_custkey") % 4, "O que te espera: chip e medalhas. Modalidades: 5 km. Cerveja ao final", "Leve o kit com camiseta. Retirada no dia, com chip", "Nada de especial", "Número de peito para todos")
    return dealt(spark, d, "customer").select("c_custkey", F.array_join(E.kit_items(body), ",").alias("items"))


@query("""SELECT o_orderkey, o_orderkey % 4 <> 3 AS found, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderkey % 4 = 1 END AS same_day, CASE WHEN o_orderkey % 4 < 2 THEN lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR), 2, '0') || ':00' END AS opens, CASE WHEN o_orderkey % 4 < 2 THEN '18:00' END AS closes, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderkey % 4 = 2 END AS by_others FROM orders""")
def e8_kit_pickup(spark, d):
    """Hours of the pickup, whether it's on the day, and whether others may come."""
    k, hours = F.col("o_orderkey") % 4, _text(" entre ", (F.col("o_orderkey") % 12 + 1).cast("string"), "h e 18h")
    body = F.when(k == 0, _text("Texto. Retirada de kit", hours, " na loja.")).when(k == 1, _text("RETIRADA DE KIT no dia da prova", hours)).when(k == 2, _text("Retirada de kit por terceiros com formulário")).otherwise("Sem kit")
    p = E.kit_pickup(body)
    return dealt(spark, d, "orders").select("o_orderkey", p.alias("p")).select("o_orderkey", F.col("p").isNotNull().alias("found"), "p.same_day", F.col("p.start").alias("opens"), F.col("p.end").alias("closes"), "p.by_others")


@query("""WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, lpad(CAST(o_orderkey % 10 + 1 AS VARCHAR), 2, '0') || ':30' AS at_ FROM orders)
SELECT o_orderkey, 'start' AS activity, CASE WHEN o_orderkey % 3 < 2 THEN day END AS date, CASE WHEN o_orderkey % 3 > 0 THEN at_ END AS time FROM o
UNION ALL SELECT o_orderkey, 'kit_pickup', CASE WHEN o_orderkey % 3 < 2 THEN day END, '06:00' FROM o WHERE o_orderkey % 2 = 0""")
def e9_schedule(spark, d):
    """The start, said or given, and a pickup on the day."""
    k = F.col("o_orderkey")
    said = F.when(k % 3 > 0, _text("Largada a partir das ", (k % 10 + 1).cast("string"), "h30, na praça. ")).otherwise("")
    pickup = F.when(k % 2 == 0, "Retirada de kit no dia do evento entre 6h e 7h.").otherwise("")
    day = F.when(k % 3 < 2, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", F.inline(E.schedule(F.concat(said, pickup), day, F.lit(None).cast("string")))).select("o_orderkey", "activity", "date", "time")


@query("""SELECT s_suppkey, c.category, c.text FROM supplier, (VALUES ('awards', 'Premiação para os ' || 3 || ' primeiros'), ('age', 'Idosos 60+ têm 50% off'), ('route', 'Percurso em meio à natureza')) c(category, text)
WHERE (c.category = 'awards' AND s_suppkey % 2 = 0) OR (c.category = 'age' AND s_suppkey % 3 = 0) OR (c.category = 'route' AND s_suppkey % 5 = 0)""")
def e10_rules(spark, d):
    """Rules by category, each to the end of its sentence."""
    k = F.col("s_suppkey")
    body = _text("Regras. ", F.when(k % 2 == 0, "Premiação para os 3 primeiros. ").otherwise(""), F.when(k % 3 == 0, "Idosos 60+ têm 50% off. ").otherwise("Idosos 60+ são bem-vindos. "), F.when(k % 5 == 0, "Percurso em meio à natureza. ").otherwise("Percurso em meio urbano. "))
    return table(spark, d, "supplier").select("s_suppkey", F.inline(E.rules(body))).select("s_suppkey", "category", "text")


CASES = (
    ("Corrida da Cidade", "corrida de rua", "road"), ("Corrida da Serra", "trail running", "trail"), ("X", "não é corrida de rua", "unknown"), ("X", "Veja também: trail running", "unknown"), ("X", "provas de rua e corridas de montanha", "mixed"), ("Trail da Serra", "", "trail"), ("Kids Run", "", "kids"), ("Caminhada da Paz", "", "walk"), ("Caminhada e corrida", "", "unknown"), ("X", "Não perca! Maratona de rua.", "road"), ("X", "Modalidade: road", "road"),
    ("X", "prova com asfalto", "unknown"), ("X", "maratona com rua", "unknown"), ("X", "corrida no montanha", "unknown"), ("X", "Percursos com trilhas, praias e dunas", "trail"), ("X", "corrida, de rua", "unknown"), ("Desafio", "Corrida de rua 5 km. Trail running 10 km.", "mixed"),
    ("Circuito Run", "Largada na Rua das Flores, asfalto novo no estacionamento", "unknown"), ("Corrida de Verão", "Acesse Trilha do Líder e veja as trilhas do nosso menu", "unknown"), ("X", "Outras provas: corrida de rua", "unknown"), ("X", "nao " + "x" * 95 + " corrida de rua", "unknown"), ("X", "nao " + "x" * 97 + " corrida de rua", "road"), ("X", "maratona de asfalto", "unknown"), ("X", "percurso  em\tasfalto", "road"))


@query(f"""SELECT event_id, [{', '.join(f"'{c[2]}'" for c in CASES)}][event_id % {len(CASES)} + 1] AS modality FROM events""")
def e12_modality(spark, d):
    """Modality from explicit evidence that nothing before it in its clause denies."""
    k = F.col("event_id") % len(CASES)
    return table(spark, d, "events").select("event_id", E.modality(_one_of(k, *[c[0] for c in CASES]), _one_of(k, *[c[1] for c in CASES])).alias("modality"))


ADDRESSES = ("Rua A, 10 - Centro, Garuva/SC", "Parque do Sol - São Paulo/SP", "Av. Brasil, 100, Joinville - SC, Brasil", "Rua das Flores/RJ", "Lisboa, Portugal")


@query("""SELECT c_custkey, ['Garuva', 'São Paulo', 'Joinville', NULL, NULL][c_custkey % 5 + 1] AS city, ['SC', 'SP', 'SC', NULL, NULL][c_custkey % 5 + 1] AS state, [NULL, NULL, 'BR', NULL, 'PT'][c_custkey % 5 + 1] AS country FROM customer""")
def e13_locations(spark, d):
    """City, state and country of an address; streets and venues aren't cities."""
    where = _one_of(F.col("c_custkey") % 5, *ADDRESSES)
    return table(spark, d, "customer").select("c_custkey", E.location(where).alias("p"), E.country_in_location(where)["country"].alias("country")).select("c_custkey", "p.city", "p.state", "country")


@query("""SELECT p_partkey, p_brand AS name, CASE WHEN p_partkey % 2 = 0 THEN '2026-08-16' END AS date, CASE WHEN p_partkey % 3 > 0 THEN 'Garuva' END AS city, CASE WHEN p_partkey % 3 > 0 THEN 0.9 ELSE 0.0 END AS city_sure,
array_to_string(list_filter([CASE WHEN p_partkey % 2 = 1 THEN 'missing_date' END, CASE WHEN p_partkey % 3 = 0 THEN 'missing_city' END, CASE WHEN p_partkey % 3 = 0 THEN 'missing_state' END, CASE WHEN p_partkey % 3 = 0 THEN 'country_unconfirmed' END, CASE WHEN p_partkey % 5 = 0 THEN 'missing_registration_url' END], lambda x: x IS NOT NULL), ',') AS warnings,
CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 > 0 AND p_partkey % 5 > 0 THEN 0.92 ELSE 0.72 END AS confidence, CASE WHEN p_partkey % 4 = 0 THEN 'cancelled' ELSE 'unknown' END AS status, 'trail' AS modality, 1 AS distances FROM part""".replace("0.9 ELSE 0.0 END AS city_sure", "0.9::DOUBLE ELSE 0.0::DOUBLE END AS city_sure").replace("THEN 0.92 ELSE 0.72 END", "THEN 0.92::DOUBLE ELSE 0.72::DOUBLE END"))
def e16_source_extraction(spark, d):
    """The fields of a source's JSON record and of its text, with warnings and confidences; each source names its own paths."""
    k = F.col("p_partkey")
    record = F.to_json(F.struct(F.col("p_brand").alias("nome"), F.when(k % 2 == 0, "16/08/2026").alias("dia"), F.when(k % 3 > 0, "Garuva, SC, Brasil").alias("local"), F.when(k % 5 > 0, "https://x.example.com/1").alias("uri"), F.when(k % 4 == 0, "Cancelado").alias("status")))
    rows = dealt(spark, d, "part").select("p_partkey", record.alias("record"), F.lit("Um trail run de 12 km.").alias("body"))
    out = E.source_extraction(rows, "record", "body", ["p_partkey"], E.Fields(name=("$.title", "$.nome"), day=("$.dia",), address=("$.local",)))
    return out.select("p_partkey", F.col("name.value").alias("name"), F.col("date.value").alias("date"), F.col("city.value").alias("city"), F.col("city.confidence").alias("city_sure"), F.array_join("warnings", ",").alias("warnings"), "confidence", "status", "modality", F.size("distances").alias("distances"))


@query("""SELECT doc_id, nullif(trim(split_part(text, chr(10), 1)), '') AS name, nullif(regexp_extract(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), '') AS date, 1 AS attempts FROM documents""")
def e17_model(spark, d):
    """A model's answers as evidence, here of its stand-in."""
    out = E.model_extraction(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")
    return out.select("doc_id", jsons.as_evidence("answer", "$.name")["value"].alias("name"), jsons.as_evidence("answer", "$.date")["value"].alias("date"), "attempts")


CITIES = ("Garuva", "Rua XV", "3 Barras", "Centro Novo", "Lagoa Santa", "Arena do Sol", "")


@query("""SELECT c_custkey, c_custkey % 7 IN (0, 3, 4) AS safe FROM customer""")
def b28_safe_city(spark, d):
    """Whether a city is fit to be shown: no street or venue, no leading digit."""
    return table(spark, d, "customer").select("c_custkey", M.safe_city(_one_of(F.col("c_custkey") % 7, *CITIES)).alias("safe"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'trail' WHEN p_partkey % 4 = 1 THEN 'road' ELSE 'unknown' END AS modality FROM part""")
def b29_quoted_modality(spark, d):
    """A distance's modality holds only by a quote that stands in the text and names that distance."""
    k, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    quote = F.when(k == 0, _text("trail run de ", n, " km")).when(k == 1, _text("Corrida de rua, ", n, " km")).when(k == 2, _text("trail run de 99 km")).otherwise(_text("trail run de ", n, " km"))
    body = F.when(k == 3, "outro texto").otherwise(_text("Venha!  ", F.upper(quote), " e mais"))
    return table(spark, d, "part").select("p_partkey", E.quoted_modality(quote, F.col("p_size").cast("double"), body).alias("modality"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Rua A, Garuva, SC' WHEN 1 THEN s_name || ', Garuva' END AS address, CASE s_suppkey % 2 WHEN 0 THEN 'https://x.example.com/2' END AS offer_url, 'Garuva' AS city, 'Garuva, SC' AS place FROM supplier""")
def b30_addresses(spark, d):
    """Postal addresses joined, the first offer's address, a city before a colon, a place without its country."""
    k = F.col("s_suppkey")
    where = F.when(k % 3 == 0, '{"address": "Rua A, Garuva, SC"}').when(k % 3 == 1, F.to_json(F.struct(F.struct(F.col("s_name").alias("streetAddress"), F.lit("Garuva").alias("addressLocality")).alias("address")))).otherwise("{}")
    offers = F.when(k % 2 == 0, '[{"price": "1"}, {"url": "https://x.example.com/2"}]').otherwise('{"price": "30"}')
    return table(spark, d, "supplier").select("s_suppkey", E.postal_address(where).alias("address"), jsons.first_text(offers, "url").alias("offer_url"), E.city_before_colon(F.lit("Garuva, Brasil: centro")).alias("city"), E.without_country(F.lit("Garuva, SC, Estados Unidos.")).alias("place"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'missing_state,low' WHEN 1 THEN 'low' WHEN 2 THEN 'missing_state,low,country_unconfirmed' ELSE 'missing_state,low' END AS warnings FROM customer""")
def b31_warnings(spark, d):
    """A foreign record with a place needs no state; one without a country says so."""
    k = F.col("c_custkey") % 4
    country = _one_of(k, "BR", "pt", "", "PT")
    given = F.array(F.lit("missing_state"), F.lit("low"), F.lit("low"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(E.normalized_warnings(given, country, F.when(k == 3, "").otherwise("Lisboa")), ",").alias("warnings"))
