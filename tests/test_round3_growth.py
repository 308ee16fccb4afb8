"""Findings of round 3 on growth: what a query made, held or moved grew faster than its input before."""

from pyspark.sql import functions as F

from waymark import plans
from waymark.functions import numbers
from waymark.operators import lineage, parts, ranges
from waymark.operators import resolve as M
from waymark.operators import stateful as Q

plans.load()


def test_cascade_makes_no_pairs_of_records_that_share_a_key(spark, monkeypatch):
    """300 records on each side that agree in source and id, link, address and fingerprint: 90,000 pairs of each rank."""
    seen = "array<struct<date:string,city:string,state:string,country:string>>"

    def records(n, first):
        same = lambda v: F.lit(v)
        return spark.range(first, first + n).select(
            "id", F.when(F.col("id") % 2 == 0, "s").otherwise(F.col("id").cast("string")).alias("source"), same("7").alias("external_id"), F.array(same("l"), same("m")).alias("links"), F.array(same("u"), same("v")).alias("urls"), same("2026-08-16").alias("date"),
            same("Garuva").alias("city"), same("SC").alias("state"), same("BR").alias("country"), same("Corrida").alias("name"), same("f").alias("fingerprint"), same("published").alias("status"), F.array().cast(seen).alias("observed"),
        )

    latest, hits = M.latest, []
    monkeypatch.setattr(M, "latest", lambda df, *rest: hits.append(df.count()) or latest(df, *rest))
    got = {r["id"]: (r["match"], r["rank"], r["automatic"], r["reason"]) for r in M.match_cascade(records(300, 0), records(300, 1000)).collect()}
    assert got == {i: (1000, 1, True, "same_source") if i % 2 == 0 else (1000, 2, False, "link_ambiguous") for i in range(300)}
    assert hits[0] <= 4 * 300
    one = {r["id"]: (r["match"], r["rank"], r["automatic"], r["reason"]) for r in M.match_cascade(records(2, 1), records(1, 1000)).collect()}
    assert one == {1: (1000, 2, False, "observation_unconfirmed"), 2: (1000, 1, True, "same_source")}


def test_curated_and_extracted_rows_are_dealt_over_tasks(spark):
    for name in ("b5_curated", "e16_source_extraction"):
        assert plans.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 16, name


def test_price_is_searched_for_once_a_row(spark):
    """The search stands once in the plan, not once for each use of what was found."""
    cases = {"R$ 1.499,90": 1499.9, "BRL 1,234.567": 1234.567, "1.499": 1499.0, "12,5": 12.5, "1.499,": 1499.0, "5,": 5.0, "a 7 x 8": 7.0, "1.2.3": 12.3, ".5": 5.0, "": None, None: None, "1.234.56": 1234.56}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "x string, want double")
    got = rows.select("x", "want", numbers.normalize_price("x").alias("got"))
    assert all(r["got"] == r["want"] for r in got.collect())
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_extract") == 1


def test_places_are_folded_once_a_row(spark):
    place = "struct<date:string,city:string,state:string,country:string>"
    pairs = [
        (("2026-08-16", " SÃO  josé", "SC", "BR"), ("2026-08-16T10", "sao jose", "sc", "br"), None), (("2026-08-16", "a", None, "BR"), ("2026-08-16", "a", "sc", "br"), "location_unconfirmed"), (("2026-08-16", "a", None, "BR"), ("2026-08-16", "b", "sc", "br"), "location_conflict"),
        (("", "a", "SC", "BR"), ("2026-08-16", "b", "sc", "br"), "date_unconfirmed"), ((None, "a", "SC", "BR"), ("2026-08-16", "b", "sc", "br"), "date_unconfirmed"), (("2026-08-17", "a", "SC", "BR"), ("2026-08-16", "b", "sc", "br"), "date_mismatch"), (("2026-08-16", "  ", "SC", "BR"), ("2026-08-16", "b", "sc", "br"), "location_unconfirmed"),
        (None, ("2026-08-16", "b", "sc", "br"), "date_unconfirmed"), (("2026-08-16", "Garuva ", "SC", "BR"), ("2026-08-16", "GARUVA", "sc", "br"), None),
    ]
    seen = spark.createDataFrame(pairs, f"a {place}, b {place}, want string").select("want", M.location_evidence("a", "b").alias("got"))
    assert all(r["got"] == r["want"] for r in seen.collect())
    assert seen._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 6  # three fields of two sides


def test_parts_of_small_groups_take_no_pointers(spark, monkeypatch):
    """Groups that lie in one range are done by one pass; only those on a border go by pointers."""
    whole, asked = parts._by_pointers, []
    monkeypatch.setattr(parts, "_by_pointers", lambda rows, *rest: asked.append(rows.count()) or whole(rows, *rest))
    rows = spark.range(4000).select(F.floor(F.col("id") / 5).alias("g"), "id", F.lit(30).alias("size"))
    got = parts.accumulated_parts(rows, "g", ["id"], "size", 3, 70).collect()
    assert len(got) == 4000 and all(r["part"] == r["id"] % 5 // 2 + 1 for r in got)
    assert sum(asked) <= 5 * 4


def test_ranges_grow_in_number_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(lineage, "ROWS_HELD", 100)
    out = ranges.placed(spark.range(2000).select("id", F.lit(1).alias("v")), [], ["id"], {"total": "v"}).collect()
    assert sorted((r["id"], r["place"], r["total"]) for r in out) == [(i, i, i + 1) for i in range(2000)]
    assert lineage.tasks_over(spark.range(2000)) == 20 and lineage.tasks_over(spark.range(10)) == 4


def test_a_key_that_never_forgets_takes_few_rounds(spark):
    """Requests at an even pace, so each decision hangs on the first request: the state goes through 40 ranges, not a round for each."""
    k = F.col("id")
    rows = spark.range(8000).select((k % 101 == 0).cast("int").alias("key"), k.alias("i"), F.timestamp_seconds(1_700_000_000 + k).alias("at"))
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.sparkContext.setJobGroup("limit", "limit")
    try:
        got = {r["i"]: (r["allowed"], r["retry_after"]) for r in Q.sliding_limit(rows, "key", "at", "i", 2, 600.5).collect()}
    finally:
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("limit"))
        spark.sparkContext._jsc.clearJobGroup()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, held = {}, {0: [], 1: []}
    for i in range(8000):
        live = held[i % 101 == 0] = [h for h in held[i % 101 == 0] if h > i - 600.5]
        want[i] = (True, 0) if len(live) < 2 else (False, max(1, int(live[0] + 600.5 - i) + 1))
        if want[i][0]:
            live.append(i)
    assert got == want
    assert jobs < 40
