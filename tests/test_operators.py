"""Operators on small known rows, and those without SQL against plain loops."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from waymark import plans
from waymark.operators import batches as B
from waymark.operators import extract as E
from waymark.operators import relational as R
from waymark.operators import resolve as M
from waymark.operators import stateful as Q
from waymark.sources import datasource, readers, sinks, workbooks

FOLDER = "/root/testdata/sf0.001"
plans.load()


def test_matching_ignores_what_is_not_asked(spark):
    df = spark.createDataFrame([(1, "Abc"), (2, "xyz")], "id long, name string")
    assert R.matching(df, equal={"id": None}, contains={"name": ""}).count() == 2
    assert [r["id"] for r in R.matching(df, contains={"name": "BC"}).collect()] == [1]
    assert [r["id"] for r in R.matching(df, contains={"name": "a."}).collect()] == []


def test_page_is_bounded(spark):
    df = spark.range(500)
    assert R.page(df, [F.col("id")], size=1000).count() == 100
    assert [r["id"] for r in R.page(df, [F.col("id")], number=3, size=2).collect()] == [4, 5]
    with pytest.raises(ValueError):
        R.refused_beyond(df, 499)


def test_parts_are_refused_beyond_their_bounds(spark):
    df = spark.createDataFrame([(1, i, "x" * 40) for i in range(10)], "g long, k long, t string")
    got = [r["part"] for r in sinks.selection_parts(df, "g", ["k"], ["t"], 4, 100).orderBy("k").collect()]
    assert got == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    for bounds in ((4, 39, 10_000), (4, 100, 399)):
        with pytest.raises(ValueError, match="export_too_large"):
            sinks.selection_parts(df, "g", ["k"], ["t"], *bounds)


def test_long_lists_are_read_whole(spark):
    lot = "struct<name:string,value:double,current:boolean>"
    many = [("n", float(i), False) for i in range(105)]
    df = spark.createDataFrame([(1, many[:2], many[2:])], f"k long, a array<{lot}>, b array<{lot}>")
    got = R.merged_lots(df, "k", ["a", "b"], ["name", "value"]).collect()
    assert len(got) == 105 and [r["value"] for r in got if r["current"]] == [0.0]
    html = "".join(f'<div class="card"><h3>Run {i}</h3></div>' for i in range(300))
    assert readers.cards(spark.createDataFrame([(1, html)], "k long, html string"), "k", "html", "card").count() == 300
    with pytest.raises(Exception, match="more than 5 values"):
        R.counts_map(spark.range(6), "id", 5).collect()


def test_gate_as_in_use(spark):
    at = lambda s: datetime(2026, 1, 1, 10, 0, s)
    rows = [("a", 1, at(0), False), ("a", 2, at(0), False), ("b", 3, at(0), True), ("b", 4, at(9), False), ("c", 5, at(0), False), ("c", 6, at(0), False), ("c", 7, at(2), False), ("d", 8, datetime(2026, 1, 1, 10, 59), False), ("d", 9, datetime(2026, 1, 1, 11, 0), False)]
    df = spark.createDataFrame(rows, "k string, id long, ts timestamp, shut boolean")
    got = {r["id"]: (r["decision"], r["retry_at"]) for r in Q.request_gate(df.filter("k != 'c'"), "k", "ts", "id", 1, 0, F.col("shut")).collect()}
    assert got == {1: ("allowed", None), 2: ("budget", datetime(2026, 1, 1, 11)), 3: ("allowed", None), 4: ("blocked", None), 8: ("allowed", None), 9: ("allowed", None)}
    # a request that comes too soon uses up neither the budget nor the spacing
    got = {r["id"]: r["decision"] for r in Q.request_gate(df.filter("k = 'c'"), "k", "ts", "id", 2, 1000).collect()}
    assert got == {5: "allowed", 6: "spacing", 7: "allowed"}


def test_limiter_tells_whole_seconds(spark):
    at = lambda ms: datetime(2026, 1, 1, 0, 0, 0, 0).replace(second=ms // 1000, microsecond=ms % 1000 * 1000)
    df = spark.createDataFrame([("a", i, at(ms)) for i, ms in enumerate((0, 500, 10_000, 10_001))], "k string, id long, ts timestamp")
    got = [(r["allowed"], r["retry_after"]) for r in Q.sliding_limit(df, "k", "ts", "id", 1, 10).orderBy("id").collect()]
    assert got == [(True, 0), (False, 10), (True, 0), (False, 10)]


def test_rules_refuse_a_write(spark):
    df = spark.range(3)
    assert Q.guarded(df, {"none": df.filter("id > 5")}).count() == 3
    with pytest.raises(ValueError, match="refused by big"):
        Q.guarded(df, {"none": df.filter("id > 5"), "big": df.filter("id > 1")})


def test_workbooks(spark, tmp_path):
    import zipfile
    from datetime import date

    columns = {"event_id": "ID", "day": "Data", "at": "Hora", "name": "Nome", "n": "N", "none": "Nada"}
    rows = [(1, 7, date(2026, 8, 16), datetime(2026, 8, 16, 12), "=a & <b>", 2.5, None), (2, 8, None, None, "c", 1.0, None)]
    df = spark.createDataFrame(rows, "part int, event_id long, day date, at timestamp, name string, n double, none string")
    files = workbooks.workbooks(df, "part", ["event_id"], columns)
    one = {r["part"]: bytes(r["content"]) for r in files.collect()}
    assert workbooks.sheet_rows(one[1]) == [list(columns.values()), ["7", "46250", "46250.5", "'=a & <b>", "2.5"]]
    assert one[1] == workbooks.workbook([r[1:] for r in rows[:1]], columns)
    assert workbooks.sheet_rows(workbooks.workbook([], columns)) == [list(columns.values()), []]
    path = sinks.export_workbooks(files, str(tmp_path), "out")
    with zipfile.ZipFile(path) as archive:
        assert archive.namelist() == ["out-1.xlsx", "out-2.xlsx"] and archive.read("out-2.xlsx") == one[2]
    assert sinks.export_workbooks(files.filter("part = 1"), str(tmp_path), "one").endswith("one.xlsx")
    with pytest.raises(ValueError, match="export_too_large"):
        sinks.export_workbooks(files, str(tmp_path), "out", 100)
    assert [workbooks.column_name(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_scopes(spark):
    from datetime import date

    assert B.normalized_scope({}, date(2020, 1, 1))["date_from"] == date(2020, 1, 1)
    assert B.normalized_scope({"mode": "single", "url": "https://x.example.com/"}, date(2020, 1, 1))["event_urls"] == ["https://x.example.com/"]
    for bad in ({"mode": "selected", "event_ids": [" "]}, {"mode": "single"}):
        with pytest.raises(ValueError):
            B.normalized_scope(bad, date(2020, 1, 1))


def test_adapter_hooks(spark, tmp_path):
    import sys

    (tmp_path / "own_adapter.py").write_text("SCHEMA = 'name string, n int'\ndef fetch(part):\n    yield from [(part, 1), (part, 2)]\ndef refuse(part):\n    assert part != 'bad', 'refused'\ndef only_two(part, row):\n    return row if row[1] == 2 else None\n")
    sys.path.insert(0, str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "own_adapter.py"))
    datasource.register(spark)
    read = lambda parts: spark.read.format("waymark_adapter").option("module", "own_adapter").option("partitions", parts).option("before", "own_adapter:refuse").option("after", "own_adapter:only_two").load()
    assert sorted(r["name"] for r in read("a,b").collect()) == ["a", "b"]
    with pytest.raises(Exception, match="refused"):
        read("a,bad").collect()


def test_frontier_depths(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 10)], "node long, to long")
    got = {r["node"]: r["depth"] for r in Q.frontier(spark.createDataFrame([(1,)], "node long"), edges).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 3}
    chain = spark.range(25).select(F.col("id").alias("node"), (F.col("id") + 1).alias("to"))
    start = spark.createDataFrame([(0,)], "node long")
    assert Q.frontier(start, chain).count() == 26 and Q.frontier(start, chain, 2).count() == 3


def test_links_as_urllib(spark):
    from urllib.parse import urljoin

    page = [(1, "https://a.com/x/y", '<a href="/b">1</a><a href="c?d">2</a><a href="mailto:z@z">3</a><a href="/b">4</a><a href="#t">5</a>')]
    got = E.links(spark.createDataFrame(page, "page_id long, url string, html string"), "html", "url", "page_id")
    assert {r["url"] for r in got.collect()} == {urljoin("https://a.com/x/y", h) for h in ("/b", "c?d", "#t")}


def test_cross_source_reason(spark):
    side = "struct<source:string,external_id:string,status:string,date:string,city:string,state:string,country:string>"
    base = ("a", "1", "published", "2026-01-01", "Garuva", "SC", "BR")
    rows = [(0, base, ("a", "2", *base[2:])), (1, base, ("b", "1", "hidden", *base[3:])), (2, base, ("b", "1", "x", "2026-01-02", *base[4:])), (3, base, ("b", "1", "x", "2026-01-01", "GARÚVA", "sc", "br"))]
    df = spark.createDataFrame(rows, f"k int, l {side}, r {side}")
    got = [r["w"] for r in df.orderBy("k").select(M.cross_source_reason("l", "r", F.lit(True), F.array("r")).alias("w")).collect()]
    assert got == ["source_identity_conflict", "restricted", "date_mismatch", None]


def test_merged_fields(spark):
    df = spark.createDataFrame([(("a", None, "c"), ("x", "y", "z"), ["f"], ["h"])], "l struct<f:string,g:string,h:string>, r struct<f:string,g:string,h:string>, pl array<string>, pr array<string>")
    assert tuple(df.select(*M.merged_fields("l", "r", ["f", "g", "h"], "pl", "pr", F.lit(True))).first()) == ("a", "y", "z")
    assert tuple(df.select(*M.merged_fields("l", "r", ["f", "g", "h"], "pl", "pr", F.lit(False))).first()) == ("a", "y", "z")


def test_survivors_skip_empty(spark):
    rows = [(1, 1, "", ["x"], []), (1, 2, "b", ["y"], ["k"]), (1, 3, "c", [], ["l"])]
    df = spark.createDataFrame(rows, "g long, p int, name string, warn array<string>, kids array<string>")
    got = M.survivors(df, "g", [F.asc("p")], ["name"], lists=["kids"], unions=["warn"], greatest=["p"]).first()
    assert (got["name"], got["kids"], got["warn"], got["p"]) == ("b", ["k"], ["x", "y"], 3)


def test_claim_respects_exclusive_groups(spark):
    at = datetime(2026, 1, 1)
    rows = [("a1", "a", "running"), ("a2", "a", "queued"), ("b1", "b", "queued"), ("c1", "c", "queued"), ("c2", "c", "queued")]
    df = spark.createDataFrame([(i, s, "results", st, at, at, False, 0, 3, datetime(2026, 1, 2)) for i, s, st in rows], "id string, source string, kind string, status string, created timestamp, available timestamp, hold boolean, attempt int, max_attempts int, lease_until timestamp")
    now = F.lit(datetime(2026, 1, 1, 1))
    assert sorted(r["id"] for r in Q.claimed(df, now).collect()) == ["b1", "c1"]
    assert sorted(r["id"] for r in Q.claimed(df, now, exclusive=("a", "b")).collect()) == ["c1"]
    assert [r["id"] for r in Q.claimed(df, now, per_source=False).collect()] == ["b1"]


def test_readers(spark):
    html = "<table><tr><td>16/08/2026 Garuva</td></tr><tr><td><a href='show?id=1'>Run A</a></td></tr><tr><td><a href='show?id=2'>Run B</a></td></tr></table>"
    got = readers.calendar_rows(spark.createDataFrame([(1, html)], "k long, html string"), "k", "html", "show").orderBy("row").collect()
    assert [(r["title"], r["date"]) for r in got] == [("Run A", "2026-08-16"), ("Run B", None)]
    ld = '<script type="application/ld+json">{"@graph": [{"@type": "Event", "url": "https://a.com/e", "competitor": {"name": "z"}}, {"@type": "Place"}]}</script><script type="application/ld+json">bad</script>'
    page = spark.createDataFrame([(1, "https://www.a.com/e/", ld)], "k long, url string, html string").select("k", "url", readers.json_ld_records("html").alias("records"))
    row = readers.selected_record(page, "k", "records", "url").first()
    assert row["selection"] == "unique_match" and "competitor" not in row["record"]
    payload = spark.createDataFrame([('{"HTML": "<p>", "recordsTotal": "12", "hasMore": "true"}',), ("<p>raw",), ('{"html": "x", "recordsTotal": "1.5", "hasMore": "maybe"}',)], "p string")
    assert [tuple(r) for r in readers.normalized_payload(payload, "p").collect()] == [("<p>", 12, True), ("<p>raw", None, None), ("x", None, None)]
    cards = '<div class="card big"><h3>Run <b>A</b></h3><a href="/a">x</a> <span>16/08/2026</span> <p>Garuva - SC</p> 120 finishers</div><div class="card"><h3>Run B</h3></div>'
    got = readers.cards(spark.createDataFrame([(1, cards)], "k long, html string"), "k", "html", "card").orderBy("position").collect()
    assert [(r["title"], r["href"], r["date"], r["finishers"]) for r in got] == [("Run A", "/a", "2026-08-16", 120), ("Run B", None, None, None)]
    raw = spark.createDataFrame([(bytearray("São".encode("cp1252")), None), (bytearray("São".encode()), None), (bytearray("é".encode("latin-1")), "ISO-8859-1")], "b binary, c string")
    assert [r[0] for r in raw.select(readers.decoded(F.col("b"), F.coalesce("c", F.lit("")))).collect()] == ["São", "São", "é"]
    pages = spark.createDataFrame([(1, 0, 10, 15, 10, True), (1, 10, 5, 15, None, False), (2, 0, 5, 9, None, False)], "g int, o int, n int, t int, x int, m boolean")
    assert [r["error"] for r in readers.strict_pages(pages, "g", "o", "n", "t", "x", "m").orderBy("g", "o").collect()] == [None, None, "end_not_evidenced"]
    detail = '{"eventId": "5", "title": " Run ", "uri": "https://a.com", "eventContents": [{"title": "T", "description": "<p>x <a href=\\"/q\\">y</a></p>"}]}'
    got = readers.json_detail(spark.createDataFrame([(detail,)], "p string"), "p").first()
    assert got["title"] == "Run" and "/q" in got["links"] and "x y" in got["text"]
    assert readers.dispatched(readers.mock_pages(spark, ["a"]), "url", [readers.Adapter("mock", ("example.com",))]).first()["adapter"] == "mock"


def test_ordered_scan(spark):
    rows = spark.range(50).withColumn("k", F.col("id") % 7)
    assert [(r["k"], r["id"]) for r in readers.ordered_scan(rows, [F.desc("k"), F.asc("id")])] == sorted(((i % 7, i) for i in range(50)), key=lambda x: (-x[0], x[1]))


def test_sqlite_source(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (id INTEGER, name TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(i, f"n{i}") for i in range(100)])
    datasource.register(spark)
    df = spark.read.format("waymark_sqlite").schema("id int, name string").option("path", path).option("table", "t").option("columns", "id, name").option("partitions", "3").load()
    assert df.count() == 100 and df.agg(F.sum("id")).first()[0] == 4950 and df.rdd.getNumPartitions() == 3
    with sqlite3.connect(path) as db:
        db.execute("INSERT INTO t (rowid, id, name) VALUES (1000000000, 1000, NULL)")
    tests = ["id = 5", "id > 90", "id >= 10 and id < 20", "name = 'n7'", "name > 'n9'", "id in (1, 2, 1000)", "name is null", "name is not null and id <= 3", "name like 'n1%'", "id % 2 = 0", "name in ('n1', 'x')", "not id = 5"]
    rows = [(i, f"n{i}") for i in range(100)] + [(1000, None)]
    same = spark.createDataFrame(rows, "id int, name string")
    for test in tests:
        assert sorted(map(str, df.filter(test).collect())) == sorted(map(str, same.filter(test).collect())), test
    some = df.filter("id > 90")
    sizes = [len(p) for p in some.rdd.glom().collect()]
    assert sum(sizes) == 10 and len(sizes) == 3 and max(sizes) <= 4  # a gap of rowids doesn't count, nor what is filtered out
    reader = datasource.SqliteReader({"path": path, "table": "t", "columns": "id, name"})
    from pyspark.sql.datasource import EqualTo, StringContains

    assert list(reader.pushFilters([EqualTo(("id",), 5), StringContains(("name",), "x")])) == [StringContains(("name",), "x")]
    assert [r for p in reader.partitions() for r in reader.read(p)] == [(5, "n5")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1), (2, "=b", 2), (3, "c", 1)], "id long, name string, part int")
    path = str(tmp_path / "t")
    sinks.write_replacing(df, path, "part")
    sinks.write_replacing(df.filter("id = 3"), path, "part")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [2, 3]
    sinks.export_parts(sinks.export_columns(df, {"id": "Id", "name": "Name"}), str(tmp_path / "csv"), ["Id"], 1)
    back = spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()
    assert sorted(r["Name"] for r in back) == ["'=b", "a", "c"]
    assert len(list((tmp_path / "csv").glob("part-*.csv"))) == 3
    assert len({r["row_id"] for r in sinks.with_row_ids(df, ["id", "name"]).collect()}) == 3


def test_strict_plan_has_pushdown(spark):
    plan = plans.QUERIES["j4_some"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice" in plan and "PushedFilters" in plan
    scan = plans.QUERIES["listing_total"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in scan.split("ReadSchema", 1)[1].split("\n")[0]
