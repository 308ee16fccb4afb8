"""Findings of round 3, each by a case that came out wrong, or grew too fast, before."""

import hashlib

from pyspark.sql import functions as F

from waymark.functions import text
from waymark.operators import extract as E
from waymark.operators import relational as R


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_title_keeps_entities_that_are_not_markup(spark):
    page = F.lit("<title>a &quot;b&quot; &lt;c&gt; &amp; d</title>")
    assert value(spark, E.html_title(page, E.MARKUP)) == "a &quot;b&quot; <c> & d"
    assert value(spark, E.html_title(page)) == 'a "b" <c> & d'


def test_stop_words_beside_letters_beyond_ascii(spark):
    assert value(spark, text.name_text(F.lit("dasßtzie eßa Corrida da Sé e2"))) == "tzie a corrida se e2"


def test_set_hash_covers_every_row_hash(spark):
    sets = {1: ["b", "a", "a"], 2: ["x"], None: ["n", "m"], 3: [str(i) for i in range(25_000)]}
    rows = spark.createDataFrame([(g, v) for g, values in sets.items() for v in values], "g long, v string").repartition(5)
    own = lambda values: hashlib.sha256("\n".join(sorted(hashlib.sha256(v.encode()).hexdigest() for v in values)).encode()).hexdigest()
    assert {r["g"]: r["content_hash"] for r in R.set_hash(rows, "g", F.col("v")).collect()} == {g: own(v) for g, v in sets.items()}


def test_quality_model_is_fitted_on_long_texts_from_a_file(spark, monkeypatch):
    """Bags of more than one piece, batches of more than one run, and no table of them on the driver."""
    from pyspark.sql.classic.dataframe import DataFrame

    from waymark.llm import quality

    def refused(self):
        raise AssertionError("the sample came to the driver whole")

    monkeypatch.setattr(DataFrame, "toArrow", refused)
    monkeypatch.setattr(DataFrame, "collect", refused)
    monkeypatch.setattr(quality, "ROWS", 500)
    words = {1: "The river runs past the old mill and the town. ", 0: "buy NOW $$$ !!! click $$$ "}
    rows = [(i, words[i % 2] * (2 if i % 5 else 900), i % 2) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = quality.train(docs.repartition(3), labels)
    again = quality.train(docs.repartition(7), labels)
    monkeypatch.undo()
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert min(s for k, s in scores.items() if k % 2) > max(s for k, s in scores.items() if not k % 2)
    assert max(abs(scores[r["doc_id"]] - r["score"]) for r in quality.score(docs, again).collect()) < 0.01


def test_variants_are_counted_and_not_paired(spark):
    left = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"]), (3, ["z"]), (4, None), (1, ["c"])], "l long, v array<string>")
    right = spark.createDataFrame([(10, "a"), (10, "b"), (11, "a"), (11, "a"), (12, "c"), (13, None), (9, "b")], "r long, w string")
    got = {r["l"]: (r["candidates"], r["first_candidate"], r["ambiguous"]) for r in R.by_variants(left, right, "l", F.col("v"), "r", "w").collect()}
    assert got == {1: (4, 9, True), 2: (1, 12, False)}
    many = lambda n: spark.range(n).select((F.col("id") % 2 + 1).cast("string").alias("w"), "id")
    rows = R.by_variants(many(3000).select(F.col("id").alias("l"), F.array("w").alias("v")), many(3000).select(F.col("id").alias("r"), "w"), "l", F.col("v"), "r", "w")
    joins = [line for line in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert rows.count() == 3000 and rows.filter("candidates = 1500").count() == 3000 and joins


def test_any_key_pairs_are_made_once_without_a_shuffle_of_pairs(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", None), (3, None, 7), (3, "b", 8), (4, None, None)], "l long, x string, y long")
    right = spark.createDataFrame([(1, "a", 5), (2, "b", 7), (2, "b", 8), (3, "c", 5)], "r long, x string, y long")
    keys = [F.col("x"), F.col("y")]
    out = R.by_any_key(left, right, keys, keys, "l", "r")
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1), (1, 3), (2, 1), (3, 2)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join Inner")]


def test_parts_of_one_group_are_spread(spark):
    rows = spark.range(5000).select(F.lit("g").alias("g"), "id").repartition(3)
    out = R.parts_by_rows(rows, ["id"], 7, ["g"])
    assert all(r["part"] == r["id"] // 7 + 1 for r in out.collect())
    assert "row_number" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_costly_rows_of_one_row_group_are_dealt_over_tasks(spark):
    from waymark import plans

    plans.load()
    for name in ("e5_distances", "e6_prices", "e7_kit", "s13_event_page"):
        assert plans.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 16, name
    plan = plans.QUERIES["s5_calendar"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan[plan.index("ArrowEval") :]
