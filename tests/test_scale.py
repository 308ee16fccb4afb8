"""Operators that spread one key over many tasks, against plain loops."""

import os
import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import parts, ranges, resolve, similar, stateful
from waymark.sources import sinks
from waymark.streaming import jobs


def jaccard(a, b):
    a, b = set(a), set(b)
    return round(len(a & b) / len(a | b), 4) if a and b else 0


# --- similar names


def names(rng, n):
    words = [f"w{i}" for i in range(30)]
    return [(i, rng.choice(["x", "y", None]), rng.choices(words[: rng.choice([4, 30])], k=rng.randrange(6))) for i in range(n)]


@pytest.mark.parametrize("least", [0.3, 0.8])
def test_similar_rows_equal_all_pairs(spark, least):
    rng = random.Random(int(least * 10))
    left, right = names(rng, 120), names(rng, 150)
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, block string, words array<string>")
    want = {(i, j): jaccard(v, w) for i, b, v in left for j, c, w in right if b is not None and b == c and jaccard(v, w) >= least}
    got = similar.similar_pairs(frame(left, "a"), frame(right, "b"), "a", "b", "words", ["block"], least)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and {(a, b): s for a, b, s in rows} == want
    best = lambda pairs: {i: min((-s, j) for (k, j), s in pairs.items() if k == i) for i, _ in pairs}
    rows = similar.best_similar(frame(left, "id"), frame(right, "match"), "id", "match", "words", ["block"], least).collect()
    assert {r["id"]: (-r["score"], r["match"]) for r in rows} == best(want) and len(rows) == len(best(want))
    own = {(i, j): jaccard(v, w) for i, b, v in left for j, c, w in left if i != j and b is not None and b == c and jaccard(v, w) >= least}
    rows = similar.best_similar(frame(left, "id"), frame(left, "match"), "id", "match", "words", ["block"], least, same=True).collect()
    assert {r["id"]: (-r["score"], r["match"]) for r in rows} == best(own)


def test_pairs_looked_at_grow_with_a_block(spark):
    """One block; names of a rare word and three common ones, and copies of one name."""

    def looked_at(n):
        k = F.col("id")
        own = [F.concat(F.lit(p), F.floor(k / m).cast("string")) for p, m in (("rare", 2), ("half", 3))]
        rows = spark.range(n).select("id", F.lit("b").alias("block"), F.when(k % 3 == 0, F.array(F.lit("same"), F.lit("name"))).otherwise(F.array(*own, F.lit("run"), F.lit("of"), F.lit("city"))).alias("words"))
        side = similar._side(rows, "id", "words", ["block"])
        return similar.candidates(similar._classes(side, side), 0.6).count()

    small, large = looked_at(1500), looked_at(12000)
    assert large <= 10 * small < 10 * 1500 * 5


def test_similarity_of_nothing(spark):
    empty = spark.createDataFrame([], "a long, block string, words array<string>")
    assert similar.similar_pairs(empty, empty.withColumnRenamed("a", "b"), "a", "b", "words", ["block"], 0.5).count() == 0
    with pytest.raises(ValueError, match="least similarity"):
        similar.similar_classes(empty, empty, 0.0)


# --- places


def test_places_and_sums(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), i, rng.choice([None, 1, 5])) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(7)
    out = ranges.placed(df, ["g"], ["k"], {"total": "v"}).collect()
    assert len(out) == 500
    for g in ("a", "b", None):
        total = 0
        for n, r in enumerate(sorted((r for r in out if r["g"] == g), key=lambda r: r["k"])):
            total += r["v"] or 0
            assert (r["place"], r["total"]) == (n, total)
    assert sorted(r["place"] for r in ranges.placed(df, [], ["k"]).collect()) == list(range(500))


# --- groups, hints, slugs


def test_linked_groups_of_text_keys_a_path_and_a_hub(spark):
    rows = [(f"p{i:05}", f"l{j}") for i in range(2000) for j in (i, i + 1)]
    rows += [(f"h{i:05}", "hub") for i in range(5000)] + [("alone", None), ("x", "own"), ("b", "two"), ("a", "two")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "key string, link string")
    folder = spark.sparkContext.getCheckpointDir()
    before = set(os.listdir(folder.removeprefix("file:"))) if folder else set()
    out = {r["key"]: (r["group"], r["size"], r["ambiguous"]) for r in resolve.linked_groups(df, "key", "link").collect()}
    assert len(out) == 2000 + 5000 + 4
    assert all(out[f"p{i:05}"] == ("p00000", 2000, True) for i in range(2000)) and all(out[f"h{i:05}"] == ("h00000", 5000, True) for i in range(5000))
    assert out["alone"] == ("alone", 1, False) and out["x"] == ("x", 1, False) and out["b"] == ("a", 2, False)
    if folder:
        assert len(set(os.listdir(folder.removeprefix("file:"))) - before) == 1  # the last round
    assert resolve.linked_groups(df.limit(0), "key", "link").count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_linked_groups_of_random_links(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(120), rng.choice([None, *range(90)])) for _ in range(160)]
    label = {k: k for k, _ in rows}
    for _ in label:
        for link in {x for _, x in rows if x is not None}:
            own = {k for k, x in rows if x == link}
            least = min(label[k] for k in own)
            label = {k: least if label[k] in {label[j] for j in own} else v for k, v in label.items()}
    out = resolve.linked_groups(spark.createDataFrame(rows, "key long, link long"), "key", "link").collect()
    assert {r["key"]: r["group"] for r in out} == label


def test_weak_candidates_equal_pairs(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "d1", "d2"]), *[rng.choice([None, 1, 2, 3]) for _ in range(3)]) for i in range(150)]
    want = {i: sum(1 for j, e, *w in rows if j != i and d is not None and d == e and any(x is not None and x == y for x, y in zip(v, w, strict=True))) for i, d, *v in rows}
    df = spark.createDataFrame([*rows, rows[0]], "id long, day string, a long, b long, c long")
    out = resolve.weak_candidates(df, "id", "day", [F.col("a"), F.col("b"), F.col("c")])
    assert {r["id"]: r["weak"] for r in out.collect()} == want
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2  # no record meets another


def test_unique_slugs(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id long, base string")
    got = resolve.unique_slugs(frame([(1, "a"), (2, "a"), (3, "a-2")]), "id", "base")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a"), (2, "a-3"), (3, "a-2")]
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "a", "b", "a-2", "a-3", "a-2-2", "b-07", "b-1", "c"])) for i in range(300)]
    taken = ["a", "a-5", "a-6", "a-7", "c-2", "c-4", "b-300", "zz", "a-2-3"]
    used, want = set(taken) | {b for _, b in rows}, {}
    free = {b for _, b in rows} - set(taken)
    for i, b in rows:
        slug, k = b, 2
        while not (slug == b and b in free) and slug in used:
            slug, k = f"{b}-{k}", k + 1
        free.discard(b) if slug == b else used.add(slug)
        want[i] = slug
    out = resolve.unique_slugs(frame(rows).repartition(5), "id", "base", spark.createDataFrame([(t,) for t in taken], "slug string")).collect()
    assert {r["id"]: r["slug"] for r in out} == want and len(set(want.values())) == 300


# --- exactly-once writes


def test_a_batch_that_failed_half_way_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "pages")
    write = jobs.exactly_once(path, ["k"], buckets=4)
    frame = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "k long, v string")
    write(frame(range(0, 20), "one"), 0)
    fails = frame(range(10, 40), "two").withColumn("v", F.when(F.col("k") == 33, F.raise_error(F.lit("broken"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken"):
        write(fails, 1)
    assert spark.read.parquet(path).count() == 20
    write(frame(range(10, 40), "two"), 1)
    write(frame(range(10, 40), "two"), 1)  # replayed
    write(frame(range(30, 50), "three"), 2)
    rows = spark.read.parquet(path).collect()
    assert sorted(r["k"] for r in rows) == list(range(50))
    assert {r["v"] for r in rows if r["k"] < 20} == {"one"} and {r["v"] for r in rows if 20 <= r["k"] < 40} == {"two"}


# --- parts with limits


def parts_by_loop(rows, most_rows, most_bytes):
    """part of each key of rows (group, key, size)."""
    out, state = {}, {}
    for g, k, s in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        part, n, total = state.get(g, (0, most_rows, 0))
        part, n, total = (part + 1, 1, s or 0) if n + 1 > most_rows or total + (s or 0) > most_bytes else (part, n + 1, total + (s or 0))
        state[g], out[k] = (part, n, total), part
    return out


@pytest.mark.parametrize(("most_rows", "most_bytes", "block"), [(3, 100, 7), (50, 60, 16), (10**6, 500, 16), (1, 0, 5), (9, 10**9, 4096)])
def test_parts_equal_a_loop(spark, most_rows, most_bytes, block):
    rng = random.Random(most_rows)
    rows = [(rng.choice(["a"] * 8 + ["b", None]), k, rng.choice([0, None, 1, 7, 30, 200])) for k in range(400)] + [(f"g{k}", k, 5) for k in range(400, 430)]
    df = spark.createDataFrame(rows, "g string, k long, size long").repartition(6)
    out = parts.accumulated_parts(df, "g", ["k"], "size", most_rows, most_bytes, block)
    assert out.columns == ["g", "k", "size", "part"]
    assert {r["k"]: r["part"] for r in out.collect()} == parts_by_loop(rows, most_rows, most_bytes)


def test_parts_of_nothing(spark):
    assert parts.accumulated_parts(spark.createDataFrame([], "g string, k long, size long"), "g", ["k"], "size", 3, 10).count() == 0
    with pytest.raises(ValueError, match="holds a row"):
        parts.accumulated_parts(spark.createDataFrame([], "g string, k long, size long"), "g", ["k"], "size", 0, 10)


# --- gates and limiters over ranges of one key


@pytest.mark.parametrize("gap", [1, 7, 61])
def test_one_key_over_many_ranges(spark, gap):
    """Requests at an even pace: where each range's first state is wrong until the one before is right."""
    rng = random.Random(gap)
    rows = [(rng.choice([None, 1, 1, 1]), i, 1_700_000_000 + i * gap + rng.choice([0, 0, 1]) * gap // 2) for i in range(1200)]
    df = spark.createDataFrame(rows, "k long, i long, s long").withColumn("at", F.col("s").cast("timestamp"))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = {r["i"]: (r["allowed"], r["retry_after"]) for r in stateful.sliding_limit(df, "k", "at", "i", 5, 60.0).collect()}
        gate = {r["i"]: (r["decision"], r["retry"]) for r in stateful.request_gate(df, "k", "at", "i", 20, 30_000, F.col("i") % 100 == 99, F.col("at") + F.expr("interval 5 minutes"), F.col("i") % 100 == 50).withColumn("retry", F.unix_seconds("retry_at")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, states, held = {}, {}, {}
    for k, i, s in sorted(rows, key=lambda r: (r[2], r[1])):
        live = [h for h in held.get(k, []) if h > s - 60]
        want[i] = (True, 0) if len(live) < 5 else (False, max(1, live[0] + 60 - s + 1))
        held[k] = [*live, s] if want[i][0] else live
    assert got == want
    want = {}
    for k, i, s in sorted(rows, key=lambda r: (r[2], r[1])):
        hour, used, ready, until = states.get(k, (0, 0, 0, None))
        if i % 100 == 50:
            refused = until is not None and until > s
            want[i], until = (("refused", until), until) if refused else (("resumed", None), None)
        elif until is not None:
            want[i] = ("blocked", until)
        else:
            hour, used = (s // 3600, 0) if s // 3600 > hour else (hour, used)
            want[i] = ("budget", (hour + 1) * 3600) if used >= 20 else ("spacing", ready) if ready > s else ("allowed", None)
            if want[i][0] == "allowed":
                used, ready, until = used + 1, s + 30, s + 300 if i % 100 == 99 else None
        states[k] = (hour, used, ready, until)
    assert gate == want


# --- whole sets


def test_a_set_is_replaced_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "sets")
    frame = lambda rows: spark.createDataFrame(rows, "root long, name string, v string")
    assert sinks.committed(spark, path) == 0
    with pytest.raises(ValueError, match="no committed"):
        sinks.read_committed(spark, path)
    assert sinks.commit_sets(frame([(1, "a", "x"), (1, "b", "x"), (2, "c", "x")]), path, "root", ["name"], ["name", "v"]) == 1
    broken = frame([(1, "d", "y")] * 50).repartition(8).withColumn("v", F.when(F.spark_partition_id() == 5, F.raise_error(F.lit("killed"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="killed"):
        sinks.commit_sets(broken, path, "root", ["name"], ["name", "v"])
    rows = lambda **k: sorted((r["root"], r["name"], r["v"]) for r in sinks.read_committed(spark, path, **k).collect())
    assert rows() == [(1, "a", "x"), (1, "b", "x"), (2, "c", "x")] and sinks.committed(spark, path) == 1
    assert sinks.commit_sets(frame([(1, "d", "y")]), path, "root", ["name"], ["name", "v"]) == 2
    assert rows() == [(1, "d", "y"), (2, "c", "x")] and rows(version=1)[0] == (1, "a", "x")
    # of two writers that read the same version the second is refused, and leaves nothing
    with pytest.raises(ValueError, match="another writer"):
        sinks.commit_whole(frame([(9, "z", "z")]), path, based_on=1)
    assert rows() == [(1, "d", "y"), (2, "c", "x")]
    assert sorted(n.split("-")[0] for n in os.listdir(path) if not n.startswith(".")) == ["_aside", "_commits", "rows", "rows"]


def test_controls_equal_a_fold(spark):
    rng = random.Random(8)
    states = {r: rng.choice(["ready", "paused", "ready", "completed", "cancelled"]) for r in range(12)}
    rows = [(rng.randrange(12), 1_700_000_000 + rng.randrange(30), rng.randrange(14), rng.choice(["pause", "resume", "pause", "resume", "cancel"])) for _ in range(300)]
    want, now, first = [], dict(states), {}
    for run, at, command, action in sorted(rows):
        if (run, command) in first:
            effect = "replayed" if first[run, command] == action else "key_conflict"
        else:
            first[run, command] = action
            effect = "refused" if now[run] in ("cancelled", "completed") else "applied"
        if effect == "applied":
            now[run] = {"pause": "paused", "cancel": "cancelled"}.get(action, "ready")
        want.append((run, at, command, action, effect, now[run]))
    runs = spark.createDataFrame(list(states.items()), "run long, state string")
    commands = spark.createDataFrame(rows, "run long, s long, command_id long, action string").withColumn("at", F.col("s").cast("timestamp")).drop("s")
    out = [(r["run"], int(r["at"].timestamp()), r["command_id"], r["action"], r["effect"], r["state"]) for r in stateful.controlled(runs, commands).collect()]
    assert sorted(out) == sorted(want)
