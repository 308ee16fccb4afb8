"""Whitening, Merkle manifests and web archives against brute force, and on odd input."""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import merkle, warc, whitening
from waymark.llm._store import shared_dir

# --- whitening


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def by_numpy(rows, components=32):
    """x, eigenvalues and the whitened rows' absolute values, without merging."""
    x = np.array([[np.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows])
    value, way = np.linalg.eigh(np.cov(x.T, bias=True))
    value, way = value[::-1][:components], way[:, ::-1][:, :components]
    return x, value, np.abs((x - x.mean(0)) @ way / np.sqrt(value))


@pytest.mark.parametrize("parts", [1, 3, 70])
def test_whitening_equals_an_eigendecomposition(spark, parts):
    rng = np.random.default_rng(parts)
    mix = rng.normal(size=(40, 40))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate((rng.normal(size=(300, 40)) @ mix + 5).astype(np.float32))]
    bad = [(-1, None), (-2, []), (-3, [*rows[0][1][:-1], None]), (-4, [*rows[0][1][:-1], float("nan")]), (-5, [*rows[0][1][:-1], float("inf")])]
    df = vectors(spark, rows + bad).repartition(parts)
    out = whitening.whiten(df, whitening.train(df)).toPandas()
    x, value, white = by_numpy(rows)
    assert len(out) == 300 * 32 and set(out.n) == {300}
    got = out.pivot(index="vec_id", columns="component", values="whitened").loc[range(300)].to_numpy()
    assert np.allclose(np.abs(got), white, atol=1e-8)
    assert np.abs(np.cov(got.T, bias=True) - np.eye(32)).max() < 1e-9 and out.identity_error.max() < 1e-9
    share = out.groupby("component").explained.first()
    assert np.allclose(share, value / np.cov(x.T, bias=True).trace(), rtol=1e-9)
    sums = [int(c) for c in x.sum(0)]
    exact = {i: sum((300 * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for i, row in enumerate(x)}
    assert {r.vec_id: r.deviation for r in out.itertuples()} == exact


def test_merging_loses_nothing():
    rng = np.random.default_rng(5)
    x = whitening.whole(rng.normal(size=(500, 30)) * np.logspace(3, -1, 30))
    cuts = np.split(x, [1, 2, 9, 40, 41, 300])
    whole = whitening.Summary.of(x)
    merged = whitening.Summary.of(cuts[0])
    for part in cuts[1:]:
        merged = merged.merged(whitening.Summary.of(part))
    assert merged.sums == whole.sums == [int(c) for c in x.astype(np.int64).sum(0)] and merged.n == 500
    assert np.allclose(merged.values, whole.values, rtol=1e-10)
    back = whitening.Summary.read(merged.row(30))
    assert back.sums == merged.sums and np.array_equal(back.vectors, merged.vectors)


def test_whitening_of_odd_input(spark):
    empty = vectors(spark, [])
    assert whitening.whiten(empty, whitening.train(empty)).count() == 0
    # one vector, equal ones, directions without spread, two lengths, a null key, great entries
    rows = [(None, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (2, [2.0, 2.0, 3.0]), (3, [1.0, 5.0]), (4, [3e38, 1.0, 1.0, 1.0]), (5, [0.0, 1.0, 1.0, 1.0])]
    df = vectors(spark, rows).withColumns({n: F.lit("x") for n in ("n", "Component", "whitened", "__v")})
    out = whitening.whiten(df, whitening.train(df)).collect()
    three = [r for r in out if r["n"] == 4]
    assert len(three) == 4 * 3 and {r["explained"] for r in three if r["component"] == 1} == {1.0}
    assert all(r["whitened"] is None and r["explained"] == 0 for r in three if r["component"] > 1)
    # x of the first entry is 1000064 three times and 1000128: 4 x - S is -64 and 192
    assert sorted(r["deviation"] for r in three if r["component"] == 1) == [64**2] * 3 + [192**2]
    assert np.isclose(sum(r["whitened"] ** 2 for r in three if r["component"] == 1) / 4, 1)
    assert [r["whitened"] for r in out if r["vec_id"] == 3] == [None, None]
    assert {r["deviation"] for r in out if r["vec_id"] in (4, 5)} == {None}


# --- manifests


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + arity])) for i in range(0, len(levels[-1]), arity)])
    return levels


def path(levels, i, arity):
    steps = []
    for level in levels[:-1]:
        low = i // arity * arity
        steps.append(("".join(level[low:i]), "".join(level[i + 1 : low + arity])))
        i //= arity
    return steps


def manifest_by_loop(rows, arity):
    """(group, key, leaf, subroot, root, path) of rows (key, group, text)."""
    groups = {}
    for key, group, text in rows:
        groups.setdefault(group, []).append((key is not None, key or 0, H(enc(key) + enc(group) + enc(text))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([leaf for *_, leaf in sorted(groups[g])], arity) for g in names}
    forest = tree([trees[g][-1][0] for g in names], arity)
    return sorted(
        (repr(g), key if has else None, leaf, trees[g][-1][0], forest[-1][0], path(trees[g], i, arity) + path(forest, k, arity))
        for k, g in enumerate(names)
        for i, (has, key, leaf) in enumerate(sorted(groups[g]))
    ) if names else []


@pytest.mark.parametrize(("arity", "depth"), [(2, 10), (2, 2), (3, 1), (5, 2)])
def test_manifest_equals_a_loop(spark, arity, depth):
    rng = random.Random(arity * 10 + depth)
    sizes = {"en": 150, None: 9, "": 1, "é": 8, "zz": 2, "Z": 25, "\U0001f600": 3, "￮": 3}
    rows = [(rng.randrange(10**6), g, rng.choice([None, "", "a", "long " * 999, "é\n"])) for g, n in sizes.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "k long, g string, t string").withColumns({n: F.lit(0) for n in ("tree", "node", "item", "each", "range")}).repartition(5)
    out, _ = merkle.manifest(df, merkle.leaf_of(F.col("k"), F.col("g"), F.col("t")), "g", "k", arity=arity, depth=depth)
    out = out.withColumn("again", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    got = sorted((repr(r["group"]), r["key"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["path"]]) for r in out)
    assert got == manifest_by_loop(rows, arity)
    assert all(r["again"] == r["root"] for r in out)


def test_manifest_of_odd_input(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert merkle.digests(spark.createDataFrame([], schema)).count() == 0
    # equal rows, a key of many rows, null keys, all nulls; crc32 of 3 is divisible by 7
    rows = [(3, "a", "en", "s", 1)] * 40 + [(3, "b", "en", "s", 1), (None, None, None, None, None), (None, "x", "en", None, 5), (3, "c", "fr", None, None)]
    df = spark.createDataFrame(rows, schema).repartition(4)
    hit = zlib.crc32(b"3") % 7 == 0
    out = merkle.digests(df).collect()
    assert len(out) == len(rows) and len({r["root"] for r in out}) == 1 and len({r["subroot"] for r in out}) == 3
    for r in out:
        changed = hit and r["doc_id"] == 3 and r["leaf"] != H(enc(3) + "-" + enc("fr") + "-" + enc("c"))
        assert r["verified"] == (not changed) == (r["folded_root"] == r["root"])
    alone = next(r for r in out if r["leaf"] == H("-----"))
    assert alone["subroot"] == alone["leaf"]


def test_manifest_finds_what_was_changed(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.col("id").alias("n_chars"))
    out = merkle.digests(docs)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    assert out.filter(hit == F.col("verified")).count() == 0 and 300 < out.filter(~F.col("verified")).count() < 600
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


# --- archives


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def archive(spark, df, **more):
    return warc.read_archive(spark, warc.write_archive(df, "page_id", "url", "html", **more))


def test_archive_gives_payloads_back(spark):
    rng = random.Random(1)
    odd = ["", "\r\n\r\n", "WARC/1.1\r\n\r\n" * 300, "\r\n" * 5000, "é\n" * 400, "x" * 3_000_000, "\r\r\n\r\n\n" * 20000, None, "\r", "\n", "a\r\n", "a\r\n\r"]
    odd += ["".join(rng.choices("\r\na", k=rng.randrange(70_000))) for _ in range(30)]
    rows = [(i, f"http://h/{i}", t) for i, t in enumerate(odd)]
    records = archive(spark, pages(spark, rows).repartition(3)).collect()
    assert len(records) == 3 * len(rows) and all(r["complete"] for r in records)
    found = {r["uri"]: bytes(r["payload"]).decode() for r in records if r["type"] == "response"}
    assert found == {u: t or "" for _, u, t in rows}
    assert all(r["digest_ok"] for r in records if r["type"] == "response")
    assert len({r["id"] for r in records}) == len(records)


def test_revisits_and_captures(spark):
    long, short = "é" * 500, "e" * 999  # 1,000 and 999 bytes
    rows = [(i, f"http://h/{i}?a#b", long) for i in range(40)] + [(100 + i, None, short) for i in range(5)] + [(None, "u v", long), (7, "http://other", "alone" * 300), (None, None, None)]
    folder = warc.write_archive(pages(spark, rows).repartition(4).withColumn("key", F.lit(1)).withColumn("body", F.lit(2)), "page_id", "url", "html")
    records = warc.read_archive(spark, folder)
    out = warc.captures(records).collect()
    assert len(out) == len(rows)
    for r in out:
        assert len(r["requests"]) == len(r["metadata"]) == 1 and r["requests"][0]["type"] == "request"
        key = next((f["value"] for f in r["metadata"][0]["fields"] if f["name"] == "key"), None)
        is_long = r["original"] is not None or bytes(r["main"]["payload"]).decode() == long
        if is_long and key != "39":
            assert r["main"]["type"] == "revisit" and r["main"]["payload_bytes"] == 0
            assert bytes(r["original"]["payload"]).decode() == long and [f["value"] for f in r["original"]["about"] if f["name"] == "key"] == ["39"]
        else:
            assert r["main"]["type"] == "response" and r["original"] is None
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.digests(pages(spark, rows)).collect())
    want = []
    for i, _, t in rows:
        body = (t or "").encode()
        again = t == long and i != 39
        want.append((str(i), len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", 39 if again else None))
    assert got == sorted(want)


def test_repeated_pages_and_empty_tables(spark):
    rows = [(1, "u", "z" * 2000)] * 30 + [(1, "t", "z" * 2000), (2, "u", "short"), (2, "u", "short")]
    out = [(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.digests(pages(spark, rows).repartition(3)).collect()]
    assert sorted(out, key=str) == sorted([(1, "response", None)] * 30 + [(1, "revisit", 1)] + [(2, "response", None)] * 2, key=str)
    assert warc.digests(pages(spark, [])).count() == 0


def test_foreign_archives(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n\x00\xff\r\n\r\nbytes"
    sha1 = base64.b32encode(hashlib.sha1(b"\x00\xff\r\n\r\nbytes").digest()).decode()

    def record(kind, name, block, *more):
        head = "\r\n".join([f"WARC/1.0\r\nwarc-type: {kind}", f"WARC-Record-ID: <{name}>", *more, f"Content-Length: {len(block)}"])
        return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    whole = [
        record("warcinfo", "i", b"software: x\r\n", "Content-Type: application/warc-fields"),
        record("request", "q", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        record("response", "r", body, "Content-Type: application/http; msgtype=response", "WARC-Concurrent-To: <q>", "WARC-Concurrent-To:", " <m>", f"WARC-Payload-Digest: sha1:{sha1}"),
        record("metadata", "m", b"a: 1\r\n b\r\n", "Content-Type: application/warc-fields"),
        record("resource", "s", b"plain", "WARC-Payload-Digest: sha1:00"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in whole))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(whole[4][:-12]))
    rows = warc.read_archive(spark, str(tmp_path)).collect()
    by = {r["id"]: r for r in rows if r["complete"]}
    assert len(rows) == 6 and [r["id"] for r in rows if not r["complete"]] == ["<s>"]
    assert bytes(by["<r>"]["payload"]) == b"\x00\xff\r\n\r\nbytes" and by["<r>"]["digest_ok"] and not by["<s>"]["digest_ok"] and by["<i>"]["digest_ok"] is None
    assert [(f["name"], f["value"]) for f in by["<m>"]["fields"]] == [("a", "1 b")]
    out = {r["main"]["id"]: r for r in warc.captures(warc.read_archive(spark, str(tmp_path / "a.warc.gz"))).collect()}
    assert set(out) == {"<r>", "<s>"} and [x["id"] for x in out["<r>"]["requests"]] == ["<q>"] and [x["id"] for x in out["<r>"]["metadata"]] == ["<m>"]
    assert out["<s>"]["requests"] == [] and out["<s>"]["original"] is None
    (tmp_path / "c.txt").write_bytes(b"no archive\r\n\r\n")
    with pytest.raises(Exception, match="no record begins"):
        warc.read_archive(spark, str(tmp_path / "c.txt")).collect()


def test_queries_leave_only_results(spark):
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    merkle.digests(spark.createDataFrame([(1, "a", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")).collect()
    warc.digests(pages(spark, [(1, "u", "x")])).collect()
    vecs = vectors(spark, [(1, [1.0, 2.0]), (2, [2.0, 1.0])])
    whitening.whiten(vecs, whitening.train(vecs)).collect()
    assert {x.split("-")[0] for x in set(os.listdir(folder)) - before} == {"manifest", "captures"}
