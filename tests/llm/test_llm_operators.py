"""The training-data operators against brute force, the public libraries, and edge cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.llm import chat, decontaminate, jaccard, language, licenses, lm, media, pieces, quality, registry, toxicity
from waymark.llm._graph import components
from waymark.llm._tokens import BY_SPACE, WORDS, shingles, tokenize

FOLDER = "/root/testdata/sf0.001"
#: Null, empty and blank texts, repeated rows, a null key, a text of one word, ties; extra columns with clashing names.
EDGE = [
    (1, None, "en", 0.5, True, "x"), (2, "", "en", 0.5, True, "x"), (3, " \n\t", None, 0.5, False, "x"), (4, "one", "en", 0.5, False, "x"),
    (5, "the same words in two rows of text", "en", 0.5, False, "x"), (5, "the same words in two rows of text", "en", 0.5, False, "x"),
    (6, "The same, words in two rows of TEXT!", "fr", 0.5, False, "x"), (None, "a text without any key at all here", "en", 0.5, False, "x"),
    (7, "漢字🙂 ▁ \x00 é ß", "de", 0.5, False, "x"), (8, "!!! ??? ...", "de", 0.5, False, "x"), (9, "word " * 30000, "en", 0.5, False, "x"), (10, "x" * 100_000, "es", 0.5, False, "x"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string, lang string, score double, held_out boolean, license string")


@pytest.fixture(scope="module")
def docs(spark):
    return registry.table(spark, FOLDER, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return registry.table(spark, FOLDER, "labels")


def none_of(df):
    return df.filter(F.lit(False))


def word_list(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.lower())


# --- tokens


def test_tokens_split_and_hash_alike():
    texts = ["A b  c", "", "a\nB\tc", "é é", "a b c" * 3]
    t = tokenize(pa.array(texts), BY_SPACE)
    assert t.counts().tolist() == [3, 0, 3, 2, 7]
    assert t.hash[:3].tolist() == t.hash[3:6].tolist()
    assert t.hash[6] == t.hash[7]


def test_token_hashes_don_t_hang_on_slabs(monkeypatch):
    from waymark.llm import _tokens

    text = pa.array(["alpha beta " * 500, "x" * 3000 + " beta"])
    whole = tokenize(text, WORDS).hash
    monkeypatch.setattr(_tokens, "SLAB", 64)
    assert (tokenize(text, WORDS).hash == whole).all()


def test_shingles_of_short_texts():
    found, first = shingles(tokenize(pa.array(["a b", "a b", "b a", "", "a b c d e f"]), WORDS), 5)
    assert np.diff(first).tolist() == [1, 1, 1, 0, 2]
    assert found[0] == found[1] != found[2]


# --- 1 toxicity


def test_toxicity_learns_grades(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(600):
        bad = rnd.choice([0, 0, 1, 2, 3])
        text = " ".join([rnd.choice(words) for _ in range(40)] + [rnd.choice(["scum", "idiots", "trashy"]) for _ in range(bad * 2)])
        rows.append((i, text, bad))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df.select("doc_id", "toxic"))
    assert (np.diff(model.thresholds) > 0).all()
    got = toxicity.score(df, model).collect()
    assert sum(r["is_toxic"] == (r["toxic"] > 0) for r in got) > 590
    means = [np.mean([r["expected_severity"] for r in got if r["toxic"] == g]) for g in range(4)]
    assert means == sorted(means)


def test_toxicity_gradient():
    rnd = np.random.default_rng(0)
    n, d = 60, 3
    x = rnd.normal(size=(n, d))
    grade = np.digitize(x @ [2, -1, 0.5] + rnd.logistic(size=n) * 0.3, [-1, 1])
    rows, cols = np.repeat(np.arange(n), d), np.tile(np.arange(d), n)
    w, t = toxicity.fit(rows, cols, x.ravel(), grade, d, steps=600)
    above = 1 / (1 + np.exp(-((x @ w)[:, None] - t)))
    assert ((above > 0.5).sum(1) == grade).mean() > 0.8


def test_toxicity_edges(edge, labels, docs):
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(edge, model).collect()}
    assert len(got) == 11 and not got[1]["is_toxic"] and got[1]["p_toxic"] == got[2]["p_toxic"]
    assert toxicity.score(none_of(edge), model).count() == 0
    bare = toxicity.train(none_of(docs), none_of(labels))
    assert not any(r["is_toxic"] for r in toxicity.score(edge, bare).collect())


# --- 2 n-gram Jaccard join


def brute_links(rows):
    sets = []
    for _, text in rows:
        w = word_list(text or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    n, up = [0] * len(rows), list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        i = len(sets[a] & sets[b])
        if sets[a] and sets[b] and i >= 0.8 * (len(sets[a]) + len(sets[b]) - i) - 1e-9:
            n[a] += 1
            n[b] += 1
            up[max(top(a), top(b))] = min(top(a), top(b))
    return n, [top(k) for k in range(len(rows))]


def near_copies():
    rnd = random.Random(5)
    base = [f"w{rnd.randint(0, 400)}" for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(len(words))] = f"v{rnd.randint(0, 9999)}"
        rows.append((i, " ".join(words)))
    return rows + [(200 + i, " ".join(f"u{rnd.randint(0, 9999)}" for _ in range(30))) for i in range(40)]


@pytest.mark.parametrize("block", [1500, 40])
def test_near_duplicates_as_brute_force(spark, docs, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", block)
    rows = near_copies() + [(1000 + r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()] + [(5000, near_copies()[0][1]), (5001, None)]
    n, top = brute_links(rows)
    got = {r["doc_id"]: r for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k]["n_links"] for k, _ in rows] == n
    assert [got[k]["class_id"] for k, _ in rows] == [rows[t][0] for t in top]


def test_pruning_keeps_what_is_likely():
    need = jaccard.least_agreements(0.8, 1e-8)
    assert need[0] == 0 and (np.diff(need) >= 0).all() and need[128] < 0.8 * 128
    # the posterior of the fewest agreements that stay isn't below the tolerance, one fewer is
    for n in (16, 64, 128):
        tail = [sum(math.comb(n + 1, k) * 0.8**k * 0.2 ** (n + 1 - k) for k in range(m + 1)) for m in range(n + 1)]
        assert tail[need[n]] >= 1e-8 and (need[n] == 0 or tail[need[n] - 1] < 1e-8)


def test_near_duplicates_edges(edge):
    got = jaccard.near_duplicates(edge.drop("score")).collect()
    assert len(got) == len(EDGE)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert [r["n_links"] for r in by[5]] == [2, 2] and by[6][0]["class_id"] == 5 and by[6][0]["n_links"] == 2
    assert by[1][0]["n_links"] == by[2][0]["n_links"] == 0 and by[1][0]["class_id"] == 1 and by[2][0]["class_id"] == 2
    assert by[None][0]["n_links"] == 0
    assert jaccard.near_duplicates(none_of(edge)).count() == 0
    kept = sorted(r["doc_id"] or 0 for r in jaccard.one_of_each(edge).collect())
    assert kept == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10]


def test_rows_of_one_key_and_texts_without_words(spark):
    one, two, other = ("first of two quite different texts here", "and this is the second one of them", "nothing like the others at all today")
    rows = [(1, one), (1, two), (1, one), (2, two), (3, "!!! ??? ..."), (4, "!!! ??? ..."), (5, "?!"), (6, ""), (6, None), (7, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(docs).collect())
    assert got == [(1, 1, 1)] * 3 + [(2, 1, 1), (3, 3, 1), (4, 3, 1), (5, 5, 0), (6, 6, 0), (6, 6, 0), (7, 7, 0)]
    kept = Counter((r["doc_id"], r["text"]) for r in jaccard.one_of_each(docs).collect())
    assert kept == Counter([(1, one), (1, two), (3, "!!! ??? ..."), (5, "?!"), (6, ""), (6, None), (7, other)])


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    assert all(got[n] == find(n) for n in got) and len(got) == len({n for a, b in edges if a != b for n in (a, b)})


# --- 3 benchmark decontamination


def test_overlaps_tolerate_substitutions(spark):
    rnd = random.Random(3)
    word = lambda: f"t{rnd.randint(0, 5000)}"
    items = [(i, " ".join(word() for _ in range(rnd.randint(14, 50)))) for i in range(30)] + [(90, "a b c d e f"), (91, "x y"), (92, None)]
    texts, want = [], set()
    for k in range(200):
        words = [word() for _ in range(60)]
        if k % 2:
            own = rnd.randrange(30)
            part = items[own][1].split()
            for at in rnd.sample(range(len(part)), 2):
                part[at] = "changed"
            words[20:20] = part
            want.add((k, own))
        texts.append((k, " ".join(words).title()))
    texts += [(900, "see A, b c; d e f!"), (901, "x y"), (902, None), (903, "")]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert want <= got and got - want == {(900, 90), (901, 91)}


def test_every_pair_of_substitutions_is_hit():
    for a, b in itertools.combinations(range(decontaminate.SPAN), 2):
        hit = any(all(start + p not in (a, b) for p in decontaminate.places(m)) for m in decontaminate.MASKS for start in range(decontaminate.SPAN - len(m) + 1))
        assert hit, (a, b)


def test_every_overlap_that_counts_is_hit():
    words = lambda n: [f"t{i}" for i in range(n)]
    for n in range(decontaminate.LEAST, decontaminate.SPAN + 2):
        width = min(n, decontaminate.SPAN)
        need = n if n < 7 else math.ceil(decontaminate.AGREE * width)
        texts = [" ".join("changed" if i in gone else w for i, w in enumerate(words(n))) for gone in itertools.combinations(range(n), width - need)]
        t = tokenize(pa.array(texts + ["before " + x + " after" for x in texts]), WORDS)
        seeds = decontaminate.Seeds(["other", "item"], ["x y z", " ".join(words(n))])
        assert {x[0] for x in seeds.overlaps(t.hash, t.first)} == set(range(2 * len(texts))), n
    texts = [" ".join("changed" if i % 4 == phase else w for i, w in enumerate(words(60))) for phase in range(4)]
    t = tokenize(pa.array(texts), WORDS)
    assert {x[0] for x in decontaminate.Seeds(["item"], [" ".join(words(60))]).overlaps(t.hash, t.first)} == {0, 1, 2, 3}


def test_clean_keeps_the_rest(spark, docs, edge):
    benchmark = registry.table(spark, FOLDER, "benchmark")
    leaks = {r["doc_id"] for r in decontaminate.overlaps(docs, benchmark).collect()}
    exact = docs.join(benchmark.select(F.col("text").alias("t")), F.expr("contains(text, t)")).select("doc_id").distinct()
    assert {r["doc_id"] for r in exact.collect()} <= leaks
    left = decontaminate.clean(docs, benchmark)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in docs.collect()} - leaks
    assert decontaminate.clean(edge, benchmark).count() == len(EDGE)
    assert decontaminate.clean(edge, none_of(benchmark)).count() == len(EDGE)
    assert decontaminate.overlaps(none_of(docs), benchmark).count() == 0


def test_blocks_of_the_benchmark(spark, docs, monkeypatch):
    benchmark = registry.table(spark, FOLDER, "benchmark")
    whole = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs, benchmark).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK", 400)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs, benchmark).collect()} == whole


# --- 4 SentencePiece


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=registry.piece_model())


def test_pieces_as_the_library(library):
    rnd = random.Random(4)
    letters = "ab cde▁ \n\té漢字🙂xX<0x0A>#$aaaaaa1234  \x00"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(2000)]
    texts += ["", " ", "▁", "a" * 3000, " " * 100, " the  theater", "\n\n", *[r[1] for r in EDGE if r[1]]]
    own = pieces.pieces(registry.piece_model())
    for text, (ids, n, plain) in zip(texts, own.encode(texts), strict=True):
        want = library.encode(text)
        assert ids == ",".join(map(str, want)) and n == len(want) and plain == library.decode(want)
        assert own.decode(want) == library.decode(want)


def test_words_are_learnt_again_when_the_table_is_full(library, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_WORDS", 5)
    own = pieces.Pieces(registry.piece_model())
    for text in ["one two three four", "five six seven one", "one two"]:
        assert own.encode([text])[0][0] == ",".join(map(str, library.encode(text)))


def test_encode_documents(edge, library):
    got = pieces.encode_documents(edge.withColumn("n_tokens", F.lit("x")), registry.piece_model(), ids=True).collect()
    assert len(got) == len(EDGE)
    for r in got:
        text = next(t or "" for k, t, *_ in EDGE if k == r["doc_id"])
        assert r["input_ids"] == library.encode(text) and r["n_tokens"] == len(r["input_ids"])
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest() and r["decoded"] == library.decode(r["input_ids"])
    assert pieces.encode_documents(none_of(edge), registry.piece_model()).count() == 0


# --- 5 licences


def test_licences_and_inheritance(spark):
    files = [
        ("a/LICENSE", "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
        ("a/x.py", "# SPDX-License-Identifier: Apache-2.0\nprint()"), ("a/y.py", "print()"), ("a/b/c/z.py", None), ("a/b/LICENSE.txt", "Licensed under CC BY-NC 4.0."),
        ("d/q.py", "nothing"), ("top.py", ""), (None, "Released under the MIT License."), ("a/y.py", "print()"), ("a/m.txt", "my driving licence was expired and so the words went on for long"),
    ]
    got = licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()
    assert len(got) == len(files)
    by = {r["path"]: (r["license"], r["license_source"], r["license_dir"]) for r in got}
    assert by["a/LICENSE"][:2] == ("MIT", "header") and by["a/x.py"][:2] == ("Apache-2.0", "header")
    assert by["a/y.py"] == ("MIT", "inherited", "a") and by["a/m.txt"] == ("MIT", "inherited", "a")
    assert by["a/b/c/z.py"] == ("CC-BY-NC-4.0", "inherited", "a/b")
    assert by["d/q.py"] == by["top.py"] == (None, None, None) and by[None][:2] == ("MIT", "header")


def test_licence_texts_headers_and_versions(spark):
    from waymark.llm._license_texts import BSD_END, BSD_TWO, MIT_TEXT, whole

    gpl = "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version.\nimport os\n" + "x = os.sep\n" * 90
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\nint x;\n"
    wrap = lambda text: re.sub(r"(.{60}\S*) ", r"\1\n", text)
    notes = {"BSD-2-Clause": "Released under the BSD 2-Clause License.", "LGPL-2.1": "Licensed under the GNU Lesser General Public License, version 2.1.", "CC-BY-3.0": "Licensed under CC BY 3.0."}
    full = ["Apache-2.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0", "Artistic-1.0", "Unlicense"]
    files = [(f"full/{n}/main.c", whole(n), n, True) for n in full] + [(f"note/{n}", x, n, True) for n, x in notes.items()]
    files += [("h/gpl.py", gpl, "GPL-2.0", False), ("h/mpl.c", mpl, "MPL-2.0", True), ("mit/a", wrap("Copyright (c) 2020 Some One " + MIT_TEXT), "MIT", True), ("bsd/a", wrap("Copyright (c) 2020 Some One " + BSD_TWO + " " + BSD_END), "BSD-2-Clause", True)]
    files += [("head/a", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/", "Apache-2.0", True), ("head/g", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "GPL-3.0", True)]
    got = {r["path"]: (r["license"], r["is_license_file"]) for r in licenses.headers(spark.createDataFrame([f[:2] for f in files], "path string, text string")).collect()}
    assert got == {f[0]: f[2:] for f in files}


def test_nearest_ancestor_as_brute_force(spark):
    rnd = random.Random(6)
    names = ["p", "q", "r"]
    files = []
    for i in range(300):
        path = "/".join([rnd.choice(names) for _ in range(rnd.randint(0, 5))] + [f"f{i}"])
        files.append((path, rnd.choice(["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "plain words", "plain words", "plain words"])))
    got = {r["path"]: r for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    held = {p.rpartition("/")[0] for p, t in files if "plain" not in t}
    for path, text in files:
        if "plain" not in text:
            continue
        at = path.rpartition("/")[0]
        while at not in held and at:
            at = at.rpartition("/")[0]
        assert got[path]["license_dir"] == (at if at in held else None)


# --- 6 language model


def brute_base(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {k: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) + [None] for k, t in rows}
    c = Counter()
    for k, _ in rows:
        if zlib.crc32(str(k).encode()) % 10:
            c.update(tokens[k])
    n, v = sum(c.values()), len(c)
    return {k: (len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for k, w in tokens.items()}


@pytest.mark.parametrize("size", [30_000, 10_000_000])
def test_lm_scores(docs, monkeypatch, size):
    monkeypatch.setattr(lm, "BLOCK", size)
    monkeypatch.setattr(lm, "BUCKET", size)
    want = brute_base([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: r for r in lm.score_texts(docs).collect()}
    for k, (n, known, total, base) in want.items():
        assert (got[k]["n_tokens"], got[k]["n_known"], got[k]["train_tokens"]) == (n, known, total)
        assert got[k]["base_score"] == pytest.approx(base, abs=1e-6)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_chances_sum_to_one():
    """Over all known tokens and one unknown, after each context."""
    texts = pa.array(["a b a c", "b a b", "a a"])
    block = lm.Block(texts)
    w, p = block.counts(np.ones(3, bool))
    n, v = int(w[block.words != lm.START].sum()), int((block.words != lm.START).sum())
    mix = lm.weights(*(np.zeros(0, np.int64),) * 4)
    known = [x for x in block.words.tolist() if x != int(lm.START)]
    for context in block.words.tolist():
        count = w[block.words.tolist().index(context)]
        level = lm.levels(np.array([count]))[0]
        total = 0.0
        for word in [*known, None]:
            key = lm.mixed(np.array([context], np.uint64) * lm.PAIR + np.uint64(word))[0] if word is not None else None
            at = np.flatnonzero(block.pairs == key) if word is not None else []
            p2 = p[at[0]] / count if len(at) and count else 0.0
            p1 = w[block.words.tolist().index(word)] / n if word is not None else 0.0
            total += mix[level] @ [p2, p1, 1 / (v + 1)]
        assert total == pytest.approx(1.0) if context != int(lm.END) else total <= 1.0


def test_lm_packing():
    rnd = np.random.default_rng(1)
    keys = np.unique(rnd.integers(0, 1 << 63, 1000, dtype=np.uint64))
    assert (lm.unpack_keys(memoryview(lm.pack_keys(keys))) == keys).all()
    counts = np.concatenate([rnd.integers(0, 300, 500), [10**9, 0, 255, 254]])
    assert (lm.unpack_counts(lm.pack_counts(counts)) == counts).all()


def test_lm_weights_reach_the_best_likelihood():
    rnd = np.random.default_rng(2)
    level, n = np.ones(200, np.int64), rnd.integers(1, 50, 200)
    r2, r1 = rnd.integers(-20, 60, 200), rnd.integers(-20, 40, 200)
    mix = lm.weights(level, r2, r1, n * 100)[1]
    x = np.stack([2.0 ** (r2 / lm.GRAIN), 2.0 ** (r1 / lm.GRAIN), np.ones(200)], axis=1)
    best = max((n @ np.log(x @ w), tuple(w)) for w in ([a / 50, b / 50, 1 - (a + b) / 50] for a in range(50) for b in range(50 - a)))
    assert n @ np.log(x @ mix) >= best[0] - 1e-2 * abs(best[0])


def test_lm_edges(edge):
    got = lm.score_texts(edge).collect()
    assert len(got) == len(EDGE) and all(np.isfinite(r["score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert lm.score_texts(none_of(edge)).count() == 0


# --- 7 language


def test_language_held_out(docs, edge):
    from waymark.llm._store import fold_of

    model = language.train(docs.filter(fold_of("doc_id", 4) != 2))
    got = language.predict(docs.select("doc_id", "text", F.col("lang").alias("want")), model).collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == r["want"] for r in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in got)
    rows = {r["doc_id"]: r for r in language.predict(edge, model).collect()}
    assert len(rows) == 11 and {rows[k]["lang_pred"] for k in (1, 2, 3, 8)} == {"und"} and rows[4]["lang_pred"] in model.names
    none = language.train(none_of(docs))
    assert {r["lang_pred"] for r in language.predict(edge, none).collect()} == {"und"}
    assert language.predict(none_of(edge), model).count() == 0


def test_every_language_is_learnt_with_its_own_quota(spark, monkeypatch):
    monkeypatch.setattr(language, "WORDS_KEPT", 6)
    monkeypatch.setattr(language, "GRAMS_KEPT", 30)
    rnd = random.Random(7)
    words = {f"l{k:02d}": ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(6)] for k in range(70)}
    rows = [(i, " ".join(rnd.choices(words[name], k=30)), name) for i, name in enumerate(n for k, n in enumerate(words) for _ in range(8 if k < 35 else 2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    assert model.names == sorted(words)
    assert all(r["lang_pred"] == r["lang"] for r in language.predict(docs, model).collect())


def test_language_scores_as_brute_force(spark):
    rows = [(1, "aab aab abb xyz", "p"), (2, "aab abb abb qrs", "q"), (3, "zzz zzz aab", "r")]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {name: Counter(text.split()) for _, text, name in rows}
    texts = ["aab abb aab", "zzz", "", "abb"]
    got = language.text_scores(model, tokenize(pa.array(texts), language.LETTERS), len(texts))
    want = [[sum(math.log((counts[n][w] + 0.1) / (counts[n].total() + 1)) for w in x.split()) for n in "pqr"] for x in texts]
    assert np.allclose(got, want)
    gram = lambda n, g: sum(v for w, v in counts[n].items() for i in range(6 - len(g)) if f"<{w}>"[i : i + len(g)] == g)
    got = language.text_scores(model, tokenize(pa.array(["aaz"]), language.LETTERS), 1)[0]
    size = {n: sum(3 * v for v in counts[n].values()) for n in "pqr"}
    assert np.allclose(got, [math.log((gram(n, "<aa") + 0.1) / (size[n] + 1)) for n in "pqr"])


def test_back_off_is_longest_first():
    t = tokenize(pa.array(["abc"]), language.LETTERS)
    sizes = [(n, len(h)) for n, h, _ in language.grams(t.data, t.start, t.end)]
    assert sizes == [(5, 1), (4, 2), (3, 3), (2, 4), (1, 3)]


# --- 8 quality


def test_quality_gradient():
    rnd = np.random.default_rng(3)
    first = np.array([0, 3, 4, 9])
    x, y = rnd.normal(size=(9, 6)), np.array([0.0, 1.0, 1.0])
    p = {"W": rnd.normal(size=(6, 4)), "b": rnd.normal(size=4), "V": rnd.normal(size=(4, 2)), "U": rnd.normal(size=(4, 2)), "w": rnd.normal(size=2), "c": rnd.normal(size=4), "d": rnd.normal(size=1)}
    loss = lambda: -np.mean(y * np.log(quality.forward(p, x, first)["y"]) + (1 - y) * np.log(1 - quality.forward(p, x, first)["y"]))
    for k, g in quality.gradients(p, x, first, y).items():
        at = tuple(rnd.integers(0, s) for s in p[k].shape)
        keep = p[k][at]
        p[k][at] = keep + 1e-6
        up = loss()
        p[k][at] = keep - 1e-6
        down = loss()
        p[k][at] = keep
        assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_quality_held_out(spark, edge):
    from waymark.llm._store import fold_of

    docs, labels = (registry.table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    model = quality.train(docs, labels, keep=fold_of("doc_id", 4) != 2)
    got = quality.score(docs, model).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.9 * len(got)
    rows = {r["doc_id"]: r for r in quality.score(edge, model).collect()}
    assert len(rows) == 11 and rows[1]["score"] == rows[2]["score"] and all(0 <= r["score"] <= 1 for r in rows.values())
    assert {r["score"] for r in quality.score(edge, quality.train(docs, none_of(labels))).collect()} == {1.0}
    assert quality.score(none_of(edge), model).count() == 0


# --- 9 media


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def samples():
    import gzip
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello")
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\1\2\3\0"
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\2\2D\1\0;"
    pdf = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
    return {"image/png": png(), "image/bmp": bmp, "image/gif": gif, "application/pdf": pdf, "application/zip": z.getvalue(), "application/gzip": gzip.compress(b"x" * 99), "audio/wav": media.to_wav(b"abcd" * 10)}


@pytest.mark.parametrize("kind", sorted(samples()))
def test_media_types_and_carving(kind):
    data = samples()[kind]
    assert media.sniff(data) == [(0, len(data), kind)]
    assert media.sniff(b"noise " + data + b" more") == [(6, len(data), kind)]
    broken = data[: len(data) // 2]
    assert all(k != kind for _, _, k in media.sniff(broken))


def crc(data, poly, bits):
    out = 0
    for b in data:
        out ^= b << bits - 8
        for _ in range(8):
            out = (out << 1 ^ (poly if out >> bits - 1 else 0)) & (1 << bits) - 1
    return out.to_bytes(bits // 8, "big")


def flac(total=None):
    """Mono frames of 16 samples of 8 bits: constant, verbatim, fixed and LPC with Rice residuals, wasted bits."""
    rnd = random.Random(9)
    bits = lambda x, n: format(x, f"0{n}b")
    rice = lambda n: "".join("0" * rnd.randint(0, 40) + "1" + bits(rnd.randint(0, 3), 2) for _ in range(n))
    verbatim = "".join(bits(rnd.randint(0, 255), 8) for _ in range(16))
    frames = ["00000000" + bits(7, 8), "00000010" + verbatim, "00010100" + bits(77, 16) + "00" + "0000" + "0010" + rice(14)]
    frames += ["01000010" + bits(77, 16) + "0010" + "00001" + bits(5, 6) + "00" + "0001" + "0010" + rice(6) + "1111" + "00011" + "101" * 8, "00000011" + "01" + verbatim[: 16 * 6]]
    out = b""
    for k, x in enumerate(frames):
        head = bytes([0xFF, 0xF8, 0x69, 0x02, k, 15])
        head += crc(head, 0x07, 8)
        x += "0" * (-len(x) % 8)
        frame = head + int(x, 2).to_bytes(len(x) // 8, "big")
        out += frame + crc(frame, 0x8005, 16)
    info = struct.pack(">HH", 16, 16) + bytes(6) + ((8000 << 44) | (7 << 36) | (80 if total is None else total)).to_bytes(8, "big") + bytes(16)
    return b"fLaC\0\0\0\x22" + info + b"\x81\0\0\x05\0fLaC" + out


def ogg(*pages):
    return b"".join(b"OggS\0" + bytes([flags]) + bytes(8) + struct.pack("<III", serial, 0, 0) + b"\1\x09" + b"some data" for flags, serial in pages)


def test_carved_files_are_whole():
    import gzip
    import io
    import zipfile

    inner, z = samples()["application/zip"], io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("inner.zip", inner)
        f.writestr("b.txt", "hello")
    one = b"%PDF-1.4\n1 0 obj\nendobj\nxref\ntrailer\nstartxref\n24\n%%EOF"
    revised = one + b"\n2 0 obj\nendobj\nxref\ntrailer\nstartxref\n%d\n%%%%EOF" % (len(one) + 16)
    linear = b"%PDF-1.4\n1 0 obj\nendobj\nxref\ntrailer\nstartxref\n0\n%%EOF\n2 0 obj\nendobj\nxref\ntrailer\nstartxref\n24\n%%EOF"
    holder = b"%PDF-1.4\n1 0 obj\n" + one + b"\nendobj\nxref\ntrailer\nstartxref\n%d\n%%%%EOF" % (17 + len(one) + 8)
    cases = [("audio/flac", flac()), ("audio/flac", flac(0)), ("application/zip", z.getvalue()), ("application/gzip", gzip.compress(b"x" * 99) + gzip.compress(b"y" * 99))]
    cases += [("application/pdf", x) for x in (one, revised, linear, holder)]
    cases += [("application/ogg", ogg((2, 1), (2, 2), (0, 1), (4, 1), (0, 2), (4, 2))), ("application/ogg", ogg((6, 1), (2, 2), (4, 2)))]
    for kind, data in cases:
        assert media.sniff(data)[0] == (0, len(data), kind)
        assert media.sniff(b"noise " + data + b" more %%EOF") == [(6, len(data), kind)]
    assert media.sniff(flac()[:-1]) == media.sniff(flac(81)) == []
    assert media.sniff(b"." + one + one) == [(1, len(one), "application/pdf"), (1 + len(one), len(one), "application/pdf")]
    assert media.sniff(ogg((2, 1), (0, 1), (4, 1))) == [(0, 37 * 3, "application/ogg")]


def test_media_columns(spark):
    rows = [(1, bytearray(png()), "image/jpeg"), (2, bytearray(b"GIF89a not one"), "image/gif"), (3, None, None), (4, bytearray(b"xx" + png()), "image/png"), (4, bytearray(b"xx" + png()), "image/png")]
    df = spark.createDataFrame(rows, "id long, content binary, declared string")
    got = {r["id"]: r for r in media.media_columns(df, "content", "declared").collect()}
    assert got[1]["media_type"] == "image/png" and got[1]["type_corrected"]
    assert got[2]["media_type"] == got[3]["media_type"] == media.UNKNOWN and not got[3]["embedded"]
    assert bytes(got[4]["embedded"][0]["content"]) == png() and got[4]["embedded"][0]["offset"] == 2


def test_declared_types_of_other_formats_stay(spark):
    rows = [(1, bytearray(b"\0\0\0\x18ftypmp42"), "video/mp4"), (2, bytearray(png()), "image/webp"), (3, bytearray(b"words"), "text/plain"), (4, bytearray(b"words"), "application/pdf"), (5, bytearray(b"words"), None)]
    got = {r["id"]: (r["media_type"], r["type_corrected"]) for r in media.media_columns(spark.createDataFrame(rows, "id long, content binary, declared string"), "content", "declared").collect()}
    assert got == {1: ("video/mp4", False), 2: ("image/png", True), 3: ("text/plain", False), 4: (media.UNKNOWN, True), 5: (media.UNKNOWN, False)}


def test_texts_as_media(edge):
    got = media.texts_as_media(edge).collect()
    assert len(got) == len(EDGE)
    for r in got:
        raw = next((t or "").encode() for k, t, *_ in EDGE if k == r["doc_id"])
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r["media_sha256"] == hashlib.sha256(media.to_wav(padded)).hexdigest()
    assert media.texts_as_media(none_of(edge)).count() == 0


# --- 10 chat


def test_escaping_is_reversible():
    rnd = random.Random(7)
    for _ in range(5000):
        text = "".join(rnd.choice(["#", "###", "</turn>", "\\", "\n", "a", "\n</turn>\n", "### Assistant:"]) for _ in range(rnd.randint(0, 8)))
        role = rnd.choice(["user", "assistant", 'odd"\\:\n', "", "User"])
        whole = chat.rendered(role, text)[0] + chat.rendered("user", text)[0]
        assert [p[:2] for p in chat.parsed(whole)] == [(role, text), ("user", text)]


def test_events_are_folded(spark):
    log = [
        (1, 10, "m1", "delta", "user", "Hel"), (1, 11, "m1", "delta", None, "lo"), (1, 12, "m2", "delta", "assistant", "draft"), (1, 13, "m2", "regenerate", None, None),
        (1, 14, "m2", "delta", None, "fin"), (1, 16, "m3", "delta", "user", "gone"), (1, 17, "m3", "delete", None, None), (1, 15, "m2", "delta", None, "al"),
        (1, 18, "m1", "edit", None, "Hello!"), (2, None, "a", "delta", "user", None), (None, 1, "z", "delta", None, "x"),
    ]
    random.Random(8).shuffle(log)
    df = spark.createDataFrame(log, "conv_id long, seq long, message_id string, kind string, role string, text string")
    got = sorted(((r["conv_id"] or 0, r["turn"], r["role"], r["text"]) for r in chat.final_messages(df).collect()))
    assert got == [(0, 0, "", "x"), (1, 0, "user", "Hello!"), (1, 1, "assistant", "final"), (2, 0, "user", "")]


def test_chat_edges(spark):
    turns = [(1, 0, "user", None), (1, 1, "assistant", "é\n"), (1, 1, "assistant", "é\n"), (1, None, None, "x"), (2, 0, "assistant", "a" * 100_000), (None, 0, "user", "y")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.events_of_turns(df), "place").collect()}
    whole = "".join(f"{r}\n{t}\n" for r, t in [("", "x"), ("user", ""), ("assistant", "é\n"), ("assistant", "é\n")])
    assert got[1]["n_turns"] == 4 and got[1]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest() and got[1]["loss_chars"] == 4
    assert got[2]["loss_chars"] == 100_000 and got[None]["n_turns"] == 1
    assert chat.digests(chat.events_of_turns(none_of(df)), "place").count() == 0
