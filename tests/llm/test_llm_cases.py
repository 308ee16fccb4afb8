"""Brute-force versions of the operators, clashing columns, and the pipeline's stages one by one."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.llm import chat, decontaminate, jaccard, language, licenses, lm, media, pieces, quality, registry, toxicity
from waymark.llm._sample import sigmoid
from waymark.llm._tokens import LETTERS, hashes, mixed, tokenize
from waymark.llm._workers import rows_kept

FOLDER = "/root/testdata/sf0.001"
#: Names that operators use for themselves, as columns of the input, in odd cases too.
NAMES = ["__text", "__lower", "__hash", "__kept", "__key", "__letters", "__dir", "Grade", "score", "predicted", "held_out", "License_Source", "license_dir", "license", "n_tokens", "p_toxic", "passages", "embedded", "feature", "place", "class_id", "best"]


@pytest.fixture(scope="module")
def docs(spark):
    return registry.table(spark, FOLDER, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return registry.table(spark, FOLDER, "labels")


@pytest.fixture(scope="module")
def clashing(docs):
    """Forty documents with all such columns, each holding its own name and the document's id."""
    few = docs.orderBy("doc_id").limit(40).select("doc_id", "text")
    return few.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in NAMES]).cache()


def own_columns(df, names=NAMES):
    return all(r[n] == f"{n}:{r['doc_id']}" for r in df.collect() for n in names)


# --- clashing columns


def test_stages_give_back_all_columns(spark, clashing, docs, labels):
    stages = dict(corpus_pipeline.STAGES)
    for name in ("toxicity", "quality", "near_duplicates", "decontaminate"):
        out = stages[name](spark, clashing, FOLDER)
        assert out.columns == clashing.columns and own_columns(out), name
    out = stages["encode"](spark, clashing, FOLDER)
    rest = [n for n in NAMES if n != "n_tokens"]
    assert out.columns == ["doc_id", *rest, "n_tokens", "ids_sha256", "decoded_sha256"] and own_columns(out, rest)


def test_operators_with_clashing_columns(spark, clashing, docs, labels):
    n = clashing.count()
    lower = {x.lower() for x in NAMES}
    runs = {
        "toxicity": toxicity.score(clashing, toxicity.train(clashing, labels)),
        "near": jaccard.near_duplicates(clashing),
        "encode": pieces.encode_documents(clashing, registry.piece_model()),
        "licenses": licenses.scan(clashing.withColumn("path", F.concat(F.lit("a/"), F.col("doc_id").cast("string")))),
        "lm": lm.score_texts(clashing),
        "language": language.predict(clashing, language.train(docs.limit(60))),
        "quality": quality.score(clashing, quality.train(docs, labels)),
        "media": media.texts_as_media(clashing),
        "columns": media.media_columns(clashing.withColumn("raw", F.col("text").cast("binary")), "raw"),
    }
    for name, out in runs.items():
        got = out.collect()
        assert len(got) == n, name
        assert len({c.lower() for c in out.columns}) == len(out.columns), name
        for c in out.columns:
            if c in NAMES and not any(isinstance(r[c], float | bool | int) or r[c] is None for r in got):
                kept = [r[c] == f"{c}:{r['doc_id']}" for r in got]
                assert all(kept) or not any(kept), (name, c)
    assert lower
    overlaps = decontaminate.overlaps(clashing, registry.table(spark, FOLDER, "benchmark").withColumn("__text", F.lit("x")))
    assert overlaps.columns[:2] == ["doc_id", "item_id"]
    log = spark.createDataFrame([(1, 1, s, "delta", "user", t, p) for s, t, p in ((0, "a", 9), (1, "b", 1))] + [(1, 2, 2, "delta", "user", "c", 0)], "conv_id long, message_id long, seq long, kind string, role string, text string, place long")
    assert [r["text"] for r in chat.final_messages(log).collect()] == ["ab", "c"]


def test_keys_of_other_types(spark):
    df = spark.createDataFrame([("a", "some text of a few words here"), ("b", None), (None, "x")], "doc_id string, text string")
    assert sorted(str(r["doc_id"]) for r in media.texts_as_media(df).collect()) == ["None", "a", "b"]
    assert sorted(str(r["doc_id"]) for r in lm.score_texts(df).collect()) == ["None", "a", "b"]
    assert sorted(str(r["doc_id"]) for r in jaccard.near_duplicates(df).collect()) == ["None", "a", "b"]


# --- stages


def test_stages_on_nothing_and_on_edges(spark, docs):
    empty = docs.filter("false")
    edges = spark.createDataFrame([(1, None, None), (2, "", "x"), (2, "", "x"), (None, " ", None), (3, "plain words " * 20000, "x")], "doc_id long, text string, lang string")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0, name
        out = stage(spark, edges, FOLDER)
        got = out.collect()
        assert len(got) <= 5 and (name == "encode" or out.columns == edges.columns), name
        assert name not in ("near_duplicates", "decontaminate", "encode") or len(got) == 5, name


def test_rows_kept_as_a_loop(spark):
    rows = [(i, None if i % 7 == 0 else "x" * (i * 37 % 3000)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, text string")
    got = rows_kept(df, "text", lambda column: [len(t) % 2 == 0 for t in column.to_pylist()])
    assert sorted(r["k"] for r in got.collect()) == [k for k, t in rows if len(t or "") % 2 == 0]


def test_small_blocks_of_long_texts(spark, monkeypatch):
    """Many blocks, most of them empty: no link is counted twice."""
    base = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join([*base[:-k], *[f"x{k}_{i}" for i in range(k)]] if k else base)) for k in range(6)]
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 50)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: (0, 5) for k in range(6)}


# --- 1 toxicity


def test_toxicity_score_as_brute_force(spark, docs, labels):
    model = toxicity.train(docs, labels)
    weight = dict(zip(model.lookup.keys.tolist(), model.weights.tolist(), strict=True))

    def hashed(word: bytes, salt: int | None) -> int:
        data = np.frombuffer(word, np.uint8)
        h = hashes(data, np.array([0]), np.array([len(word)]), LETTERS.value)
        return int(h[0] if salt is None else mixed(h + np.uint64(salt))[0])

    rows = docs.orderBy("doc_id").limit(25).collect()
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    for r in rows:
        found: Counter = Counter()
        for word in re.findall(rb"[A-Za-z\x80-\xff]+", (r["text"] or "").encode()):
            found[hashed(word, None)] += 1
            for k in toxicity.PREFIXES:
                if len(word) > k:
                    found[hashed(word[:k], k)] += 1
        raw = sum(math.log1p(n) * weight[h] for h, n in found.items() if h in weight)
        above = [1 / (1 + math.exp(-(raw - t))) for t in model.thresholds]
        own = got[r["doc_id"]]
        assert own["expected_severity"] == pytest.approx(sum(above), rel=1e-6, abs=1e-9) and own["is_toxic"] == (own["p_toxic"] >= model.cutoff)


def test_toxicity_grades_don_t_hang_on_order():
    row, col, value = np.array([0, 0, 1, 2, 2]), np.array([1, 2, 0, 1, 2]), np.array([0.5, 1.0, 2.0, 0.5, 1.5])
    label = np.array([1, 0, 1])
    one = toxicity._by_content(row, col, value, label)
    other = toxicity._by_content(np.array([0, 0, 1, 1, 2]), np.array([1, 2, 1, 2, 0]), np.array([0.5, 1.5, 0.5, 1.0, 2.0]), np.array([1, 1, 0]))
    assert all((a == b).all() for a, b in zip(one, other, strict=True))


# --- 3 benchmark decontamination


def test_overlaps_as_brute_force():
    """Items of 1 to 20 tokens with 0 to 4 substitutions: found where, and only where, some line-up agrees enough."""
    rnd = random.Random(8)
    items = [[f"i{k}x{j}" for j in range(n)] for k, n in enumerate(list(range(1, 21)) * 3)]
    texts = []
    for k, item in enumerate(items):
        for subs in range(5):
            own = list(item)
            for at in rnd.sample(range(len(own)), min(subs, len(own))):
                own[at] = "other"
            texts.append(["pad"] * rnd.randint(0, 5) + own + ["pad"] * rnd.randint(0, 5))
    seeds = decontaminate.Seeds(list(range(len(items))), [" ".join(x) for x in items])
    t = tokenize(pa.array([" ".join(x) for x in texts]), decontaminate.WORDS)
    got = {(x, y) for x, y, *_ in seeds.overlaps(t.hash, t.first)}

    def agrees(text, item):
        width = min(decontaminate.SPAN, len(item))
        need = len(item) if len(item) < decontaminate.PARTLY else math.ceil(decontaminate.AGREE * width)
        for o in range(-len(item) + 1, len(text)):
            same = [0 <= o + k < len(text) and text[o + k] == w for k, w in enumerate(item)]
            if any(sum(same[s : s + width]) >= need for s in range(len(item) - width + 1)):
                return True
        return False

    want = {(x, y) for x, text in enumerate(texts) for y, item in enumerate(items) if agrees(text, item)}
    assert got == want and len(want) > 100


def test_hits_in_parts(monkeypatch):
    """A passage that repeats in both sides is lined up a few hits at a time, with the same result."""
    words = [f"w{i}" for i in range(30)]
    texts, items = [" ".join(words)] * 40, [" ".join(words[5:25])] * 30
    t = tokenize(pa.array(texts), decontaminate.WORDS)
    whole = {x[:2] for x in decontaminate.Seeds(list(range(30)), items).overlaps(t.hash, t.first)}
    monkeypatch.setattr(decontaminate, "HITS", 50)
    assert {x[:2] for x in decontaminate.Seeds(list(range(30)), items).overlaps(t.hash, t.first)} == whole == set(itertools.product(range(40), range(30)))


def test_large_benchmark_by_a_join(spark, docs, monkeypatch):
    """A benchmark that is joined by its seeds gives what block passes give."""
    benchmark = registry.table(spark, FOLDER, "benchmark").unionByName(spark.createDataFrame([(900, "x y"), (901, None), (902, "a b c d e f g h")], "item_id long, text string"))
    texts = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(5000, "so x y z"), (5001, "so x y z"), (5002, None), (5003, "1 a b c d Q f g h 2")], "doc_id long, text string"))
    rows = lambda: sorted((r["doc_id"], r["item_id"], r["first_token"], r["last_token"], r["n_match"], r["item_tokens"], round(r["share"], 9)) for r in decontaminate.overlaps(texts, benchmark).collect())
    left = lambda: sorted(r["doc_id"] for r in decontaminate.clean(texts, benchmark).collect())
    want, kept = rows(), left()
    monkeypatch.setattr(decontaminate, "PASSES", 0)
    monkeypatch.setattr(decontaminate, "BITS", 20)
    assert rows() == want and left() == kept
    assert {x[:2] for x in want} >= {(5000, 900), (5001, 900), (5003, 902)}


# --- 5 licences


def test_cosine_as_brute_force():
    templates = {"A-1.0": ["you may copy this software freely"], "A-2.0": ["you may copy this software at a price"], "B": ["no warranty of any kind is given for this software"]}
    known = licenses.Templates(templates)
    every = [(n, licenses.terms(t)) for n, ts in templates.items() for t in ts]
    families = defaultdict(set)
    for n, t in every:
        families[n.partition("-")[0]] |= set(t)
    idf = lambda w: 1 + math.log((1 + len(families)) / (1 + sum(w in f for f in families.values())))
    vector = lambda t: {w: (1 + math.log(c)) * idf(w) for w, c in t.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))

    def cosine(text, template):
        a, b = vector(licenses.terms(text)), vector(template)
        return sum(x * b.get(w, 0) for w, x in a.items()) / (norm(a) * norm(b))

    rnd = random.Random(4)
    words = sorted({w for _, t in every for w in t if isinstance(w, str)}) + ["other", "words", "here"]
    for _ in range(200):
        text = " ".join(rnd.choices(words, k=rnd.randint(2, 12)))
        best = max(cosine(text, t) for _, t in every)
        got, name = known.nearest(text)
        assert got == pytest.approx(best, abs=1e-9)
        # what could reach the threshold is never passed over
        if best >= licenses.LIKE:
            assert known.possible(text) and known.promising(pa.array(["some line\n" + text + ". And more"]))[0]


def test_no_licensed_text_is_passed_over():
    """Whole templates without the lines that are promising alone, parts of them, and wraps of 8 to 100 columns, against the scan of every text."""
    import textwrap

    from waymark.llm._license_texts import templates

    known, rnd, cases = licenses.Templates(templates()), random.Random(1), []
    for texts in templates().values():
        for t in texts:
            if len(t.split()) < 300:
                continue
            for width in rnd.sample((8, 12, 25, 40, 72, 100), 2):
                lines = textwrap.wrap(t, width)
                alone = known.promising(pa.array(lines))
                cases.append("\n".join(x for x, good in zip(lines, alone, strict=True) if not good))
                size = int(len(lines) * rnd.choice([0.2, 0.4, 0.6, 0.8]))
                at = rnd.randrange(len(lines) - size)
                cases.append("\n".join(lines[at : at + size]))
            lines = t.split("\n")
            cases += ["\n".join(lines[len(lines) // 10 :]), "the " * 50 + t[:2500].replace("\n", " ")]
    cases += ["", "the", "of the\n\n\nof the", "\n", "a b c"]
    passed = known.promising(pa.array(cases))
    licensed = [known.scan(x)[1] is not None for x in cases]
    assert sum(licensed) > 70 and not any(found and not good for found, good in zip(licensed, passed, strict=True))


def test_texts_without_a_cue_word(spark):
    clauses = known_texts()
    rows = [(k, f"src/{k}.c", t) for k, t in enumerate(clauses)] + [(90, "src/90.c", "Just an ordinary text about the weather.\nIt rains; it pours."), (91, None, None), (92, "src/92.c", ""), (93, "src/93.c", "Mit. Und so weiter.\nMIT\n")]
    got = {r["k"]: r for r in licenses.headers(spark.createDataFrame(rows, "k long, path string, text string")).collect()}
    assert all(got[k]["license"] is not None for k in range(len(clauses)))
    assert all(got[k]["license"] is None for k in (90, 91, 92, 93))
    assert not any(re.search("licen|copyright|permission is hereby|redistribution and use", t.lower()) for t in clauses)


def known_texts():
    """Parts of licence templates that hold no word such as licence or copyright."""
    from waymark.llm._license_texts import templates

    out = []
    for name, texts in templates().items():
        for t in texts:
            lines = [x for x in t.split("\n\n") if len(x.split()) > 40 and not re.search("licen|copyright|permission is hereby|redistribution and use", x.lower())]
            if name.startswith(("GPL-3", "Apache-2")) and lines:
                out.append(max(lines, key=lambda x: len(x.split())))
    return [x for x in out if licenses.Templates(templates()).nearest(x)[0] >= licenses.LIKE][:3]


# --- 6 language model


def brute_lm(rows):
    """key -> score, by plain counts of all texts; only the fit of the weights is the operator's own."""
    import zlib

    fold = {k: zlib.crc32(("" if k is None else str(k)).encode()) % 10 for k, _ in rows}
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    tokens = {k: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), "\0END"] for k, t in rows}

    def counted(keep):
        words, pairs = Counter(), Counter()
        for k, ts in tokens.items():
            if keep(fold[k]):
                words.update(ts)
                words["\0START"] += 1
                pairs.update(zip(["\0START", *ts], ts, strict=False))
        own = {w: n for w, n in words.items() if w != "\0START"}
        return words, pairs, sum(own.values()), len(own)

    def parts(ts, words, pairs, total, distinct):
        for a, b in zip(["\0START", *ts], ts, strict=False):
            c = words[a]
            yield (0 if c == 0 else 1 + min(lm.LEVELS - 2, int(math.log2(c)))), pairs[a, b] / max(c, 1), words[b] / max(total, 1), 1 / (distinct + 1)

    rest = counted(lambda f: f > 1)
    cells = Counter()
    for k, ts in tokens.items():
        if fold[k] == 1:
            for level, p2, p1, p0 in parts(ts, *rest):
                cells[(level, *[round(lm.GRAIN * math.log2(p / p0)) if p > 0 else -1000 for p in (p2, p1)])] += 1
    mix = lm.weights(*[np.array(x, np.int64) for x in zip(*[(*c, n) for c, n in sorted(cells.items())], strict=True)])
    whole = counted(lambda f: f > 0)
    return {k: sum(math.log10(mix[level] @ np.array(p)) for level, *p in parts(ts, *whole)) for k, ts in tokens.items()}


@pytest.mark.parametrize("fan", [lm.FAN, 2])
def test_lm_score_as_brute_force(spark, docs, fan, monkeypatch):
    """With one level of requests, and with groups of blocks whose sums meet."""
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").limit(60).collect()] + [(1000, None), (1001, "A a\tA b")]
    monkeypatch.setattr(lm, "LEAST", 20_000)
    got = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=20_000, fan=fan).collect()
    want = brute_lm(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"]], rel=1e-6)


# --- 7 language identification


def test_language_as_brute_force(spark):
    texts = [("en", "the cat and the dog"), ("en", "the house and the tree"), ("fr", "le chat et le chien"), ("fr", "la maison et le chat"), ("de", "der hund und die katze"), ("de", "das haus und der hund")]
    train = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts * 3)], "doc_id long, text string, lang string")
    names = sorted({lang for lang, _ in texts})
    counts = [{lang: Counter() for lang in names} for _ in range(language.LONGEST + 1)]
    grams = lambda w, n: [g for k in range(len(w) + 3 - n) if (g := f"<{w}>"[k : k + n]) and (n > 1 or g not in "<>")]
    for lang, t in texts * 3:
        for w in t.split():
            counts[0][lang][w] += 1
            for n in range(1, language.LONGEST + 1):
                counts[n][lang].update(grams(w, n))
    seen = [Counter() for _ in counts]
    for n, by in enumerate(counts):
        for c in by.values():
            seen[n].update(c)

    def word_score(w, lang):
        log = lambda n, f: math.log((counts[n][lang][f] + language.UNSEEN) / (sum(counts[n][lang].values()) + 1))
        if seen[0][w] >= 2:
            return log(0, w)
        for n in range(language.LONGEST, 0, -1):
            known = [g for g in grams(w, n) if seen[n][g] >= 2]
            if known:
                return sum(log(n, g) for g in known) / len(known)
        return 0.0

    asked = ["the dog", "le chien", "hund und katze", "catt dogg", "maisons", "haus", "houses and chats", "zzz", "42", None]
    got = {r["doc_id"]: r for r in language.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), language.train(train)).collect()}
    for k, t in enumerate(asked):
        if not t or not re.search("[a-z]", t):
            assert got[k]["lang_pred"] == "und" and got[k]["score"] == 0
            continue
        total = {lang: sum(word_score(w, lang) for w in t.split()) for lang in names}
        best = max(total.values())
        odds = {lang: math.exp(v - best) for lang, v in total.items()}
        assert got[k]["score"] == pytest.approx(1 / sum(odds.values()), rel=1e-6)
        assert got[k]["lang_pred"] == min(lang for lang in names if total[lang] >= best - 1e-12)


# --- 8 quality


def test_quality_score_as_brute_force():
    rnd = np.random.default_rng(3)
    p = {"W": rnd.normal(size=(quality.WIDTH, quality.CODE)), "b": rnd.normal(size=quality.CODE), "V": rnd.normal(size=(quality.CODE, quality.GATE)), "U": rnd.normal(size=(quality.CODE, quality.GATE)), "w": rnd.normal(size=quality.GATE), "c": rnd.normal(size=quality.CODE), "d": np.array([0.2])}
    texts = ["", "one two three " * 40, "A1! " * 10, "x " * 500, "word"]
    x, first = quality.encode(pa.array(texts))
    model = quality.Model(p, x.mean(0), x.std(0) + 1e-3)
    y, sizes, top = quality._scored(pa.array(texts), model)
    for k, t in enumerate(texts):
        tokens = t.split()
        passages = [tokens[i : i + quality.PASSAGE] for i in range(0, len(tokens), quality.PASSAGE)] or [[]]
        assert sizes[k] == len(passages)
        bag = (x[first[k] : first[k + 1]] - model.centre) / model.scale
        codes = [np.tanh(v @ p["W"] + p["b"]) for v in bag]
        gates = [float((np.tanh(h @ p["V"]) * sigmoid(h @ p["U"])) @ p["w"]) for h in codes]
        a = np.exp(np.array(gates) - max(gates))
        a /= a.sum()
        z = sum(w * h for w, h in zip(a, codes, strict=True))
        assert y[k] == pytest.approx(float(sigmoid(z @ p["c"] + 0.2))) and top[k] == pytest.approx(a.max())
        for j, own in enumerate(passages):
            row = x[first[k] + j]
            span = " ".join(own)
            digits = sum(c.isdigit() for c in span) / max(1, len(span))
            assert row[2] == pytest.approx(math.sqrt(digits)) and row[quality.N_CLASSES + 9] == pytest.approx(math.log1p(len(own)) / 4)


# --- 9, 10


def test_media_marks_in_one_pass():
    """Many signatures and many ends: each zip and PDF ends where a search from it would end."""
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", b"text")
    data = b"PK\x03\x04" * 500 + out.getvalue() + b"%PDF-1.4\n" * 300 + b"startxref 5 %%EOF " * 300
    found = media.sniff(b"...." + data)
    assert (4 + 2000, len(out.getvalue()), "application/zip") in found
    assert len([f for f in found if f[2] == "application/zip"]) == 1


def test_chat_reads_over_borders(spark, monkeypatch):
    turns = [(1, k, "assistant" if k % 2 else "user", text) for k, text in enumerate(["### User:\nx", "a\n</turn>\n### Assistant:\nb", "", "\\### \\\\</turn>", "end"])]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    log = chat.events_of_turns(df)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"delta", "edit", "regenerate", "delete"}
    one = chat.digests(log, "place").first()
    digest = chat.Digest()
    for _, _, role, text in turns:
        digest.add(role, text)
    monkeypatch.setattr(chat, "CHUNK", 1)
    small = chat.Digest()
    for _, _, role, text in turns:
        small.add(role, text)
    assert tuple(one)[1:] == digest.row() == small.row() and one["n_turns"] == 5
    whole = "".join(chat.rendered(r, t)[0] for _, _, r, t in turns)
    assert [(r, t) for r, t, _, _ in chat.parsed(whole)] == [(r, t) for _, _, r, t in turns]
