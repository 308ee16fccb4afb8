"""Language identification, words first, backing off to shorter character n-grams.

A known word scores by its log frequency in each language. A word that isn't known
is scored by its character n-grams of 5 that are; if none is, by those of 4, and so
on down to 1. A text's score in a language is the sum over its words; the output is
the language with the greatest one and its share among all.

Frequencies come from a bounded sample of labelled texts, SAMPLE for each language, and
every language that has a text is learnt. Each has its own WORDS_KEPT commonest words
and GRAMS_KEPT commonest n-grams (on average: of features that are equally frequent
where the bound falls, those with the least hashes); what one language keeps is counted
in all. Counts are kept only where a feature occurs, so the model grows with the
languages and not with their square. A text that is null or has no letter gets `und` and
score 0; ties go to the language that is first in order of its name. Repeated rows
get equal results. Without any labelled text, an empty table included, all are `und`. A
very long text is scored whole, in memory of some twenty times its size. Extra columns
pass through unless they have the name of a result column.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._sample import Lookup
from ._store import carried, dropped, extended, fold_of, quoted, text_of, unused, written
from ._tokens import LETTERS, mixed, slabs, tokenize
from ._workers import batchwise

SAMPLE, WORDS_KEPT, GRAMS_KEPT, LONGEST = 1500, 100_000, 60_000, 5
UND = "und"
SLAB = 1 << 21
#: Counts added up at a time, and the frequency of what isn't seen.
ADDED, UNSEEN = 1 << 21, 0.1
STEP = np.uint64(0x9FB21C651E98DF25)


class Features(NamedTuple):
    """Kept features by hash: those at place i have languages and gains begin[i]:begin[i + 1]."""

    lookup: Lookup
    begin: np.ndarray
    lang: np.ndarray
    gain: np.ndarray


class Model(NamedTuple):
    """base: by kind (0: words, else the length of n-grams) and language, the log frequency of what isn't seen; gains come on top."""

    names: list[str]
    base: np.ndarray
    words: Features
    grams: Features


def grams(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """For n from LONGEST to 1: n, the hash of each n-gram of characters of each padded word, and its word."""
    words = [bytes(data[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    padded = b"".join([b"<" + w + b">" for w in words]).decode("utf-8", "replace").lower()
    codes = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.cumsum(codes == ord("<")) - 1
    for n in range(LONGEST, 0, -1):
        if len(codes) < n:
            continue
        h = np.zeros(len(codes) - n + 1, np.uint64)
        for k in range(n):
            h = h * STEP + codes[k : k + len(h)] + np.uint64(1)
        own = owner[: len(h)] == owner[n - 1 :]
        if n == 1:
            own &= (codes != ord("<")) & (codes != ord(">"))
        yield n, mixed(h[own] + np.uint64(n)), owner[: len(h)][own]


def counter():
    """Counts words and n-grams of each batch by language; the n-grams of a word are made once and count as often as it does."""

    def run(batches):
        for batch in batches:
            for low, high in slabs(batch.column(0), SLAB):
                t = tokenize(batch.column(0).slice(low, high - low), LETTERS)
                lang = batch.column(1).slice(low, high - low).to_numpy(zero_copy_only=False).astype(np.int64)[t.owner()]
                for k in np.unique(lang):
                    own = np.flatnonzero(lang == k)
                    word, example, n = np.unique(t.hash[own], return_index=True, return_counts=True)
                    yield _counts(0, word, k, n)
                    order = np.argsort(example)
                    example, n = own[example[order]], n[order]
                    for size, h, owner in grams(t.data, t.start[example], t.end[example]):
                        gram, back = np.unique(h, return_inverse=True)
                        yield _counts(size, gram, k, np.bincount(back, n[owner], minlength=len(gram)).astype(np.int64))

    return run


def _counts(kind, h, lang, n):
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h.view(np.int64)), pa.array(np.full(len(h), lang, np.int32)), pa.array(n)], names=["kind", "feature", "lang", "n"])


def train(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model from at most `sample` texts of each language (on average: those whose key's hash is below a bound)."""
    own = docs.filter(F.col(lang).isNotNull())
    totals = sorted((r[0], r[1]) for r in own.groupBy(lang).count().collect())
    names = [n for n, _ in totals]
    if not names:
        return Model([], np.zeros((LONGEST + 1, 0)), _features([], []), _features([], []))
    share = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(1 << 20)) / float(1 << 20)
    number = T.StructType([T.StructField("name", docs.schema[lang].dataType), T.StructField("lang", T.IntegerType()), T.StructField("share", T.DoubleType())])
    numbers = docs.sparkSession.createDataFrame([(name, k, min(1.0, sample / n)) for k, (name, n) in enumerate(totals)], number)
    named = own.select(F.col(f"`{lang}`").alias("name"), text_of(text).alias("text"), share.alias("at"))
    # numbers: a row for each language that is learnt, as the model has
    rows = named.join(F.broadcast(numbers), "name").filter("at < share").select("text", "lang")
    counts = rows.mapInArrow(batchwise(counter()), "kind int, feature long, lang int, n long")
    sums = counts.groupBy("kind", "feature", "lang").agg(F.sum("n").alias("n"))
    table = written(sums.groupBy("kind", "feature").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("by_lang")), "language-counts")
    seen = table.select("kind", (F.col("total") >= 2).alias("ranked"), F.explode("by_lang").alias("c")).groupBy("kind", "c.lang", "c.n", "ranked").count().collect()
    whole = np.zeros((LONGEST + 1, len(names)))
    levels: dict[int, dict[int, int]] = {}
    for kind, k, n, ranked, count in seen:
        whole[kind, k] += n * count
        if ranked:
            levels.setdefault(kind * len(names) + k, {})[n] = count
    # for each kind and language: the least count that is kept, and the share of the features with just that count
    bounds = [_bound(levels.get(i, {}), WORDS_KEPT if i < len(names) else GRAMS_KEPT // LONGEST) for i in range(whole.size)]
    least, part = F.array(*[F.lit(int(n)) for n, _ in bounds]), F.array(*[F.lit(float(x)) for _, x in bounds])
    place = lambda c: F.col("kind") * len(names) + c["lang"]
    at = F.pmod("feature", F.lit(1 << 20)) / float(1 << 20)
    kept = table.filter("total >= 2").filter(F.exists("by_lang", lambda c: (c["n"] > F.get(least, place(c))) | ((c["n"] == F.get(least, place(c))) & (at < F.get(part, place(c)))))).select("kind", "feature", "by_lang")
    words, parts = kept.filter("kind = 0").toArrow(), kept.filter("kind > 0").toArrow()
    dropped(table)
    return Model(names, np.log(UNSEEN / (whole + 1.0)), *[_features(x["feature"].to_numpy(), x["by_lang"].combine_chunks()) for x in (words, parts)])


def _bound(levels: dict[int, int], quota: int) -> tuple[int, float]:
    for n in sorted(levels, reverse=True):
        if levels[n] >= quota:
            return n, quota / levels[n]
        quota -= levels[n]
    return 0, 0.0


def _features(found, by_lang) -> Features:
    if not len(found):
        return Features(Lookup(np.zeros(0, np.uint64)), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0))
    if isinstance(by_lang, pa.ChunkedArray):
        by_lang = pa.concat_arrays(by_lang.chunks)
    h = found.view(np.uint64)
    order = np.argsort(h, kind="stable")
    size = by_lang.value_lengths().to_numpy().astype(np.int64)
    flat = by_lang.flatten()
    _, at = _spread(np.cumsum(size) - size, size, order)
    n = flat.field("n").to_numpy()[at]
    return Features(Lookup(h), np.append(0, np.cumsum(size[order])), flat.field("lang").to_numpy().astype(np.int64)[at], np.log((n + UNSEEN) / UNSEEN))


def _spread(begin: np.ndarray, size: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of each of the rows, its place in `rows`, and where it lies."""
    n = size[rows]
    return np.repeat(np.arange(len(rows)), n), np.arange(int(n.sum())) + np.repeat(begin[rows] - (np.cumsum(n) - n), n)


def word_scores(model: Model, t, one: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the words that stand at the tokens `one`: the kind of feature that scores each (-1: none), and begin, language and gain of their gains."""
    n_langs = len(model.names)
    kind = np.full(len(one), -1)
    hit, place = model.words.lookup.find(t.hash[one])
    kind[hit] = 0
    row, at = _spread(model.words.begin[:-1], np.diff(model.words.begin), place)
    word, lang, gain = [hit[row]], [model.words.lang[at]], [model.words.gain[at]]
    left = np.flatnonzero(kind < 0)
    token = one[left]
    by_place = np.argsort(token)
    left, token = left[by_place], token[by_place]
    for size, h, owner in grams(t.data, t.start[token], t.end[token]) if len(left) else []:
        keep = kind[left[owner]] < 0
        h, owner = h[keep], owner[keep]
        hit, place = model.grams.lookup.find(h)
        n = np.bincount(owner[hit], minlength=len(left))
        row, at = _spread(model.grams.begin[:-1], np.diff(model.grams.begin), place)
        cell, back = np.unique(left[owner[hit[row]]] * n_langs + model.grams.lang[at], return_inverse=True)
        total = np.bincount(back, model.grams.gain[at] / n[owner[hit[row]]], minlength=len(cell))
        word.append(cell // n_langs)
        lang.append(cell % n_langs)
        gain.append(total)
        kind[left[n > 0]] = size
    word = np.concatenate(word)
    order = np.argsort(word, kind="stable")
    return kind, np.searchsorted(word[order], np.arange(len(one) + 1)), np.concatenate(lang)[order], np.concatenate(gain)[order]


def text_scores(model: Model, t, texts: int) -> np.ndarray:
    """The sum over the words of each text, by language."""
    n_langs = len(model.names)
    out = np.zeros((texts, n_langs))
    if not len(t.hash):
        return out
    _, one, back = np.unique(t.hash, return_index=True, return_inverse=True)
    kind, begin, lang, gain = word_scores(model, t, one)
    pair, count = np.unique(t.owner() * len(one) + back, return_counts=True)
    text, word = pair // len(one), pair % len(one)
    for k in range(LONGEST + 1):
        of = kind[word] == k
        out += np.bincount(text[of], count[of], minlength=texts)[:, None] * model.base[k]
    size = np.diff(begin)
    step = np.cumsum(size[word]) // ADDED
    cuts = np.flatnonzero(np.diff(step, prepend=-1, append=-1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        row, at = _spread(begin[:-1], size, word[a:b])
        low, high = text[a], text[b - 1] + 1
        cells = (text[a:b][row] - low) * n_langs + lang[at]
        out[low:high] += np.bincount(cells, gain[at] * count[a:b][row], minlength=(high - low) * n_langs).reshape(-1, n_langs)
    return out


def predict(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without the text, with held_out, lang_pred and score."""
    own = ["held_out", "lang_pred", "score"]
    kept = carried(docs, own, text)
    rest = docs.select(*quoted(kept), (fold_of(key, 4) == 2).alias("held_out"))
    source = docs.select(*quoted(kept), (fold_of(key, 4) == 2).alias("held_out"), text_of(text).alias(unused("text", kept)), text_of(text).rlike(r"\p{L}").alias(unused("letters", kept)))
    schema = extended(rest.schema, "lang_pred string, score double")

    def run(batches):
        for batch in batches:
            column, letters = batch.column(len(kept) + 1), batch.column(len(kept) + 2).to_numpy(zero_copy_only=False)
            best, share = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            size = np.cumsum(pa.compute.binary_length(column).to_numpy().astype(np.int64)) // SLAB
            for k in np.unique(size) if model.names else []:
                low, high = np.searchsorted(size, k), np.searchsorted(size, k, "right")
                t = tokenize(column.slice(low, high - low), LETTERS)
                total = text_scores(model, t, high - low)
                best[low:high] = total.argmax(1)
                odds = np.exp(np.maximum(total - total.max(1, keepdims=True), -700))
                share[low:high] = odds.max(1) / odds.sum(1)
            known = letters & (best >= 0)
            names = pa.array([model.names[b] if ok else UND for b, ok in zip(best, known, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in range(len(kept) + 1)], names, pa.array(np.where(known, share, 0.0))], names=[*kept, *own])

    return source.mapInArrow(batchwise(run), schema)
