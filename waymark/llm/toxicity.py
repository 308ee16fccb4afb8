"""Toxicity by cumulative-link ordinal regression over sparse text features.

Features are a text's words and their beginnings of 4, 5 and 6 bytes. The model is
P(grade > k) = sigmoid(w.x - t_k): one weight vector for all thresholds, which are
kept in order. Its output is the expected grade and the chance of any toxicity. A
text is toxic from the chance that parts the sample's labels best (by F1).

It is fitted on a bounded sample of labelled rows (SAMPLE). Grades above 0 are given
directly, or made from a 0/1 label: labelled texts are graded by how many of their
tokens carry a feature that the sample ties to the label, in even parts.

Null and empty texts score as texts without features. Repeated rows get equal
scores. Without labels of both kinds, an empty table of labels included, nothing is
toxic. A very long text is taken apart on its own, in memory of some ten times its
size. Labelled texts with equally many marked tokens go to grades in order of their
features. Extra columns pass through unless they have the name of a result column.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._sample import Adam, Lookup, labelled, sigmoid
from ._store import carried, dropped, extended, quoted, text_of, unused, written
from ._tokens import LETTERS, hashes, mixed, slabs, tokenize
from ._workers import batchwise, rows_kept

#: Labelled rows to fit on; features in the model; rows that a feature must occur in; grades.
SAMPLE, FEATURES, LEAST_ROWS, GRADES = 20_000, 2048, 5, 4
PREFIXES = (4, 5, 6)


class Model(NamedTuple):
    lookup: Lookup
    weights: np.ndarray
    thresholds: np.ndarray
    cutoff: float


def best_cutoff(chance: np.ndarray, yes: np.ndarray) -> float:
    """The chance at which F1 is greatest, half way to the next lower one."""
    order = np.argsort(-chance, kind="stable")
    p, hits = chance[order], np.cumsum(yes[order])
    ends = np.append(p[1:] != p[:-1], True)
    f1 = np.where(ends, 2 * hits / (np.arange(1, len(p) + 1) + max(1, yes.sum())), -1)
    k = int(f1.argmax())
    return float((p[k] + p[k + 1]) / 2 if k + 1 < len(p) else p[k] / 2)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each feature of each text, and the text it belongs to."""
    t = tokenize(column, LETTERS)
    owner = t.owner()
    found, owners = [t.hash], [owner]
    for k in PREFIXES:
        long = np.flatnonzero(t.end - t.start > k)
        found.append(mixed(hashes(t.data, t.start[long], t.start[long] + k, LETTERS.value) + np.uint64(k)))
        owners.append(owner[long])
    return np.concatenate(found), np.concatenate(owners)


def counted(column: pa.Array, lookup: Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, feature and log(1 + count) of the model's features in each text."""
    width, found = max(1, len(lookup.keys)), []
    for low, high in slabs(column):
        h, owner = features(column.slice(low, high - low))
        at, place = lookup.find(h)
        found.append(np.stack(np.unique((owner[at] + low) * width + place, return_counts=True)))
    pair, count = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return pair // width, pair % width, np.log1p(count)


def chosen_features(sample: DataFrame, most: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """The features that tell labels apart best, and whether each goes with the label.

    Rows with and without the label are counted for each feature; the measure is
    the likelihood ratio of that two-by-two table.
    """

    def run(batches):
        for batch in batches:
            for low, high in slabs(batch.column(0)):
                h, owner = features(batch.column(0).slice(low, high - low))
                label = (batch.column(1).slice(low, high - low).to_numpy(zero_copy_only=False) > 0).astype(np.int64)
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                h, label = h[new], label[owner[new]]
                key, begin = np.unique(h, return_index=True)
                n = np.diff(np.append(begin, len(h)))
                with_label = np.add.reduceat(label, begin) if len(h) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(with_label), pa.array(n - with_label)], names=["feature", "yes", "no"])

    totals = sample.agg(F.count(F.when(F.col("label") > 0, 1)), F.count(F.when(F.col("label") <= 0, 1))).first()
    yes, no = totals
    if not yes or not no:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    sums = sample.mapInArrow(batchwise(run), "feature long, yes long, no long").groupBy("feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    a, b = F.col("yes"), F.col("no")
    term = lambda x, total, share: F.when(x > 0, x * F.log(x / (total * share))).otherwise(0.0)
    share = (a + b) / float(yes + no)
    ratio = term(a, yes, share) + term(b, no, share) + term(yes - a, yes, 1 - share) + term(no - b, no, 1 - share)
    best = sums.filter(a + b >= LEAST_ROWS).filter(a + b < yes + no).select("feature", (a * no > b * yes).alias("toward"), ratio.alias("ratio"))
    rows = best.orderBy(F.desc("ratio"), "feature").limit(most).collect()
    return np.array([r["feature"] for r in rows], np.int64).view(np.uint64), np.array([r["toward"] for r in rows], bool)


def fit(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grade: np.ndarray, width: int, steps: int = 150, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by maximum likelihood; thresholds are a first one and positive gaps."""
    top = int(grade.max()) if len(grade) else 0
    params = {"w": np.zeros(width), "t": np.zeros(max(1, top))}
    best = Adam(params, 0.1)
    n = max(1, len(grade))
    if top == 0:
        return params["w"], np.array([50.0])
    for _ in range(steps):
        score = np.bincount(rows, values * params["w"][cols], minlength=n)
        gaps = np.exp(params["t"][1:])
        cuts = params["t"][0] + np.concatenate([[0.0], np.cumsum(gaps)])
        above = np.concatenate([np.ones((n, 1)), sigmoid(score[:, None] - cuts), np.zeros((n, 1))], axis=1)
        slope = above * (1 - above)
        i = np.arange(n)
        chance = np.maximum(above[i, grade] - above[i, grade + 1], 1e-12)
        d_score = (slope[i, grade] - slope[i, grade + 1]) / chance
        d_cut = np.zeros((n, top))
        inner = grade > 0
        d_cut[i[inner], grade[inner] - 1] -= (slope[i, grade] / chance)[inner]
        inner = grade < top
        d_cut[i[inner], grade[inner]] += (slope[i, grade + 1] / chance)[inner]
        d_cut = d_cut.sum(0)
        to_end = np.cumsum(d_cut[::-1])[::-1]
        best.step({"w": -np.bincount(cols, values * d_score[rows], minlength=width) / n + ridge * params["w"], "t": -np.concatenate([[to_end[0]], to_end[1:] * gaps]) / n})
    return params["w"], params["t"][0] + np.concatenate([[0.0], np.cumsum(np.exp(params["t"][1:]))])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, grades: int = GRADES) -> Model:
    """A model from at most `sample` labelled documents. A label above 1 is a grade already."""
    rows = written(labelled(docs, labels, label, sample), "toxicity-sample")
    keys, toward = chosen_features(rows)
    lookup = Lookup(keys)
    marks = toward[np.argsort(keys)] if len(keys) else toward

    def run(batches):
        for batch in batches:
            at, col, value = counted(batch.column(0), lookup)
            cut = np.searchsorted(at, np.arange(batch.num_rows + 1))
            lists = lambda x, k: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, k))
            yield pa.RecordBatch.from_arrays([batch.column(1), lists(col, pa.int32()), lists(value, pa.float32())], names=["label", "cols", "values"])

    found = rows.mapInArrow(batchwise(run), "label int, cols array<int>, values array<float>").toArrow()
    dropped(rows)
    label_of = found["label"].to_numpy().astype(np.int64)
    sizes = pa.compute.list_value_length(found["cols"]).to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(label_of)), sizes)
    col = pa.compute.list_flatten(found["cols"]).to_numpy().astype(np.int64)
    value = pa.compute.list_flatten(found["values"]).to_numpy().astype(np.float64)
    row, col, value, label_of = _by_content(row, col, value, label_of)
    grade = np.maximum(label_of, 0)
    if len(grade) and grade.max() == 1 and grades > 2:
        marked = np.bincount(row, np.expm1(value) * marks[col] if len(col) else None, minlength=len(grade))
        toxic = np.flatnonzero(grade)
        place = np.argsort(np.argsort(marked[toxic], kind="stable"), kind="stable")
        grade[toxic] = 1 + place * (grades - 1) // max(1, len(toxic))
    weights, thresholds = fit(row, col, value, grade, max(1, len(keys)))
    if not grade.any():
        return Model(lookup, weights, thresholds, 1.0)
    raw = np.bincount(row, value * weights[col], minlength=len(grade)) if len(col) else np.zeros(len(grade))
    return Model(lookup, weights, thresholds, best_cutoff(sigmoid(raw - thresholds[0]), grade > 0))


def _by_content(row: np.ndarray, col: np.ndarray, value: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sample in order of label and features, so that the order in which rows arrive doesn't count where they are cut into grades."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(col.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + value.view(np.uint64)))])
    first = np.searchsorted(row, np.arange(len(label) + 1))
    order = np.lexsort((sums[first[1:]] - sums[first[:-1]], label))
    size = np.diff(first)[order]
    at = np.arange(len(row)) + np.repeat(first[:-1][order] - (np.cumsum(size) - size), size)
    return np.repeat(np.arange(len(label)), size), col[at], value[at], label[order]


def above_thresholds(column: pa.Array, model: Model) -> np.ndarray:
    """For each text, P(grade > k) for each threshold."""
    at, col, value = counted(column, model.lookup)
    s = np.bincount(at, value * model.weights[col], minlength=len(column)) if len(at) else np.zeros(len(column))
    return sigmoid(s[:, None] - model.thresholds)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the text, with expected_severity, p_toxic, grade (the likeliest, the lower one of equals) and is_toxic."""
    own = ["expected_severity", "p_toxic", "grade", "is_toxic"]
    kept = carried(docs, own, text)
    rest = docs.select(*quoted(kept))
    source = docs.select(*quoted(kept), text_of(text).alias(unused("text", kept)))
    schema = extended(rest.schema, "expected_severity double, p_toxic double, grade int, is_toxic boolean")

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            above = above_thresholds(batch.column(len(kept)), model)
            chance = -np.diff(np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1), axis=1)
            new = [pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(chance.argmax(1).astype(np.int32)), pa.array(above[:, 0] >= model.cutoff)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in range(len(kept))], *new], names=[*kept, *own])

    return source.mapInArrow(batchwise(run), schema)


def without_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that score() doesn't find toxic."""
    return rows_kept(docs, text, lambda column: above_thresholds(column, model)[:, 0] < model.cutoff)
