"""Document quality by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE tokens. Every passage is encoded: figures of
its bytes, tokens and repetitions go through one hidden layer. Gated attention
weighs the passages, a = softmax(w.(tanh(V h) * sigmoid(U h))), and the weighted sum
of the codes gives the score. Weights are learned from document labels only, on a
bounded sample (SAMPLE).

Null and empty texts have one empty passage. Repeated rows get equal scores. Without
labels of both kinds every score is the share of label 1, or 1 without any, an empty
table of labels included. A very long text is one bag on its own, in memory of some
twenty times its size. Ties don't arise but between equal texts; equal attention
weights share alike. Extra columns pass through unless they have the name of a result
column.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._sample import Adam, labelled, sigmoid
from ._store import carried, dropped, extended, fold_of, quoted, text_of, unused, written
from ._tokens import BY_SPACE, slabs, tokenize
from ._workers import batchwise, rows_kept

#: Labelled rows to fit on; tokens of a passage; sizes of codes and of the attention; score from which a text is good.
SAMPLE, PASSAGE, CODE, GATE, GOOD = 8000, 48, 16, 8, 0.7
#: Bytes looked at on their own, and those that stand for a group.
MARKS = b"!#$%&*|@,.-_/<>{}()[]=+\\:;\"'?~^"
#: Texts encoded at a time, in bytes; passages fitted at a time; passages of a piece; pieces that the driver gets at a time.
SLAB, ROWS, PIECE, SENT = 1 << 19, 1 << 15, 64, 1 << 10



def _classes() -> np.ndarray:
    table = np.full(256, 5, np.int64)  # other
    table[97:123], table[65:91], table[48:58], table[128:] = 0, 1, 2, 3
    table[[32, *range(9, 14)]] = 4
    for k, mark in enumerate(MARKS):
        table[mark] = 6 + k
    return table


CLASSES, N_CLASSES = _classes(), 6 + len(MARKS)
WIDTH = N_CLASSES + 10


def _shares(flag: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flag)])
    return (sums[begin + n] - sums[begin]) / np.maximum(n, 1)


def _seen_before(owner: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the same owner has the same key further up."""
    order = np.lexsort((key, owner))
    same = np.zeros(len(key), bool)
    same[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    return same


def encode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The figures of each passage, and where each text's passages begin."""
    t = tokenize(column, BY_SPACE)
    counts = t.counts()
    bags = np.maximum(1, -(-counts // PASSAGE))
    first_bag = np.concatenate([[0], np.cumsum(bags)])
    text = np.repeat(np.arange(len(counts)), bags)
    begin = t.first[text] + (np.arange(first_bag[-1]) - first_bag[text]) * PASSAGE
    n = np.minimum(PASSAGE, t.first[text + 1] - begin)
    out = np.zeros((len(text), WIDTH))
    if not len(t.hash):
        return out, first_bag
    safe = np.minimum(begin, len(t.start) - 1)
    low = np.where(n > 0, t.start[safe], 0)
    high = np.where(n > 0, t.end[np.minimum(begin + n, len(t.end)) - 1], 0)
    sizes = np.maximum(high - low, 0)
    ends = np.cumsum(sizes)
    # bytes between passages count for none
    passage = np.repeat(np.arange(len(text)), sizes)
    place = np.arange(int(ends[-1])) + np.repeat(low - (ends - sizes), sizes)
    kinds = np.bincount(passage * N_CLASSES + CLASSES[t.data[place]], minlength=len(text) * N_CLASSES).reshape(len(text), N_CLASSES)
    out[:, :N_CLASSES] = np.sqrt(kinds / np.maximum(sizes, 1)[:, None])
    length = t.end - t.start
    last, head = CLASSES[t.data[t.end - 1]], CLASSES[t.data[t.start]]
    owner = t.owner()
    again = np.zeros(len(t.hash), bool)
    again[1:] = (t.hash[1:] == t.hash[:-1]) & (owner[1:] == owner[:-1])
    pair = t.hash.copy()
    pair[:-1] = pair[:-1] * np.uint64(3) + t.hash[1:]
    upper = (head == 1) & (CLASSES[t.data[np.minimum(t.start + 1, t.end - 1)]] == 1)
    k = N_CLASSES
    for values in (again, last >= 5, upper, head >= 5, length / 10.0, length > 20, length == 1):
        out[:, k] = _shares(values, begin, n)
        k += 1
    numbered = np.repeat(np.arange(len(text)), n)
    inside = np.arange(len(numbered)) + np.repeat(begin - (np.cumsum(n) - n), n)
    twice = np.zeros(len(t.hash), bool)
    twice[inside] = _seen_before(numbered, t.hash[inside])
    out[:, k] = _shares(twice, begin, n)
    out[:, k + 1] = _shares(_seen_before(owner, pair), begin, n)
    out[:, k + 2] = np.log1p(n) / 4
    return out, first_bag


class Model(NamedTuple):
    params: dict[str, np.ndarray]
    centre: np.ndarray
    scale: np.ndarray


def forward(p: dict, x: np.ndarray, first: np.ndarray) -> dict:
    """Codes, attention weights and the score of each bag."""
    h = np.tanh(x @ p["W"] + p["b"])
    v, u = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
    e = (v * u) @ p["w"]
    sizes, begin = np.diff(first), first[:-1]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, begin), sizes))
    a = e / np.repeat(np.add.reduceat(e, begin), sizes)
    z = np.add.reduceat(a[:, None] * h, begin, axis=0)
    return {"h": h, "v": v, "u": u, "a": a, "z": z, "y": sigmoid(z @ p["c"] + p["d"][0]), "sizes": sizes, "begin": begin}


def gradients(p: dict, x: np.ndarray, first: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    f = forward(p, x, first)
    h, v, u, a = f["h"], f["v"], f["u"], f["a"]
    g = (f["y"] - label) / len(label)
    dz = np.repeat(g[:, None] * p["c"], f["sizes"], axis=0)
    da = (dz * h).sum(1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, f["begin"]), f["sizes"]))
    dv = de[:, None] * p["w"] * u * (1 - v * v)
    du = de[:, None] * p["w"] * v * u * (1 - u)
    dh = a[:, None] * dz + dv @ p["V"].T + du @ p["U"].T
    dx = dh * (1 - h * h)
    return {"W": x.T @ dx, "b": dx.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ de, "c": f["z"].T @ g, "d": np.array([g.sum()])}


class Bags(NamedTuple):
    """Bags of passages in an array or file: bag k is the pieces first[k] to first[k + 1], a piece the rows of x from `begin` on, `size` of them."""

    x: np.ndarray
    first: np.ndarray
    begin: np.ndarray
    size: np.ndarray

    def of(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The passages of some bags one after the other, and where each bag's begin."""
        pieces = np.concatenate([np.arange(self.first[k], self.first[k + 1]) for k in own])
        ends = np.cumsum(self.size[pieces])
        rows = np.arange(int(ends[-1])) + np.repeat(self.begin[pieces] - (ends - self.size[pieces]), self.size[pieces])
        return self.x[rows], np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(self.first[own + 1] - self.first[own])])]


def fit(bags: Bags, label: np.ndarray, centre: np.ndarray, scale: np.ndarray, epochs: int = 30, batch: int = 128, ridge: float = 1e-5) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(7)
    p = {"W": draw.normal(0, 1 / np.sqrt(len(centre)), (len(centre), CODE)), "b": np.zeros(CODE), "V": draw.normal(0, 0.3, (CODE, GATE)), "U": draw.normal(0, 0.3, (CODE, GATE)), "w": draw.normal(0, 0.3, GATE), "c": draw.normal(0, 0.3, CODE), "d": np.zeros(1)}
    sizes = np.add.reduceat(bags.size, bags.first[:-1])
    best = Adam(p, 0.01)
    for epoch in range(epochs):
        best.rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order = draw.permutation(len(label))
        for k in range(0, len(order), batch):
            own, total = order[k : k + batch], {}
            # a batch's gradients are summed over runs of about ROWS passages, or of one longer bag
            for part in np.split(own, np.flatnonzero(np.diff(np.cumsum(sizes[own]) // ROWS)) + 1):
                x, first = bags.of(part)
                g = gradients(p, (x - centre) / scale, first, label[part])
                total = {n: v * (len(part) / len(own)) + total.get(n, 0) for n, v in g.items()}
            best.step({n: v + ridge * p[n] for n, v in total.items()})
    return p


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, keep=None) -> Model | float:
    """A model from at most `sample` labelled documents, or a constant score if they don't have both labels.

    All passages of these documents are fitted on. Their figures, WIDTH numbers of four bytes
    for each passage, some six tenths of the sampled texts' size, come in pieces of PIECE passages
    into a temporary file of the driver, from which a batch is read at a time. So the driver
    holds some passages, and a few numbers for each piece, not the sample; at least the longest text's.
    """
    rows = labelled(docs, labels, label, sample, keep=keep)

    def run(batches):
        for batch in batches:
            for low, high in slabs(batch.column(0), SLAB):
                part = batch.slice(low, high - low)
                x, first = encode(part.column(0))
                for y, bag in zip(part.column(1).to_pylist(), np.split(x.astype(np.float32), first[1:-1]), strict=True):
                    raw, own = bag.tobytes(), os.urandom(16)
                    said = (int(y > 0), hashlib.sha256(raw).digest(), own)
                    pieces = [bag[k : k + PIECE].tobytes() for k in range(0, len(bag), PIECE)]
                    # few enough at a time for any long text
                    for k in range(0, len(pieces), PIECE):
                        some = pieces[k : k + PIECE]
                        yield pa.RecordBatch.from_arrays([*[pa.array([v] * len(some)) for v in said], pa.array(range(k, k + len(some)), pa.int32()), pa.array(some, pa.binary())], names=["label", "hash", "own", "piece", "bag"])

    found = written(rows.mapInArrow(batchwise(run), "label long, hash binary, own binary, piece int, bag binary"), "bags")
    try:
        with tempfile.TemporaryFile() as file:
            at, bags = 0, {}
            # a partition comes at a time, and one of the file may hold the whole sample
            for r in found.repartition(max(1, -(-found.count() // SENT))).toLocalIterator():
                n = len(r["bag"]) // (4 * WIDTH)
                bags.setdefault(bytes(r["own"]), (r["label"], bytes(r["hash"]), []))[2].append((r["piece"], at, n))
                file.write(r["bag"])
                at += n
            bags = sorted((y, h, sorted(pieces)) for y, h, pieces in bags.values())  # the order in which rows arrive doesn't count
            y = np.array([b[0] for b in bags], float)
            if len(y) == 0 or y.min() == y.max():
                return float(y.mean()) if len(y) else 1.0
            file.flush()
            first = np.concatenate([[0], np.cumsum([len(b[2]) for b in bags])])
            begin, size = (np.array([p[k] for b in bags for p in b[2]]) for k in (1, 2))
            x = np.memmap(file, np.float32, "r", shape=(at, WIDTH))
            centre = sum(x[b : b + n].sum(0, dtype=float) for b, n in zip(begin, size, strict=True)) / at
            scale = np.sqrt(sum(((x[b : b + n] - centre) ** 2).sum(0) for b, n in zip(begin, size, strict=True)) / at) + 1e-3
            return Model(fit(Bags(x, first, begin, size), y, centre, scale), centre, scale)
    finally:
        dropped(found)


def _scored(column: pa.Array, model: Model | float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, number of passages and greatest attention of each text."""
    x, first = encode(column)
    sizes = np.diff(first)
    if isinstance(model, float):
        return np.full(len(column), model), sizes, np.zeros(len(column))
    f = forward(model.params, (x - model.centre) / model.scale, first)
    return f["y"], sizes, np.maximum.reduceat(f["a"], first[:-1])


def score(docs: DataFrame, model: Model | float, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without the text, with held_out, score (0 to 1), predicted, passages and attention (the greatest weight)."""
    own = ["held_out", "score", "predicted", "passages", "attention"]
    kept = carried(docs, own, text)
    rest = docs.select(*quoted(kept), (fold_of(key, 4) == 2).alias("held_out"))
    source = docs.select(*quoted(kept), (fold_of(key, 4) == 2).alias("held_out"), text_of(text).alias(unused("text", kept)))
    schema = extended(rest.schema, "score double, predicted int, passages int, attention double")

    def run(batches):
        for batch in batches:
            column = batch.column(len(kept) + 1)
            for low, high in slabs(column, SLAB):
                y, sizes, top = _scored(column.slice(low, high - low), model)
                new = [pa.array(y), pa.array((y >= GOOD).astype(np.int32)), pa.array(sizes.astype(np.int32)), pa.array(top)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(low, high - low) for c in range(len(kept) + 1)], *new], names=[*kept, *own])

    return source.mapInArrow(batchwise(run), schema)


def only_good(docs: DataFrame, model: Model | float, text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that score() predicts to be good."""
    return rows_kept(docs, text, lambda column: _scored(column, model)[0] >= GOOD)
