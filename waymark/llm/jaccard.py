"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts are sets of shingles of WORDS words. Equal word sequences are one text from
the start. MinHash values in BANDS bands make candidates; pairs compare their values
STEP at a time and are dropped as soon as the posterior probability of a similarity
of at least THRESHOLD, given the agreements so far, falls below TOLERANCE. All that
stay are verified exactly.

Pairs are never rows. Texts that share a band hang together in candidate groups;
small groups are packed, large ones cut into blocks, and a task takes one block or a
pair of them, finds the links in arrays, and returns each text's number of links and
a spanning set of them. So a group of any size is spread over tasks, and every pair
of it is looked at once.

At similarity THRESHOLD a pair shares no band with probability (1 - 0.8**4)**32, that
is 5e-8, and is pruned wrongly with probability below TOLERANCE at each step.

Case, punctuation and white space don't count. A text of fewer than WORDS words has
one shingle of all of them. Texts without words link with exact copies only. Null and
blank texts have no links and are classes of their own, one for each row. Repeated rows
link with each other. Ties go to the least key; rows without a key count in classes, and
a class without any has a null id. Empty tables give none. A very long text is a block
of its own, in memory of some fifty times its size. Extra columns don't matter.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._store import dropped, text_of, unused, written
from ._tokens import WORDS as BY_WORD
from ._tokens import BY_SPACE, inside_text, mixed, shingles, tokenize, window_hashes
from ._workers import batchwise, tablewise

WORDS, THRESHOLD, BANDS, ROWS, STEP, TOLERANCE = 5, 0.8, 32, 4, 16, 1e-8
VALUES = BANDS * ROWS
#: Texts and tokens of a block, and bytes of text tokenised at a time.
BLOCK_TEXTS, BLOCK_TOKENS, SLAB = 1500, 750_000, 1 << 20
#: Side of the squares in which the pairs of a block are looked at, and the most pairs held as lists at a time.
SIDE, PAIRS = 512, 1 << 15

_draw = np.random.default_rng(20)
FACTORS = _draw.integers(0, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1)
MASKS = _draw.integers(0, 1 << 32, VALUES, dtype=np.uint32)


def minhashes(found: np.ndarray, first: np.ndarray) -> np.ndarray:
    """VALUES MinHash values of each set; found may hold a shingle twice. Sets without any get the greatest value."""
    n = len(first) - 1
    out = np.full((VALUES, n), np.uint32(0xFFFFFFFF))
    some = np.flatnonzero(np.diff(first))
    low = 0
    while low < len(some):
        high = max(low + 1, int(np.searchsorted(first[some + 1], first[some[low]] + (1 << 15), "right")))
        part = (found[first[some[low]] : first[some[high - 1] + 1]] >> np.uint64(32)).astype(np.uint32)
        begin = first[some[low:high]] - first[some[low]]
        for k in range(VALUES):
            out[k, some[low:high]] = np.minimum.reduceat((part ^ MASKS[k]) * FACTORS[k], begin)
        low = high
    return out


def bands(values: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each text."""
    v = values.astype(np.uint64).reshape(BANDS, ROWS, -1)
    key = np.arange(BANDS, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        key = mixed(key ^ (v[:, r] + np.uint64(0x51ED270B0A1F39C1)))
    return key


@lru_cache(maxsize=4)
def least_agreements(threshold: float, tolerance: float) -> np.ndarray:
    """The fewest agreements after 0, 1, ... values with which P(similarity >= threshold) isn't below the tolerance.

    The prior of the similarity is uniform, so after m agreements in n the posterior
    is Beta(m + 1, n - m + 1); its tail is a sum of binomial terms.
    """
    out = np.zeros(VALUES + 1, np.int64)
    for n in range(1, VALUES + 1):
        terms = [lgamma(n + 2) - lgamma(k + 1) - lgamma(n + 2 - k) + k * np.log(threshold) + (n + 1 - k) * np.log1p(-threshold) for k in range(n + 2)]
        tail = np.cumsum(np.exp(terms))  # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
        out[n] = int(np.argmax(tail >= tolerance))
    return out


def pruned(values: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """The places of those pairs whose MinHash values, compared STEP at a time, leave the threshold likely enough."""
    need = least_agreements(threshold, tolerance)
    agreed, at = np.zeros(len(a), np.int64), np.arange(len(a))
    for k in range(0, VALUES, STEP):
        agreed += (values[k : k + STEP, a] == values[k : k + STEP, b]).sum(0)
        keep = agreed >= need[min(k + STEP, VALUES)]
        a, b, agreed, at = a[keep], b[keep], agreed[keep], at[keep]
    return at


class Sets:
    """Shingle sets as the numbers, in order, of those of their shingles that several sets have."""

    def __init__(self, found: np.ndarray, first: np.ndarray):
        self.size = np.diff(first)
        ids, inverse, n = np.unique(found, return_inverse=True, return_counts=True)
        shared = n > 1
        column, keep = np.cumsum(shared, dtype=np.int32) - 1, shared[inverse]
        self.column = column[inverse[keep]]
        self.first = np.concatenate([[0], np.cumsum(keep)])[first]
        self.width = int(shared.sum())

    def near(self, left: np.ndarray, right: np.ndarray, hit: np.ndarray, threshold: float, slab: int = 1 << 15) -> None:
        """Clears hit (left by right) where the similarity is below the threshold. Sets become rows of bits, a slab of shingles at a time."""
        rows, cols = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        used, place = np.concatenate([left[rows], right[cols]]), np.full((2, max(hit.shape)), -1)
        place[0, rows], place[1, cols] = np.arange(len(rows)), len(rows) + np.arange(len(cols))
        pairs = np.flatnonzero(hit)
        common = np.zeros(len(pairs), np.int32)
        for low in range(0, self.width, slab):
            words = -(-min(slab, self.width - low) // 64)
            bits = np.empty((len(used), words), np.uint64)
            for k in range(0, len(used), 64):
                part = np.zeros((len(used[k : k + 64]), words * 64), bool)
                for r, u in enumerate(used[k : k + 64].tolist()):
                    own = self.column[self.first[u] : self.first[u + 1]]
                    a, b = np.searchsorted(own, (low, low + slab))
                    part[r, own[a:b] - low] = True
                bits[k : k + 64] = np.packbits(part, axis=1).view(np.uint64)
            step = max(1, (1 << 18) // words)
            for p in range(0, len(pairs), step):
                x, y = np.divmod(pairs[p : p + step], hit.shape[1])
                common[p : p + step] += np.bitwise_count(bits[place[0, x]] & bits[place[1, y]]).sum(1, dtype=np.int32)
        for p in range(0, len(pairs), PAIRS):
            x, y = np.divmod(pairs[p : p + PAIRS], hit.shape[1])
            n = common[p : p + PAIRS]
            hit[x, y] = n >= threshold * (self.size[left[x]] + self.size[right[y]] - n) - 1e-9


def candidates(keys: np.ndarray, left: np.ndarray, right: np.ndarray, side: int = SIDE):
    """Parts of left, parts of right, and which pairs of them share a band (pairs above the diagonal, if left and right are the same)."""
    same = left is right
    for i in range(0, len(left), side):
        for j in range(i if same else 0, len(right), side):
            x, y = left[i : i + side], right[j : j + side]
            hit = np.zeros((len(x), len(y)), bool)
            for k in range(len(keys)):
                hit |= keys[k, x][:, None] == keys[k, y]
            yield x, y, np.triu(hit, 1) if same and i == j else hit


def links(found: np.ndarray, first: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD, tolerance: float = TOLERANCE):
    """Blocks of sets of left and of right, and which pairs of them are linked: pruned by their MinHash values, then verified exactly.

    Pairs are bits of a block's matrix; lists of them are never longer than PAIRS while MinHash values are compared.
    """
    values = minhashes(found, first)
    keys, sets = bands(values), Sets(found, first)
    for x, y, hit in candidates(keys, left, right):
        step = max(1, PAIRS // max(1, len(y)))
        for r in range(0, len(x), step):
            i, j = np.nonzero(hit[r : r + step])
            a, b = x[r + i], y[j]
            fits = np.minimum(sets.size[a], sets.size[b]) >= threshold * np.maximum(sets.size[a], sets.size[b]) - 1e-9
            at = np.flatnonzero(fits)
            hit[r : r + step] = False
            at = at[pruned(values, a[at], b[at], threshold, tolerance)]
            hit[r + i[at], j[at]] = True
        if hit.any():
            sets.near(x, y, hit, threshold)
            yield x, y, hit


def signed(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """key, tkey (which text a row has), id (of its sequence of words, or its bytes if it has none; null if blank), n (words) and MinHash values."""

    def run(batches):
        for batch in batches:
            size = np.cumsum(pa.compute.binary_length(batch.column(2)).to_numpy().astype(np.int64)) // SLAB
            for k in np.unique(size):
                low, high = np.searchsorted(size, k), np.searchsorted(size, k, "right")
                column = batch.column(2).slice(low, high - low)
                t = tokenize(column, BY_WORD)
                ids, n = sequence_ids(t), t.counts()
                keys = np.ascontiguousarray(bands(minhashes(*windows(t, words))).T)
                none = n == 0
                filled = none & (tokenize(column, BY_SPACE).counts() > 0)
                for j in np.flatnonzero(none).tolist():
                    ids[j] = blake2b(column[j].as_py().encode(), digest_size=16).digest() if filled[j] else None
                columns = [batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array(ids, pa.binary()), pa.array(n), pa.array([None if x else r.tobytes() for x, r in zip(none, keys, strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "tkey", "id", "n", "bands"])

    kind = dict(docs.dtypes)[key]
    source = docs.select(F.col(key).alias("key"), F.xxhash64(text_of(text)).alias("tkey"), F.lower(text_of(text)).alias("text"))
    return source.mapInArrow(batchwise(run), f"key {kind}, tkey long, id binary, n long, bands binary")


def windows(t, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of each text in order of place, repeated ones too."""
    counts = t.counts()
    if len(counts) and counts.min() < words:
        return shingles(t, words)
    at = inside_text(t.first, words)
    return window_hashes(t.hash, tuple(range(words)))[at], np.concatenate([[0], np.cumsum(counts - words + 1)])


def sequence_ids(t) -> list[bytes]:
    """128 bits for the sequence of words of each text."""
    place = (np.arange(len(t.hash)) - np.repeat(t.first[:-1], t.counts())).astype(np.uint64)
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(t.hash + place * np.uint64(salt)))])
        out.append(mixed(sums[t.first[1:]] - sums[t.first[:-1]] + t.counts().astype(np.uint64)))
    return [x.tobytes() for x in np.ascontiguousarray(np.stack(out, axis=1))]


def _exploded(batches):
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
        ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))
        yield pa.RecordBatch.from_arrays([ids, pa.array(keys)], names=["id", "band"])


def _task(words: int, threshold: float, tolerance: float):
    def run(table: pa.Table) -> pa.Table:
        """Links of one task: its texts (side 0) among each other, or those of side 1 with those of side 2."""
        ids = table["id"].to_pylist()
        side = table["side"].to_numpy()
        t = tokenize(table["text"], BY_WORD)
        right = sequence_ids(t)
        place: dict[bytes, int] = {}
        for k, i in enumerate(ids):  # a key with other texts, or a text with several rows
            if right[k] == i:
                place.setdefault(i, k)
        own = np.array(sorted(place.values()), np.int64)
        weight = table["copies"].to_numpy()
        found, first = shingles(t, words)
        left = other = own
        if (side != 0).any():
            left, other = own[side[own] == 1], own[side[own] == 2]
        n, up = np.zeros(len(ids), np.int64), np.arange(len(ids))

        def tops(x):
            while (up[x] != x).any():
                x = up[x]
            return x

        spanning = []
        for x, y, hit in links(found, first, left, other, threshold, tolerance):
            up[:] = tops(up)
            n[x] += hit @ weight[y]
            n[y] += weight[x] @ hit
            for r in np.flatnonzero(hit.any(1)):
                near = y[hit[r]]
                roots, one = np.unique(tops(near), return_index=True)
                own = int(tops(x[r : r + 1])[0])
                fresh = roots != own
                spanning += [(ids[x[r]], ids[k]) for k in near[one[fresh]]]
                up[roots] = up[own] = min(own, int(roots[0]))
        linked = np.flatnonzero(n)
        counts = pa.table({"a": pa.array([ids[k] for k in linked], pa.binary()), "b": pa.array([None] * len(linked), pa.binary()), "links": pa.array(n[linked])})
        edges = pa.table({"a": pa.array([x for x, _ in spanning], pa.binary()), "b": pa.array([y for _, y in spanning], pa.binary()), "links": pa.array([0] * len(spanning), pa.int64())})
        return pa.concat_tables([counts, edges])

    return run


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per row of docs: key, class_id (the least key of its class), copy_id (the least key of equal texts), n_links.

    A class is a connected component of links, equal texts included; n_links counts
    the other rows with a similarity of at least the threshold. The result lies in the
    shared folder; all that was written on the way is deleted.
    """
    rows, named = _classes(docs, key, text, words, threshold, tolerance)
    least = named.groupBy("label").agg(F.min("low").alias("class"))
    named_by_id = named.join(least, "label").select("id", F.col("low").alias("copy"), "class", "n_links")
    out = rows.select("key", "id").join(named_by_id, "id", "left")
    alone = F.col("id").isNull()
    out = out.select(F.col("key").alias(key), F.when(alone, F.col("key")).otherwise(F.col("class")).alias("class_id"), F.when(alone, F.col("key")).otherwise(F.col("copy")).alias("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = written(out, "near-duplicates")
    dropped(rows, named)
    return out


def _classes(docs: DataFrame, key: str, text: str, words: int, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and the texts with the label of their class; both written.

    Joins on what many rows share (a band, a label) are between written tables, so that
    both sides are plain shuffles and adaptive execution can split a hot key's rows.
    """
    if not 0.8 <= threshold <= 1:
        raise ValueError("the bands are made for similarities of 0.8 or more")
    rows = written(signed(docs, key, text, words), "signed")
    with_words = rows.filter("id is not null")
    texts = with_words.groupBy("id").agg(F.min(F.struct("key", "tkey")).alias("least"), F.min(F.when(F.col("key").isNotNull(), F.struct("key", "tkey"))).alias("keep"), F.min("key").alias("low"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.first("bands").alias("bands"))
    texts = written(texts, "texts")
    keys = texts.filter("bands is not null").select("id", "bands").mapInArrow(batchwise(_exploded), "id binary, band long")
    hubs = keys.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("last")).filter("hub != last").select("band", "hub")
    hubs = written(hubs, "hubs")
    edges = keys.join(hubs, "band").filter("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    groups = components(edges)
    active = groups.join(texts.select(F.col("id").alias("node"), "least", "copies", "n"), "node")
    sizes = active.groupBy("label").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("tokens"))
    sizes = written(sizes.withColumn("blocks", F.ceil(F.greatest(F.col("texts") / BLOCK_TEXTS, F.col("tokens") / BLOCK_TOKENS)).cast("int")), "groups")
    small = sizes.filter("blocks = 1").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("texts"), F.lit(0))).first()
    bins = max(1, -(-int(small[0]) // (BLOCK_TOKENS // 3)), -(-int(small[1]) // (BLOCK_TEXTS // 3)))
    placed = active.join(sizes.select("label", "blocks"), "label")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    task = lambda other: F.concat_ws("|", F.hex("label"), F.least(other, block).cast("string"), F.greatest(other, block).cast("string"))
    side = lambda other: F.when(other == block, 0).when(other > block, 1).otherwise(2)
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(task(other).alias("task"), side(other).alias("side")))
    packed = F.array(F.struct(F.pmod(F.xxhash64("label"), F.lit(bins)).cast("string").alias("task"), F.lit(0).alias("side")))
    at = lambda of, own: F.xxhash64(F.col(of), own)
    tasks = placed.select(at("least.key", F.col("least.tkey")).alias("at"), F.col("node").alias("id"), "copies", F.inline(F.when(F.col("blocks") == 1, packed).otherwise(pairs)))
    whole = docs.select(at(key, F.xxhash64(text_of(text))).alias("at"), F.lower(text_of(text)).alias("text"))
    given = tasks.join(whole, "at").select("task", "side", "id", "copies", "text")
    found = written(given.groupBy("task").applyInArrow(tablewise(_task(words, threshold, tolerance)), "a binary, b binary, links long"), "links")
    counts = found.filter("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    classes = components(found.filter("b is not null").select("a", "b"))
    named = texts.select("id", "low", "keep", "copies").join(counts, "id", "left").join(classes.toDF("id", "label"), "id", "left")
    named = named.select("id", "low", "keep", F.coalesce("label", "id").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = written(named, "classes")
    dropped(texts, hubs, groups, sizes, found, classes)
    return rows, named


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class: that with the least key, then the least hash of its text. Rows without a key or with a blank text stay."""
    rows, named = _classes(docs, key, text, WORDS, THRESHOLD, TOLERANCE)
    least = named.groupBy("label").agg(F.min("keep").alias("keep")).filter("keep is not null")
    least = written(least.select(F.col("keep.key").alias("key"), F.col("keep.tkey").alias("hash")), "kept")
    dropped(rows, named)
    blank = ~text_of(text).rlike(r"[^ \t\n\x0B\f\r]")
    own = unused("hash", docs.columns)
    hashed = docs.withColumn(own, F.xxhash64(text_of(text)))
    kept = least.select(F.col("key").alias(unused("key", [*docs.columns, own])), F.col("hash").alias(unused("kept", [*docs.columns, own])))
    a, b = kept.columns
    one = hashed.filter(~blank).join(kept, (F.col(f"`{key}`") == kept[a]) & (F.col(own) == kept[b]), "left_semi").dropDuplicates([key, own])
    return one.drop(own).unionByName(docs.filter(F.col(f"`{key}`").isNull() | blank))
