"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over token positions; positions marked 0 are ignored. The hash of
the positions marked 1 is taken at every place of every benchmark item and of every
text, and equal hashes are joined. A hit fixes how text and item line up; the tokens
around it are then compared one by one, and the overlap counts if a stretch of SPAN
tokens (or the whole item, if shorter) agrees in at least AGREE of its tokens. So a
passage with words substituted is found, even where no long run is unchanged.

A benchmark of up to PASSES blocks of BLOCK tokens goes to the executors block by block,
one pass over the texts for each. A larger one is never held anywhere: its seeds are a
table, the texts make one pass that keeps the seeds that a bit table of fixed size (BITS)
lets through, and equal hashes are joined by a shuffle; only texts and items of a hit are
then lined up. So what is broadcast doesn't grow with the benchmark. Each length of item has
masks of which one hits wherever the overlap counts (SHORT, MASKS); tests enumerate
this. Items of fewer than PARTLY tokens are matched whole, down to a single token; a
caller for whom such items are common phrases sets `least`. Items without tokens, null
and empty texts overlap with nothing; repeated rows give equal results. Of several
line-ups of a text with an item the one with most equal tokens is told, the first in
the text of equal ones. A very long text is taken apart on its own, in memory of some
fifteen times its size; its hits are lined up PAIRS tokens at a time. Extra columns
don't matter to overlaps() and stay as they are in clean(). Empty tables give none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ._sample import Lookup
from ._store import dropped, extended, text_of, unused, written
from ._tokens import WORDS, inside_text, mixed, slabs, tokenize, window_hashes
from ._workers import batchwise, rows_kept

SPAN, AGREE, LEAST, PARTLY, BLOCK, PASSES = 13, 0.75, 1, 7, 500_000, 4
#: Size of the bit table as a power of two, and bits set for each seed.
BITS, PROBES = 28, 2
#: Position masks for items of SPAN tokens or more: with any three substitutions in SPAN tokens one of them still hits.
MASKS = ("1101111", "1110001011", "10111011", "110010000111", "11110011")
#: Those for shorter items, by the least number of tokens: one substitution in 7, two in 8 to 11, three in 12.
SHORT = {
    7: ("11011",),
    8: ("11101", "1000111", "10010011"),
    9: ("111011", "11111", "110000111", "1101011"),
    12: ("110111", "110001011", "11101001", "110100011"),
}
#: Tokens compared at a time, and hits lined up at a time.
PAIRS, HITS = 1 << 20, 1 << 18


def places(mask: str) -> tuple[int, ...]:
    return tuple(i for i, c in enumerate(mask) if c == "1")


def lowered(texts: list[str] | pa.Array) -> pa.Array:
    return pc.utf8_lower(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))


def lengths() -> list[tuple[int, float, tuple[str, ...]]]:
    """Least number of tokens, the number that is too many, and masks, for each kind of item."""
    masks = {n: ("1" * n,) for n in range(1, PARTLY)} | SHORT | {SPAN: MASKS}
    return [(low, high, masks[low]) for low, high in zip(masks, [*list(masks)[1:], np.inf], strict=True)]


class Seeds:
    """The seeds of a block of benchmark items."""

    def __init__(self, ids: list, texts: list[str], least: int = LEAST):
        t = tokenize(lowered(texts), WORDS)
        self.ids, self.hash, self.first, self.count = ids, t.hash, t.first, t.counts()
        keys, at = [], []
        #: The masks that some item needs, each with a number that tells its hashes from others'.
        self.masks = []
        for low, high, masks in lengths():
            held = np.repeat((self.count >= max(low, least)) & (self.count < high), self.count)
            if not held.any():
                continue
            for k, mask in enumerate(masks):
                p = inside_text(t.first, len(mask))
                p = p[held[p]]
                self.masks.append((len(mask), places(mask), low * 100 + k))
                keys.append(window_hashes(t.hash, places(mask))[p] + np.uint64(self.masks[-1][2]))
                at.append(p)
        keys, at = (np.concatenate(keys), np.concatenate(at)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(keys, kind="stable")
        self.keys = keys = keys[order]
        self.at = at[order]
        self.item = np.searchsorted(self.first, self.at, "right") - 1
        self.lookup = Lookup(np.unique(keys))
        self.begin = np.searchsorted(keys, self.lookup.keys)
        self.n = np.diff(np.append(self.begin, len(keys)))

    def hits(self, h: np.ndarray, first: np.ndarray):
        """text, item, and where the item's first token lies among the text's, for the hits of each seed; some HITS of them at a time, distinct."""
        for span, at, salt in self.masks:
            p = inside_text(first, span)
            if not len(p):
                continue
            hit, place = self.lookup.find(window_hashes(h, at)[p] + np.uint64(salt))
            cuts = np.flatnonzero(np.diff(np.cumsum(self.n[place]) // HITS, prepend=-1, append=-1))
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                own, n = place[low:high], self.n[place[low:high]]
                seed = np.arange(int(n.sum())) + np.repeat(self.begin[own] - (np.cumsum(n) - n), n)
                where = np.repeat(p[hit[low:high]], n)
                found = np.stack([np.searchsorted(first, where, "right") - 1, self.item[seed], where - (self.at[seed] - self.first[self.item[seed]])])
                found = found[:, np.lexsort(found)]
                yield found[:, np.append(True, (found[:, 1:] != found[:, :-1]).any(0))]

    def overlaps(self, h: np.ndarray, first: np.ndarray, known: np.ndarray | None = None):
        """text, item, first and last token of the overlap in the text, and tokens that agree, for each confirmed line-up.

        known: marks of texts whose line-ups needn't be looked at any more; read anew for each part of the hits.
        """
        for text, item, offset in self.hits(h, first):
            if known is not None:
                text, item, offset = (x[~known[text]] for x in (text, item, offset))
            step = max(1, PAIRS // int(self.count[item].max(initial=1)))
            for low in range(0, len(text), step):
                yield from self._confirmed(h, first, text[low : low + step], item[low : low + step], offset[low : low + step])

    def _confirmed(self, h, first, x, y, o):
        size = self.count[y]
        k = np.arange(int(size.max()))
        pos = o[:, None] + k
        real = (k < size[:, None]) & (pos >= first[x][:, None]) & (pos < first[x + 1][:, None])
        same = real & (h[np.clip(pos, 0, len(h) - 1)] == self.hash[np.minimum(self.first[y][:, None] + k, len(self.hash) - 1)])
        sums = np.concatenate([np.zeros((len(x), 1), np.int64), np.cumsum(same, axis=1)], axis=1)
        width = np.minimum(SPAN, size)
        best = np.zeros(len(x), np.int64)
        for w in np.unique(width):
            own = width == w
            best[own] = (sums[own, w:] - sums[own, :-w]).max(1)
        need = np.where(size < PARTLY, size, np.ceil(AGREE * width)).astype(np.int64)
        for r in np.flatnonzero(best >= need):
            agree = np.flatnonzero(same[r])
            yield int(x[r]), int(y[r]), int(o[r] + agree[0] - first[x[r]]), int(o[r] + agree[-1] - first[x[r]]), len(agree)


def block_count(benchmark: DataFrame, text: str) -> int:
    total = benchmark.agg(F.coalesce(F.sum(F.char_length(text_of(text))), F.lit(0))).first()[0]
    return max(1, -(-int(total) // (BLOCK * 4)))


def blocks(benchmark: DataFrame, key: str, text: str, n: int):
    """Rows of the benchmark, in n blocks of at most BLOCK tokens; one block at a time is on the driver."""
    sized = benchmark.select(F.col(f"`{key}`").alias("id"), text_of(text).alias("text"))
    for k in range(n):
        yield sized.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect()


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: int = LEAST) -> DataFrame:
    """A row for each text and benchmark item (of `least` tokens or more) that overlap: key, item, token places, n_match, item_tokens and share."""
    source = docs.select(F.col(f"`{key}`"), text_of(text).alias(unused("text", [key])))
    kind = dict(benchmark.dtypes)[item]
    schema = extended(docs.select(F.col(f"`{key}`")).schema, f"{item} {kind}, first_token int, last_token int, n_match int, item_tokens int, share double")
    n = block_count(benchmark, item_text)
    if n > PASSES:
        pairs = _joined(docs, benchmark, text, item, item_text, least)
        names = docs.select(F.col(f"`{key}`"), *_text_id(text)).join(pairs, ["t1", "t2"])
        return names.select(F.col(f"`{key}`"), F.col("id").alias(item), *schema.names[2:])
    out = None
    for rows in blocks(benchmark, item, item_text, n):
        found = source.mapInArrow(batchwise(_searcher(Seeds([r["id"] for r in rows], [r["text"] for r in rows], least), schema)), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _text_id(text: str) -> list:
    """128 bits that stand for a text."""
    return [F.xxhash64(text_of(text)).alias("t1"), F.xxhash64(F.lit(1), text_of(text)).alias("t2")]


def _slots(seeds: np.ndarray, size: int) -> np.ndarray:
    """The PROBES places of each seed in a bit table of 2**size bits."""
    return np.stack([(mixed(seeds + np.uint64(k)) >> np.uint64(64 - size)).astype(np.int64) for k in range(PROBES)])


def _bit_table(seeds: DataFrame, size: int) -> np.ndarray:
    """One bit for each place that a seed has: 2**size of them, however many seeds there are."""

    def run(batches):
        for batch in batches:
            at = np.unique(_slots(batch.column(0).to_numpy().view(np.uint64), size))
            word, begin = np.unique(at >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), begin) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], names=["word", "bits"])

    found = seeds.select("seed").mapInArrow(batchwise(run), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (size - 6), np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _joined(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, least: int) -> DataFrame:
    """t1, t2 (which text), id of the item, and the overlap, for each text and item that overlap, by a join on seeds."""
    size = BITS
    items = written(benchmark.select(F.monotonically_increasing_id().alias("iid"), F.col(f"`{item}`").alias("id"), text_of(item_text).alias("item")), "items")

    def seed_rows(batches):
        for batch in batches:
            own = Seeds(batch.column(0).to_pylist(), batch.column(1).to_pylist(), least)
            yield pa.RecordBatch.from_arrays([pa.array(own.keys.view(np.int64)), pa.array(np.array(own.ids, np.int64)[own.item]), pa.array((own.at - own.first[own.item]).astype(np.int32))], names=["seed", "iid", "at"])

    seeds = written(items.select("iid", "item").mapInArrow(batchwise(seed_rows), "seed long, iid long, at int"), "seeds")
    table = docs.sparkSession.sparkContext.broadcast(_bit_table(seeds, size))
    every = [(len(mask), places(mask), low * 100 + k) for low, _, masks in lengths() for k, mask in enumerate(masks)]

    def hit_rows(batches):
        bits = table.value
        for batch in batches:
            for low, high in slabs(batch.column(2)):
                t = tokenize(lowered(batch.column(2).slice(low, high - low)), WORDS)
                for span, at, salt in every:
                    p = inside_text(t.first, span)
                    h = window_hashes(t.hash, at)[p] + np.uint64(salt) if len(p) else np.zeros(0, np.uint64)
                    may = np.ones(len(h), bool)
                    for slot in _slots(h, size):
                        may &= (bits[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
                    p, h = p[may], h[may]
                    own = np.searchsorted(t.first, p, "right") - 1
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own + low)), batch.column(1).take(pa.array(own + low)), pa.array(h.view(np.int64)), pa.array((p - t.first[own]).astype(np.int32))], names=["t1", "t2", "seed", "place"])

    texts = docs.select(*_text_id(text), text_of(text).alias("text"))
    hits = texts.mapInArrow(batchwise(hit_rows), "t1 long, t2 long, seed long, place int").distinct()
    lines = hits.join(seeds, "seed").groupBy("t1", "t2", "iid").agg(F.collect_set(F.col("place") - F.col("at")).alias("offsets"))
    whole = lines.join(texts.dropDuplicates(["t1", "t2"]), ["t1", "t2"]).join(items, "iid").select("t1", "t2", "id", "text", "item", "offsets")
    schema = extended(whole.select("t1", "t2", "id").schema, "first_token int, last_token int, n_match int, item_tokens int, share double")

    def confirm(batches):
        for batch in batches:
            found, rows = [], []
            for k, (own, other, offsets) in enumerate(zip(*[batch.column(c).to_pylist() for c in (3, 4, 5)], strict=True)):
                seeds_of = Seeds([0], [other], least)
                t = tokenize(lowered(pa.array([own])), WORDS)
                o = np.array(sorted(offsets), np.int64)
                step = max(1, PAIRS // max(1, int(seeds_of.count[0])))
                best = None
                for low in range(0, len(o), step):
                    x = np.zeros(len(o[low : low + step]), np.int64)
                    for _, _, a, b, n in seeds_of._confirmed(t.hash, t.first, x, x, o[low : low + step]):
                        if best is None or (n, -a) > (best[2], -best[0]):
                            best = (a, b, n)
                if best:
                    rows.append(k)
                    found.append((*best, int(seeds_of.count[0]), best[2] / int(seeds_of.count[0])))
            if rows:
                at = pa.array(rows)
                kinds = [pa.int32()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in range(3)], *[pa.array(v, kind) for v, kind in zip(zip(*found, strict=True), kinds, strict=True)]], names=schema.names)

    pairs = written(whole.mapInArrow(batchwise(confirm), schema), "overlaps")
    dropped(items, seeds)
    table.destroy()
    return pairs


def _searcher(seeds: Seeds, schema):
    kinds = [f.type for f in to_arrow_schema(schema)]

    def run(batches):
        for batch in batches:
            for low, high in slabs(batch.column(1)):
                best: dict[tuple[int, int], tuple] = {}
                t = tokenize(lowered(batch.column(1).slice(low, high - low)), WORDS)
                for x, y, a, b, n in seeds.overlaps(t.hash, t.first):
                    if (n, -a) > best.get((x, y), (0, 0, 0))[:2]:
                        best[x, y] = (n, -a, b)
                if not best:
                    continue
                at = pa.array([x + low for x, _ in best], pa.int64())
                size = [int(seeds.count[y]) for _, y in best]
                found = [[seeds.ids[y] for _, y in best], [-v[1] for v in best.values()], [v[2] for v in best.values()], [v[0] for v in best.values()], size, [v[0] / s for v, s in zip(best.values(), size, strict=True)]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *[pa.array(v, k) for v, k in zip(found, kinds[1:], strict=True)]], names=schema.names)

    return run


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", least: int = LEAST) -> DataFrame:
    """docs without the rows whose text overlaps with an item of `least` tokens or more. Rows are judged where they lie: no join, no shuffle."""
    n = block_count(benchmark, item_text)
    if n > PASSES:
        pairs = _joined(docs, benchmark, text, item, item_text, least)
        a, b = unused("t1", docs.columns), unused("t2", docs.columns)
        ids = [c.alias(x) for c, x in zip(_text_id(text), (a, b), strict=True)]
        return docs.select("*", *ids).join(pairs.select(F.col("t1").alias(a), F.col("t2").alias(b)).distinct(), [a, b], "left_anti").select(*docs.columns)
    out = docs
    for rows in blocks(benchmark, item, item_text, n):
        seeds = Seeds([r["id"] for r in rows], [r["text"] for r in rows], least)

        def clear(column, seeds=seeds):
            t = tokenize(lowered(column), WORDS)
            hit = np.zeros(len(column), bool)
            for x, *_ in seeds.overlaps(t.hash, t.first, hit):
                hit[x] = True
            return ~hit

        out = rows_kept(out, text, clear)
    return out
