"""Language-model scores by deleted interpolation.

A token's probability mixes the maximum-likelihood estimates of its bigram and its
unigram with an even share, by weights that depend on how often the context occurs
(a bucket for each power of two). The weights are learned by expectation-
maximisation on held-out counts: one fold of the training texts is left out of the
counts, its tokens are put into cells of equal bucket and (nearly) equal estimates,
and the cells, a few thousand for a corpus of any size, are what the driver sees.

Counting is a request and a reply. Texts are dealt into blocks of about BLOCK bytes.
A block counts its distinct n-grams and sends each bucket of hashes one packed
array; the bucket adds up what all blocks sent and answers each with the totals, in
the same order. So each distinct n-gram of a block is shuffled once, common ones are
added up before the shuffle, and neither a table of all n-grams nor a hot n-gram ever
meets one task.

Null texts count as empty: one end token. Repeated rows count as often as they
occur and get equal scores. Without training texts every token has the even share.
"""

from __future__ import annotations

import gc
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import dropped, fold_of, text_of, written
from ._tokens import BY_SPACE, mixed, tokenize
from ._workers import pairwise, tablewise

#: Bytes of a block, and the fewest that a block is made for; bytes of text for a bucket of n-grams; blocks whose requests meet at once.
BLOCK, LEAST, BUCKET, FAN = 12_000_000, 1_000_000, 8_000_000, 4096
LEVELS, GRAIN, ROUNDS, PRIOR = 40, 4, 60, 20.0
START, END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
PAIR = np.uint64(0xD1342543DE82EF95)
#: Fixed values of the base score: added count.
ADDED = 0.1


class Block:
    """The n-grams of a block of texts: distinct hashes, and for each token where its word, context and bigram stand among them."""

    def __init__(self, texts: pa.Array):
        t = tokenize(texts, BY_SPACE)
        n = t.counts()
        self.size = n + 1
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.owner = np.repeat(np.arange(len(n)), self.size)
        total = int(self.first[-1])
        word = np.full(total, END)
        context = np.full(total, START)
        own = np.arange(len(t.hash)) + t.owner()  # an end token stands behind every text before
        word[own] = t.hash
        context[own + 1] = t.hash
        pair = mixed(context * PAIR + word)
        self.words, where = np.unique(np.concatenate([word, context]), return_inverse=True)
        self.word, self.context = where[:total], where[total:]
        self.pairs, self.pair = np.unique(pair, return_inverse=True)

    def counts(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each word (the start counts as a word) and each bigram occurs in the given texts."""
        own = rows[self.owner]
        words = np.bincount(self.word[own], minlength=len(self.words))
        begins = np.searchsorted(self.words, START)
        if begins < len(self.words) and self.words[begins] == START:
            words[begins] += int(rows.sum())
        return words, np.bincount(self.pair[own], minlength=len(self.pairs))


def pieces(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each key by its upper bits, and the order that sorts by bucket (keys are sorted already)."""
    bucket = ((keys >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
    return bucket, np.searchsorted(bucket, np.arange(buckets + 1))


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted hashes as their differences, in as many bytes as the greatest of them needs."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, -(-int(steps.max()).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_keys(raw: memoryview) -> np.ndarray:
    width = raw[0]
    part = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, width)
    steps = np.zeros((len(part), 8), np.uint8)
    steps[:, :width] = part
    return np.cumsum(steps.view(np.uint64).ravel())


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts in a byte each, the few great ones behind them, compressed."""
    great = np.flatnonzero(counts >= 255)
    parts = [np.array([len(great)], np.int64), great.astype(np.int64), counts[great].astype(np.int64), np.minimum(counts, 255).astype(np.uint8)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in parts))


def unpack_counts(raw: bytes) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    at, great = np.frombuffer(data, np.int64, n, 8), np.frombuffer(data, np.int64, n, 8 + 8 * n)
    out = np.frombuffer(data, np.uint8, offset=8 + 16 * n).astype(np.int64)
    out[at] = great
    return out


REQUEST = "unit int, bucket int, keys binary, counts binary, held binary"
REPLY = "unit int, bucket int, train binary, held binary, n_train long, n_held long, v_train long, v_rest long"
DOWN = "unit int, bucket int, train binary, held binary"


def _split(unit: int, buckets: int, kinds) -> pa.Table:
    """A request for each bucket of each kind of n-gram (keys, counts, counts of the held fold or None) that has any."""
    rows = {k: [] for k in ("bucket", "keys", "counts", "held")}
    for kind, (keys, counts, held) in enumerate(kinds):
        _, cut = pieces(keys, buckets)
        for b in np.flatnonzero(np.diff(cut)):
            own = slice(cut[b], cut[b + 1])
            rows["bucket"].append(kind * buckets + int(b))
            rows["keys"].append(pack_keys(keys[own]))
            rows["counts"].append(pack_counts(counts[own]))
            rows["held"].append(None if held is None else pack_counts(held[own]))
    n = len(rows["bucket"])
    return pa.table({"unit": pa.array([unit] * n, pa.int32()), "bucket": pa.array(rows["bucket"], pa.int32()), **{k: pa.array(rows[k], pa.binary()) for k in ("keys", "counts", "held")}})


def _ask(buckets: int, first_held: int):
    """Blocks from first_held on hold the fold that is left out of the counts the weights are learned on."""

    def run(table: pa.Table) -> pa.Table:
        block, unit = Block(table["text"]), table["block"][0].as_py()
        words, pairs = block.counts(table["fold"].to_numpy() != 0)
        held = unit >= first_held
        return _split(unit, buckets, [(block.words, words, words if held else None), (block.pairs, pairs, pairs if held else None)])

    return run


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct keys of all requests, their counts, those of the held fold, and where each request's keys stand among them."""
    keys = [unpack_keys(memoryview(x.as_buffer())) for x in table["keys"]]
    sizes = np.array([len(k) for k in keys])
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    back = np.split(place, np.cumsum(sizes)[:-1])
    train, held = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
    for at, counts, own in zip(back, table["counts"], table["held"], strict=True):
        train[at] += unpack_counts(counts.as_py())
        if own.is_valid:
            held[at] += unpack_counts(own.as_py())
    return distinct, train, held, back


def _answers(units, back, train: np.ndarray, held: np.ndarray, told: int) -> dict[str, pa.Array]:
    """The totals of each request's keys, in its order; the held fold's only to units from `told` on."""
    return {"train": pa.array([pack_counts(train[p]) for p in back], pa.binary()), "held": pa.array([pack_counts(held[p]) if u >= told else None for p, u in zip(back, units, strict=True)], pa.binary())}


def _answer(buckets: int, told: int):
    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        distinct, train, held, back = _merged(table)
        word = (distinct != START) & (bucket < buckets)
        sums = [int(train[word].sum()), int(held[word].sum()), int((train[word] > 0).sum()), int((train[word] > held[word]).sum())]
        fixed = dict(zip(("n_train", "n_held", "v_train", "v_rest"), sums, strict=True))
        answers = _answers(table["unit"].to_numpy(), back, train, held, told)
        return pa.table({"unit": table["unit"].combine_chunks(), "bucket": table["bucket"].combine_chunks(), **answers, **{k: pa.array([v] + [0] * (len(back) - 1), pa.int64()) for k, v in fixed.items()}})

    return run


def _pass_up(buckets: int, finer: int, fan: int):
    """The requests of a group of blocks for one bucket as the group's own requests, for buckets that are `finer` times as fine."""

    def run(table: pa.Table) -> pa.Table:
        distinct, train, held, _ = _merged(table)
        kind = table["bucket"][0].as_py() // buckets
        none = (np.zeros(0, np.uint64),) * 2 + (None,)
        return _split(table["unit"][0].as_py() // fan, buckets * finer, [(distinct, train, held) if k == kind else none for k in (0, 1)])

    return run


def _pass_down(buckets: int, told: int):
    """What a group of blocks is told, to each block in the order of its keys."""

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        distinct, _, _, back = _merged(table)
        order = np.argsort(replies["bucket"].to_numpy())
        train, held = (np.concatenate([unpack_counts(replies[c][k].as_py()) for k in order.tolist()]) for c in ("train", "held"))
        answers = _answers(table["unit"].to_numpy(), back, train, held, told)
        return pa.table({"unit": table["unit"].combine_chunks(), "bucket": table["bucket"].combine_chunks(), **answers})

    return run


def replies_to(requests: DataFrame, blocks: int, buckets: int, told: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """The totals for each request (DOWN), and a table whose columns n_train, n_held, v_train and v_rest add up to those of all n-grams.

    Up to `fan` blocks, every bucket answers every block itself. With more, groups of
    blocks first add up their own requests, and only the groups' sums meet; so the
    number of requests grows with the input and not with its square.
    """
    if blocks <= fan:
        whole = written(requests.groupBy("bucket").applyInArrow(tablewise(_answer(buckets, told)), REPLY), "replies")
        return whole, whole
    fan = max(fan, math.isqrt(blocks))
    finer = -(-blocks // fan)
    asked = written(requests, "requests")
    group = F.floor(F.col("unit") / fan).cast("int")
    up = asked.groupBy(group, "bucket").applyInArrow(tablewise(_pass_up(buckets, finer, fan)), REQUEST)
    whole = written(up.groupBy("bucket").applyInArrow(tablewise(_answer(buckets * finer, 0)), REPLY), "group-replies")
    to_group = whole.select("unit", "bucket", "train", "held").groupBy(F.col("unit"), F.floor(F.col("bucket") / finer).cast("int"))
    down = asked.groupBy(group, "bucket").cogroup(to_group).applyInArrow(pairwise(_pass_down(buckets, told)), DOWN)
    down = written(down, "replies")
    dropped(asked)
    return down, whole


def _received(block: Block, replies: pa.Table, buckets: int, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The totals of the block's words and bigrams."""
    out = (np.zeros(len(block.words), np.int64), np.zeros(len(block.pairs), np.int64))
    cuts = [pieces(k, buckets)[1] for k in (block.words, block.pairs)]
    for b, x in zip(replies["bucket"].to_pylist(), replies[name], strict=True):
        kind, b = divmod(b, buckets)
        out[kind][cuts[kind][b] : cuts[kind][b + 1]] = unpack_counts(x.as_py())
    return out


def levels(count: np.ndarray) -> np.ndarray:
    """The bucket of a context's frequency: 0 for none, then one for each power of two."""
    return np.where(count > 0, 1 + np.minimum(LEVELS - 2, np.log2(np.maximum(count, 1)).astype(np.int64)), 0)


def estimates(block: Block, words: np.ndarray, pairs: np.ndarray, total: int, distinct: int):
    """For each token its context's bucket, and its bigram, unigram and even estimates."""
    context = words[block.context]
    p2 = pairs[block.pair] / np.maximum(context, 1)
    p1 = words[block.word] / max(total, 1)
    return levels(context), p2, p1, 1.0 / (distinct + 1)


def _cells(buckets: int, total: int, distinct: int):
    def run(text: pa.Table, replies: pa.Table) -> pa.Table:
        if not text.num_rows:
            return pa.table({k: pa.array([], pa.int32() if k != "n" else pa.int64()) for k in ("level", "r2", "r1", "n")})
        block = Block(text["text"])
        (w, p), (wh, ph) = (_received(block, replies, buckets, x) for x in ("train", "held"))
        level, p2, p1, p0 = estimates(block, w - wh, p - ph, total, distinct)
        low = -1000
        bins = [np.where(x > 0, np.rint(GRAIN * np.log2(np.maximum(x, 1e-300) / p0)), low).astype(np.int64) for x in (p2, p1)]
        code, n = np.unique((level * 4096 + bins[0] + 2048) * 4096 + bins[1] + 2048, return_counts=True)
        return pa.table({"level": pa.array((code >> 24).astype(np.int32)), "r2": pa.array(((code >> 12 & 4095) - 2048).astype(np.int32)), "r1": pa.array(((code & 4095) - 2048).astype(np.int32)), "n": pa.array(n)})

    return run


def weights(level: np.ndarray, r2: np.ndarray, r1: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Mixture weights of each level by expectation-maximisation over cells of held-out counts.

    PRIOR tokens with the weights of all levels together are added to each level, so
    that one with few held-out tokens stays near the rest. Level 0 has no bigrams.
    """
    ratio = lambda r: np.where(r > -1000, 2.0 ** (r / GRAIN), 0.0)
    x = np.stack([ratio(r2), ratio(r1), np.ones(len(n))], axis=1)
    out = np.tile([0.4, 0.5, 0.1], (LEVELS, 1))
    shared = np.array([0.4, 0.5, 0.1])
    for _ in range(ROUNDS if len(n) else 0):
        part = out[level] * x
        part *= (n / part.sum(1))[:, None]
        sums = np.stack([np.bincount(level, part[:, k], minlength=LEVELS) for k in range(3)], axis=1)
        shared = (sums.sum(0) + 1e-6) / (sums.sum() + 3e-6)
        out = sums + PRIOR * shared + 1e-6
        out[0, 0] = 0
        out /= out.sum(1, keepdims=True)
    if not len(n):
        out[0, 0] = 0
        out /= out.sum(1, keepdims=True)
    return out


def _scorer(buckets: int, mix: np.ndarray, total: int, distinct: int, key: str):
    def run(text: pa.Table, replies: pa.Table) -> pa.Table:
        names = [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not text.num_rows:
            return pa.table({k: pa.array([], v) for k, v in zip(names, [text.schema.field("key").type, pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2], strict=True)})
        block = Block(text["text"])
        w, p = _received(block, replies, buckets, "train")
        level, p2, p1, p0 = estimates(block, w, p, total, distinct)
        count = w[block.word]
        m = mix[level]
        chance = np.log10(m[:, 0] * p2 + m[:, 1] * p1 + m[:, 2] * p0)
        base = np.log10((count + ADDED) / (total + ADDED * (distinct + 1)))
        begin = block.first[:-1]
        columns = [text["key"].combine_chunks(), pa.array(text["fold"].to_numpy() == 0), pa.array(block.size), pa.array(np.add.reduceat((count > 0).astype(np.int64), begin)), pa.array(np.full(len(begin), total)), pa.array(np.add.reduceat(base, begin)), pa.array(np.add.reduceat(chance, begin))]
        return pa.table(dict(zip(names, columns, strict=True)))

    return run


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10, block_bytes: int = BLOCK, fan: int = FAN) -> DataFrame:
    """One row per text: key, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Texts whose key's crc32 is 0 modulo folds are held out of all counts; those with 1
    are left out of the counts on which the weights are learned. The result lies in the
    shared folder; all that was written on the way is deleted.
    """
    spark = docs.sparkSession
    total_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(text_of(text))), F.lit(0))).first()[0]
    # small tables go to as many blocks and buckets as there are cores, large ones to some of equal size
    few_bytes = min(spark.sparkContext.defaultParallelism, -(-int(total_bytes) // LEAST))
    n = max(1, few_bytes, -(-int(total_bytes) // block_bytes))
    few = max(1, -(-n // folds))
    met = min(int(total_bytes), max(fan, math.isqrt(n)) * block_bytes)
    buckets = max(4, few_bytes, -(-met // BUCKET))
    fold = fold_of(key, folds)
    mixed_key = F.xxhash64(F.col(f"`{key}`"), F.xxhash64(text_of(text)))
    block = F.when(fold == 1, n + F.pmod(mixed_key, F.lit(few))).otherwise(F.pmod(mixed_key, F.lit(n))).cast("int")
    rows = docs.select(F.col(f"`{key}`").alias("key"), text_of(text).alias("text"), fold.cast("int").alias("fold"), block.alias("block"))
    requests = rows.groupBy("block").applyInArrow(tablewise(_ask(buckets, n)), REQUEST)
    replies, sums = replies_to(requests, n + few, buckets, n, fan)
    for _ in range(2):  # lets Spark delete the shuffle files of the counts
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    n_train, n_held, v_train, v_rest = (int(x or 0) for x in sums.agg(*[F.sum(c) for c in ("n_train", "n_held", "v_train", "v_rest")]).first())
    if sums is not replies:
        dropped(sums)
    given = replies.select(F.col("unit").alias("block"), "bucket", "train", "held")
    held = rows.filter(fold == 1).groupBy("block").cogroup(given.filter(F.col("block") >= n).groupBy("block"))
    cells = held.applyInArrow(pairwise(_cells(buckets, n_train - n_held, v_rest)), "level int, r2 int, r1 int, n long")
    found = cells.groupBy("level", "r2", "r1").agg(F.sum("n").alias("n")).toArrow()
    mix = weights(*[found[c].to_numpy().astype(np.int64) for c in ("level", "r2", "r1", "n")])
    schema = f"`{key}` {dict(docs.dtypes)[key]}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    both = rows.groupBy("block").cogroup(given.drop("held").groupBy("block"))
    scores = written(both.applyInArrow(pairwise(_scorer(buckets, mix, n_train, v_train, key)), schema), "lm-scores")
    dropped(replies)
    return scores
