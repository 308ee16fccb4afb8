"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The distinct words of a batch lie in one flat array of symbols. Each round finds
every word's best pair by a segmented minimum, merges it at its leftmost places
in all words at once and compacts the array, until no word has a pair left.
Words are encoded once per worker and kept in a table of bounded size.

Null texts count as empty and give no ids; an empty table gives no rows. Repeated rows
give equal results; extra columns pass through unless they have the name of a result
column. Pairs of equal rank are merged from the left. A very long text is encoded whole,
in memory of some thirty times its longest run without spaces.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._store import carried, extended, quoted, text_of, unused
from ._workers import batchwise

SPACE = "▁"
NONE = np.int32(2**31 - 1)
#: Words kept by a worker, and characters encoded at a time.
KEPT_WORDS, CHUNK = 100_000, 1 << 19


class Pieces:
    """The merge rules of a BPE model with byte fallback, and its encoding and decoding of words."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) for i in range(size)]
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.id_bytes = {i: b for b, i in self.byte_ids.items()}
        self.unknown = model.unk_id()
        ids = {n: i for i, n in enumerate(names) if not special[i]}
        letters = sorted(set(chain.from_iterable(ids)) - ids.keys())
        symbols = ids | {c: size + k for k, c in enumerate(letters)}
        self.names = [n if not s else "" for n, s in zip(names, special, strict=True)] + letters
        self.first_other = len(self.names)
        self.by_code = np.arange(0x110000, dtype=np.int32) + self.first_other
        for c, i in symbols.items():
            if len(c) == 1:
                self.by_code[ord(c)] = i
        self.by_code[ord(" ")] = self.by_code[ord(SPACE)]
        order = sorted((n for n in ids if len(n) > 1), key=lambda n: (-model.get_score(ids[n]), ids[n]))
        rank = {n: k for k, n in enumerate(order)}
        self.merged = np.array([ids[n] for n in order], np.int32)
        best_use = np.full(len(order), NONE, np.int32)
        pairs = []
        for n in order:
            for cut in range(1, len(n)):
                if (a := symbols.get(n[:cut])) is not None and (b := symbols.get(n[cut:])) is not None:
                    pairs.append(((a << 32) | b, rank[n]))
                    for part in (n[:cut], n[cut:]):
                        if part in rank:
                            best_use[rank[part]] = min(best_use[rank[part]], rank[n])
        pairs.sort()
        self.pair_keys = np.array([p[0] for p in pairs], np.int64)
        self.pair_ranks = np.array([p[1] for p in pairs], np.int32)
        self._index_pairs()
        #: Merging such a piece at several places at once can't make a better pair than the piece itself.
        self.safe = best_use > np.arange(len(order))
        joined = {c for n in order for c in n}
        crossing = any(SPACE in n.lstrip(SPACE) for n in order)
        alone = "\n" if "\n" not in joined else ""
        space = f"[ {SPACE}]"
        self.words = re.compile("(?s).+" if crossing else ("\n|" if alone else "") + f"{space}*[^ {SPACE}{alone}]+|{space}+")
        self.tails = [f"{i}," for i in range(size)]
        #: The ids of words, each with a comma, and the texts that are decoded from them.
        self.kept: dict[str, str] = {}
        self.decoded: dict[str, str] = {}

    def _index_pairs(self) -> None:
        """An open hash table of the pairs, probed for many keys at once."""
        bits = max(10, (len(self.pair_keys) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.table = np.full((1 << bits) + 64, -1, np.int32)
        slots = self._slot(self.pair_keys)
        for k, s in enumerate(slots.tolist()):
            while self.table[s] >= 0:
                s = (s + 1) % len(self.table)
            self.table[s] = k

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE for one that no piece is made of."""
        out = np.full(len(left), NONE, np.int32)
        if not len(self.pair_keys):
            return out
        keys = (left.astype(np.int64) << 32) | right
        todo = np.arange(len(keys))
        slots = self._slot(keys)
        while len(todo):
            at = self.table[slots]
            used = at >= 0
            todo, slots, at = todo[used], slots[used], at[used]
            hit = self.pair_keys[at] == keys[todo]
            out[todo[hit]] = self.pair_ranks[at[hit]]
            todo, slots = todo[~hit], (slots[~hit] + 1) % len(self.table)
        return out

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The final symbols of the words, and where each word's begin."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        done_symbols, done_words, done_sizes = [], [], []
        symbols, who = self.by_code[codes], np.arange(len(words))
        begin = np.cumsum(sizes) - sizes
        ranks = np.full(len(symbols), NONE, np.int32)
        ranks[:-1] = self.ranks(symbols[:-1], symbols[1:])
        ranks[begin + sizes - 1] = NONE
        while len(who):
            least = np.minimum.reduceat(ranks, begin)
            open_ = least != NONE
            if not open_.all():
                stay = np.repeat(open_, sizes)
                done_symbols.append(symbols[~stay])
                done_words.append(who[~open_])
                done_sizes.append(sizes[~open_])
                symbols, ranks, who, sizes, least = symbols[stay], ranks[stay], who[open_], sizes[open_], least[open_]
                begin = np.cumsum(sizes) - sizes
                if not len(who):
                    break
            owner = np.repeat(np.arange(len(who)), sizes)
            at = np.flatnonzero(ranks == least[owner])
            of = owner[at]
            leading = np.ones(len(at), bool)
            leading[1:] = of[1:] != of[:-1]
            # in a run of overlapping places every other one is merged, from the left
            fresh = np.ones(len(at), bool)
            fresh[1:] = (at[1:] != at[:-1] + 1) | leading[1:]
            place = np.arange(len(at))
            parity = (place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0
            at = at[np.where(self.safe[ranks[at]], parity, leading)]
            symbols[at] = self.merged[ranks[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            sizes = sizes - np.bincount(owner[at], minlength=len(who))
            moved = np.cumsum(stay) - 1
            at = moved[at]
            symbols, ranks = symbols[stay], ranks[stay]
            begin = np.cumsum(sizes) - sizes
            last = np.zeros(len(symbols), bool)
            last[begin + sizes - 1] = True
            near = np.zeros(len(symbols), bool)
            near[at] = near[at[at > 0] - 1] = True
            ranks[near] = NONE
            changed = np.flatnonzero(near & ~last)
            ranks[changed] = self.ranks(symbols[changed], symbols[changed + 1])
        if not done_words:
            return symbols, np.zeros(1, np.int64)
        who, sizes, symbols = np.concatenate(done_words), np.concatenate(done_sizes), np.concatenate(done_symbols)
        begin = np.cumsum(sizes) - sizes
        order = np.argsort(who, kind="stable")
        ends = np.cumsum(sizes[order])
        source = np.arange(len(symbols)) + np.repeat(begin[order] - (ends - sizes[order]), sizes[order])
        return symbols[source], np.concatenate([[0], ends])

    def tail(self, symbol: int) -> str:
        """The ids of a symbol that is no piece, in decimal, each with a comma: those of its bytes, or the unknown one."""
        name = self.names[symbol] if symbol < self.first_other else chr(symbol - self.first_other)
        ids = [self.byte_ids.get(b, self.unknown) for b in name.encode("utf-8", "surrogatepass")]
        return "".join(self.tails[i] for i in (ids if self.unknown not in ids else [self.unknown]))

    def learn(self, words: list[str]) -> None:
        """Encodes the words, decodes them again, and keeps both results."""
        symbols, begin = self.merge(words)
        size = len(self.tails)
        tails, names = self.tails, self.names[:size]
        if (other := symbols >= size).any():
            found, at = np.unique(symbols[other], return_inverse=True)
            symbols[other] = size + at
            more = list(map(self.tail, found.tolist()))
            tails = tails + more
            names = names + [" ⁇ " if t == tails[self.unknown] else self.plain(list(map(int, t[:-1].split(",")))) for t in more]
        marked = np.insert(symbols, begin[1:], len(tails)).tolist()
        ids = "".join(map([*tails, "\n"].__getitem__, marked)).split("\n")[:-1]
        plain = "".join(map([*(n.replace(SPACE, " ") for n in names), "\0"].__getitem__, marked)).split("\0")[:-1]
        if len(plain) != len(words):  # a word holds the mark itself
            plain = [self.plain(list(map(int, i[:-1].split(",")))) for i in ids]
        self.kept.update(zip(words, ids, strict=True))
        self.decoded.update(zip(words, plain, strict=True))

    def plain(self, ids: list[int]) -> str:
        """The text of ids: pieces with their spaces, runs of byte ids as UTF-8 with U+FFFD for bad bytes."""
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i in self.id_bytes:
                run.append(self.id_bytes[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if i is not None:
                out.append(" ⁇ " if i == self.unknown else self.names[i].replace(SPACE, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space that encoding puts before it."""
        text = self.plain(ids)
        return text[1:] if text.startswith(" ") and ids and self.names[ids[0]].startswith(SPACE) else text

    def split(self, text: str) -> list[str]:
        return self.words.findall(SPACE + text) if text else []

    def encode(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """For each text its ids in decimal, joined by commas, their number, and the text decoded from them."""
        split = list(map(self.split, texts))
        new = set(chain.from_iterable(split))
        if len(self.kept) + len(new) > KEPT_WORDS:  # only words that are used now stay
            self.kept = {w: self.kept[w] for w in new if w in self.kept}
            self.decoded = {w: self.decoded[w] for w in self.kept}
        if new := new.difference(self.kept):
            self.learn(list(new))
        out = []
        for words in split:
            ids = "".join(map(self.kept.__getitem__, words))
            out.append((ids[:-1], ids.count(","), "".join(map(self.decoded.__getitem__, words))[1:]))
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def chunks(sizes: list[int], most: int):
    """Ranges of rows of at most so many characters together, one row at least."""
    begin, total = 0, 0
    for k, n in enumerate(sizes):
        if k > begin and total + n > most:
            yield begin, k
            begin, total = k, 0
        total += n
    if sizes:
        yield begin, len(sizes)


def encode_documents(df: DataFrame, model: str, text: str = "text", ids: bool = False) -> DataFrame:
    """df without the text, with n_tokens, ids_sha256 and decoded_sha256; with ids also input_ids and decoded.

    model: the path of a SentencePiece BPE model, which every executor can open.
    """
    own = ["n_tokens", "ids_sha256", "decoded_sha256", *(["input_ids", "decoded"] if ids else [])]
    kept = carried(df, own, text)
    source = df.select(*quoted(kept), text_of(text).alias(unused("text", kept)))
    kinds = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", input_ids array<int>, decoded string" if ids else "")
    schema = extended(df.select(*quoted(kept)).schema, kinds)

    def run(batches):
        coder = pieces(model)
        for batch in batches:
            column = batch.column(len(kept))
            lengths = pa.compute.binary_length(column).to_pylist()
            for a, b in chunks(lengths, CHUNK):
                found = coder.encode(column.slice(a, b - a).to_pylist())
                sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
                new = [pa.array([n for _, n, _ in found], pa.int64()), pa.array([sha(i) for i, _, _ in found]), pa.array([sha(t) for _, _, t in found])]
                if ids:
                    new += [pa.array([list(map(int, i.split(","))) if i else [] for i, _, _ in found], pa.list_(pa.int32())), pa.array([t for _, _, t in found], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in range(len(kept))] + new, names=[*kept, *own])

    return source.mapInArrow(batchwise(run), schema)
