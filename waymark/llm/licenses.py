"""Licence scans: sparse TF-IDF cosine to templates, then inheritance by directory.

Texts and templates are sparse TF-IDF vectors over words and word pairs; weights come
from the families of templates, so that versions of one licence don't make its words
common. What of a vector no template has only adds to its length, so a candidate's
cosine is at most what its known terms can add over that length. A file's
header candidates are those of its sentences, of two words or more, for which that bound
reaches LIKE, their lines, joined where they follow each other, and for each template, be it a notice, a
standard header or a whole licence, the lines with the run of words that most of all
are that template's word pairs. Each is compared with every template. Of the
candidates at LIKE or more, the one with most words, counted by the cube of their
similarity, gives the file's licence. A file that is named like a licence file, or of
whose words that block makes FILE_SHARE or more, is a licence file and holds for its
directory. A file without a licence of its own takes
that of the nearest directory above it that has one, found by joining the
directories with their ancestors.

Null texts and texts without a candidate have no licence of their own; a null path lies
in no directory and inherits nothing. Among several licence files of a directory one
named so counts first, then the most similar one, then the first by licence and path;
of equally similar templates the first by name. Repeated rows get equal results, and an
empty table gives none. A text that no bound lets reach LIKE is passed over without looking at
candidates; the bounds hold for every text (Templates.promising). They are taken in arrays over SLAB
bytes of texts at a time, or over one very long text, in memory of some twenty times its size. Extra columns pass
through unless they have the name of a result column, license_source and license_dir
among them.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._license_texts import templates as known_licenses
from ._sample import Lookup
from ._store import carried, dropped, extended, quoted, text_of, unused, written
from ._tokens import byte_table, slabs, tokenize, window_hashes
from ._workers import batchwise

LIKE, FILE_SHARE, SLAB = 0.6, 0.3, 1 << 20
NAMES = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$"
_WORD, _SENTENCE = re.compile(r"[A-Za-z0-9]+"), re.compile(r"(?<=[.;])[ \t\r]+")
ASCII = byte_table(np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123)]))


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def terms(text: str) -> Counter:
    words = words_of(text)
    return Counter(words) + Counter(zip(words, words[1:], strict=False))


class Templates:
    def __init__(self, templates: dict[str, list[str]]):
        own = [(name, terms(t)) for name, texts in templates.items() for t in texts]
        families: dict[str, set] = {}
        for name, t in own:
            families.setdefault(name.partition("-")[0], set()).update(t)
        seen = Counter(w for t in families.values() for w in t)
        self.idf = {w: 1 + log((1 + len(families)) / (1 + n)) for w, n in seen.items()}
        self.other = 1 + log(1 + len(families))
        #: term -> (template, weight); templates have length 1.
        self.names, self.terms = [name for name, _ in own], {}
        for k, (_, t) in enumerate(own):
            for w, x in self.vector(t).items():
                self.terms.setdefault(w, []).append((k, x))
        #: The greatest weight of each term in any template: what it can add to a cosine at most.
        self.most = {w: max(y for _, y in found) for w, found in self.terms.items()}
        self.words, self.pairs = (self._hashed([w for w in self.idf if isinstance(w, kind)]) for kind in (str, tuple))

    def _hashed(self, known: list) -> tuple[Lookup, np.ndarray, np.ndarray]:
        """The hashes of words or pairs, and in their order what one adds to a vector's square, and to a cosine at most."""
        if not known:
            return Lookup(np.zeros(0, np.uint64)), np.zeros(0), np.zeros(0)
        t = tokenize(pa.array([w if isinstance(w, str) else " ".join(w) for w in known], pa.string()), ASCII)
        h = t.hash if isinstance(known[0], str) else window_hashes(t.hash, (0, 1))[t.first[:-1]]
        order = np.argsort(h)
        idf = np.array([self.idf[w] for w in known])
        return Lookup(h), (idf * idf)[order], (idf * np.array([self.most[w] for w in known]))[order]

    def _bounds(self, unit: np.ndarray, units: int, words: np.ndarray, pairs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each unit of words its vector's square, and what its terms can add to the product with a template's at most."""
        size, gain = np.zeros(units), np.zeros(units)
        for (lookup, square, most), h, of in ((self.words, words, unit), (self.pairs, pairs[inside], unit[1:][inside])):
            _, first, n = np.unique(h ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
            h, of, often = h[first], of[first], 1 + np.log(n)
            at, place = lookup.find(h)
            whole = np.full(len(h), self.other**2)
            whole[at] = square[place]
            size += np.bincount(of, often * often * whole, minlength=units)
            gain += np.bincount(of[at], often[at] * most[place], minlength=units)
        return size, gain

    def promising(self, column: pa.Array) -> np.ndarray:
        """The texts in which a sentence, or lines that blocks() may choose, could reach LIKE with some template.

        Of a sentence the bound is that of possible(). The runs of blocks() hold more pairs of
        a template than others, so each lies where known pairs outnumber others in some
        window; such places that touch make a stretch. A block of its lines can't add more
        to a product than all of them together, and is no shorter than the shortest of them.
        """
        t = tokenize(column, ASCII)
        out = np.zeros(len(column), bool)
        if len(t.data) < 2 or len(t.hash) < 2:
            return out
        text_of_word = np.searchsorted(t.offsets, t.start, "right") - 1
        pairs, same_text = window_hashes(t.hash, (0, 1)), text_of_word[1:] == text_of_word[:-1]
        breaks = t.data == 10
        stops = np.append(np.isin(t.data[:-1], (46, 59)) & np.isin(t.data[1:], (32, 9, 13)), False)
        line, unit = (np.searchsorted(np.union1d(np.flatnonzero(ends), t.offsets), t.start, "right") for ends in (breaks, breaks | stops))
        inside = unit[1:] == unit[:-1]
        size, gain = self._bounds(unit, int(unit.max()) + 1, t.hash, pairs, inside)
        paired = np.bincount(unit[1:][inside], minlength=len(size)) > 0  # one word alone is no evidence
        out[text_of_word[np.isin(unit, np.flatnonzero(paired & (gain >= (LIKE - 1e-9) * np.sqrt(np.maximum(size, 1e-9)))))]] = True
        # sums over windows: +1 for a known pair, -1 for others, and no window goes over two texts
        at, place = self.pairs[0].find(pairs)
        value = np.full(len(pairs), -1, np.int64)
        value[at] = 1
        value[~same_text] = -(1 << 32)
        total = np.concatenate([[0], np.cumsum(value)])
        before = total[1:] - np.minimum.accumulate(total[:-1])
        behind = np.maximum.accumulate(total[:0:-1])[::-1] - total[:-1]
        dense = np.flatnonzero(before + behind - value > 0)
        if not len(dense):
            return out
        lines = int(line.max()) + 1
        size, gain = self._bounds(line, lines, t.hash, pairs, line[1:] == line[:-1])
        over = at[same_text[at] & (line[1:][at] != line[:-1][at])]  # pairs over the end of a line
        gain += np.bincount(line[1:][over], self.pairs[2][place[np.isin(at, over)]], minlength=lines)
        size[np.bincount(line, minlength=lines) == 0] = np.inf
        heads = np.flatnonzero(np.diff(dense, prepend=-2) > 1)
        low, high = line[dense[heads]], line[dense[np.append(heads[1:], len(dense)) - 1] + 1]
        sums = np.concatenate([[0], np.cumsum(gain)])
        least = np.minimum.reduceat(np.append(size, np.inf), np.ravel(np.column_stack([low, high + 1])))[::2]
        good = sums[high + 1] - sums[low] >= (LIKE - 1e-6) * np.sqrt(np.maximum(least, 1e-9))
        out[text_of_word[dense[heads[good]]]] = True
        return out

    def possible(self, text: str) -> bool:
        """Whether a sentence of two words or more can reach LIKE with some template."""
        if len(words_of(text)) < 2:
            return False
        raw = {w: 1 + log(n) for w, n in terms(text).items()}
        size = sum((x * self.idf.get(w, self.other)) ** 2 for w, x in raw.items())
        return sum(x * self.idf.get(w, 0.0) * self.most.get(w, 0.0) for w, x in raw.items()) >= LIKE * sqrt(size)

    def vector(self, t: Counter) -> dict:
        raw = {w: (1 + log(n)) * self.idf.get(w, self.other) for w, n in t.items()}
        length = sqrt(sum(x * x for x in raw.values())) or 1.0
        return {w: x / length for w, x in raw.items()}

    def nearest(self, text: str) -> tuple[float, str | None]:
        scores: dict[int, float] = {}
        for w, x in self.vector(terms(text)).items():
            for k, y in self.terms.get(w, ()):
                scores[k] = scores.get(k, 0.0) + x * y
        k, best = min(scores.items(), key=lambda s: (-s[1], self.names[s[0]]), default=(None, 0.0))
        return best, self.names[k] if k is not None else None

    def spans(self, text: str) -> list[str]:
        """Runs of lines that have a possible sentence, these lines and sentences, and blocks()."""
        runs, last = [], -2
        for k, line in enumerate(text.split("\n")):
            sentences = [x for x in _SENTENCE.split(line) if self.possible(x)]
            if sentences:
                if k == last + 1:
                    runs[-1][0].append(line)
                else:
                    runs.append(([line], []))
                runs[-1][1].extend([line, *sentences])
                last = k
        out = [x for lines, parts in runs for x in (" ".join(lines), *parts)]
        return list(dict.fromkeys(out + self.blocks(text)))

    def blocks(self, text: str) -> list[str]:
        """For each template, the lines of the run in which word pairs of it most outnumber others."""
        lines = text.split("\n")
        words, line = [], []
        for k, x in enumerate(lines):
            own = words_of(x)
            words += own
            line += [k] * len(own)
        runs: dict[int, tuple] = {}
        for i, pair in enumerate(zip(words, words[1:], strict=False)):
            for k, _ in self.terms.get(pair, ()):
                score, begin, last, best = runs.get(k, (0, i, i - 1, (0, 0, 0)))
                score -= i - last - 1
                if score <= 0:
                    score, begin = 0, i
                score += 1
                runs[k] = (score, begin, i, max(best, (score, -begin, i)))
        found = dict.fromkeys((line[-begin], line[last + 1]) for *_, (_, begin, last) in runs.values())
        return ["\n".join(lines[a : b + 1]) for a, b in found]

    def scan(self, text: str) -> tuple[float, str | None, str | None, float]:
        """Similarity, licence, the span it was found in, and that span's share of the words."""
        found = [(*self.nearest(s), s) for s in self.spans(text)]
        close = [f for f in found if f[0] >= LIKE]
        if not close:
            return max((f[0] for f in found), default=0.0), None, None, 0.0
        best, name, span = max(close, key=lambda f: (f[0] ** 3 * len(f[2].split()), f[0]))
        return best, name, span, len(span.split()) / max(1, len(text.split()))


@lru_cache(maxsize=2)
def prepared(templates: tuple) -> Templates:
    """Templates, made once in a worker."""
    return Templates({k: list(v) for k, v in templates})


def headers(files: DataFrame, path: str = "path", text: str = "text", templates: dict[str, list[str]] | None = None) -> DataFrame:
    """files without the text, with license, similarity, header and is_license_file, from each file's own text."""
    own = ["license", "similarity", "header", "is_license_file"]
    kept = carried(files, own, text)
    source = files.select(*quoted(kept), text_of(text).alias(unused("text", kept)))
    schema = extended(files.select(*quoted(kept)).schema, "license string, similarity double, header string, is_license_file boolean")
    given, named, at = templates or known_licenses(), re.compile(NAMES), kept.index(path)
    none = (0.0, None, None, 0.0)

    def run(batches):
        known = prepared(tuple((k, tuple(v)) for k, v in given.items()))
        for batch in batches:
            column, found = batch.column(len(kept)), []
            for low, high in slabs(column, SLAB):
                part = column.slice(low, high - low)
                found += [known.scan(part[k].as_py()) if good else none for k, good in enumerate(known.promising(part).tolist())]
            names = [bool(p and named.search(p)) for p in batch.column(at).to_pylist()]
            new = [pa.array([f[1] for f in found], pa.string()), pa.array([f[0] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.string()), pa.array([f[1] is not None and (n or f[3] >= FILE_SHARE) for f, n in zip(found, names, strict=True)], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in range(len(kept))] + new, names=[*kept, *own])

    return source.mapInArrow(batchwise(run), schema)


def directory(path):
    """What stands before a path's last slash; the top is the empty text."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def scan(files: DataFrame, path: str = "path", text: str = "text", templates: dict[str, list[str]] | None = None) -> DataFrame:
    """headers() with license_source (header, inherited or null) and license_dir, the licence taken over where a file has none.

    Every directory of a file without a licence is joined with its ancestors; what is
    shuffled are names of directories. The result lies in the shared folder.
    """
    kept = carried(files, ["license", "similarity", "header", "is_license_file", "license_source", "license_dir"], text)
    own = headers(files.select(*quoted(kept), text_of(text).alias(unused("text", kept))), path, unused("text", kept), templates)
    here = unused("dir", own.columns)
    own = written(own.withColumn(here, directory(F.col(f"`{path}`"))), "licenses")
    order = F.struct((~F.col(f"`{path}`").rlike(NAMES)).alias("other"), (-F.col("similarity")).alias("order"), F.col("license").alias("license"), F.col(f"`{path}`").alias("path"))
    held = own.filter(F.col("is_license_file") & F.col(here).isNotNull()).groupBy(F.col(here).alias("above")).agg(F.min(order).alias("best")).select("above", F.col("best.license").alias("held"))
    held = written(held, "license-files")  # so that a directory with very many below it can be split
    dirs = own.filter(F.col("license").isNull() & F.col(here).isNotNull()).select(F.col(here).alias("dir")).distinct()
    parts = F.split("dir", "/")
    up = dirs.select("dir", F.inline(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("above")))))
    near = written(up.join(held, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "held")).alias("near")), "license-dirs")
    both = own.alias("o").join(near.alias("n"), F.col(f"o.{here}") == F.col("n.dir"), "left")
    none = F.col("o.license").isNull()
    out = both.select(
        *[F.col(f"o.`{c}`") for c in own.columns if c not in (here, "license", "is_license_file")],
        F.coalesce("o.license", "n.near.held").alias("license"),
        F.col("o.is_license_file"),
        F.when(~none, "header").when(F.col("n.near").isNotNull(), "inherited").alias("license_source"),
        F.when(none, F.col("n.near.above")).alias("license_dir"),
    )
    out = written(out, "licensed")
    dropped(own, held, near)
    return out
