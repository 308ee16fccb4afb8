"""Embedding whitening: principal components by hierarchical merging of singular value decompositions.

Entries become whole numbers x = floor(64 c) + 1,000,000. Every partition reduces its vectors
to a summary: their number, exact sums, mean, and all singular values and right vectors of the
centred rows. Two summaries merge by putting their scaled vectors on top of each other, with one more row
sqrt(n m / (n + m)) (mean - other mean), and decomposing that again; no dimension is ever
left out, so nothing but rounding is lost. Partitions merge in groups of FAN, those in groups again,
until one summary of dimension squared numbers is left, which is all that the driver gets
and sends out. The covariance of what comes out is then measured in one more pass.

Vectors that are null, or hold a null or an entry that isn't finite, are left out; so are empty ones, which have
no components. Vectors of other lengths are lists of their own, each with its own fit.
Components along which the vectors don't vary (eigenvalue 0 but for rounding) have no
direction of their own: whitened is null there, explained 0, and identity_error passes them over.
Entries whose x leaves 2^53 are held at it; a deviation that doesn't fit a long is null. Null
keys and repeated rows count like others; an empty table gives no rows. Memory: a slab of
vectors and a few matrices of dimension squared. Columns that aren't named are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._store import dropped, unused, written
from ._workers import batchwise, tablewise

#: Fixed values of the rule for entries.
SCALE, SHIFT = 64, 1_000_000
#: Entries of a slab of vectors; summaries that one task merges.
SLAB, FAN = 1 << 20, 8
#: Components that are returned.
COMPONENTS = 32

_SUMMARY = "dims int, part long, n long, sums array<string>, values array<double>, vectors array<double>"


def whole(entries: np.ndarray) -> np.ndarray:
    """x of entries, as whole numbers in doubles."""
    bound = float(1 << 53)
    return np.clip(np.floor(SCALE * entries.astype(np.float64)) + SHIFT, -bound, bound)


@dataclass
class Summary:
    """n rows, their sums (exact ones of whole numbers), and singular values (falling) and right vectors (rows) of the centred rows."""

    n: int
    sums: list
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, exact: bool = True) -> Summary:
        sums = _sums(x) if exact else x.sum(0).tolist()
        centre, rest = _mean(sums, len(x))
        return cls(len(x), sums, *_svd((x - centre) - rest))

    def merged(self, other: Summary) -> Summary:
        n = self.n + other.n
        mine, mine_rest = _mean(self.sums, self.n)
        theirs, theirs_rest = _mean(other.sums, other.n)
        between = np.sqrt(self.n * other.n / n) * ((mine - theirs) + (mine_rest - theirs_rest))
        rows = np.vstack([self.values[:, None] * self.vectors, other.values[:, None] * other.vectors, between[None]])
        return Summary(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], *_svd(rows))

    def row(self, dims: int, part: int = 0) -> dict:
        return {"dims": dims, "part": part, "n": self.n, "sums": [repr(x) for x in self.sums], "values": self.values, "vectors": self.vectors.ravel()}

    @classmethod
    def read(cls, row: dict) -> Summary:
        sums = [float(x) if "." in x or "e" in x else int(x) for x in row["sums"]]
        return cls(row["n"], sums, np.array(row["values"]), np.array(row["vectors"]).reshape(len(row["values"]), len(sums)))


def _sums(x: np.ndarray) -> list[int]:
    """Exact sums by column: high and low parts are summed as whole numbers."""
    y = x.astype(np.int64)
    return [(int(a) << 20) + int(b) for a, b in zip((y >> 20).sum(0), (y & 0xFFFFF).sum(0), strict=True)]


def _mean(sums: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean as a whole number and the rest."""
    return np.array([float(s // n) for s in sums]), np.array([(s % n) / n for s in sums])


def _svd(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All singular values and right vectors; of more rows than columns, those of the triangle that has the same."""
    rows = np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows
    return np.linalg.svd(rows, full_matrices=False)[1:]


def usable(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector has entries, all of them finite."""
    v = F.col(f"`{vector}`")
    limit = F.lit(float("inf"))
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < limit), F.lit(False)))
    return df.filter(v.isNotNull() & (F.size(v) > 0) & fine)


def _slabs(batches, at: int):
    """Rows of one length in runs: positions, and their entries as a matrix, of each batch."""
    for batch in batches:
        column = batch.column(at)
        size = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        for dims in np.unique(size):
            rows = np.flatnonzero(size == dims)
            step = max(1, SLAB // int(dims))
            for low in range(0, len(rows), step):
                some = rows[low : low + step]
                flat = pa.compute.list_flatten(column.take(pa.array(some))).to_numpy(zero_copy_only=False)
                yield batch, some, whole(flat.reshape(len(some), int(dims)))


@dataclass
class Model:
    """A fit of vectors of one length: components are rows, total is the trace of the covariance."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    total: float
    identity_error: float | None = None

    def __post_init__(self):
        centre = [s // self.n for s in self.sums]
        self.centre = np.array(centre, np.float64)
        self.left = np.array([s - self.n * c for s, c in zip(self.sums, centre, strict=True)], np.int64)
        noise = self.total * len(self.sums) * np.finfo(np.float64).eps
        self.known = self.eigenvalues > noise

    @property
    def explained(self) -> np.ndarray:
        return np.where(self.known, self.eigenvalues / (self.total or 1.0), 0.0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        centred = (x - self.centre) - self.left / self.n
        scale = np.sqrt(np.where(self.known, self.eigenvalues, 1.0))
        return np.where(self.known, (centred @ self.components.T) / scale, np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 by row: with d = x - centre and S = n centre + left, of n^2 d^2 - 2 n d left + left^2."""
        d = (x - self.centre).astype(np.int64)
        if len(d) and np.abs(d).max() >= 1 << 26:  # beyond what halves of the products hold
            big = [sum((self.n * int(a) - int(b)) ** 2 for a, b in zip(row, self.left, strict=True)) for row in d]
        else:
            high, low = self.left >> 24, self.left & 0xFFFFFF
            squares, crossed, rest = (d * d).sum(1), [(int(a) << 24) + int(b) for a, b in zip(d @ high, d @ low, strict=True)], sum(int(b) ** 2 for b in self.left)
            big = [self.n**2 * int(a) - 2 * self.n * b + rest for a, b in zip(squares, crossed, strict=True)]
        return [v if v < 1 << 63 else None for v in big]


def train(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each length of vectors among the usable ones."""
    clean = usable(df, vector)
    models = {}
    for dims, s in _reduced(clean, vector, Summary.of).items():
        spread = s.values**2 / s.n
        ways = s.vectors * np.sign(s.vectors[np.arange(len(s.vectors)), np.abs(s.vectors).argmax(1)])[:, None]
        k, got = min(components, dims), min(components, len(spread))
        models[dims] = Model(s.n, s.sums, np.pad(spread[:got], (0, k - got)), np.pad(ways[:got], ((0, k - got), (0, 0))), float(spread.sum()))
    with_spread = lambda x: Summary.of((m := models[x.shape[1]]).whitened(x)[:, m.known], exact=False)
    for dims, s in _reduced(clean, vector, with_spread).items():
        covariance = (s.vectors.T * (s.values**2 / s.n)) @ s.vectors
        models[dims].identity_error = float(np.abs(covariance - np.eye(len(covariance))).max(initial=0.0))
    return models


def _reduced(clean: DataFrame, vector: str, summed) -> dict[int, Summary]:
    """The merged summary for each length of vectors. summed: from a slab of x to a summary."""
    schema = T.StructType.fromDDL("dims int, part long, n long, sums array<string>, values array<double>, vectors array<double>")
    arrow = to_arrow_schema(schema)

    def by_partition(batches):
        found: dict[int, Summary] = {}
        for _, _, x in _slabs(batches, 0):
            dims, one = x.shape[1], summed(x)
            found[dims] = found[dims].merged(one) if dims in found else one
        yield pa.RecordBatch.from_pylist([s.row(dims) for dims, s in found.items()], arrow)

    def by_group(table: pa.Table) -> pa.Table:
        whole, row = None, {}
        for batch in table.sort_by("part").to_batches(max_chunksize=1):
            (row,) = batch.to_pylist()
            one = Summary.read(row)
            whole = one if whole is None else whole.merged(one)
        return pa.Table.from_pylist([whole.row(row["dims"], row["part"] // FAN)], arrow)

    first = clean.select(F.col(f"`{vector}`").cast("array<double>").alias("v")).mapInArrow(batchwise(by_partition), schema)
    rows = base = written(first.withColumn("part", F.spark_partition_id().cast("long")), "summaries")
    last = base.agg(F.max("part")).first()[0] or 0
    while last:
        rows = rows.groupBy("dims", F.floor(F.col("part") / FAN)).applyInArrow(tablewise(by_group), schema)
        last //= FAN
    found = {r["dims"]: Summary.read(r.asDict()) for r in rows.collect()}
    dropped(base)
    return found


def whiten(df: DataFrame, models: dict[int, Model], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each usable vector and component: key, component, n, deviation, whitened, explained, identity_error."""
    schema = T.StructType([df.schema[key], *T.StructType.fromDDL("n long, deviation long, identity_error double, whitened array<double>, explained array<double>").fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch, rows, x in _slabs(batches, 1):
            m = models[x.shape[1]]
            white = m.whitened(x)
            n, k = white.shape
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * k)
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.ravel(), mask=np.isnan(v.ravel()))) for v in (white, np.broadcast_to(m.explained, white.shape))]
            columns = [batch.column(0).take(pa.array(rows)), pa.array([m.n] * n, pa.int64()), pa.array(m.deviations(x), pa.int64()), pa.array([m.identity_error] * n, pa.float64()), *lists]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    plain = usable(df, vector).select(F.col(f"`{key}`"), F.col(f"`{vector}`").cast("array<double>").alias(unused("v", [key])))
    rows = plain.mapInArrow(batchwise(run), schema)
    each = rows.select(F.col(f"`{key}`"), "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "one"))
    return each.select(F.col(f"`{key}`"), (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("one.whitened").alias("whitened"), F.col("one.explained").alias("explained"), "identity_error")
