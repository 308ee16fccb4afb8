"""Bounded samples of labelled rows, and lookups of hashes in a fixed set."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import text_of


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int, key: str = "doc_id", text: str = "text", keep=None) -> DataFrame:
    """text and label of at most `bound` labelled documents, those with the least hashes of the key.

    Only these keys are broadcast: `bound` rows of two numbers. A document that has
    several labels takes the greatest; rows without key or label don't count.
    """
    own = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull())
    if keep is not None:
        own = own.filter(keep)
    own = own.groupBy(key).agg(F.max(F.col(label).cast("int")).alias("label"))
    own = own.orderBy(F.xxhash64(key), key).limit(bound)
    return docs.select(key, text_of(text).alias("text")).join(F.broadcast(own), key).select("text", "label")


class Lookup:
    """A set of 64-bit hashes; a bit table turns most others away before the search."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys.astype(np.uint64))
        self.bits = min(24, max(12, int(len(keys) * 16).bit_length()))
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self._slot(self.keys)] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The positions in h of members, and each one's place among the sorted keys."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.table[self._slot(h)])
        place = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[place] == h[at]
        return at[hit], place[hit]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Adam:
    """Adaptive gradient steps over a dict of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.n = params, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in params.items()}
        self.square = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.n += 1
        for k, g in grads.items():
            self.mean[k] = 0.9 * self.mean[k] + 0.1 * g
            self.square[k] = 0.999 * self.square[k] + 0.001 * g * g
            m, s = self.mean[k] / (1 - 0.9**self.n), self.square[k] / (1 - 0.999**self.n)
            self.params[k] -= self.rate * m / (np.sqrt(s) + 1e-8)
