"""Python workers that give memory back.

A worker is used again by later tasks, of other operators too, and keeps what its
allocators once took. So whatever runs in one ends by returning unused pages, and what
several operators took one after the other doesn't add up.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._tokens import slabs


def released() -> None:
    """Unused pages of Arrow's pool and of the C library go back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU library
        pass


def texts(column: pa.Array) -> pa.Array:
    """A column as text, null as an empty one."""
    return pc.fill_null(column if pa.types.is_string(column.type) else column.cast(pa.string()), "")


def rows_kept(docs: DataFrame, text: str, mask: Callable) -> DataFrame:
    """The rows of docs, as they are, for whose text the mask is true: a function from a text array to booleans, given a slab at a time."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            column = texts(batch.column(at))
            for low, high in slabs(column):
                part = batch.slice(low, high - low).filter(pa.array(mask(column.slice(low, high - low)), pa.bool_()))
                if part.num_rows:
                    yield part

    return docs.mapInArrow(batchwise(run), docs.schema)


def batchwise(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, for mapInArrow, followed by released()."""

    def tidy(batches):
        yield from run(batches)
        released()

    return tidy


def tablewise(run: Callable[[pa.Table], pa.Table]):
    """run, for applyInArrow, followed by released()."""

    def tidy(table: pa.Table) -> pa.Table:
        out = run(table)
        released()
        return out

    return tidy


def pairwise(run: Callable[[pa.Table, pa.Table], pa.Table]):
    """run, for applyInArrow of cogroups, followed by released()."""

    def tidy(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        released()
        return out

    return tidy
