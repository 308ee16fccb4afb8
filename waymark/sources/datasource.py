"""Python data sources: a SQLite table by key ranges, and an adapter's partitions."""

from __future__ import annotations

import sqlite3

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


#: Filters that SQLite is asked, by how they are written there.
COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class SqliteReader(DataSourceReader):
    """Reads rowid ranges of equally many rows, one for each partition, in read-only mode; simple filters are asked of SQLite."""

    def __init__(self, options: dict):
        self.path, self.table = options["path"], options["table"]
        self.columns = [c.strip() for c in options["columns"].split(",")]
        self.parts = int(options.get("partitions", 4))
        self.tests: list[tuple[str, list]] = []
        for name in (self.table, *self.columns):
            if not name.replace("_", "").isalnum():
                raise ValueError(f"not a plain name: {name!r}")

    def pushFilters(self, filters):
        """Takes comparisons of one column with numbers or texts, and tests for null; gives the others back."""
        for f in filters:
            if (test := self._test(f)) is None:
                yield f
            else:
                self.tests.append(test)

    def _test(self, f) -> tuple[str, list] | None:
        if len(f.attribute if hasattr(f, "attribute") else ()) != 1 or f.attribute[0] not in self.columns:
            return None
        column = f.attribute[0]
        if isinstance(f, (IsNull, IsNotNull)):
            return f"{column} IS {'NOT ' * isinstance(f, IsNotNull)}NULL", []
        values = list(f.value) if isinstance(f, In) else [f.value]
        # a text is compared as text, by bytes, and a number as a number, as Spark does
        texts = all(isinstance(v, str) for v in values)
        if not texts and not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
            return None
        own = f"CAST({column} AS TEXT)" if texts else column
        if isinstance(f, In):
            return f"{own} IN ({', '.join('?' * len(values))})", values
        return (f"{own} {COMPARED[type(f)]} ?", values) if type(f) in COMPARED else None

    def _rows(self, db, what: str, low: int | None = None, high: int | None = None):
        tests = [*self.tests, *([("rowid >= ? AND rowid < ?", [low, high])] if low is not None else [])]
        where = " AND ".join(f"({t})" for t, _ in tests)
        return db.execute(f"SELECT {what} FROM {self.table}" + (f" WHERE {where}" if where else ""), [v for _, values in tests for v in values])

    def _open(self):
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self):
        """Ranges between quantiles of the rowids that pass the filters: gaps and filters don't make partitions uneven."""
        with self._open() as db:
            ranked = f"rowid AS id, ntile({self.parts}) OVER (ORDER BY rowid) AS n"
            inner = " AND ".join(f"({t})" for t, _ in self.tests)
            query = f"SELECT min(id) FROM (SELECT {ranked} FROM {self.table}{f' WHERE {inner}' if inner else ''}) GROUP BY n ORDER BY 1"
            lows = [r[0] for r in db.execute(query, [v for _, values in self.tests for v in values])]
        if not lows:
            return [Range(0, 0)]
        return [Range(a, b) for a, b in zip(lows, [*lows[1:], (1 << 63) - 1], strict=True)]

    def read(self, partition):
        with self._open() as db:
            yield from self._rows(db, ", ".join(self.columns), partition.low, partition.high)


class SqliteSource(DataSource):
    """spark.read.format("waymark_sqlite") with path, table, columns and a schema; every executor must see the file."""

    @classmethod
    def name(cls):
        return "waymark_sqlite"

    def schema(self):
        return ", ".join(f"{c.strip()} string" for c in self.options["columns"].split(","))

    def reader(self, schema):
        return SqliteReader(self.options)


def _hook(name: str | None):
    """A function named module:function; nothing for none."""
    import importlib

    module, _, function = (name or "").partition(":")
    return getattr(importlib.import_module(module), function) if module else None


class AdapterReader(DataSourceReader):
    """Calls `fetch(partition name)` of a module for each of its partitions; rows are tuples.

    Options `before` and `after` name hooks (module:function): the first is called with a
    partition's name before it is fetched, and may refuse it by raising; the second with
    the name and each row, and returns the row to keep, or none.
    """

    def __init__(self, options: dict):
        self.module, self.names = options["module"], options.get("partitions", "").split(",")
        self.before, self.after = options.get("before"), options.get("after")

    def partitions(self):
        return [Range(i, i + 1) for i in range(len(self.names))]

    def read(self, partition):
        import importlib

        before, after, name = _hook(self.before), _hook(self.after), self.names[partition.low]
        if before:
            before(name)
        for row in importlib.import_module(self.module).fetch(name):
            kept = after(name, row) if after else row
            if kept is not None:
                yield kept


class AdapterSource(DataSource):
    """spark.read.format("waymark_adapter") with module and partitions: an extension point for new sources."""

    @classmethod
    def name(cls):
        return "waymark_adapter"

    def schema(self):
        import importlib

        return importlib.import_module(self.options["module"]).SCHEMA

    def reader(self, schema):
        return AdapterReader(self.options)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    spark.dataSource.register(AdapterSource)
