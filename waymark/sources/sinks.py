"""Merging into tables, and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import formula_guard
from ..operators.parts import accumulated_parts
from ..operators.relational import set_hash, with_children
from .workbooks import PART_BYTES, PART_ROWS, TOTAL_BYTES, packed


def upserted(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """target with the incoming rows put in or in place of those with their keys."""
    return target.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)


def upserted_by_policy(target: DataFrame, incoming: DataFrame, keys: list[str], policy: dict[str, str | Column]) -> DataFrame:
    """One full outer join; for each other column `overwrite`, `keep` (new only where old is null), `coalesce` (old where new is null), or an expression over t and i."""
    t, i = target.alias("t"), incoming.alias("i")
    both = t.join(i, [F.col(f"t.{k}") == F.col(f"i.{k}") for k in keys], "full_outer")
    there = F.col(f"i.{keys[0]}").isNotNull()

    def value(c: str) -> Column:
        old, new, how = F.col(f"t.{c}"), F.col(f"i.{c}"), policy.get(c, "overwrite")
        if isinstance(how, Column):
            return how
        return {"overwrite": F.when(there, new).otherwise(old), "coalesce": F.coalesce(new, old), "keep": F.coalesce(old, new)}[how]

    return both.select(*[F.coalesce(f"t.{k}", f"i.{k}").alias(k) for k in keys], *[value(c).alias(c) for c in target.columns if c not in keys])


def inserted(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Incoming rows whose keys aren't there yet, one of each."""
    first = incoming.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")
    return first.join(target.select(*keys), keys, "left_anti")


def updated_record(current: DataFrame, incoming: DataFrame, key: str, fields: list[str], is_primary: str, protected: str) -> DataFrame:
    """current with incoming values: of a primary source in place of what stands there, of any other only in gaps; never empty ones, never in protected fields."""
    new = incoming.select(key, F.col(is_primary).alias("__primary"), F.col(protected).alias("__held"), *[F.col(f).alias(f"__{f}") for f in fields])
    rows = current.join(new, key, "left")
    kinds = dict(current.dtypes)

    def value(f: str) -> Column:
        old, got = (F.nullif(F.col(c).cast("string"), F.lit("")).cast(kinds[f]) for c in (f, f"__{f}"))
        held = F.coalesce(F.array_contains("__held", f), F.lit(False))
        return F.when(held, F.col(f)).when(F.coalesce(F.col("__primary"), F.lit(False)), F.coalesce(got, F.col(f))).otherwise(F.coalesce(old, got))

    return rows.select(*[value(c).alias(c) if c in fields else F.col(c) for c in current.columns])


def replaced_children(target: DataFrame, incoming: DataFrame, parent: str, parents: DataFrame | None = None) -> DataFrame:
    """All children of the parents that come in are replaced; parents: those that come in, even with none."""
    whose = (parents if parents is not None else incoming).select(parent).distinct()
    return target.join(whose, parent, "left_anti").unionByName(incoming)


def write_replacing(df: DataFrame, path: str, partition: str) -> None:
    """Overwrites only the partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def snapshots(df: DataFrame, key: str, version: Column) -> DataFrame:
    """The whole record as JSON, with a version, to be appended."""
    return df.select(key, version.alias("version"), F.to_json(F.struct(*[c for c in df.columns])).alias("snapshot"))


def with_row_ids(df: DataFrame, parts: list[str], name: str = "row_id") -> DataFrame:
    """A deterministic id from the parts."""
    return df.withColumn(name, F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256), 1, 32))


def export_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the listed columns, under their labels, text guarded against formulas, nested values as JSON."""
    kinds = dict(df.dtypes)
    nested = lambda c: kinds[c].startswith(("array", "struct", "map"))
    one = lambda c: F.to_json(c) if nested(c) else formula_guard(c) if kinds[c] == "string" else F.col(c)
    return df.select(*[one(c).alias(label) for c, label in columns.items()])


def export_parts(df: DataFrame, path: str, order: list[str], rows: int = 25_000, kind: str = "csv") -> None:
    """Files of at most so many rows; each task writes its own, so no node holds the export."""
    out = df.orderBy(*order).write.mode("overwrite").option("maxRecordsPerFile", rows)
    (out.option("header", True).csv if kind == "csv" else out.json if kind == "json" else out.parquet)(path)


def text_bytes(columns: list[str]) -> Column:
    """Bytes of a row's values as text."""
    out = F.lit(0)
    for c in columns:
        out = out + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    return out.cast("long")


def selection_parts(df: DataFrame, group: str, order: list[str], columns: list[str], rows: int = PART_ROWS, part_bytes: int = PART_BYTES, total_bytes: int = TOTAL_BYTES) -> DataFrame:
    """df with part: parts of each group by rows and bytes of text. A larger row, or a larger whole, is refused before anything is sorted."""
    sized = df.withColumn("__bytes", text_bytes(columns))
    most, whole = sized.agg(F.coalesce(F.max("__bytes"), F.lit(0)), F.coalesce(F.sum("__bytes"), F.lit(0))).first()
    if most > part_bytes or whole > total_bytes:
        raise ValueError("export_too_large_refine_selection")
    return accumulated_parts(sized, group, order, "__bytes", rows, part_bytes).drop("__bytes")


def union_parts(frames: list[DataFrame], core: list[str], internal: tuple[str, ...] = ()) -> DataFrame:
    """All frames as one, with the core columns first and then every other that any of them has, in order of name; internal ones are left out."""
    extra = sorted({c for df in frames for c in df.columns} - set(core) - set(internal))
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    for c in core:
        out = out if c in out.columns else out.withColumn(c, F.lit(None).cast("string"))
    return out.select(*core, *extra)


def export_workbooks(files: DataFrame, path: str, name: str, total_bytes: int = TOTAL_BYTES) -> str:
    """Writes the workbooks (part, rows, content) as one file, or a zip of several, through the file system of the path; beyond the bound it is refused."""
    size = files.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()[0]
    if size > total_bytes:
        raise ValueError("export_too_large_refine_selection")
    first = files.columns[0]
    rows = files.orderBy(first).collect()  # bounded above
    one = len(rows) == 1
    data = bytes(rows[0]["content"]) if one else packed({f"{name}-{r[first]}.xlsx": bytes(r["content"]) for r in rows})
    target = f"{path.rstrip('/')}/{name}.{'xlsx' if one else 'zip'}"
    context = files.sparkSession.sparkContext
    to = context._jvm.org.apache.hadoop.fs.Path(target)
    out = to.getFileSystem(context._jsc.hadoopConfiguration()).create(to, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return target


def replaced_set(target: DataFrame, incoming: DataFrame, set_key: str, record: list[str], content: list[str]) -> DataFrame:
    """target with the sets that come in replaced whole; rows get a deterministic id, and all of a set its content hash, whatever their order."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content])
    own = with_row_ids(incoming, [set_key, *record])
    own = own.join(set_hash(own, set_key, text), set_key)
    return target.join(incoming.select(set_key).distinct(), set_key, "left_anti").unionByName(own, allowMissingColumns=True)


def _files(spark: SparkSession, path: str):
    """Hadoop's file context and path class for a path of any file system."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs
    return fs, fs.FileContext.getFileContext(fs.Path(path).toUri() if "://" in path else fs.Path(path).makeQualified(fs.FileSystem.get(spark.sparkContext._jsc.hadoopConfiguration()).getUri(), fs.Path("/")).toUri(), spark.sparkContext._jsc.hadoopConfiguration())


def committed(spark: SparkSession, path: str) -> int:
    """The number of the last committed version of a table of versions; 0 if there is none."""
    fs, _ = _files(spark, path)
    log = fs.Path(f"{path}/_commits")
    own = log.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in own.listStatus(log)] if own.exists(log) else []
    return max((int(n) for n in names if n.isdigit()), default=0)


def read_committed(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a committed version, the last one if none is named; what failed writers left is never seen."""
    fs, _ = _files(spark, path)
    number = committed(spark, path) if version is None else version
    if not number:
        raise ValueError(f"{path} has no committed version")
    entry = fs.Path(f"{path}/_commits/{number}")
    stream = entry.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(entry)
    try:
        folder = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return spark.read.parquet(f"{path}/{folder}")


def commit_whole(df: DataFrame, path: str, based_on: int | None = None) -> int:
    """Replaces a table whole, and returns the new version's number.

    The rows go to a folder of their own; then one entry, written aside, is moved to the next
    number, which fails if another writer has it. So readers see the old set or the new one,
    a writer that is killed before leaves the old one, and of two writers one is refused.
    based_on: the version that the rows were made from, the last one if none is named.
    """
    spark = df.sparkSession
    after = committed(spark, path) if based_on is None else based_on
    folder = f"rows-{uuid.uuid4().hex}"
    fs, context = _files(spark, path)
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    try:
        df.write.parquet(f"{path}/{folder}")
        aside = fs.Path(f"{path}/_aside/{folder}")
        out = aside.getFileSystem(hadoop).create(aside, False)
        out.write(bytearray(folder.encode()))
        out.close()
        entry = fs.Path(f"{path}/_commits/{after + 1}")
        entry.getFileSystem(hadoop).mkdirs(entry.getParent())
        if entry.getFileSystem(hadoop).exists(entry):
            raise ValueError(f"version {after + 1} was committed by another writer")
        options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(aside, entry, options)  # an entry that is there is never moved over
    except Exception:
        for left in (fs.Path(f"{path}/{folder}"), fs.Path(f"{path}/_aside/{folder}")):
            left.getFileSystem(hadoop).delete(left, True)
        raise
    return after + 1


def commit_sets(incoming: DataFrame, path: str, set_key: str, record: list[str], content: list[str]) -> int:
    """Replaces the sets that come in, each whole, and returns the new version: replaced_set() of the last version, committed at once or not at all."""
    spark = incoming.sparkSession
    last = committed(spark, path)
    own = replaced_set(read_committed(spark, path, last), incoming, set_key, record, content) if last else replaced_set(incoming.limit(0), incoming, set_key, record, content)
    return commit_whole(own, path, last)


def publication_audit(changes: DataFrame, key: str, actor: Column, at: Column) -> DataFrame:
    """Audit rows of publication_changes(): one for each wish that wasn't refused, a wish for the state as it is too."""
    done = changes.filter(F.col("refused").isNull()).withColumnRenamed("publication", "after")
    return audit_rows(done, actor, F.lit("publication_status"), at, key, ["before", "after"])


def audit_rows(df: DataFrame, actor: Column, action: Column, at: Column, subject: str, details: list[str]) -> DataFrame:
    """Rows for an append-only log: who did what to which record, when, and the details as JSON. Equal events have equal ids."""
    rows = df.select(actor.alias("actor"), action.alias("action"), at.alias("at"), F.col(subject).cast("string").alias("subject"), F.to_json(F.struct(*details)).alias("details"))
    return with_row_ids(rows, ["actor", "action", "at", "subject", "details"], "audit_id")


def nested_json(df: DataFrame, key: str, children: dict[str, tuple[DataFrame, str, list[str]]], order: list[Column], most: int = 1000) -> DataFrame:
    """key and json of the first `most` records: all columns, and each named list of children (rows, their foreign key, fields) inside."""
    first = df.orderBy(*order).limit(most)
    out = first
    for name, (rows, foreign, fields) in children.items():
        own = rows.join(first.select(F.col(key).alias(foreign)), foreign, "left_semi")
        out = with_children(out, own, key, foreign, name, fields)
    return out.select(key, F.to_json(F.struct(*out.columns)).alias("json"))


def expired_rows(df: DataFrame, at: str, now: Column, live: DataFrame | None = None, key: str | None = None, most: int | None = None) -> DataFrame:
    """Rows past their expiry that no live lease holds; the oldest ones if only some are to go at once."""
    out = df.filter(F.col(at) < now)
    if live is not None:
        out = out.join(live.select(key), key, "left_anti")
    return out if most is None else out.orderBy(at).limit(most)
