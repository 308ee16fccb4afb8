"""Filters, joins, aggregates, windows, paging and deduplication."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import duration_ms
from ..functions.jsons import has_any
from ..functions.numbers import coverage
from ..functions.text import clean
from .lineage import cut, tasks_for
from .ranges import placed


def matching(df: DataFrame, *, equal: dict | None = None, contains: dict | None = None, between: dict | None = None, any_of: dict | None = None, text: str | None = None, columns: Iterable[str] = ()) -> DataFrame:
    """The conjunction of those filters that have a value; null values and empty texts ask for nothing.

    between takes (low, high), either of them null; contains ignores case and is literal;
    text is looked for in any of the columns.
    """
    out = df.filter(any_contains(columns, text)) if text else df
    for c, v in (equal or {}).items():
        out = out if v in (None, "") else out.filter(F.col(c) == v)
    for c, v in (contains or {}).items():
        out = out if v in (None, "") else out.filter(F.lower(c).contains(v.lower()))
    for c, (low, high) in (between or {}).items():
        out = out if low is None else out.filter(F.col(c) >= low)
        out = out if high is None else out.filter(F.col(c) <= high)
    for c, v in (any_of or {}).items():
        out = out if not v else out.filter(F.col(c).isin(*v))
    return out


def incomplete(required: Iterable[str], allowed: dict[str, list] | None = None, unknown: dict[str, str] | None = None, prefixes: dict[str, str] | None = None) -> Column:
    """Whether any required column is null or empty, or one holds a value that isn't allowed, is unknown, or begins so."""
    parts = [F.col(c).isNull() | (F.col(c).cast("string") == "") for c in required]
    parts += [~F.coalesce(F.col(c).isin(*v), F.lit(False)) for c, v in (allowed or {}).items()]
    parts += [F.coalesce(F.col(c) == v, F.lit(False)) for c, v in (unknown or {}).items()]
    parts += [F.coalesce(F.col(c).startswith(v), F.lit(False)) for c, v in (prefixes or {}).items()]
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def any_contains(columns: Iterable[str], text: str) -> Column:
    """A literal, case-insensitive search over several columns."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c).cast("string")).contains(text.lower()), F.lit(False)) for c in columns])


def in_scope(df: DataFrame, day: str, low, high, keys: dict[str, list]) -> DataFrame:
    """Rows in a date range that carry any of the given keys; no keys at all ask for all rows."""
    out = matching(df, between={day: (low, high)})
    wanted = [F.col(c).isin(*v) for c, v in keys.items() if v]
    return out.filter(reduce(lambda a, b: a | b, wanted)) if wanted else out


def allowed_sources(value: str | None, known: Iterable[str]) -> list[str]:
    """The known ones of a comma list."""
    return [s for s in dict.fromkeys(x.strip().lower() for x in (value or "").split(",")) if s in set(known)]


def admin_filter(df: DataFrame, warnings: str, has: list[str] = (), equal: dict | None = None, without: dict[str, list] | None = None) -> DataFrame:
    """matching(), with any of some warnings in a JSON array of them, and without listed values."""
    out = matching(df, equal=equal)
    out = out.filter(has_any(warnings, "$", list(has))) if has else out
    for c, v in (without or {}).items():
        out = out.filter(~F.coalesce(F.col(c).isin(*v), F.lit(False)))
    return out


#: What a mode of curation asks for.
CURATION = {"published": ("publication", "published"), "pending_review": ("publication", "pending_review"), "failed": ("curation", "failed"), "not_curated": ("curation", "not_curated")}


def for_curation(df: DataFrame, only: str | None, limit: int, at: str, key: str) -> DataFrame:
    """Records of a mode (any for an unknown one), the newest first, 1 to 100 of them."""
    column, value = CURATION.get(only or "", (None, None))
    out = df if column is None else df.filter(F.col(column) == value)
    return out.orderBy(F.desc(at), F.asc(key)).limit(min(max(limit, 1), 100))


def job_list(df: DataFrame, started: str, finished: str, renamed: dict[str, str], json: str, picked: dict[str, str]) -> DataFrame:
    """Jobs with duration_ms (null while they run), renamed columns, and picked paths of their JSON."""
    out = df.withColumn("duration_ms", duration_ms(started, finished))
    for path, name in ((p, n) for n, p in picked.items()):
        out = out.withColumn(name, F.get_json_object(json, path))
    return out.withColumnsRenamed(renamed).drop(json, started, finished)


def owned_by(df: DataFrame, owner: str, user, admin: bool = False) -> DataFrame:
    return df if admin else df.filter(F.col(owner) == F.lit(user))


def with_children(parents: DataFrame, children: DataFrame, key: str, child_key: str, name: str, fields: list[str]) -> DataFrame:
    """Parents with their children as an array in order of the fields; an empty one for those without."""
    rows = children.groupBy(F.col(child_key).alias("__key")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    joined = parents.join(rows, F.col(key) == F.col("__key"), "left").drop("__key")
    kind = rows.schema[name].dataType.simpleString()
    return joined.withColumn(name, F.coalesce(name, F.array().cast(kind)))


def having_some(parents: DataFrame, children: DataFrame, key: str, child_key: str, condition=None) -> DataFrame:
    own = children if condition is None else children.filter(condition)
    return parents.join(own.select(F.col(child_key).alias(key)), key, "left_semi")


def having_none(parents: DataFrame, children: DataFrame, key: str, child_key: str, condition=None) -> DataFrame:
    own = children if condition is None else children.filter(condition)
    return parents.join(own.select(F.col(child_key).alias(key)), key, "left_anti")


#: Parts that the left rows of one key are dealt to.
SALTS = 8


def by_any_key(left: DataFrame, right: DataFrame, left_keys: list[Column], right_keys: list[Column], left_id: str, right_id: str) -> DataFrame:
    """Distinct (left_id, right_id) that agree in any key: an OR join as one equi-join over tagged keys.

    A pair is made at the least key that both ids have, so pairs are never shuffled to make them distinct.
    Keys are dealt over a fixed number of tasks, and the left rows of each over SALTS of them.
    """
    tags = lambda keys: F.array_compact(F.array(*[F.when(k.isNotNull(), F.concat_ws(":", F.lit(str(i)), k.cast("string"))) for i, k in enumerate(keys)]))
    n = tasks_for(left.sparkSession)

    def side(df: DataFrame, own: str, keys: list[Column], p: str, salt: Column) -> DataFrame:
        ids = df.select(F.col(own).alias(f"__{p}"), tags(keys).alias("t")).groupBy(f"__{p}").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias(f"__{p}_all"))
        each = ids.select(f"__{p}", f"__{p}_all", F.explode(f"__{p}_all").alias("__key"))
        return each.withColumn("__salt", salt).repartition(n, "__key", "__salt")

    a = side(left, left_id, left_keys, "a", F.pmod(F.xxhash64("__a"), F.lit(SALTS)).cast("int"))
    b = side(right, right_id, right_keys, "b", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    first = F.array_min(F.array_intersect("__a_all", "__b_all")) == F.col("__key")
    return a.join(b, ["__key", "__salt"]).filter(first).select(F.col("__a").alias(left_id), F.col("__b").alias(right_id))


def by_variants(left: DataFrame, right: DataFrame, left_id: str, left_variants: Column, right_id: str, right_value: str) -> DataFrame:
    """For each left row, how many right rows have one of its variants, and the least of them; ambiguous if several.

    Rows aren't paired: right ids of one value are a count and a least id of that value, and the counts
    of a left row's distinct variants add up. Only right ids of several values are met one by one, as they count once.
    """
    a = left.select(left_id, F.explode(left_variants).alias("__value")).distinct()
    ids = right.select(F.col(right_id).alias("__id"), F.col(right_value).alias("__value")).distinct()
    own = ids.groupBy("__id").agg(F.count(F.lit(1)).alias("__n"), F.min("__value").alias("__value"))
    many = own.filter("__n > 1").select(F.col("__id").alias("__of"))
    met = a.join(ids.join(many, F.col("__id").eqNullSafe(F.col("__of")), "left_semi"), "__value").select(left_id, "__id").distinct()
    values = own.filter("__n = 1").groupBy("__value").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__id"))
    hits = a.join(values, "__value").select(left_id, "__n", "__id").union(met.select(left_id, F.lit(1).cast("long"), "__id"))
    return hits.groupBy(left_id).agg(F.sum("__n").alias("candidates"), F.min("__id").alias("first_candidate"), (F.sum("__n") > 1).alias("ambiguous"))


def resolve_alias(df: DataFrame, aliases: DataFrame, key: str, old: str = "alias", new: str = "canonical") -> DataFrame:
    """df with the key replaced by what it is an alias of."""
    a = aliases.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
    return df.join(a, F.col(key) == F.col("__old"), "left").withColumn(key, F.coalesce("__new", key)).drop("__old", "__new")


def by_slug(df: DataFrame, records: DataFrame, aliases: DataFrame, slug: str, key: str, old: str = "alias", new: str = "canonical") -> DataFrame:
    """df with the key of the record that has the slug, or else of the one that a slug is an alias of."""
    own = records.select(F.col(slug).alias("__slug"), F.col(key).alias("__own"))
    was = aliases.select(F.col(old).alias("__was"), F.col(new).alias("__new"))
    rows = df.join(own, F.col(slug) == F.col("__slug"), "left").join(was, F.col(slug) == F.col("__was"), "left")
    return rows.withColumn(key, F.coalesce("__own", "__new")).drop("__slug", "__own", "__was", "__new")


def looked_up(df: DataFrame, side: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """df with columns of another table by key, or a default where it has none."""
    out = df.join(side.select(key, *defaults), key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def latest(df: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; add a unique column to it for a defined result."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def leaves(df: DataFrame, key: str, parent: str) -> DataFrame:
    """Rows that no other row names as its parent."""
    return df.join(df.select(F.col(parent).alias(key)).filter(F.col(key).isNotNull()), key, "left_anti")


def best_match(df: DataFrame, key: str, score: str, tie: str, least: float = 0.8) -> DataFrame:
    return latest(df.filter(F.col(score) >= least), [key], [F.desc(score), F.asc(tie)])


def counts_map(df: DataFrame, key: str, most: int = 1000) -> DataFrame:
    """One row: the number of rows by value, as a map; of more than `most` values (a status has few) it is refused."""
    rows = df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias("k")).count()
    first = rows.limit(most + 1).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "count")))).alias("counts"))
    return first.select(F.when(F.size("counts") <= most, F.col("counts")).otherwise(F.raise_error(F.lit(f"more than {most} values"))).alias("counts"))


def covered(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Count and percent of each flag in one pass, a row for each."""
    one = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in flags.items()])
    rows = one.select("total", F.inline(F.array(*[F.struct(F.lit(n).alias("flag"), F.col(n).alias("n")) for n in flags])))
    return rows.select("flag", "n", "total", coverage("n", "total").alias("percent"))


def reconciled(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Expected and actual counts of each group; either may be missing."""
    both = expected.join(actual, key, "full_outer").select(key, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))
    text = F.concat_ws(" ", F.lit("expected"), F.col("expected").cast("string"), F.lit("got"), F.col("actual").cast("string"))
    return both.withColumn("warning", F.when(F.col("expected") != F.col("actual"), text))


def progress(groups: DataFrame, root: str, rows: str, expected: str, done: str) -> DataFrame:
    """For each root: its groups, those complete, rows, expected rows where they're known, and the percent of rows in complete groups."""
    total = F.sum(rows)
    out = groups.groupBy(root).agg(F.count(F.lit(1)).alias("groups"), F.count_if(done).alias("complete"), total.alias("rows"), F.coalesce(F.sum(expected), F.lit(0)).alias("expected"), F.coalesce(F.sum(F.when(F.col(done), F.col(rows))), F.lit(0)).alias("__in"))
    return out.withColumn("percent", coverage("__in", "rows")).drop("__in")


#: Digits of a hash that are summed as one number: sums of so few bits hold 2^47 rows.
LIMB = 4


def content_hash(df: DataFrame, group: list[str], row_text: Column) -> DataFrame:
    """A hash of each group's rows, repeated ones included, that doesn't depend on their order.

    Each row's SHA-256 is cut into limbs; limbs are summed place by place, and the hash is
    that of the sums and the number of rows. Sums of parts of a group add up, so a group
    of any size is summed before it is shuffled, and none is ever gathered.
    """
    digest = df.select(*group, F.sha2(row_text, 256).alias("__h"))
    limbs = [F.conv(F.substring("__h", k, LIMB), 16, 10).cast("long") for k in range(1, 65, LIMB)]
    sums = digest.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(limb).alias(f"__{k}") for k, limb in enumerate(limbs)])
    text = F.concat_ws(",", *[F.coalesce(F.col(c), F.lit(0)).cast("string") for c in ("__n", *[f"__{k}" for k in range(len(limbs))])])
    return sums.select(*group, F.sha2(text, 256).alias("content_hash"))


def set_hash(df: DataFrame, group: str, row_text: Column) -> DataFrame:
    """The SHA-256 over the sorted SHA-256 of each set's rows, repeated ones included, whatever their order.

    A set's hashes stand in order in one task and run through its digest batch by batch, so a set of
    any size is hashed whole in bounded memory.
    """
    kind = df.schema[group].dataType.simpleString()
    rows = df.select(F.col(group).alias("g"), F.sha2(row_text, 256).alias("h")).repartition("g").sortWithinPartitions("g", "h")

    def run(batches):
        last, digest = None, None
        for batch in batches:
            groups, hashes = batch.column(0), batch.column(1).to_pylist()
            ends = [k + 1 for k in pc.indices_nonzero(_changed(groups)).to_pylist()] + [len(hashes)]
            keys, values, begin = [], [], 0
            for end in ends if hashes else []:
                key = groups.slice(begin, 1)
                if digest is None or not key.equals(last):
                    if digest is not None:
                        keys.append(last)
                        values.append(digest.hexdigest())
                    last, digest, mark = key, hashlib.sha256(), ""
                digest.update((mark + "\n".join(hashes[begin:end])).encode())
                mark, begin = "\n", end
            if keys:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(values)], names=["g", "content_hash"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([last, pa.array([digest.hexdigest()])], names=["g", "content_hash"])

    return rows.mapInArrow(run, f"g {kind}, content_hash string").withColumnRenamed("g", group)


def _changed(values: pa.Array) -> pa.Array:
    """For each value but the last, whether the next one is another; null equals null."""
    a, b = values.slice(0, max(len(values) - 1, 0)), values.slice(1)
    return pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20, most: int = 100) -> DataFrame:
    """A page of rows in a total order; the size is bounded."""
    size = max(1, min(size, most))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_total(df: DataFrame, size: int = 20, most: int = 100) -> DataFrame:
    size = max(1, min(size, most))
    return df.agg(F.count(F.lit(1)).alias("total")).select("total", F.ceil(F.col("total") / size).cast("int").alias("pages"))


def after(df: DataFrame, at: str, key: str, last_at, last_key, size: int, until=None) -> DataFrame:
    """The next rows behind a (time, key) place, none newer than a snapshot."""
    more = (F.col(at) > F.lit(last_at)) | ((F.col(at) == F.lit(last_at)) & (F.col(key) > last_key))
    out = df.filter(more)
    out = out if until is None else out.filter(F.col(at) <= F.lit(until))
    return out.orderBy(at, key).limit(size)


def sorted_by(df: DataFrame, column: str, allowed: Iterable[str], tie: str, descending: bool = False) -> DataFrame:
    """Sorted by an allowed column, else by the tie; nulls last, ties by the tie."""
    if column not in set(allowed):
        return df.orderBy(tie)
    return df.orderBy(F.desc_nulls_last(column) if descending else F.asc_nulls_last(column), tie)


def by_date(df: DataFrame, at: str, key: str, most: int) -> DataFrame:
    """The first rows by date, those without one last."""
    return df.orderBy(F.asc_nulls_last(at), F.asc(key)).limit(most)


def chunked(df: DataFrame, order: list[Column], size: int, name: str) -> DataFrame:
    """df with the number of its chunk, of so many rows each, in a total order.

    Rows are dealt by ranges and numbered inside each; a range's first number is the sum
    of the counts before it, of which there are as many as partitions.
    """
    dealt = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id()))
    counts = dealt.groupBy("__range").count()
    before = F.coalesce(F.sum("count").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begins = counts.select("__range", before.alias("__before"))
    n = F.row_number().over(W.partitionBy("__range").orderBy(*order)) - 1
    return dealt.join(begins, "__range").withColumn(name, F.floor((n + F.col("__before")) / size).cast("int")).drop("__range", "__before")


def refused_beyond(df: DataFrame, most: int) -> DataFrame:
    """df, or an error if it has more rows than that; counts one row past the limit at most."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return df


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct non-empty values of each column: facet, value."""
    rows = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])))
    return rows.filter("value is not null and value != ''").distinct()


def minus_seen(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys of df that weren't seen."""
    return df.select(*keys).distinct().join(seen.select(*keys), keys, "left_anti")


def deduplicated(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key, with how many there were."""
    w = W.partitionBy("__k")
    rows = df.withColumn("__k", key).withColumn("__n", F.row_number().over(w.orderBy(*order))).withColumn("copies", F.count(F.lit(1)).over(w))
    return rows.filter("__n = 1").drop("__k", "__n")


def result_key(group: list[Column], bib: Column, position: Column, name: Column) -> Column:
    """What two result rows agree in if they're one: group and name, with the bib, else with the position."""
    who = F.when(clean(bib) != "", F.concat(F.lit("bib:"), clean(bib))).otherwise(F.concat(F.lit("pos:"), F.coalesce(position.cast("string"), F.lit(""))))
    return F.concat_ws("|", *[g.cast("string") for g in group], who, F.lower(clean(name)))


def record_key(*parts: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), lambda p: F.concat(F.length(p).cast("string"), F.lit(":"), p)), "|"), 256)


def first_by(array: Column, key) -> Column:
    """An array without the elements whose key came before."""
    keys = F.transform(array, key)
    return F.filter(array, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def merged_lots(df: DataFrame, group: str, lists: list[str], key: list[str]) -> DataFrame:
    """The union of several lists of lots (the key's fields and current): one of each key, current if any is, one current at least."""
    whole = df.select(group, F.posexplode(F.concat(*lists)).alias("at", "lot"))
    one = whole.groupBy(group, *[F.col(f"lot.{k}").alias(k) for k in key]).agg(F.max("lot.current").alias("current"), F.min("at").alias("at"))
    w = W.partitionBy(group)
    some = F.max("current").over(w)
    first = F.row_number().over(w.orderBy("at")) == 1
    return one.withColumn("current", F.when(some, F.col("current")).otherwise(first)).drop("at")


def gaps(df: DataFrame, group: str, offset: str, size: str, digest: str) -> DataFrame:
    """Each page as ok, gap, overlap or repeated, by where the one before ended and whether its hash occurred."""
    w = W.partitionBy(group).orderBy(offset)
    expected = F.coalesce(F.lag(F.col(offset) + F.col(size)).over(w), F.lit(0))
    seen = F.row_number().over(W.partitionBy(group, digest).orderBy(offset)) > 1
    state = F.when(seen, "repeated").when(F.col(offset) > expected, "gap").when(F.col(offset) < expected, "overlap").otherwise("ok")
    return df.select(group, offset, size, state.alias("state"))


def parts_by_rows(df: DataFrame, order: list[str], rows: int, group: list[str] | None = None) -> DataFrame:
    """df with part, so many rows in each. Places come from ranges, so a group of any size is spread."""
    return placed(df, group or [], order, name="__place").withColumn("part", (F.floor(F.col("__place") / rows) + 1).cast("int")).drop("__place")


def unpivoted(df: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    return df.select(*key, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])))
