"""Queues, budgets, ledgers and recurrence as batch queries. The streaming forms are in waymark.streaming."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from .lineage import cut, stored, tasks_over

#: Lease and waiting time that lifts a task to the front; kinds that go first or last.
LEASE_SECONDS, WAIT_MINUTES = 90, 15
FIRST_KINDS = ("export", "export-selection")
#: Stages of a cycle, in order.
STAGES = ("discovery", "enrichment", "reconciliation")
LAST_KINDS = ("catalog-sync", "catalog-reconcile", "catalog", "catalog-process", "curate-batch")


def enqueued(df: DataFrame, owner: str, key: str, request: Column, order: list[Column]) -> DataFrame:
    """The first request of each (owner, key), with how often it came and whether all of them asked for the same."""
    w = W.partitionBy(owner, key)
    rows = df.withColumn("__h", F.sha2(request, 256))
    rows = rows.withColumn("__n", F.row_number().over(w.orderBy(*order)))
    rows = rows.withColumn("requests", F.count(F.lit(1)).over(w)).withColumn("consistent", F.min("__h").over(w) == F.max("__h").over(w))
    return rows.filter("__n = 1").drop("__n", "__h")


def priority(kind: str, created: str, now: Column) -> Column:
    """0 for what has waited long or is asked for by a person, 2 for bulk work, else 1."""
    waited = F.col(created) <= now - F.expr(f"interval {WAIT_MINUTES} minutes")
    return F.when(waited, 0).when(F.col(kind).isin(*FIRST_KINDS), 0).when(F.col(kind).isin(*LAST_KINDS), 2).otherwise(1)


def recovered(df: DataFrame, now: Column) -> DataFrame:
    """Running tasks whose lease is over go back to the queue, or fail after their last attempt."""
    over = (F.col("status") == "running") & (F.col("lease_until") < now) & ~F.col("hold")
    return df.withColumn("expired", F.coalesce(over, F.lit(False))).withColumn("status", F.when(F.col("expired") & (F.col("attempt") >= F.col("max_attempts")), "failed").when(F.col("expired"), "queued").otherwise(F.col("status"))).withColumn("lease_until", F.when(~F.col("expired"), F.col("lease_until")))


def claimed(df: DataFrame, now: Column, blocked: DataFrame | None = None, exclusive: tuple[str, ...] = (), per_source: bool = True) -> DataFrame:
    """The next task of each free source (or of all), with its new attempt and lease.

    df: id, source, kind, status, created, available, hold, attempt, max_attempts,
    lease_until. A source with a running task, one that is blocked, or one of an
    exclusive group of which another runs, gives none.
    """
    rows = recovered(df, now)
    group = F.when(F.col("source").isin(*exclusive), "exclusive").otherwise(F.concat(F.lit("own:"), F.col("source"))) if exclusive else F.col("source")
    rows = rows.withColumn("__group", group)
    busy = rows.filter("status = 'running'").select("__group").distinct()
    free = rows.filter((F.col("status") == "queued") & (F.col("available") <= now) & ~F.col("hold")).join(busy, "__group", "left_anti")
    if blocked is not None:
        free = free.join(blocked.select("source"), "source", "left_anti")
    order = [priority("kind", "created", now), F.col("created"), F.col("id")]
    if per_source:
        first = free.withColumn("__n", F.row_number().over(W.partitionBy("__group").orderBy(*order))).filter("__n = 1")
    else:
        first = free.orderBy(*order).limit(1)
    return first.select("id", "source", priority("kind", "created", now).alias("priority"), (F.col("attempt") + 1).alias("attempt"), (now + F.expr(f"interval {LEASE_SECONDS} seconds")).alias("lease_until"))


def transitions(tasks: DataFrame, reports: DataFrame, now: Column) -> DataFrame:
    """Tasks after reports (id, token, outcome): only the holder of a live lease counts; a failure waits and is tried again.

    Outcomes: heartbeat, completed, failed, and deferred, which gives the attempt back.
    """
    r = reports.select("id", F.col("token").alias("by"), "outcome")
    rows = tasks.join(r, "id", "left")
    holder = F.coalesce((F.col("by") == F.col("token")) & (F.col("status") == "running") & (F.col("lease_until") >= now), F.lit(False))
    last = F.col("attempt") >= F.col("max_attempts")
    wait = F.least(F.lit(1800), 30 * F.pow(F.lit(2.0), F.col("attempt"))).cast("int")
    status = F.when(~holder, F.col("status")).when(F.col("outcome") == "completed", "completed").when((F.col("outcome") == "failed") & last, "failed").when(F.col("outcome").isin("failed", "deferred"), "queued").otherwise(F.col("status"))
    attempt = F.when(holder & (F.col("outcome") == "deferred"), F.greatest(F.col("attempt") - 1, F.lit(0))).otherwise(F.col("attempt"))
    return rows.select("id", status.alias("new_status"), attempt.alias("new_attempt"), F.when(holder & (F.col("outcome") == "failed") & ~last, wait).alias("retry_seconds"), (F.col("outcome").isNotNull() & ~holder).alias("refused"))


def _in_order(df: DataFrame, key: str, at: str, order: str, gate, result: str, more: list[Column] = ()) -> DataFrame:
    """Rows decided one after the other within each key: gate().run(times, *more) passes a key's next rows, gate.shown gives their results.

    gate: a class whose `state` is a list of numbers that says all that later decisions hang on.
    Rows are dealt by ranges of key and time, so one key may lie in many tasks; there are as many more
    ranges as rows. They are sorted once and kept in blocks, a row for each batch. Each range is run from an
    empty state first. Where a key goes on from the range before, and that one's state turns out to be
    another than was taken, the range is run again, until none changes; then the first range is
    right, and so each next one. Limits that forget settle in a few rounds, which take all such
    ranges at once. Where a round settles less than half of them, as when a key's every state hangs on its
    first request, the next ones take the state from range to range instead: a task for each key,
    over WALKED ranges from its first open one. So a range is run a few times, however many a key has.
    The driver holds a state for each range, a task the blocks of its ranges.
    """
    out = StructType([df.schema[key], df.schema[order], *StructType.fromDDL(result)])
    types = [ARROW[f.dataType.typeName()] for f in out.fields[2:]]
    rest_of = [f"__{i}" for i in range(len(more))]
    own = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))  # one form of a key in every batch
    rows = df.select(key, order, own.alias("__key"), F.unix_micros(F.col(at).cast("timestamp")).alias("__at"), *[c.alias(n) for c, n in zip(more, rest_of, strict=True)])
    spark, ranges, by = df.sparkSession, tasks_over(df), ["__key", "__at", order]
    kept = [f for f in rows.schema.fields if f.name != "__key"]
    packed = StructType([*StructType.fromDDL(_BLOCK), *[StructField(f.name, ArrayType(f.dataType)) for f in kept]])

    def pack(batches):
        last, block = None, 0
        for batch in batches:
            if n := batch.num_rows:
                keys = batch.column("__key")
                first, before, last = keys[0].as_py(), last, keys[n - 1].as_py()
                begins = (np.flatnonzero(pc.not_equal(keys[1:], keys[:-1])) + 1).tolist()
                begins = [0, *begins] if block and first != before else begins
                told = [[batch.column("__range")[0].as_py()], [block], [first], [last], [begins]]
                told = [pa.array(v, t) for v, t in zip(told, (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32())), strict=True)]
                lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([*told, *lists], names=packed.names)
                block += 1

    dealt = rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("__range", F.spark_partition_id())
    dealt = stored(dealt.mapInArrow(pack, packed))

    def runs(begins: dict[int, list], ends_only: bool):
        def run(batches):
            place, at_work = None, gate()
            for batch in batches:
                ends = {}
                for i in range(batch.num_rows):
                    r, first, last, fresh = (batch.column(c)[i].as_py() for c in ("__range", "__first", "__last", "__begins"))
                    times = batch.column("__at")[i].values.to_numpy(zero_copy_only=False).tolist()
                    rest, found = [batch.column(c)[i].values.to_pylist() for c in rest_of], []
                    if r != place and r in begins:  # any other range goes on from the one before, which is of the same key
                        at_work = gate(begins[r])
                    place = r
                    for lo, hi in pairwise([0, *[f for f in fresh if f], len(times)]):
                        at_work = gate() if lo or 0 in fresh[:1] else at_work
                        found += at_work.run(times[lo:hi], *[c[lo:hi] for c in rest])
                    if ends_only:
                        before = ends.get(r, {"first": first, "alone": True})
                        ends[r] = {"r": r, "block": batch.column("__block")[i].as_py(), "first": before["first"], "last": last, "alone": before["alone"] and not fresh, "state": at_work.state}
                    else:
                        shown = [pa.array(v, t) for v, t in zip(gate.shown(times, found), types, strict=True)]
                        yield pa.RecordBatch.from_arrays([batch.column(key)[i].values, batch.column(order)[i].values, *shown], names=out.names)
                if ends_only:
                    yield pa.RecordBatch.from_pylist(list(ends.values()), ENDS)

        return run

    def ends_of(walks: list[list[int]], begins: dict[int, list]) -> dict[int, tuple]:
        """How ranges end: those of a walk in one task, each from where the one before ended."""
        steps = spark.createDataFrame([(r, walk[0]) for walk in walks for r in walk], "__range int, __walk int")
        near = dealt.filter(F.col("__range").between(min(w[0] for w in walks), max(w[-1] for w in walks)))  # reads no other files
        wanted = near.drop(key, order).join(F.broadcast(steps), "__range")
        spread = wanted.repartition(min(ranges, len(walks)), "__walk").sortWithinPartitions("__range", "__block")
        found: dict[int, tuple] = {}
        # a row for each range, or for each batch of one
        for e in sorted(spread.mapInArrow(runs(begins, True), _ENDS).collect(), key=lambda e: (e["r"], e["block"])):
            first, _, alone, _ = found.get(e["r"], (e["first"], None, True, None))
            found[e["r"]] = (first, e["last"], alone and e["alone"], list(e["state"]))
        return found

    told: dict[int, tuple] = {}
    used: dict[int, list] = {r: [] for r in range(ranges)}
    walks, begins, were_open, forgets = [[r] for r in used], used, 2 * ranges + 1, True
    while walks:
        ended = ends_of(walks, begins)
        for walk in walks:
            used |= {after: ended[r][3] for r, after in pairwise(walk)}
        told |= ended
        stale, chains, before, walked = {}, [], None, False
        for r in sorted(told):
            first, last, alone, state = told[r]
            goes_on = before is not None and before[0] == first
            walked = walked and goes_on and alone
            wanted = before[1] if goes_on else []
            if wanted == used[r] or not alone:
                used[r] = wanted  # the state behind a range of several keys hangs on its last key alone
            else:
                stale[r] = wanted
            if walked and len(chains[-1]) < WALKED:
                chains[-1].append(r)  # settled or not: what is taken through may unsettle it
            elif r in stale and not walked:
                walked = True
                chains.append([r])
            before = (last, state)
        forgets = forgets and 2 * len(stale) < were_open
        walks = [[r] for r in stale] if forgets else chains
        begins, were_open = {w[0]: stale[w[0]] for w in walks}, len(stale)
        used |= begins
    return dealt.repartition(ranges, "__range").sortWithinPartitions("__range", "__block").mapInArrow(runs(used, False), out)


#: Ranges of one key that a task takes the state through, one after the other.
WALKED = 16
ARROW = {"boolean": pa.bool_(), "long": pa.int64(), "string": pa.string()}
#: A block's range, its place there, its first and last key, and the rows that begin a key (the first one too, if it isn't the range's).
_BLOCK = "__range int, __block int, __first string, __last string, __begins array<int>"
_ENDS = "r int, block int, first string, last string, alone boolean, state array<long>"
ENDS = pa.schema([("r", pa.int32()), ("block", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("alone", pa.bool_()), ("state", pa.list_(pa.int64()))])


HOUR = 3_600_000_000


class _Gate:
    """An hourly budget, a least spacing in microseconds and a breaker. state: hour, used, when it is ready, whether it is shut, and until when."""

    limit = spacing = 0

    def __init__(self, state: list | None = None):
        self.state = list(state or [0, 0, 0, 0, 0])

    def run(self, times: list[int], *more: list) -> list[tuple[str, int | None]]:
        return [self.step(*row) for row in zip(times, *more, strict=True)]

    @staticmethod
    def shown(times: list[int], found: list) -> list:
        return list(zip(*found, strict=True)) or [[], []]

    def step(self, now: int, close: bool, until: float | None, resume: bool) -> tuple[str, int | None]:
        hour, used, ready, shut, shut_until = self.state
        if resume and shut and shut_until > now:
            return "refused", shut_until
        if resume:
            self.state = [hour, used, ready, 0, 0]
            return "resumed", None
        if shut:
            return "blocked", shut_until or None
        if hour < now // HOUR:
            hour, used = now // HOUR, 0
        if used >= self.limit:
            return "budget", (hour + 1) * HOUR
        if ready > now:
            return "spacing", ready
        self.state = [hour, used + 1, now + self.spacing, int(bool(close)), int(until or 0) if close else 0]
        return "allowed", None


def request_gate(df: DataFrame, key: str, at: str, order: str, limit: int, spacing_ms: int = 0, closes: Column | None = None, blocked_until: Column | None = None, resumes: Column | None = None) -> DataFrame:
    """Each request's decision: allowed, budget (so many were allowed in the clock hour), spacing (too soon behind the last allowed one) or blocked; and when to try again.

    Only allowed requests count and move the gate. closes: an allowed request whose answer
    shuts the gate for all behind it, with a time that the source names, or none (blocked_until).
    resumes: a row that is a person's wish to open the gate: resumed, or refused before that time.
    retry_at: the hour's end, the end of the spacing, or the time that was named.
    """
    gate = type("Gate", (_Gate,), {"limit": limit, "spacing": spacing_ms * 1000})
    flag = lambda c: F.coalesce(c, F.lit(False)) if c is not None else F.lit(False)
    until = F.unix_micros(blocked_until.cast("timestamp")) if blocked_until is not None else F.lit(None).cast("long")
    out = _in_order(df, key, at, order, gate, "decision string, __retry long", [flag(closes), until, flag(resumes)])
    return out.select(key, order, "decision", F.timestamp_micros("__retry").alias("retry_at"))


def window_view(df: DataFrame, started: str, used: str, limit: str, now: Column) -> DataFrame:
    """A budget as it's shown: an hour that is over counts as unused, and says when the next begins."""
    hour = F.date_trunc("hour", now)
    live = F.col(started) >= hour
    spent = F.when(live, F.col(used)).otherwise(0)
    return df.withColumn("used_now", spent).withColumn("left", F.greatest(F.col(limit) - spent, F.lit(0))).withColumn("resets_at", hour + F.expr("interval 1 hour"))


def sliding_limit(df: DataFrame, key: str, at: str, order: str, limit: int, seconds: float) -> DataFrame:
    """df with allowed and retry_after under at most `limit` allowed requests in any `seconds`; refused ones don't count.

    retry_after: 0 for an allowed request, else whole seconds, one more than are left.
    """
    window = type("Window", (_Window,), {"limit": limit, "span": int(seconds * 1_000_000)})
    return _in_order(df, key, at, order, window, "allowed boolean, retry_after long")


ALLOWED = -(1 << 63)


class _Window:
    """The times of allowed requests that a window of `span` microseconds still holds."""

    limit = span = 0

    def __init__(self, state: list | None = None):
        self.held = deque(state or [])

    @property
    def state(self) -> list:
        return list(self.held)

    def run(self, times: list[int]) -> list[int]:
        """For each row ALLOWED, or the time from which one is again: up to there, all are refused at once."""
        held, found, i, n = self.held, [], 0, len(times)
        while i < n:
            now = times[i]
            while held and held[0] <= now - self.span:
                held.popleft()
            if len(held) < self.limit:
                held.append(now)
                found.append(ALLOWED)
                i += 1
            else:
                free = held[0] + self.span
                after = max(i + 1, bisect_left(times, free, i))
                found += [free] * (after - i)
                i = after
        return found

    @staticmethod
    def shown(times: list[int], found: list[int]) -> list:
        """allowed and retry_after."""
        free = np.array(found, "int64")
        allowed = free == ALLOWED
        left = np.where(allowed, 0, free) - np.array(times, "int64")
        return [allowed, np.where(allowed, 0, np.maximum(1, left // 1_000_000 + 1))]


def ledger(pages: DataFrame, group: str, number: str, url: str, total: str, more: str) -> DataFrame:
    """One row per group from its pages' rows: pages, raw, distinct and duplicate rows, totals, and why it ended.

    pages: a row for each listed url; a page without any has one row with a null url.
    """
    known = F.col(url).isNotNull()
    first = pages.filter(known & F.col(group).isNotNull()).groupBy(group, url).agg(F.min(number).alias(number)).filter(F.col(number).isNotNull())
    # what a page lists and what it was the first to list meet in one sum, so nothing is sorted for a join
    listed = pages.select(group, number, known.cast("long").alias("raw"), F.col(total).alias("__total"), F.col(more).alias("__more"), F.lit(0).cast("long").alias("new"))
    fresh = first.select(group, number, F.lit(0).cast("long").alias("raw"), F.lit(1).cast("long").alias("new"))
    page = listed.unionByName(fresh, allowMissingColumns=True).groupBy(group, number).agg(F.sum("raw").alias("raw"), F.sum("new").alias("new"), F.max("__total").alias("__total"), F.max("__more").alias("__more"))
    whole = page.groupBy(group).agg(
        F.count(F.lit(1)).alias("pages"), F.sum("raw").alias("raw"), F.sum("new").alias("distinct_rows"), F.count_distinct("__total").alias("totals"),
        F.max_by("__total", number).alias("last_total"), F.max_by("__more", number).alias("last_more"), F.max_by("raw", number).alias("last_raw"),
        F.max(F.when((F.col("raw") > 0) & (F.col("new") == 0), True).otherwise(False)).alias("repeated"),
    )
    equal = F.col("last_total") == F.col("distinct_rows")
    reason = (
        F.when(F.col("repeated"), "not_advancing")
        .when(F.col("totals") > 1, "total_changed")
        .when((F.col("totals") == 1) & equal & F.col("last_more"), "pagination_conflict")
        .when(F.col("last_total").isNotNull() & ~equal, "total_mismatch")
        .when((F.col("last_raw") == 0) & F.col("last_more"), "empty_page_with_more")
        .when(~F.col("last_more"), "end_confirmed")
        .when((F.col("totals") == 1) & equal, "total_reconciled")
        .otherwise("end_unconfirmed")
    )
    return whole.select(group, "pages", "raw", "distinct_rows", (F.col("raw") - F.col("distinct_rows")).alias("duplicates"), reason.alias("reason"))


def checkpointed(stored: DataFrame, incoming: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """What an incoming page does to stored ones: new, replay (the same again) or mismatch (refused)."""
    s = stored.select(*keys, F.col(digest).alias("__stored"))
    both = incoming.join(s, keys, "left")
    return both.select(*keys, F.when(F.col("__stored").isNull(), "new").when(F.col("__stored") == F.col(digest), "replay").otherwise("mismatch").alias("effect"))


def publishable(groups: DataFrame, root: str, complete: str) -> DataFrame:
    """Roots all of whose groups are complete."""
    return groups.groupBy(root).agg(F.count(F.lit(1)).alias("groups"), F.bool_and(complete).alias("complete"))


def expired(df: DataFrame, at: str, now: Column, ttl: str, keep: Column | None = None) -> DataFrame:
    """Rows older than their time to live that nothing keeps."""
    out = df.filter(F.col(at) < now - F.expr(f"interval {ttl}"))
    return out if keep is None else out.filter(~keep)


def presence(df: DataFrame, key: str, at: str, kind: str, now: Column, seconds: int = 75) -> DataFrame:
    """Each key's last event and whether it's there: not after a stop, nor once the event is too old."""
    last = df.groupBy(key).agg(F.max_by(kind, F.col(at)).alias("last_kind"), F.max(at).alias("last_at"))
    age = F.floor((F.unix_millis(now.cast("timestamp")) - F.unix_millis(F.col("last_at").cast("timestamp"))) / 1000)
    return last.withColumn("age_seconds", age).withColumn("state", F.when((F.col("last_kind") == "stopped") | (age > seconds), "disconnected").otherwise("connected"))


def rollup(tasks: DataFrame, cycle: str, stage: Column, status: str = "status") -> DataFrame:
    """For each cycle, how many of its tasks are open in each stage, and how many failed."""
    open_ = F.col(status).isin("queued", "running")
    return tasks.withColumn("__stage", stage).groupBy(cycle).agg(*[F.count_if(open_ & (F.col("__stage") == s)).alias(f"{s}_open") for s in STAGES], F.count_if(F.col(status) == "failed").alias("failed"))


def phase() -> Column:
    """The phase of a cycle from counts of its tasks: the first stage with open ones, else how it ended."""
    out = F.when(F.col("failed") > 0, "completed_with_failures").otherwise("completed")
    for s in reversed(STAGES):
        out = F.when(F.col(f"{s}_open") > 0, s).otherwise(out)
    return out


def controlled(runs: DataFrame, commands: DataFrame, key: str = "run") -> DataFrame:
    """Every command with its effect (applied, replayed, key_conflict or refused) and the run's state behind it.

    runs: key and state. commands: key, at, command_id, action (pause, resume or cancel).
    Commands of a run count in order of at and command_id; one whose id came before does
    nothing if it asks for the same, and is refused else. A run that has ended takes no more
    commands: what counts is the first cancel of each run, which is added up before the shuffle,
    and the last command applied so far, for which a run's commands are read once, in order.
    """
    place = F.struct("at", "command_id", "action")
    by_id = W.partitionBy(key, "command_id").orderBy("at", "action")
    rows = commands.select(key, F.col("at").cast("timestamp").alias("at"), "command_id", "action").join(runs.select(key, F.col("state").alias("__state")), key)
    rows = rows.withColumns({"__nth": F.row_number().over(by_id), "__first": F.first("action").over(by_id)})
    ended = F.col("__state").isin("cancelled", "completed")
    cancel = rows.filter((F.col("__nth") == 1) & (F.col("action") == "cancel") & ~ended).groupBy(key).agg(F.min(place).alias("__cancel"))
    late = F.coalesce(place > F.col("__cancel"), F.lit(False))
    effect = F.when((F.col("__nth") > 1) & (F.col("__first") == F.col("action")), "replayed").when(F.col("__nth") > 1, "key_conflict").when(ended | late, "refused").otherwise("applied")
    rows = rows.join(cancel, key, "left").withColumn("effect", effect)
    next_ = F.when(F.col("effect") == "applied", F.when(F.col("action") == "pause", "paused").when(F.col("action") == "cancel", "cancelled").otherwise("ready"))
    so_far = W.partitionBy(key).orderBy("at", "command_id", "action", "__nth").rowsBetween(W.unboundedPreceding, 0)
    return rows.select(key, "at", "command_id", "action", "effect", F.coalesce(F.last(next_, True).over(so_far), "__state").alias("state"))


def run_limited(tasks: DataFrame, group: str, order: list[Column], most: int, seconds: str, budget: float) -> DataFrame:
    """The tasks of each group that one batch run works through: at most so many, and none that begins after its time is over."""
    w = W.partitionBy(group).orderBy(*order)
    before = F.coalesce(F.sum(seconds).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return tasks.withColumn("__n", F.row_number().over(w)).withColumn("begins_after", before).filter((F.col("__n") <= most) & (F.col("begins_after") < budget)).drop("__n")


def local_admission(memory: str, disk: str, resident: str, least_memory: int = 512 << 20, least_disk: int = 1024 << 20, most_resident: int = 1024 << 20) -> Column:
    """Why a worker with these figures in bytes takes no task; null if it may."""
    unknown = F.lit(False)
    for c in (memory, disk, resident):
        unknown = unknown | F.col(c).isNull() | (F.col(c) < 0)
    return F.when(unknown, "local_resource_measurement_unavailable").when((F.col(memory) < least_memory) | (F.col(resident) >= most_resident), "local_memory_limit").when(F.col(disk) < least_disk, "local_disk_limit")


def prefix_step(pages: DataFrame, requested: str, raw: str, invalid: str, ids: str, seen: str, ceiling: int = 10_000, step: int = 25) -> DataFrame:
    """pages with status, reason and the next quantity of a list that is read as an ever longer prefix.

    ids and seen: arrays, of this prefix and of the one before. Invalid rows and more rows
    than were asked for block it; a short prefix completes it; one that brings nothing new,
    and one at the ceiling, end it unfinished.
    """
    n = F.col(requested)
    known = (F.size(seen) > 0) & (F.size(F.array_except(ids, seen)) == 0)
    reason = (
        F.when(F.col(invalid) > 0, "catalog_invalid_candidates")
        .when(F.col(raw) > n, "catalog_quantity_ignored")
        .when(F.col(raw) < n, "official_load_more_end")
        .when(known, "catalog_not_advancing")
        .when(n >= ceiling, "catalog_safety_ceiling")
        .otherwise("prefix_expansion")
    )
    out = pages.withColumn("reason", reason)
    status = F.when(F.col("reason").isin("catalog_invalid_candidates", "catalog_quantity_ignored"), "blocked").when(F.col("reason") == "official_load_more_end", "completed").when(F.col("reason") == "prefix_expansion", "ready").otherwise("limited")
    return out.withColumn("status", status).withColumn("quantity", F.when(F.col("status") == "ready", F.least(F.lit(ceiling), n + step)).otherwise(n))


def admission(df: DataFrame, used: str, limit: str, reserved: str, growth: str, margin: float = 0.1) -> DataFrame:
    """Whether growth fits beside what is used and reserved, with a margin kept."""
    free = F.col(limit) * (1 - margin) - F.col(used) - F.coalesce(F.col(reserved), F.lit(0))
    return df.withColumn("free", free).withColumn("admission", F.when(F.col(limit).isNull(), "unconfigured").when(free < F.col(growth), "refused").otherwise("admitted"))


def not_advancing(df: DataFrame, key: str, step: str, digest: str) -> DataFrame:
    """Steps whose checkpoint is the same as the one before."""
    before = F.lag(digest).over(W.partitionBy(key).orderBy(step))
    return df.withColumn("stuck", F.coalesce(before == F.col(digest), F.lit(False)))


def frontier(start: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """node and depth of all that can be reached from start(node) over edges(node, to), each at its least depth.

    One round for each depth, each checkpointed; it ends when a round finds nothing new,
    or after `most` rounds if a caller asks for fewer.
    """
    seen = cut(start.select("node").distinct().withColumn("depth", F.lit(0)))
    edge, depth = seen, 0
    while most is None or depth < most:
        depth += 1
        step = edge.join(edges, "node").select(F.col("to").alias("node")).distinct()
        edge = cut(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if edge.isEmpty():
            break
        seen = seen.unionByName(edge)
    return seen


def identity_refused(incoming: DataFrame, aliases: DataFrame, key: str, slug: str, alias: str = "alias", old_slug: str = "old_slug") -> DataFrame:
    """incoming with refused: what takes the id or the slug that an alias holds may not be written."""
    ids = aliases.select(F.col(alias).alias("__id")).filter("__id is not null").distinct().withColumn("__a", F.lit(True))
    slugs = aliases.select(F.col(old_slug).alias("__slug")).filter("__slug is not null").distinct().withColumn("__b", F.lit(True))
    rows = incoming.join(ids, F.col(key) == F.col("__id"), "left").join(slugs, F.col(slug) == F.col("__slug"), "left")
    return rows.withColumn("refused", F.when(F.coalesce("__a", "__b"), "event_alias_identity_reserved")).drop("__id", "__slug", "__a", "__b")


def history_refused(deleted: DataFrame, checkpoints: DataFrame, tasks: DataFrame, now: Column, key: str = "id") -> DataFrame:
    """deleted with refused: a task stays while a checkpoint of it has an open task, or is unfinished and hasn't run out.

    checkpoints: root, active, status, expires; tasks: id, status.
    """
    open_ = tasks.filter(F.col("status").isin("queued", "running")).select(F.col("id").alias("active")).withColumn("__open", F.lit(True))
    live = F.col("__open") | (F.col("status").isin("collecting", "ready") & (F.col("expires") > now))
    held = checkpoints.join(open_, "active", "left").filter(F.coalesce(live, F.lit(False))).select(F.col("root").alias(key)).distinct().withColumn("__held", F.lit(True))
    return deleted.join(held, key, "left").withColumn("refused", F.when(F.col("__held"), "checkpoint_in_use")).drop("__held")


def campaign_guarded(tasks: DataFrame, campaigns: DataFrame) -> DataFrame:
    """tasks with refused and hold: a cancelled campaign takes no task, and one that is to pause holds the queued ones.

    tasks: id, source, sync, run, status, held; campaigns: campaign, source, sync, run (either
    may be null), status, pausing. Of several campaigns of a task the least counts.
    """
    c = campaigns.select(F.struct("campaign", F.col("status").alias("state"), "pausing").alias("__c"), F.col("source").alias("__source"), F.col("sync").alias("__sync"), F.col("run").alias("__run"))
    by_sync = tasks.join(c, (F.col("source") == F.col("__source")) & (F.col("sync") == F.col("__sync")))
    by_run = tasks.join(c, F.col("run") == F.col("__run"))
    first = by_sync.select("id", "__c").union(by_run.select("id", "__c")).groupBy("id").agg(F.min("__c").alias("__c"))
    rows = tasks.join(first, "id", "left")
    refused = F.when(F.col("__c.state") == "cancelled", "campaign_cancelled")
    hold = F.coalesce(refused.isNull() & F.col("__c.pausing") & (F.col("status") == "queued") & ~F.col("held"), F.lit(False))
    return rows.withColumn("refused", refused).withColumn("hold", F.when(hold, "catalog_campaign_paused")).drop("__c")


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """How many rows break each rule: what triggers would refuse, asked before a write."""
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("rule"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def guarded(df: DataFrame, checks: dict[str, DataFrame]) -> DataFrame:
    """df, or an error that names the first rule that rows break: what a trigger does before a write."""
    for name, rows in checks.items():
        if not rows.isEmpty():
            raise ValueError(f"refused by {name}")
    return df
