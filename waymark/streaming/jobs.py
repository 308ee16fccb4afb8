"""Streams over task and request events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def deduplicated_requests(stream: DataFrame, at: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first of each key; what comes later than the watermark allows is dropped with its state."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def hourly_counts(stream: DataFrame, at: str, key: str, limit: int, late: str = "10 minutes") -> DataFrame:
    """Requests of each key and hour, and whether they stay in the budget."""
    counts = stream.withWatermark(at, late).groupBy(F.window(at, "1 hour").alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(key, F.col("w.start").alias("hour"), "n", (F.col("n") > limit).alias("over_budget"))


def sessions(stream: DataFrame, at: str, key: str, gap: str = "75 seconds", late: str = "10 minutes") -> DataFrame:
    """Spans in which a key was present: events no further apart than the gap."""
    found = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("events"))
    return found.select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "events")


def sliding_limiter(stream: DataFrame, key: str, at: str, order: str, limit: int, seconds: float, late: str = "1 hour", ttl_ms: int = 3_600_000) -> DataFrame:
    """Decisions under at most `limit` allowed requests in any `seconds`; the state is the allowed times, and ends when the watermark passes the key's last request by ttl_ms."""
    kinds = dict(stream.dtypes)
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, allowed boolean"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["__s", order], kind="stable")
        allowed = []
        for s in rows["__s"]:
            held = [h for h in held if h > s - seconds]
            allowed.append(len(held) < limit)
            if allowed[-1]:
                held.append(float(s))
        state.update((held,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(rows["__s"].iloc[-1] * 1000)) + ttl_ms)
        yield pd.DataFrame({key: [k[0]] * len(rows), order: rows[order].to_numpy(), "allowed": allowed})

    rows = stream.withWatermark(at, late).select(key, order, at, (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("__s"))
    return rows.groupBy(key).applyInPandasWithState(run, schema, "held array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def with_timers(spark: SparkSession) -> None:
    """Streams with timers keep their state in RocksDB; sets the session to it unless it names a provider."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBacked" in (spark.conf.get(key, None) or "HDFSBacked"):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _plain(rows: pd.DataFrame) -> pd.DataFrame:
    """Texts as Python's own; texts that Arrow holds in chunks can't be given back by a stateful operator."""
    return rows.astype({c: object for c in rows if pd.api.types.is_string_dtype(rows[c])})


class _Timed(StatefulProcessor):
    """A key's value until a time, at which a timer fires whether or not the key has another event.

    One timer stands for a value, and moves with its time. Times are seconds; timers are
    set to the millisecond behind.
    """

    value_schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", f"{self.value_schema}, until double")

    def held(self) -> tuple | None:
        return tuple(self.value.get()) if self.value.exists() else None

    def hold(self, *value) -> None:
        self.drop()
        self.value.update(value)
        self.handle.registerTimer(int(value[-1] * 1000) + 1)

    def drop(self) -> None:
        if (old := self.held()) is not None:
            self.handle.deleteTimer(int(old[-1] * 1000) + 1)
            self.value.clear()

    def close(self) -> None:
        pass


class _Leases(_Timed):
    value_schema = "token string"

    def __init__(self, seconds: float, columns: list[str]):
        self.seconds, self.columns = seconds, columns

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [self.columns[0], "at", "__s", "__order", "__kind", "__token"]  # computed columns come without theirs
        events = pd.concat([b.set_axis(names, axis=1) for b in rows]).sort_values(["__s", "__order"], kind="stable")
        out = []
        for s, order, kind, token in zip(events["__s"], events["__order"], events["__kind"], events["__token"], strict=True):
            lease = self.held()
            if lease and lease[1] < s:  # it ran out before this event; the timer hasn't fired yet
                out.append((None, lease[0], "expired", lease[1]))
                self.drop()
                lease = None
            mine = lease is not None and lease[0] == token
            effect = "refused" if (lease is not None if kind == "claim" else not mine) else {"claim": "granted", "heartbeat": "renewed"}.get(kind, "released")
            if effect in ("granted", "renewed"):
                self.hold(token, s + self.seconds)
            elif effect == "released":
                self.drop()
            out.append((order, token, effect, s))
        yield self.frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        token, until = self.held()
        self.value.clear()
        yield self.frame(key, [(None, token, "expired", until)])

    def frame(self, key, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=self.columns[1:4] + ["__s"])
        out[self.columns[1]] = out[self.columns[1]].astype("Int64")
        out["at"] = pd.to_datetime((out.pop("__s") * 1_000_000).round().astype("int64"), unit="us")
        out.insert(0, self.columns[0], [key[0]] * len(out))
        return _plain(out)


def leases(stream: DataFrame, key: str, at: str, order: str, kind: str, token: str, seconds: float = 90, late: str = "10 seconds") -> DataFrame:
    """What becomes of each claim, heartbeat and other report (an end) on a key: order, token, effect and at; and a row when a lease runs out.

    A claim is granted if no lease runs, others count only from its holder: granted, renewed,
    released or refused. A lease runs so many seconds behind the last grant or renewal, and is
    expired at its end, when the watermark passes it: no further event of the key is needed. order: whole
    numbers, null for an expiry; events of a batch are taken in order of at and order.
    """
    with_timers(stream.sparkSession)
    kinds = dict(stream.dtypes)
    rows = stream.withWatermark(at, late).select(key, at, (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("__s"), F.col(order).cast("long").alias("__order"), F.col(kind).alias("__kind"), F.col(token).cast("string").alias("__token"))
    schema = f"{key} {kinds[key]}, {order} long, {token} string, effect string, at timestamp"
    return rows.groupBy(key).transformWithStateInPandas(_Leases(seconds, [key, order, token, "effect"]), schema, "Append", "EventTime")


class _Presence(_Timed):
    value_schema = "begin double, events long"

    def __init__(self, gap: float, key: str):
        self.gap, self.key = gap, key

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for s in sorted(s for batch in rows for s in batch.iloc[:, 2]):
            begin, events, until = self.held() or (s, 0, s)
            if until < s:
                out.append((begin, until, events))
                begin, events = s, 0
            self.hold(begin, events + 1, max(until, s + self.gap))
        if out:
            yield self.frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        begin, events, until = self.held()
        self.value.clear()
        yield self.frame(key, [(begin, until, events)])

    def frame(self, key, rows: list[tuple]) -> pd.DataFrame:
        at = lambda k: pd.to_datetime([round(r[k] * 1_000_000) for r in rows], unit="us")
        return _plain(pd.DataFrame({self.key: [key[0]] * len(rows), "begin": at(0), "end": at(1), "events": [r[2] for r in rows]}))


def presence(stream: DataFrame, key: str, at: str, gap: float = 75, late: str = "10 seconds") -> DataFrame:
    """A row when a key has left: from its first event to `gap` seconds behind its last one, and the events between. Told by a timer, without a further event."""
    with_timers(stream.sparkSession)
    rows = stream.withWatermark(at, late).select(key, at, (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("__s"))
    schema = f"{key} {dict(stream.dtypes)[key]}, begin timestamp, end timestamp, events long"
    return rows.groupBy(key).transformWithStateInPandas(_Presence(gap, key), schema, "Append", "EventTime")


def page_ledger(stream: DataFrame, group: str, url: str, buckets: int = 64) -> DataFrame:
    """raw, distinct and duplicate rows of each group and bucket of its urls, as they stand: a group's are the sums over its buckets.

    The state of a bucket is the hashes of the urls seen in it, so that a group with very
    many urls is spread over states that are small to rewrite, and over tasks.
    """
    kind = dict(stream.dtypes)[group]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        raw, seen = (state.get[0], set(state.get[1])) if state.exists else (0, set())
        for rows in batches:
            raw += len(rows)
            seen.update(rows["__hash"].dropna().astype("int64").tolist())
        state.update((raw, sorted(seen)))
        yield pd.DataFrame({group: [k[0]], "bucket": [k[1]], "raw": [raw], "distinct_rows": [len(seen)], "duplicates": [raw - len(seen)]})

    rows = stream.select(group, F.when(F.col(url).isNotNull(), F.xxhash64(url)).alias("__hash"))
    rows = rows.withColumn("bucket", F.pmod(F.coalesce("__hash", F.lit(0)), F.lit(buckets)).cast("int"))
    schema = f"{group} {kind}, bucket int, raw long, distinct_rows long, duplicates long"
    return rows.groupBy(group, "bucket").applyInPandasWithState(run, schema, "raw long, seen array<long>", "update", GroupStateTimeout.NoTimeout)


def exactly_once(path: str, keys: list[str], buckets: int = 16):
    """A foreachBatch writer that skips pages whose keys are stored, so a replayed batch adds nothing.

    A batch goes to a folder of its own, which a replay overwrites, so a batch that failed
    half way leaves nothing behind. Rows lie by a hash of their keys, and a batch reads only
    the keys of the buckets that it touches.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        new = batch.dropDuplicates(keys).withColumn("__bucket", bucket)
        files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
            touched = [r[0] for r in new.select("__bucket").distinct().collect()]  # `buckets` at most
            stored = spark.read.schema(f"{', '.join(f'`{k}` {dict(batch.dtypes)[k]}' for k in keys)}, __batch long, __bucket int").parquet(path)
            own = stored.filter(F.col("__bucket").isin(touched) & (F.col("__batch") != batch_id)).select(*keys)
            new = new.join(own, keys, "left_anti")
        new.withColumn("__batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__batch", "__bucket").parquet(path)

    return write


def run_available(frame: DataFrame, sink: str, checkpoint: str, mode: str = "append", name: str | None = None, for_each=None):
    """Runs a stream over all there is, then ends: a batch run with limits set by the source's options."""
    out = frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    out = out.foreachBatch(for_each) if for_each else out.format(sink)
    query = (out.queryName(name) if name else out).start()
    query.awaitTermination()
    return query
