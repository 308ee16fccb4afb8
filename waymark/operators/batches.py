"""Runs over many records as queries: what a run takes on, what became of each record, and how the run ended."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_key
from ..functions.urls import is_safe, part
from .relational import by_any_key, page
from .resolve import record_diff

#: States that a job's record is not resumed from, and answers that close a gate.
SETTLED = ("completed", "skipped")
REDIRECTS, BODY_BYTES = 3, 10 << 20


def import_slice(found: DataFrame, order: list[Column], offset: int, quantity: int, home: str = "BR", states: Iterable[str] | None = None) -> DataFrame:
    """The found records that a run takes on: those that may be of the home country (and of the states, if it knows its state), from an offset."""
    own = F.coalesce(F.upper("country") == home, F.lit(True))
    if states is not None:
        own = own & F.coalesce(F.col("state").isin(*states), F.lit(True))
    return found.filter(own).orderBy(*order).offset(max(0, offset)).limit(max(0, quantity))


def run_summary(outcomes: DataFrame, run: str, taken: str = "taken") -> DataFrame:
    """One row for each run: counts by outcome, how it ended, and where the next one begins.

    outcomes: run, offset, taken (false for those that the run's time didn't reach), result
    (published, unchanged, manual_review or failed).
    """
    is_ = lambda r: F.count_if(F.col(taken) & (F.col("result") == r))
    rows = outcomes.groupBy(run).agg(F.max("offset").alias("__offset"), F.count(F.lit(1)).alias("discovered"), F.count_if(taken).alias("processed"), *[is_(r).alias(r) for r in ("published", "unchanged", "manual_review", "failed")])
    status = F.when(F.col("processed") < F.col("discovered"), "time_limit_reached").when(F.col("failed") > 0, "partial_success").otherwise("success")
    return rows.withColumn("status", status).withColumn("next_offset", F.col("__offset") + F.col("processed")).drop("__offset")


#: Candidates that one step of a run works on.
STEP = 25


def import_step(candidates: DataFrame, checks: DataFrame, limit: int = STEP) -> DataFrame:
    """The candidates of import runs after one step of each: the first `limit` pending ones by age, with status, action, match and error; and whether they were taken.

    candidates: run, id, created, status. checks: id, status (success, manual_review,
    provider_failed or validation_failed), reasons, event (what it was saved as), prior (what its reference stood for
    before) and own (whether that record is of the candidate's source). One without a
    check failed by itself; one whose source is blocked stays pending.
    """
    first = W.partitionBy("run").orderBy("created", "id")
    pending = candidates.filter("status = 'pending'").withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= max(1, min(limit, STEP))).select("id")
    c = checks.select("id", F.struct("status", F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"), "event", "prior", "own").alias("c"))
    rows = candidates.join(pending.withColumn("taken", F.lit(True)), "id", "left").join(c, "id", "left")
    taken, why = F.coalesce("taken", F.lit(False)), F.col("c.reasons")
    blocked = F.coalesce(F.array_contains(why, "source_access_blocked"), F.lit(False))
    failed = F.col("c.status").isNull() | F.col("c.status").isin("provider_failed", "validation_failed")
    status = F.when(~taken | blocked, F.col("status")).when(failed, "failed").otherwise("processed")
    action = (
        F.when(~taken | blocked, None)
        .when(failed, "review")
        .when(F.array_contains(why, "unchanged_content"), "skip")
        .when(F.col("c.event").isNull(), "review")
        .when(F.col("c.prior").isNotNull(), "update")
        .when(F.coalesce(F.col("c.own"), F.lit(False)), "create")
        .otherwise("link")
    )
    error = F.when(taken & ~blocked & failed, F.when(F.col("c").isNull(), "source_processing_failed").otherwise(F.coalesce(F.nullif(F.array_join(why, ", "), F.lit("")), "c.status")))
    match = F.when(taken & ~blocked & ~failed, F.coalesce("c.event", "c.prior"))
    return rows.select("run", "id", status.alias("status"), action.alias("action"), match.alias("match"), error.alias("error"), (taken & ~blocked).alias("taken"), (F.col("c.status") == "success").alias("succeeded"), (F.col("c.status") == "manual_review").alias("reviewed"))


def import_runs(stepped: DataFrame) -> DataFrame:
    """Each run behind a step: what is done, failed and left, what this step published, sent to review and left unchanged, and the run's status."""
    own = F.col("taken")
    sums = stepped.groupBy("run").agg(
        F.count_if(F.col("status") == "pending").alias("remaining"), F.count_if(F.col("status").isin("processed", "failed")).alias("processed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(own & F.col("succeeded") & F.col("match").isNotNull()).alias("published"), F.count_if(own & F.col("reviewed")).alias("manual_review"), F.count_if(own & (F.col("action") == "skip")).alias("unchanged"),
    )
    return sums.withColumn("status", F.when(F.col("remaining") > 0, "ready").when(F.col("failed") > 0, "partial_success").otherwise("success"))


def with_cache(rows: DataFrame, cache: DataFrame, keys: list[str], answer: str, at: str) -> DataFrame:
    """rows with cached (the newest successful answer of an equal key, dry runs left out) and needs_model."""
    good = cache.filter((F.col("status") == "success") & ~F.col("dry_run"))
    last = good.groupBy(*keys).agg(F.max_by(answer, F.struct(at, answer)).alias("cached"))
    return rows.join(last, keys, "left").withColumn("needs_model", F.col("cached").isNull())


def extracted(rows: DataFrame, cache: DataFrame, keys: list[str], answers: DataFrame, key: str, fields: list[str], required: bool = False) -> DataFrame:
    """Each record's extraction by a model, with what was answered before, and without it what its source says: job, the fields, warnings, held and changes.

    rows: key, the cache's keys, own (a struct of the fields that the source's own rules found) and
    current (one of the stored record, or null). cache: see with_cache. answers: key and
    answer of the records that a model was asked about; null if it failed. job: skipped_cached,
    success, validation_failed (no JSON object) or provider_failed. Empty fields of an answer
    are filled from the source, and all are without a valid one, which holds the record back if a
    model is required. changes: field, from and to against the stored record.
    """
    both = with_cache(rows, cache, keys, "answer", "ts").join(answers.select(key, F.col("answer").alias("__told")), key, "left")
    told = F.coalesce("cached", "__told")
    valid = F.coalesce(F.get_json_object(told, "$").startswith("{"), F.lit(False))
    job = F.when(F.col("cached").isNotNull() & valid, "skipped_cached").when(valid, "success").when(told.isNotNull(), "validation_failed").otherwise("provider_failed")
    value = lambda f: F.coalesce(F.when(valid, F.nullif(F.trim(F.get_json_object(told, f"$.{f}")), F.lit(""))), F.col(f"own.{f}"))
    out = both.withColumns({"__job": job, "__new": F.struct(*[value(f).alias(f) for f in fields])})
    failed = ~F.col("__job").isin("skipped_cached", "success")
    warnings = F.when(failed, F.array(F.lit("ai_curation_failed"))).otherwise(F.array().cast("array<string>"))
    return out.select(key, F.col("__job").alias("job"), *[F.col(f"__new.{f}").alias(f) for f in fields], warnings.alias("warnings"), (failed & F.lit(required)).alias("held"), record_diff("current", "__new", fields).alias("changes"))


def up_to_date(rows: DataFrame, records: DataFrame, keys: list[Column], record_keys: list[Column], row_id: str, record_id: str, version: str) -> DataFrame:
    """row_id of those rows whose record, found by any key, was curated by this version already."""
    done = records.filter(F.col("curated_at").isNotNull() & (F.col("curation_version") == version) & (F.coalesce(F.col("curation_status"), F.lit("not_curated")) != "not_curated"))
    return by_any_key(rows, done, keys, record_keys, row_id, record_id).select(row_id).distinct()


def discovered(pages: DataFrame, url: str, day: str, name: str, low: str | None = None, high: str | None = None) -> DataFrame:
    """The events of all pages (page, position, url, day, name): the last listing of each address, in a range of days that those without one pass, with their place by day and name."""
    own = pages
    own = own if low is None else own.filter(F.col(day).isNull() | (F.col(day) >= low))
    own = own if high is None else own.filter(F.col(day).isNull() | (F.col(day) <= high))
    last = own.groupBy(url).agg(F.max_by(F.struct(day, name), F.struct("page", "position")).alias("e")).select(url, "e.*")
    return last.withColumn("undated", F.col(day).isNull()).withColumn("sort_name", normalize_key(name))


def discovery_ends(pages: DataFrame, catalogue: str, page: str, url: str, total: str, more: str, most: int = 500) -> DataFrame:
    """For each catalogue read page by page: how many pages count, how many addresses were seen, the last total that it named, and warnings on how it ended.

    pages: a row for each listed address, or one with a null address for a page without any, with
    what the page says of a total and of more pages (either may be null). Reading ends at the
    first page that brings nothing new, that is empty or says that there is no more, that reaches the
    one total named so far, or that is the last one allowed. A catalogue has `most` pages
    that count at most, so its pages are one short window; its addresses are counted before.
    """
    own = pages.filter(F.col(page) <= most)
    first = own.filter(F.col(url).isNotNull()).groupBy(catalogue, url).agg(F.min(page).alias(page)).groupBy(catalogue, page).agg(F.count(F.lit(1)).alias("new"))
    named = own.filter(F.col(total).isNotNull()).groupBy(catalogue, total).agg(F.min(page).alias(page)).groupBy(catalogue, page).agg(F.count(F.lit(1)).alias("__totals"))
    each = own.groupBy(catalogue, page).agg(F.count(url).alias("listed"), F.max(total).alias("__total"), F.max(more).alias("__more"))
    rows = each.join(first, [catalogue, page], "left").join(named, [catalogue, page], "left").fillna({"new": 0, "__totals": 0})
    so_far = W.partitionBy(catalogue).orderBy(page).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select("*", F.sum("new").over(so_far).alias("observed"), F.sum("__totals").over(so_far).alias("totals"), F.last("__total", True).over(so_far).alias("advertised"))
    ended = (F.col("listed") == 0) | (F.col("__more") == F.lit(False))
    stop = (
        F.when((F.col("listed") > 0) & (F.col("new") == 0), "not_advancing")
        .when(F.coalesce(ended, F.lit(False)), "end")
        .when((F.col("totals") == 1) & (F.col("advertised") == F.col("observed")), "total")
        .when(F.col(page) == most, "limit")
    )
    at = rows.withColumn("stop", stop).groupBy(catalogue).agg(F.min(F.when(F.col("stop").isNotNull(), F.col(page))).alias("__at"), F.max(page).alias("__last"))
    last = rows.withColumn("stop", stop).join(at, catalogue).filter(F.col(page) == F.coalesce("__at", "__last"))
    off = F.coalesce(F.col("advertised") != F.col("observed"), F.lit(False))
    how = F.when(F.col("totals") > 1, "catalog_total_changed").when(off, "catalog_total_mismatch").when(F.col("advertised").isNull() & F.coalesce("__more", F.lit(True)), "catalog_end_unconfirmed")
    warnings = F.array_compact(F.array(
        F.when(F.col("stop") == "not_advancing", "catalog_pagination_not_advancing"), F.when(F.col("stop") == "end", how), F.when((F.col("stop") == "end") & F.col("__more"), "catalog_empty_page_with_more"),
        F.when((F.col("stop") == "total") & F.col("__more"), "catalog_pagination_conflict"), F.when(F.col("stop") == "limit", "catalog_page_limit"),
    ))
    return last.select(catalogue, F.col(page).alias("pages"), "observed", "advertised", warnings.alias("warnings"))


def enriched(records: DataFrame, fetched: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """records with what was fetched for them in their gaps, their external id from the address if they had none, and whether anything came."""
    new = fetched.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    rows = records.join(new, key, "left")
    filled = [F.coalesce(F.nullif(F.col(f), F.lit("")), F.nullif(F.col(f"__{f}"), F.lit(""))).alias(f) for f in fields]
    anything = F.lit(False)
    for f in fields:
        anything = anything | (F.coalesce(F.nullif(F.col(f), F.lit("")), F.lit("")) == "") & F.coalesce(F.col(f"__{f}") != "", F.lit(False))
    number = F.coalesce(F.try_parse_url("url", F.lit("QUERY"), F.lit("id")), F.nullif(F.regexp_extract(part("url", "PATH"), r"/(\d+)/?$", 1), F.lit("")))
    return rows.select(key, "url", F.coalesce("external_id", number).alias("external_id"), *filled, anything.alias("enriched"))


def scraped(pages: DataFrame, group: str, page: str, digest: str) -> DataFrame:
    """For each group of result pages: how many pages and rows count, and how it ended.

    pages: group, page, digest (of its rows), rows, more, error. Pages count up to the first
    error or the first one that occurred before in the group (a cycle); a group that fails
    keeps what came before, and leaves the others alone.
    """
    w = W.partitionBy(group).orderBy(page)
    again = F.row_number().over(W.partitionBy(group, digest).orderBy(page)) > 1
    bad = F.when(F.col("error").isNotNull(), F.col("error")).when(again & (F.col("rows") > 0), "pagination_cycle")
    marked = pages.withColumn("__bad", bad).withColumn("__over", F.max(F.when(F.col("__bad").isNotNull(), 1).otherwise(0)).over(w))
    good = F.col("__over") == 0
    out = marked.groupBy(group).agg(F.count_if(good).alias("pages"), F.coalesce(F.sum(F.when(good, F.col("rows"))), F.lit(0)).alias("rows"), F.min_by("__bad", F.when(F.col("__bad").isNotNull(), F.col(page))).alias("__why"), F.max_by("more", page).alias("__more"))
    return out.select(group, "pages", "rows", F.when(F.col("__why").isNotNull(), F.when(F.col("pages") > 0, "partial").otherwise("failed")).when(F.col("__more"), "partial").otherwise("completed").alias("status"), F.coalesce("__why", F.when(F.col("__more"), F.lit("end_not_reached"))).alias("reason"))


def startable(jobs: DataFrame, owner: str, created: str, key: str, capacity: int) -> DataFrame:
    """The queued jobs of each owner that may start beside those that run, the oldest first."""
    running = jobs.filter("status = 'running'").groupBy(owner).agg(F.count(F.lit(1)).alias("__running"))
    n = F.row_number().over(W.partitionBy(owner).orderBy(created, key))
    queued = jobs.filter("status = 'queued'").withColumn("__n", n).join(running, owner, "left")
    return queued.filter(F.col("__n") <= capacity - F.coalesce("__running", F.lit(0))).drop("__n", "__running")


def resumable(rows: DataFrame, status: str) -> DataFrame:
    """The records of a job that a resumed run takes up again: all that aren't settled."""
    return rows.filter(~F.coalesce(F.col(status).isin(*SETTLED), F.lit(False)))


def scope_error() -> Column:
    """What is wrong with a run's scope; null if nothing is.

    Columns: mode (all, selected or single), date_from, date_to, event_ids, event_urls
    (arrays), url, confirm_all.
    """
    urls = F.size(F.coalesce("event_urls", F.array().cast("array<string>"))) + F.when(F.coalesce("url", F.lit("")) != "", 1).otherwise(0)
    ids = F.size(F.filter(F.coalesce("event_ids", F.array().cast("array<string>")), lambda x: F.trim(x) != ""))
    return (
        F.when(~F.coalesce(F.col("mode").isin("all", "selected", "single"), F.lit(False)), "unknown_mode")
        .when(F.coalesce(F.col("date_to") < F.col("date_from"), F.lit(False)), "dates_reversed")
        .when((F.col("mode") == "selected") & (ids + urls == 0), "nothing_selected")
        .when((F.col("mode") == "single") & (urls != 1), "exactly_one_url")
        .when((F.col("mode") == "all") & (ids + urls > 0), "all_takes_no_selection")
        .when((F.col("mode") == "all") & ~F.coalesce("confirm_all", F.lit(False)), "all_needs_confirmation")
    )


def normalized_scope(scope: dict, first_day: date) -> dict:
    """A scope in one form, for a driver program: all begins at a first day, ids are trimmed, one address joins the list; an invalid one is refused."""
    out = {"mode": "all", "date_from": None, "date_to": None, "event_ids": [], "event_urls": []} | {k: v for k, v in scope.items() if k != "url"}
    out["event_ids"] = [str(x).strip() for x in out["event_ids"] if str(x).strip()]
    out["event_urls"] = [*out["event_urls"], *([scope["url"]] if scope.get("url") else [])]
    if out["mode"] == "all":
        out["date_from"] = out["date_from"] or first_day
    if out["mode"] == "selected" and not (out["event_ids"] or out["event_urls"]):
        raise ValueError("nothing_selected")
    if out["mode"] == "single" and len(out["event_urls"]) != 1:
        raise ValueError("exactly_one_url")
    return out


def checkpoint_start(wanted: DataFrame, stored: DataFrame, root: str, now: Column, version: str) -> DataFrame:
    """What happens when a task begins with a checkpoint: the first thing that is wrong, restored, or started.

    wanted: root, record, source_url, parser, manifest (text), groups (array), task;
    stored: root, record, source_url, parser, manifest_hash, active_task, expires, status.
    """
    s = stored.select(F.col(root).alias("__root"), *[F.col(c).alias(f"s_{c}") for c in stored.columns if c != root])
    rows = wanted.join(s, F.col(root) == F.col("__root"), "left")
    there = F.col("__root").isNotNull()
    same = F.col("s_record").eqNullSafe(F.col("record")) & (F.regexp_replace("s_source_url", "/$", "") == F.regexp_replace("source_url", "/$", "")) & (F.col("s_parser") == version) & (F.col("s_manifest_hash") == F.sha2("manifest", 256))
    outcome = (
        F.when((F.size("groups") == 0) | (F.size(F.array_distinct("groups")) < F.size("groups")), "result_groups_invalid")
        .when(there & ~same, "result_checkpoint_incompatible")
        .when(there & (F.col("s_active_task") != F.col("task")), "result_checkpoint_in_use")
        .when(there & ((F.col("s_expires") <= now) | (F.col("s_status") == "expired")), "result_checkpoint_expired")
        .when(there & ~F.col("s_status").isin("collecting", "ready"), "result_checkpoint_unavailable")
        .when(there, "restored")
        .otherwise("started")
    )
    return rows.select(root, outcome.alias("outcome"))


def touched_counts(tasks: DataFrame, references: DataFrame, records: DataFrame, source: str, task_keys: list[Column], reference_keys: list[Column], task_id: str, reference_id: str, record: str, home: str = "BR") -> DataFrame:
    """For each source: of the records that its tasks touch by any key, how many are published, have several sources, or wait for review."""
    hits = by_any_key(tasks, references, task_keys, reference_keys, task_id, reference_id)
    pairs = hits.join(tasks.select(task_id, F.col(source).alias("__source")), task_id).join(references.select(reference_id, record), reference_id).select("__source", record).distinct()
    several = references.groupBy(record).agg((F.count_distinct(source) > 1).alias("__several"))
    rows = pairs.join(records, record).join(several, record)
    return rows.groupBy(F.col("__source").alias(source)).agg(F.count_if((F.col("publication") == "published") & (F.col("country") == home)).alias("published"), F.count_if("__several").alias("associated"), F.count_if(F.col("publication") == "pending_review").alias("pending_review"))


def publication_changes(records: DataFrame, wishes: DataFrame, key: str, error: Column) -> DataFrame:
    """key, publication, refused and changed after wishes (key, wanted): nothing is published that breaks a rule, and an equal state is no change."""
    rows = records.join(wishes, key)
    refused = F.when(F.col("wanted") == "published", error)
    new = F.when(refused.isNull(), F.col("wanted")).otherwise(F.col("publication"))
    return rows.select(key, F.col("publication").alias("before"), new.alias("publication"), refused.alias("refused"), (new != F.col("publication")).alias("changed"))


#: Bounds of what a campaign may ask for, and states in which it has ended.
REASON, KEY, BATCHES, PREFIXES = (3, 500), 100, (1, 25), (25, 10_000)
CAMPAIGN_ENDED = ("completed", "completed_with_failures", "cancelled")


def campaign_starts(requests: DataFrame, campaigns: DataFrame, order: str, states: Iterable[str]) -> DataFrame:
    """Each wish to start a campaign with its outcome: order, id, request_hash and outcome.

    requests: actor, key, reason, states (an array), batch, prefix, and their order. campaigns: id, request_hash,
    status. A wish out of bounds is campaign_request_invalid. An actor's key that is known already brings
    the same campaign back (replayed), or an idempotency_conflict if it asks for something else. While any
    campaign runs, others are refused (campaign_active), so of several new ones the first is started.
    """
    size, reason = F.size("states"), F.trim(F.coalesce("reason", F.lit("")))
    fits = (
        (F.coalesce("actor", F.lit("")) != "")
        & F.length(F.coalesce("key", F.lit(""))).between(1, KEY)
        & (F.length(reason) >= REASON[0])
        & (F.length("reason") <= REASON[1])
        & size.between(1, 27)
        & (F.size(F.array_distinct("states")) == size)
        & (F.size(F.array_except("states", F.array(*[F.lit(x) for x in states]))) == 0)
        & F.col("batch").between(*BATCHES)
        & F.col("prefix").between(*PREFIXES)
    )
    digest = F.sha2(F.concat_ws("|", reason, F.array_join(F.array_sort("states"), ","), F.col("batch").cast("string"), F.col("prefix").cast("string")), 256)
    name = F.concat(F.lit("campaign_"), F.substring(F.sha2(F.concat_ws("|", "actor", "key"), 256), 1, 32))
    asked = requests.select(F.col(order), F.coalesce(fits, F.lit(False)).alias("fits"), name.alias("id"), digest.alias("request_hash"))
    known = campaigns.select("id", F.col("request_hash").alias("__known"))
    rows = asked.join(known, "id", "left")
    running = campaigns.agg(F.count_if(~F.col("status").isin(*CAMPAIGN_ENDED)).alias("__running"))
    first = rows.filter(F.col("fits") & F.col("__known").isNull()).agg(F.min(F.struct(order, "id", "request_hash")).alias("__new"))
    rows = rows.crossJoin(running.crossJoin(first))  # one row
    begun = F.when(F.col("__running") == 0, F.col("__new"))
    behind = (F.col("id") == begun["id"]) & (F.col(order) > begun[order])
    before = F.coalesce("__known", F.when(behind, begun["request_hash"]))
    outcome = (
        F.when(~F.col("fits"), "campaign_request_invalid")
        .when(before == F.col("request_hash"), "replayed")
        .when(before.isNotNull(), "idempotency_conflict")
        .when(F.col(order) == begun[order], "started")
        .otherwise("campaign_active")
    )
    return rows.select(order, "id", "request_hash", outcome.alias("outcome"))


def campaign_page(campaigns: DataFrame, number: int = 1, size: int = 10) -> DataFrame:
    """A page of campaigns, the newest first, with the total and whether each still runs."""
    total = campaigns.agg(F.count(F.lit(1)).alias("total"))
    rows = page(campaigns, [F.desc("created"), F.desc("id")], number, size)
    return rows.withColumn("active", ~F.col("status").isin(*CAMPAIGN_ENDED)).crossJoin(total)


def retries(tasks: DataFrame, wishes: DataFrame, actor: str) -> DataFrame:
    """The new tasks that wishes (id, key) make of failed ones without a successor: retry_of, kind, payload and a scoped key, so that the same wish makes one task."""
    failed = tasks.filter(F.col("status").isin("failed", "cancelled")).join(tasks.select(F.col("retry_of").alias("id")).filter("id is not null"), "id", "left_anti")
    scoped = F.sha2(F.to_json(F.array(F.lit("retry"), F.lit(actor), F.col("id").cast("string"), F.col("key"))), 256)
    return failed.join(wishes.select("id", "key").distinct(), "id").select(F.col("id").alias("retry_of"), "kind", "payload", scoped.alias("scoped_key"))


def fetch_error(hops: Column, length: Column, hosts: tuple[str, ...] = ()) -> Column:
    """Why a recorded fetch isn't accepted: an address on its way that isn't safe, too many redirects, or too long a body; null if it is."""
    unsafe = F.exists(hops, lambda u: ~is_safe(u, hosts))
    return F.when((F.size(hops) == 0) | unsafe, "unsafe_url").when(F.size(hops) > REDIRECTS + 1, "too_many_redirects").when(length > BODY_BYTES, "body_too_large")
