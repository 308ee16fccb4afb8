"""Deciding which records are one, merging them, and judging what is fit to publish."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import normalize_date
from ..functions.text import clean, fingerprint, name_words, once, slugify, strip_accents
from ..functions.urls import absolute, comparable
from .extract import country_in_location, country_of, looks_like_venue, normalized_warnings
from .lineage import dropped, stored
from .ranges import placed
from .relational import latest
from .similar import best_similar

#: Source priority in a merge; kept confidence; reasons that block publication by warning.
PRIORITY = {"official": 100, "tickets": 80, "results": 50, "calendar": 10}
MIN_CONFIDENCE, SIMILAR = 0.85, 0.8
CRITICAL = (
    "missing_name", "missing_date", "conflicting_date", "conflicting_location", "date_evidence_mismatch",
    "location_evidence_mismatch", "edition_observation_unconfirmed", "conflicting_country",
    "country_evidence_mismatch", "suspicious_city",
)
#: Warnings that are made anew from what was observed.
OWN_WARNINGS = (
    "missing_name", "missing_date", "missing_city", "missing_state", "conflicting_date", "conflicting_location",
    "date_evidence_mismatch", "location_evidence_mismatch", "modality_unconfirmed", "multiple_modalities",
    "modality_evidence_mismatch", "country_unconfirmed", "conflicting_country", "country_evidence_mismatch",
)
FIELDS = ("name", "date", "city", "state", "country", "modality", "registration_url", "official_url")


def folded(x: Column) -> Column:
    """For comparing places: no accents, lower case, single spaces; null if empty."""
    return F.nullif(_folded(x), F.lit(""))


def _folded(x: Column) -> Column:
    """As folded, but empty if it is; what is ASCII with single spaces already has only its case to lose."""
    return F.when(x.rlike("[^ -~]|^ |  | $"), F.lower(strip_accents(clean(x)))).otherwise(F.coalesce(F.lower(x), F.lit("")))


def _side(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def location_evidence(left: Column | str, right: Column | str) -> Column:
    """Why two records (structs with date, city, state, country) aren't shown to be at one place and day; null if they are."""
    one, other = _side(left), _side(right)
    fields = ("date", "city", "state", "country")
    compared = [F.substring(side["date"].cast("string"), 1, 10) if f == "date" else _folded(side[f].cast("string")) for f in fields for side in (one, other)]

    def reason(v: Column) -> Column:
        pairs = [(F.get(v, F.lit(2 * k)), F.get(v, F.lit(2 * k + 1))) for k in range(len(fields))]
        (a, b), places = pairs[0], pairs[1:]
        conflict, missing = F.lit(False), F.lit(False)
        for x, y in places:
            missing = missing | (x == "") | (y == "")
            conflict = conflict | ((x != "") & (y != "") & (x != y))
        return (
            F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), "date_unconfirmed")
            .when(a != b, "date_mismatch")
            .when(conflict, "location_conflict")
            .when(missing, "location_unconfirmed")
        )

    return once(F.array(*compared), reason)


def observation_reason(record: Column | str, observed: Column) -> Column:
    """Why validated observations (an array of such structs) don't bear out a record; null if one does and none speaks against it."""
    own = _side(record)
    some = lambda f: F.coalesce(F.exists(observed, f), F.lit(False))
    other_day = some(lambda o: F.substring(F.nullif(o["date"], F.lit("")), 1, 10) != F.substring(own["date"].cast("string"), 1, 10))
    other_place = some(lambda o: F.coalesce(folded(o["city"]) != folded(own["city"]), F.lit(False)) | F.coalesce(folded(o["state"]) != folded(own["state"]), F.lit(False)) | F.coalesce(folded(o["country"]) != folded(own["country"]), F.lit(False)))
    none = ~some(lambda o: location_evidence(own, o).isNull())
    return F.when(none, "observation_unconfirmed").when(other_day, "date_mismatch").when(other_place, "location_conflict")


def cross_source_reason(left: Column | str, right: Column | str, strong_link: Column, observed: Column) -> Column:
    """Why a record of one source can't be taken for one of another by itself; null if it can.

    observed: the validated observations of the right one, an array of structs.
    """
    a, b = _side(left), _side(right)
    other_id = (a["source"] == b["source"]) & ~a["external_id"].eqNullSafe(b["external_id"])
    return F.coalesce(
        F.when(F.coalesce(other_id, F.lit(False)), "source_identity_conflict"),
        F.when(b["status"].isin("hidden", "rejected"), "restricted"),
        location_evidence(a, b),
        F.when(~F.coalesce(strong_link, F.lit(False)), "link_unconfirmed"),
        observation_reason(b, observed),
    )


def match_cascade(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """One row per incoming record: id, match, rank, score, automatic and reason.

    Both sides: id, source, external_id, links (addresses that stand for a record), urls
    (any others), date, city, state, country, name, fingerprint, status; known also
    observed (see cross_source_reason). Candidates come from five equi-joins with a rank
    each: (1) same source and id; (2) a common link and the day: ambiguous if there are
    several, and automatic only if nothing speaks against it; (3) any common address and
    the day; (4) the same fingerprint and day; (5) the same day and place with names at
    least SIMILAR, which only records without any other hit are held against. The last three
    are for review and leave rejected records out. The first rank with a hit decides. As only
    the first known record of a rank counts, and whether a link has others, the known side is
    reduced to its least and greatest id for each key before it is joined.
    """
    names = ("source", "external_id", "date", "city", "state", "country", "status")
    a = incoming.select(*[F.col(c).alias(f"a_{c}") for c in incoming.columns])
    b = known.select(*[F.col(c).alias(f"b_{c}") for c in known.columns])
    open_ = b.filter("b_status != 'rejected'")

    def hit(joined: DataFrame, rank: int, score: Column, automatic: Column, reason: Column) -> DataFrame:
        return joined.select(F.col("a_id").alias("id"), F.col("b_id").alias("match"), F.lit(rank).alias("rank"), score.alias("score"), automatic.alias("automatic"), reason.alias("reason"))

    def offered(right: DataFrame, *keys: Column) -> DataFrame:
        """The least and the greatest id of the known records of each key: no more is asked of a key than which one is first, and whether there are others."""
        rows = right.select("b_id", *[k.alias(f"__k{i}") for i, k in enumerate(keys)])
        return rows.groupBy(*rows.columns[1:]).agg(F.min("b_id").alias("b_id"), F.max("b_id").alias("__last"))

    def met(left: DataFrame, right: DataFrame, *keys: tuple[Column, Column]) -> DataFrame:
        """a_id with the first known record of equal keys, and the last one. Pairs are never rows."""
        rows = left.select("a_id", *[k.alias(f"__k{i}") for i, (k, _) in enumerate(keys)])
        return rows.join(offered(right, *[k for _, k in keys]), rows.columns[1:]).select("a_id", "b_id", "__last")

    def sharing(right: DataFrame, column: str) -> DataFrame:
        """The first and the last known record that has a common element and the same day."""
        left_keys = a.select("a_id", "a_date", F.explode(F.array_distinct(f"a_{column}")).alias("key"))
        right_keys = right.select("b_id", "b_date", F.explode(F.array_distinct(f"b_{column}")).alias("b_key"))
        return met(left_keys, right_keys, (F.col("key"), F.col("b_key")), (F.col("a_date"), F.col("b_date"))).groupBy("a_id").agg(F.min("b_id").alias("b_id"), F.max("__last").alias("__last"))

    same = hit(met(a, b, (F.col("a_source"), F.col("b_source")), (F.col("a_external_id"), F.col("b_external_id"))), 1, F.lit(1.0), F.lit(True), F.lit("same_source"))
    side = lambda p: F.struct(*[F.col(f"{p}_{c}").alias(c) for c in names])
    linked = sharing(b, "links")
    several = hit(linked.filter("b_id != __last"), 2, F.lit(1.0), F.lit(False), F.lit("link_ambiguous"))
    why = cross_source_reason(side("a"), side("b"), F.lit(True), F.col("b_observed"))
    single = linked.filter("b_id = __last").select("a_id", "b_id").join(a, "a_id").join(b, "b_id").withColumn("__why", why)
    link = several.unionByName(hit(single, 2, F.lit(1.0), F.col("__why").isNull(), F.coalesce("__why", F.lit("link_confirmed"))))
    generic = hit(sharing(open_, "urls"), 3, F.lit(1.0), F.lit(False), F.lit("link_unconfirmed"))
    print_ = hit(met(a, open_, (F.col("a_fingerprint"), F.col("b_fingerprint")), (F.col("a_date"), F.col("b_date"))), 4, F.lit(1.0), F.lit(False), F.lit("fingerprint_review"))
    sure = stored(latest(same.unionByName(link).unionByName(generic).unionByName(print_), ["id"], [F.asc("rank"), F.desc("score"), F.asc("match")]))
    place = lambda df: df.withColumns({"words": name_words("name"), "__city": F.lower("city")})
    left = place(incoming.join(sure.select("id"), "id", "left_anti"))
    right = place(known.filter("status != 'rejected'")).withColumnRenamed("id", "match")
    near = best_similar(left, right, "id", "match", "words", ["date", "__city", "state", "country"], SIMILAR)
    near = near.select("id", "match", F.lit(5).alias("rank"), "score", F.lit(False).alias("automatic"), F.lit("similar_review").alias("reason"))
    best = sure.unionByName(near)
    rows = incoming.select("id").join(best, "id", "left")
    return rows.select("id", "match", F.coalesce("rank", F.lit(9)).alias("rank"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("automatic", F.lit(False)).alias("automatic"), F.coalesce("reason", F.lit("none")).alias("reason"))


def identity_reason(record: Column | str, seen: Column | str, country_status: Column, protected: Column) -> Column:
    """Why what was seen (date, city, state, country) can't enrich a record as it is; null if it can.

    country_status: that of the country's evidence; protected: fields that a person set,
    which aren't compared.
    """
    a, b = _side(record), _side(seen)
    conflict = F.lit(False)
    for field in ("city", "state", "country"):
        differs = F.coalesce(folded(a[field]) != folded(b[field]), F.lit(False))
        conflict = conflict | (differs & ~F.coalesce(F.array_contains(protected, field), F.lit(False)))
    return (
        F.when(b["date"].isNull(), "date_unconfirmed")
        .when(F.coalesce(a["date"].cast("date") != b["date"].cast("date"), F.lit(False)), "date_mismatch")
        .when(country_status.isin("conflicting", "unrecognized"), "location_unconfirmed")
        .when(conflict, "location_conflict")
    )


def country_evidence(structured: list[Column], where: Column) -> Column:
    """country and status (confirmed, none, conflicting or unrecognized) from a source's own fields and the end of its location."""
    given = F.array(*[clean(x) for x in structured])
    named = F.filter(given, lambda x: x != "")
    codes = F.transform(named, country_of)
    tail = country_in_location(where)
    all_ = F.array_distinct(F.array_compact(F.concat(codes, F.array(tail["country"]))))
    status = F.when((F.size(all_) > 1) | tail["conflicting"], "conflicting").when(F.exists(codes, lambda c: c.isNull()), "unrecognized").when(F.size(all_) == 0, "none").otherwise("confirmed")
    return F.struct(F.when(status == "confirmed", F.get(all_, F.lit(0))).alias("country"), status.alias("status"))


def canonical(df: DataFrame, carried: list[str]) -> DataFrame:
    """An extraction in the form that records have: cleaned fields, slug, fingerprint, warnings from what was observed, and a confidence.

    df: name, claimed_date, date (observed), city, state, country_status, country,
    modality, claimed_modality, registration_url, url, warnings and confidences (an array).
    The confidence is the mean of the positive ones, at most 0.95, and lower by 0.1 with
    any warning.
    """
    day = normalize_date("date")
    own = F.array_compact(F.array(
        F.when(clean("name") == "", "missing_name"), F.when(day.isNull(), "missing_date"), F.when(clean("city") == "", "missing_city"), F.when(clean("state") == "", "missing_state"),
        F.when(F.coalesce(day != normalize_date("claimed_date"), F.lit(False)), "date_evidence_mismatch"), F.when(F.col("country_status") == "conflicting", "conflicting_country"),
        F.when(F.col("modality") == "unknown", "modality_unconfirmed"), F.when(F.col("modality") == "mixed", "multiple_modalities"), F.when((F.col("claimed_modality") != "unknown") & (F.col("claimed_modality") != F.col("modality")), "modality_evidence_mismatch"),
    ))
    warnings = normalized_warnings(F.concat(F.array_except("warnings", F.array(*[F.lit(w) for w in OWN_WARNINGS])), own), "country", "city")
    positive = F.filter("confidences", lambda c: c > 0)
    mean = F.coalesce(F.aggregate(positive, F.lit(0.0), lambda t, c: t + c) / F.nullif(F.size(positive), F.lit(0)), F.lit(0.0))
    name = F.coalesce(F.nullif(clean("name"), F.lit("")), F.lit("Evento sem nome"))
    rows = df.select(
        *carried, slugify(F.concat_ws(" ", name, F.nullif(clean("city"), F.lit("")), day)).alias("slug"), name.alias("name"), day.alias("date"), F.nullif(clean("city"), F.lit("")).alias("city"), F.nullif(clean("state"), F.lit("")).alias("state"),
        "country", "modality", F.coalesce(absolute("registration_url", "url"), F.lit(None).cast("string")).alias("registration_url"), warnings.alias("warnings"), fingerprint(name, day, "city", "state", "country").alias("fingerprint"), mean.alias("__mean"),
    )
    return rows.withColumn("confidence", F.round(F.greatest(F.least(F.col("__mean"), F.lit(0.95)) - F.when(F.size("warnings") > 0, 0.1).otherwise(0.0), F.lit(0.0)), 4)).drop("__mean")


def quality_reasons(states: tuple[str, ...] = (), home: str = "BR") -> Column:
    """All reasons not to publish a record, in order."""
    place = clean("city") != ""
    if states:
        place = place & F.col("state").isin(*states)
    return F.array_compact(
        F.array(
            F.when(clean("name") == "", "missing_name"),
            F.when(F.try_to_date(F.col("date").cast("string"), "yyyy-MM-dd").isNull(), "missing_date"),
            F.when(F.coalesce(F.col("country"), F.lit("")) == "", "country_unconfirmed").when(F.upper("country") != home, "foreign"),
            F.when(F.coalesce(F.col("modality"), F.lit("unknown")) == "unknown", "modality_unconfirmed").when(~F.col("modality").isin("road", "trail"), "modality_requires_review"),
            F.when(~F.coalesce(place, F.lit(False)), "missing_location"),
            F.when(F.col("registration_url").isNull() & F.col("official_url").isNull(), "missing_registration_or_official_url"),
            F.when(~F.coalesce(F.col("has_reference"), F.lit(False)), "invalid_source_reference"),
            F.when(F.col("confidence") < MIN_CONFIDENCE, "low_confidence"),
            F.when(F.arrays_overlap(F.coalesce("warnings", F.array().cast("array<string>")), F.array(*[F.lit(w) for w in CRITICAL])), "critical_warning"),
        )
    )


def judged(df: DataFrame, states: tuple[str, ...] = (), home: str = "BR") -> DataFrame:
    """df with reasons and publication: published without any, else pending_review."""
    return df.withColumn("reasons", quality_reasons(states, home)).withColumn("publication", F.when(F.size("reasons") == 0, "published").otherwise("pending_review"))


def safe_city(x) -> Column:
    """Whether a city may be shown: not empty, no street or venue, no leading digit, no markup or address of the web."""
    city = clean(x)
    return (city != "") & ~looks_like_venue(city, municipality=True) & ~city.rlike(r"^\d") & ~city.rlike(r"[\x{FFFD}<>]") & ~city.rlike(r"(?i)https?://")


def publication_error(states: tuple[str, ...] = (), home: str = "BR") -> Column:
    """The first structural rule that a record breaks; null if none."""
    place = safe_city("city")
    if states:
        place = place & F.col("state").isin(*states)
    dated = F.try_to_date(F.col("date").cast("string"), "yyyy-MM-dd").isNotNull()
    return F.coalesce(
        F.when(clean("name") == "", "requires_name"),
        F.when(~F.coalesce(dated & place, F.lit(False)), "requires_date_city_state"),
        F.when(~F.coalesce(F.col("country") == home, F.lit(False)), "requires_country"),
        F.when(~F.coalesce(F.col("modality").isin("road", "trail", "mixed", "kids", "walk"), F.lit(False)), "requires_modality"),
        F.when(~F.coalesce(F.col("has_reference"), F.lit(False)), "requires_reference"),
    )


def priority(source: str, table: dict[str, int] = PRIORITY) -> Column:
    out = F.lit(0)
    for name, n in table.items():
        out = F.when(F.col(source) == name, n).otherwise(out)
    return out


def survivors(df: DataFrame, group: str, order: list[Column], fields: list[str], lists: list[str] = (), unions: list[str] = (), greatest: list[str] = ()) -> DataFrame:
    """One record per group: each field from the first row, in the given order, that has one; an empty text counts as none.

    lists are taken from the first row where they aren't empty; unions are joined
    over all rows; greatest takes the maximum. Rows are ranked in a window; the aggregate
    behind it has the same partitioning, so there is one shuffle.
    """
    ranked = df.withColumn("__rank", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    value = lambda c: F.nullif(F.col(c), F.lit("")) if dict(df.dtypes)[c] == "string" else F.col(c)
    aggs = [F.min_by(value(c), F.when(value(c).isNotNull(), F.col("__rank"))).alias(c) for c in fields]
    aggs += [F.coalesce(F.min_by(F.col(c), F.when(F.size(c) > 0, F.col("__rank"))), F.array().cast(dict(df.dtypes)[c])).alias(c) for c in lists]
    aggs += [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in unions]
    aggs += [F.max(c).alias(c) for c in greatest]
    return ranked.groupBy(group).agg(*aggs)


def merged_fields(left: str, right: str, fields: list[str], protected_left: str, protected_right: str, prefer_right: Column) -> list[Column]:
    """Each field of two records: that of a side where it's protected (left first), else of the preferred side, else of the other."""
    out = []
    for f in fields:
        a, b = F.col(f"{left}.{f}"), F.col(f"{right}.{f}")
        by_hand_a, by_hand_b = (F.array_contains(F.col(p), f) for p in (protected_left, protected_right))
        out.append(F.when(by_hand_a, a).when(by_hand_b, b).when(prefer_right, F.coalesce(b, a)).otherwise(F.coalesce(a, b)).alias(f))
    return out


def merge_preview(pairs: DataFrame, fields: list[str]) -> DataFrame:
    """a_id, b_id, reasons, can_merge, automatic, revision and the merged fields of pairs that might be one record.

    pairs: a and b (structs of id, source, external_id, status, date, city, state, country,
    linked (has a source), busy (a task runs on it), links, observed and the fields),
    a_protected and b_protected (fields set by a person). revision: a hash of both sides as
    they are now, which a merge must bring back unchanged.
    """
    a, b = F.col("a"), F.col("b")
    both_set = F.lit(False)
    for f in fields:
        both_set = both_set | (F.array_contains("a_protected", f) & F.array_contains("b_protected", f) & ~a[f].eqNullSafe(b[f]))
    hard = F.array_compact(F.array(
        location_evidence(a, b), F.when(a["status"].isin("hidden", "rejected") | b["status"].isin("hidden", "rejected"), "restricted"), F.when(~a["linked"] | ~b["linked"], "link_unconfirmed"),
        F.when(F.coalesce((a["source"] == b["source"]) & (a["external_id"] != b["external_id"]), F.lit(False)), "source_identity_conflict"), F.when(F.coalesce(both_set, F.lit(False)), "manual_conflict"), F.when(a["busy"] | b["busy"], "in_use"),
    ))
    strong = F.arrays_overlap(a["links"], b["links"])
    soft = F.coalesce(cross_source_reason(a, b, strong, b["observed"]), cross_source_reason(b, a, strong, a["observed"]))
    prefer_b = F.coalesce(_rank(b["source"]) > _rank(a["source"]), F.lit(False))
    merged = merged_fields("a", "b", fields, "a_protected", "b_protected", prefer_b)
    rows = pairs.select(a["id"].alias("a_id"), b["id"].alias("b_id"), hard.alias("reasons"), soft.alias("__soft"), F.sha2(F.to_json(F.struct("a", "b", "a_protected", "b_protected")), 256).alias("revision"), *merged)
    return rows.withColumn("can_merge", F.size("reasons") == 0).withColumn("automatic", (F.size("reasons") == 0) & F.col("__soft").isNull()).drop("__soft")


def _rank(source: Column, table: dict[str, int] = PRIORITY) -> Column:
    out = F.lit(0)
    for name, n in table.items():
        out = F.when(source == name, n).otherwise(out)
    return out


def weak_candidates(df: DataFrame, key: str, day: str, keys: list[Column]) -> DataFrame:
    """key and weak: how many other records of the same day share any of the keys (a fingerprint, an address), which hints but proves nothing.

    A record has one row; equal rows count once. Records aren't paired: how many share any key is the
    sum of how many share each, less those that share each two, and so on over all
    subsets of the keys, so a key that many records share is one count.
    """
    named = [f"k{i}" for i in range(len(keys))]
    rows = df.select(F.col(key).alias("id"), F.col(day).cast("string").alias("day"), *[k.cast("string").alias(n) for k, n in zip(keys, named, strict=True)]).distinct()
    subsets = [[n for i, n in enumerate(named) if bits >> i & 1] for bits in range(1, 1 << len(named))]

    def shared(names: list[str]) -> Column:
        whole = F.col("day").isNotNull()
        for n in names:
            whole = whole & F.col(n).isNotNull()
        return F.when(whole, F.struct(F.lit(1 if len(names) % 2 else -1).alias("sign"), F.to_json(F.struct("day", *names)).alias("value")))

    each = rows.select("id", F.inline(F.array_compact(F.array(*[shared(s) for s in subsets]))))
    many = each.groupBy("value").agg((F.count(F.lit(1)) - 1).alias("others")).filter("others > 0")
    sums = each.join(many, "value").groupBy("id").agg(F.sum(F.col("sign") * F.col("others")).alias("weak"))
    return df.select(F.col(key).alias("id")).distinct().join(sums, "id", "left").select(F.col("id").alias(key), F.coalesce("weak", F.lit(0)).cast("long").alias("weak"))


def source_matches(stored: DataFrame, observed: DataFrame, references: DataFrame) -> DataFrame:
    """Stored matches after new observations: external_id, event_id, status, resolved_by, and country, which an empty one doesn't erase.

    stored: external_id, event_id, status, resolved_by, country; observed: external_id, date,
    city, state, country; references: external_id, event_id, and the record's own date, city,
    state and country. An observation that its reference's record bears out in all fields
    resolves the match; one that isn't borne out reopens it; without a reference a new match
    waits. Stored matches that weren't observed stay.
    """
    names = ("date", "city", "state", "country")
    o = observed.select("external_id", F.struct(*names).alias("o"))
    r = references.select("external_id", F.col("event_id").alias("ref"), F.struct(*names).alias("r"))
    s = stored.select("external_id", F.struct("event_id", "status", "resolved_by", "country").alias("s"))
    rows = s.join(o, "external_id", "full_outer").join(r, "external_id", "left").filter("s is not null or o is not null")
    seen, fits = F.col("o").isNotNull(), F.col("ref").isNotNull() & location_evidence("o", "r").isNull()
    kept = (F.col("s.status") == "resolved") & (F.col("s.event_id") == F.col("ref"))
    event = F.when(~seen, F.col("s.event_id")).when(fits, F.col("ref")).when(F.col("ref").isNotNull(), F.lit(None)).otherwise(F.col("s.event_id"))
    status = F.when(~seen, F.col("s.status")).when(fits, "resolved").when(F.col("ref").isNotNull(), "pending").otherwise(F.coalesce("s.status", F.lit("pending")))
    by = F.when(~seen, F.col("s.resolved_by")).when(fits & F.coalesce(kept, F.lit(False)), F.col("s.resolved_by")).when(fits, "exact_reference").when(F.col("ref").isNotNull(), F.lit(None)).otherwise(F.col("s.resolved_by"))
    return rows.select("external_id", event.alias("event_id"), status.alias("status"), by.alias("resolved_by"), F.coalesce(F.nullif(F.col("o.country"), F.lit("")), "s.country").alias("country"))


def resolve_request(matches: DataFrame) -> DataFrame:
    """The outcome of a person's wish to tie a match to a record: missing, date_mismatch, location_conflict, already_associated, unchanged or resolved.

    matches: match and event (structs with date, city, state, country; null if there is none),
    wanted (the record's id), referenced (the id that the source's reference has now) and
    status and event_id of the match.
    """
    why = location_evidence("match", "event")
    outcome = (
        F.when(F.col("match").isNull() | F.col("event").isNull(), "missing")
        .when(why.isin("date_unconfirmed", "date_mismatch"), "date_mismatch")
        .when(why == "location_conflict", "location_conflict")
        .when(F.coalesce(F.col("referenced") != F.col("wanted"), F.lit(False)), "already_associated")
        .when((F.col("referenced") == F.col("wanted")) & (F.col("status") == "resolved") & (F.col("event_id") == F.col("wanted")), "unchanged")
        .otherwise("resolved")
    )
    return matches.withColumn("outcome", outcome)


#: A source's kinds of event by modality.
KINDS = {"corrida de rua": "road", "road": "road", "trail run": "trail", "trail": "trail", "corrida de montanha": "trail"}


def observation(df: DataFrame, carried: list[str]) -> DataFrame:
    """The only fields of a source's metadata that may be kept as its observation of a record.

    df: name, date, city, state, country, country_status, kind, registration_url, about_url,
    source_url, and whatever else came, which is left out.
    """
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    kinds = F.create_map(*[F.lit(v) for pair in KINDS.items() for v in pair])
    country = F.when(~F.coalesce(F.col("country_status").isin("conflicting", "unrecognized"), F.lit(False)), country_of("country"))
    return df.select(*carried, empty("name").alias("name"), F.col("date").cast("string").alias("date"), empty("city").alias("city"), empty("state").alias("state"), country.alias("country"), F.element_at(kinds, folded(F.col("kind"))).alias("modality"), empty("registration_url").alias("registration_url"), F.coalesce(empty("about_url"), empty("source_url")).alias("official_url"))


def preserved(current: DataFrame, incoming: DataFrame, reviewed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Incoming records, with the fields that were reviewed (key, field) kept as they are now."""
    held = reviewed.groupBy(key).agg(F.collect_set("field").alias("__held"))
    now = current.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    rows = incoming.join(held, key, "left").join(now, key, "left")
    return rows.select(key, *[F.when(F.coalesce(F.array_contains("__held", f), F.lit(False)), F.col(f"__{f}")).otherwise(F.col(f)).alias(f) for f in fields])


def source_comparison(observations: DataFrame, canonical: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """For each record and field: how many validated values there are, whether they differ among each other or from the record, and whether there is none.

    observations: key, source, validated and the fields; canonical: key and the fields.
    """
    def value(f: str) -> Column:
        c = F.col(f).cast("string")
        norm = F.substring(c, 1, 10) if f == "date" else comparable(c) if f.endswith("url") else folded(c)
        return F.when(~((F.lit(f) == "modality") & (c == "unknown")) & (F.trim(c) != ""), norm)

    long = lambda df, *keys: df.select(*keys, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), value(f).alias("value")) for f in fields])))
    seen = long(observations.filter("validated"), key).groupBy(key, "field").agg(F.collect_set("value").alias("values"), F.count("value").alias("evidence"))
    own = long(canonical, key)
    both = own.join(seen, [key, "field"], "left")
    values, n = F.coalesce("values", F.array().cast("array<string>")), F.coalesce("evidence", F.lit(0))
    differs = F.exists(values, lambda v: F.coalesce(v != F.col("value"), F.lit(False)))
    return both.select(key, "field", n.alias("evidence"), ((F.size(values) > 1) | F.coalesce(differs, F.lit(False))).alias("conflict"), (n == 0).alias("missing"))


def record_diff(old: str, new: str, fields: list[str]) -> Column:
    """field, from and to of each field that differs; null equals null."""
    one = lambda f: F.when(~F.col(f"{old}.{f}").eqNullSafe(F.col(f"{new}.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"{old}.{f}").cast("string").alias("from"), F.col(f"{new}.{f}").cast("string").alias("to")))
    return F.array_compact(F.array(*[one(f) for f in fields]))


def linked_groups(df: DataFrame, key: str, link: str, most: int = 3) -> DataFrame:
    """key, group (the least key of its component) and size; ambiguous beyond `most`. Records hang together by equal links.

    Keys of any type that has an order. Links join through the least key of each link, so a
    link that many records share makes as many edges as records, not pairs. A round hangs
    all greater neighbours of a node, then all its lesser ones, onto the least of them; when
    a round changes no edge, every record hangs on the least key of its component. That takes
    about the logarithm of the longest path. Each round is a table, which the next deletes; the last one stays
    for the result to read.
    """
    rows = df.filter(F.col(link).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("a"), F.col(link).alias("link")).distinct()
    hubs = rows.groupBy("link").agg(F.min("a").alias("b"))
    edges = stored(rows.join(hubs, "link").filter("a != b").select("a", "b").distinct())
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = stored(small.union(down).distinct())
        same = new.count() == edges.count() and new.join(edges, ["a", "b"], "left_anti").isEmpty()
        dropped(edges)
        edges = new
        if same:
            break
    labels = df.select(F.col(key).alias("a")).distinct().join(edges, "a", "left").select("a", F.coalesce("b", "a").alias("label"))
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    out = labels.filter("a is not null").join(sizes, "label").select(F.col("a").alias(key), F.col("label").alias("group"), "size")
    return out.withColumn("ambiguous", F.col("size") > most)


def group_merge(df: DataFrame, group: str, key: str, created: str, parts: list[str], linked: str | None = None, most: int = 3) -> DataFrame:
    """For each group: members, target (its oldest row), and whether it may be merged.

    compatible: at most `most` rows, all pairs of which agree in the given columns (nulls
    agree with anything). linked: a column with the component of proven links that a row is
    in; then one component must hold all rows.
    """
    aggs = [F.count_distinct(p).alias(f"__{p}") for p in parts]
    agree = F.col("members") <= most
    for p in parts:
        agree = agree & (F.col(f"__{p}") <= 1)
    if linked:
        aggs += [F.count_distinct(linked).alias("__linked"), F.count(linked).alias("__with")]
        agree = agree & (F.col("__linked") == 1) & (F.col("__with") == F.col("members"))
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("members"), F.min_by(key, F.struct(created, key)).alias("target"), *aggs).select(group, "members", "target", agree.alias("compatible"))


def decision(home: str = "BR") -> Column:
    """Outcome of a record from its group: foreign, waiting, merged, review or unmatched."""
    return (
        F.when(F.col("country").isNotNull() & (F.col("country") != home), "foreign")
        .when(F.col("busy"), "waiting")
        .when((F.col("members") > 1) & F.col("compatible") & ~F.col("ambiguous"), "merged")
        .when((F.col("members") > 1) | (F.col("weak") > 0), "review")
        .otherwise("unmatched")
    )


def candidate_action() -> Column:
    """What to do with a found candidate: skip, update, link, review or create."""
    return F.when(F.col("foreign"), "skip").when(F.col("same_source") & F.col("current"), "skip").when(F.col("same_source"), "update").when(F.col("automatic"), "link").when(F.col("match").isNotNull(), "review").otherwise("create")


def fallback_merge(first: str, second: str, fields: list[str]) -> list[Column]:
    """Each field from the first record, or from the second where it's empty."""
    return [F.coalesce(F.nullif(F.col(f"{first}.{f}"), F.lit("")), F.col(f"{second}.{f}")).alias(f) for f in fields]


def without_contradicted(warnings: str, holds: dict[str, Column]) -> Column:
    """Warnings without those whose condition shows that they no longer hold."""
    out = F.col(warnings)
    for name, gone in holds.items():
        out = F.when(gone, F.array_remove(out, name)).otherwise(out)
    return out


def evidence_class(values: Column) -> Column:
    """none, confirmed or conflict by how many distinct values there are."""
    n = F.size(F.array_distinct(F.array_compact(values)))
    return F.when(n == 0, "none").when(n == 1, "confirmed").otherwise("conflict")


def identity_reused(day: Column, known_day: Column) -> Column:
    """Whether the same id now stands for another year."""
    return F.coalesce(F.year(day) != F.year(known_day), F.lit(False))


def manifest(tables: dict[str, tuple[DataFrame, list[str], DataFrame | None, str | None, str | None]], sample: int = 100) -> DataFrame:
    """Rows, a hash of the first `sample` keys, and orphans of each table: name -> (rows, key, parents, foreign key, parent key)."""
    out = None
    for name, (df, key, parents, fk, pk) in tables.items():
        text = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
        first = df.select(*key).orderBy(*key).limit(sample).select(F.struct(*key).alias("k"), text.alias("t"))
        hashed = first.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "\n"), 256).alias("sample_hash"))
        parts = [df.agg(F.count(F.lit(1)).alias("rows"))]
        parts.append(hashed)
        if parents is not None:
            parts.append(df.join(parents.select(F.col(pk).alias(fk)), fk, "left_anti").agg(F.count(F.lit(1)).alias("orphans")))
        for p in parts:
            own = p.select(F.lit(name).alias("table_name"), *p.columns)
            out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    zero = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c)
    out = out if "orphans" in out.columns else out.withColumn("orphans", F.lit(0))
    return out.groupBy("table_name").agg(zero("rows"), F.max("sample_hash").alias("sample_hash"), zero("orphans"))


def unique_slugs(df: DataFrame, key: str, base: str, taken: DataFrame | None = None) -> DataFrame:
    """key and slug: the base itself for its first row by key, if it isn't taken, and for others the base with the least free numbers from 2 on.

    taken: a table with a column `slug` of those that are in use. No base's numbers run into
    another base's, as the last number tells them apart, so only bases and taken slugs are in their way:
    with those of a base numbered as breaks, a row's number is its place among rows and
    breaks together. Places come from ranges, so a base of any number of rows is spread.
    """
    rows = df.select(F.col(key).alias("key"), F.col(base).alias("base"))
    used = rows.select(F.col("base").alias("slug")).distinct()
    if taken is not None:
        old = taken.select("slug").distinct()
        first_free = used.join(old, "slug", "left_anti").select(F.col("slug").alias("base"), F.lit(1).alias("free"))
        used = used.union(old).distinct()
    else:
        first_free = used.select(F.col("slug").alias("base"), F.lit(1).alias("free"))
    numbered_slug = used.select(F.regexp_extract("slug", r"^(.+)-([1-9]\d{0,17})$", 1).alias("base"), F.regexp_extract("slug", r"^(.+)-([1-9]\d{0,17})$", 2).try_cast("long").alias("number"))
    breaks = numbered_slug.filter("number >= 2").join(rows.select("base").distinct(), "base", "left_semi")
    # the i-th break (from 0) stands behind number - 2 - i free numbers
    breaks = placed(breaks, ["base"], ["number"]).select("base", (F.col("number") - 2 - F.col("place")).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["key"].dataType).alias("key"))
    asked = placed(rows, ["base"], ["key"]).join(first_free, "base", "left")
    asked = asked.select("base", (F.col("place") - F.coalesce("free", F.lit(0))).alias("at"), F.lit(1).alias("kind"), "key")
    # a break counts for a row with at least as many rows before it as free numbers before the break
    both = placed(asked.filter("at >= 0").union(breaks), ["base"], ["at", "kind", "key"])
    later = both.filter("kind = 1").select("key", F.concat("base", F.lit("-"), (F.col("place") + 2).cast("string")).alias("slug"))
    return asked.filter("at < 0").select("key", F.col("base").alias("slug")).union(later).withColumnRenamed("key", key)
