"""Calendar dates, clock times and recurrence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import Text, _c, clean, normalize_key

#: The first three letters of Portuguese months.
MONTHS = ("jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez")


def iso_date(year: Column, month: Column, day: Column) -> Column:
    """yyyy-MM-dd, or null if there is no such day."""
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(F.try_to_date(text, "yyyy-MM-dd").isNotNull(), text)


def normalize_date(x: Text, this_year: int | Column | None = None) -> Column:
    """The first ISO day, else the first day/month[/year] with slashes or dots; an impossible day is null."""
    c = clean(x)
    year_now = (F.lit(this_year) if isinstance(this_year, int) else this_year if this_year is not None else F.year(F.current_date())).cast("string")
    part = lambda pattern, k: F.regexp_extract(c, pattern, k)
    iso = r"\b(\d{4})-(\d{2})-(\d{2})(?=\b|T\d{2}:\d{2})"
    first = iso_date(part(iso, 1), part(iso, 2), part(iso, 3))
    local = r"\b(\d{1,2})[/.](\d{1,2})(?:[/.](\d{2,4}))?\b"
    year = part(local, 3)
    year = F.when(year == "", year_now).when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    return F.coalesce(F.when(part(iso, 1) != "", first), F.when((part(local, 1) != "") & (F.length(year) == 4), iso_date(year, part(local, 2), part(local, 1))))


def normalize_time(x: Text) -> Column:
    """HH:MM of 7h, 7h30 or 07:30; null without one."""
    c = F.lower(clean(x))
    shape = r"\b([01]?\d|2[0-3])(?::|h)([0-5]\d)?\b"
    hour, minute = F.regexp_extract(c, shape, 1), F.regexp_extract(c, shape, 2)
    return F.when(hour != "", F.concat(F.lpad(hour, 2, "0"), F.lit(":"), F.when(minute == "", "00").otherwise(minute)))


def month_name_date(day: Text, month: Text, year: Text) -> Column:
    """The date of a day, a month's name and a year."""
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(normalize_key(month), 1, 3))
    digits = lambda x: F.regexp_extract(clean(x), r"\d+", 0)
    return F.when((number > 0) & (digits(day) != "") & (digits(year) != ""), iso_date(digits(year), number.cast("string"), digits(day)))


def explicit_date(x: Text) -> Column:
    """A label that is one whole date and nothing else."""
    c = clean(x)
    return F.when(c.rlike(r"^(\d{4}-\d{2}-\d{2}(T[\d:.+\-Z]*)?|\d{1,2}/\d{1,2}/\d{4})$"), normalize_date(c))


def hour_start(x: Text) -> Column:
    return F.date_trunc("hour", _c(x))


def next_hour(x: Text) -> Column:
    return hour_start(x) + F.expr("interval 1 hour")


def week_index(day: Text) -> Column:
    """Weeks since Monday 1970-01-05."""
    return F.floor(F.datediff(_c(day), F.lit("1970-01-05").cast("date")) / 7)


def every_n_weeks(day: Text, first: Text, n: int) -> Column:
    return F.pmod(week_index(day) - week_index(first), F.lit(n)) == 0


def wall_clock(day: Text, time: str, zone: str) -> Column:
    """instant and shifted_minutes of a local time; a time in a gap moves on to the first that exists, a repeated one is the earlier. Any session zone will do."""
    said = F.concat_ws(" ", _c(day).cast("string"), F.lit(time if time.count(":") == 2 else f"{time}:00"))
    instant = F.to_timestamp(F.concat_ws(" ", said, F.lit(zone)))
    back = F.convert_timezone(F.current_timezone(), F.lit(zone), instant.cast("timestamp_ntz"))
    shifted = F.timestamp_diff("MINUTE", F.to_timestamp_ntz(said), back).cast("int")
    return F.struct(instant.alias("instant"), F.when(shifted > 0, shifted).otherwise(0).alias("shifted_minutes"))


def weekly_coalesced(next_day: Text, now: Text) -> Column:
    """From the first due day and the present: due, the latest due day, how many weeks it stands for, and the next."""
    first, today = _c(next_day).cast("date"), _c(now).cast("date")
    weeks = F.floor(F.datediff(today, first) / 7).cast("int")
    latest = F.date_add(first, weeks * 7)
    return F.when(weeks >= 0, F.struct(latest.alias("latest"), weeks.alias("coalesced_weeks"), F.date_add(latest, 7).alias("next")))


def derived_status(start: Text, end: Text, today: Text) -> Column:
    return F.when(F.coalesce(_c(end), _c(start)) < _c(today), "completed").otherwise("scheduled")


def duration_ms(start: Text, end: Text) -> Column:
    return F.unix_millis(_c(end).cast("timestamp")) - F.unix_millis(_c(start).cast("timestamp"))


def age_seconds(at: Text, now: Text) -> Column:
    return F.floor((F.unix_millis(_c(now).cast("timestamp")) - F.unix_millis(_c(at).cast("timestamp"))) / 1000)
