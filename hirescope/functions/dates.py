"""Dates as boards write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# --- fixed values: the written forms, tried in order ------------------------------
MAIL = r"^(?:[A-Za-z]{3},\s+)(\d{1,2}) ([A-Za-z]{3}) (\d{4}) (\d{2}:\d{2}:\d{2}) (GMT|UTC|Z|[+-]\d{4})$"
MAIL_FORM = "d MMM yyyy HH:mm:ss xx"
PLAIN_FORMS = (
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
)
EPOCH_MS_FROM = 1e11


def parse_epoch(value: Column | str) -> Column:
    """Seconds, or milliseconds past 1e11; zero is no date."""
    v = F.nullif(col(value).cast("double"), F.lit(0.0))
    seconds = F.when(v > EPOCH_MS_FROM, v / 1000).otherwise(v)
    return F.timestamp_micros((seconds * 1e6).cast("long"))


def parse_date(value: Column | str) -> Column:
    """ISO (with Z or an offset), mail dates, plain dates, US dates; a time
    with no zone is UTC; anything else is null. Needs the UTC session zone."""
    text = F.trim(col(value).cast("string"))
    text = F.regexp_replace(text, "Z$", "+00:00")
    iso = F.when(
        text.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:[+-]\d{2}:?\d{2})?)?$"),
        text.try_cast("timestamp"),
    )
    zoned = F.regexp_replace(F.regexp_replace(text, r"\b(GMT|UTC)$", "+0000"), r"\+00:00$", "+0000")
    mail = F.when(
        zoned.rlike(MAIL), F.try_to_timestamp(F.regexp_replace(zoned, MAIL, "$1 $2 $3 $4 $5"), F.lit(MAIL_FORM))
    )
    plain = [F.when(text.rlike(rx), F.try_to_timestamp(text, F.lit(f))) for rx, f in PLAIN_FORMS]
    return F.coalesce(iso, mail, *plain)


def posted_ago(text: Column | str, as_of: Column) -> Column:
    """'Posted 5 Days Ago', 'Posted Today', 'Posted Yesterday' as a timestamp."""
    t = F.lower(F.coalesce(col(text), F.lit("")))
    days = (
        F.when(t.rlike(r"posted\s+\d+\+?\s+days?"), F.regexp_extract(t, r"posted\s+(\d+)\+?\s+days?", 1).cast("int"))
        .when(t.rlike(r"posted\s+today"), 0)
        .when(t.rlike(r"posted\s+yesterday"), 1)
    )
    return as_of - F.make_dt_interval(days)


def calendar_age(posted: Column, first_seen: Column, as_of: Column, zone: str = "UTC") -> Column:
    """Whole calendar days. A stamp at exact midnight UTC is a date and is
    read as written; any other is read in the reader's zone. A date after the
    first sighting is that sighting."""
    when = F.when(posted > first_seen, first_seen).otherwise(posted)
    midnight = when == F.date_trunc("day", when)
    day = F.when(midnight, F.to_date(when)).otherwise(F.to_date(F.from_utc_timestamp(when, zone)))
    today = F.to_date(F.from_utc_timestamp(as_of, zone))
    return F.when(when.isNotNull(), F.greatest(F.lit(0), F.datediff(today, day)))


def elapsed_age(posted: Column, as_of: Column) -> Column:
    """Days since a posting went up, fractional."""
    return (F.unix_micros(as_of) - F.unix_micros(posted)) / F.lit(86400e6)


def age_when_found(posted: Column, first_seen: Column, as_of: Column) -> Column:
    """How old a posting was when it was first seen, never negative."""
    return F.when(
        posted.isNotNull(),
        F.greatest(F.lit(0.0), elapsed_age(posted, F.coalesce(first_seen, as_of))),
    )
