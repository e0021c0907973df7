"""Four date rules, one per family of sources, and day ranges.

All rules give a ``DATE``. The lenient rule turns anything unreadable into null;
the strict ones stop the job, as the sources they serve always carry a date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import bind, strip_ordinal

# First newsletter day, and how many days the newest one lies back.
NEWSLETTER_START = "2010-01-01"
NEWSLETTER_LAG_DAYS = 2

# Month names as they are written, short or in full.
MONTHS = (
    "jan(?:uary)?",
    "feb(?:ruary)?",
    "mar(?:ch)?",
    "apr(?:il)?",
    "may",
    "june?",
    "july?",
    "aug(?:ust)?",
    "sept?(?:ember)?",
    "oct(?:ober)?",
    "nov(?:ember)?",
    "dec(?:ember)?",
)
_SHORT_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH = "(" + "|".join(MONTHS) + r")\.?"

# Written forms the lenient rule reads besides ISO, and where year, month and day
# stand in them; a month in figures comes before the day.
LENIENT_FORMS = (
    (rf"(?i)^{_MONTH} (\d{{1,2}}),? (\d{{4}})$", (3, 1, 2)),
    (rf"(?i)^(\d{{1,2}}) {_MONTH},? (\d{{4}})$", (3, 2, 1)),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", (3, 1, 2)),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})$", (1, 2, 3)),
    (r"^(\d{4})(\d{2})(\d{2})$", (1, 2, 3)),
)

_ISO_DAY = r"^\d{4}-\d{2}-\d{2}"
_WEEKDAY = r"^(?i)(mon|tues?|wed(nes)?|thu(rs)?|fri|sat(ur)?|sun)(day)?\.?,?\s+"
_CLOCK = r"(?i)[,\s]+\d{1,2}:\d{2}.*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _iso_day(c: Column) -> Column:
    """Day at the start of an ISO text, null if it is none; never an error."""
    return F.when(c.rlike(_ISO_DAY), F.substring(c, 1, 10).try_cast("date"))


def _month_number(name: Column) -> Column:
    """Number of a month written by name or in figures."""
    at = F.instr(F.lit(_SHORT_MONTHS), F.lower(F.substring(name, 1, 3)))
    return F.when(name.rlike(r"^\d"), name).otherwise(
        F.floor((at + 2) / 3).cast("string")
    )


def _written_day(c: Column) -> Column:
    day = F.lit(None).cast("string")
    for pattern, (y, m, d) in reversed(LENIENT_FORMS):
        parts = F.concat_ws(
            "-",
            F.regexp_extract(c, pattern, y),
            _month_number(F.regexp_extract(c, pattern, m)),
            F.regexp_extract(c, pattern, d),
        )
        day = F.when(c.rlike(pattern), parts).otherwise(day)
    # A form is told by its shape, as a failed parse costs an exception.
    return day.try_cast("date")


def lenient_date(c: Column | str) -> Column:
    """Day as written, zone offset ignored; null for whatever cannot be read."""

    def read(text: Column) -> Column:
        written = F.regexp_replace(F.regexp_replace(text, _WEEKDAY, ""), _CLOCK, "")
        other = bind(strip_ordinal(written), _written_day)
        return F.when(text.rlike(_ISO_DAY), _iso_day(text)).otherwise(other)

    return bind(F.trim(_col(c)), read)


def _strict(day: Column, written: Column, what: str) -> Column:
    failed = F.raise_error(F.concat(F.lit(f"{what}: unreadable date "), written))
    return F.when(written.isNull() | day.isNotNull(), day).otherwise(
        failed.cast("date")
    )


def strict_date(c: Column | str) -> Column:
    """Day as written in an ISO date or timestamp; anything else is an error."""
    c = F.trim(_col(c))
    return _strict(_iso_day(c), c, "strict_date")


def utc_date(c: Column | str) -> Column:
    """Day in UTC of an ISO timestamp, whatever zone the session runs in."""
    c = F.trim(_col(c))
    zoned = F.when(
        c.rlike(r"(?i)(z|[+-]\d{2}(:?\d{2})?)$") & c.rlike(r"(?i)[t ]\d{2}:"), c
    ).when(c.rlike(_ISO_DAY + "$"), F.concat(c, F.lit("T00:00:00Z")))
    zoned = F.coalesce(zoned, F.concat(c, F.lit("Z")))
    seconds = F.unix_seconds(F.try_to_timestamp(zoned))
    day = F.date_from_unix_date(F.floor(seconds / F.lit(86400)).cast("int"))
    return _strict(day, c, "utc_date")


def ordinal_date(c: Column | str) -> Column:
    """Day written as ``Thu, Aug 1st, 2024``."""
    c = _col(c)
    # The parser cannot read a weekday name, so it is cut off first.
    written = F.regexp_replace(strip_ordinal(c), "^[A-Za-z]{3}, ", "")
    day = F.try_to_date(written, "MMM d, yyyy")
    return _strict(day, c, "ordinal_date")


def date_range(spark: SparkSession, start: Column | str, end: Column | str) -> DataFrame:
    """One row per day from ``start`` to ``end``, both included."""
    start = F.to_date(F.lit(start)) if isinstance(start, str) else start
    end = F.to_date(F.lit(end)) if isinstance(end, str) else end
    return spark.range(1).select(
        F.explode(F.sequence(start, end, F.expr("interval 1 day"))).alias("nl_date")
    )


def newsletter_end(today: Column | None = None) -> Column:
    """Newest day a newsletter is looked for."""
    return F.date_sub(F.current_date() if today is None else today, NEWSLETTER_LAG_DAYS)


def day_text(c: Column | str) -> Column:
    """Date as ``yyyy-MM-dd``."""
    return F.date_format(_col(c), "yyyy-MM-dd")
