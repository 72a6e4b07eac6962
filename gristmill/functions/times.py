"""Time expressions. Timestamps are UTC instants; digest dates are dates of the app's zone, as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Shanghai"


def digest_date(moment: Column, zone: str = ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(moment, zone), "yyyy-MM-dd")


def in_window(moment: Column, start: Column, end: Column) -> Column:
    """start < moment <= end; false where any is null."""
    return F.coalesce((moment > start) & (moment <= end), F.lit(False))


def in_future(moment: Column, now: Column) -> Column:
    return F.coalesce(moment > now, F.lit(False))


def age(moment: Column, now: Column) -> Column:
    """Microseconds from moment to now."""
    return F.unix_micros(now) - F.unix_micros(moment)


def within_hours(moment: Column, now: Column, hours: float, closed: bool = True) -> Column:
    """Not in the future and at most `hours` old, or less than that if not closed; false for null."""
    old, most = age(moment, now), int(hours * 3_600_000_000)
    return F.coalesce((old >= 0) & ((old <= most) if closed else (old < most)), F.lit(False))


def _first(text: Column, *formats: str) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def published(text: Column) -> Column:
    """RFC 2822, then ISO; text without a zone is UTC, what cannot be read is null."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(_first(bare, "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z"), F.expr("NULL"), F.try_to_timestamp(F.trim(text)))


def iso_text(text: Column) -> Column:
    """A time written with or without a zone (then UTC) as ISO in UTC; text that cannot be read stays as it is."""
    moment = F.try_to_timestamp(F.trim(text))
    fraction = F.when(F.unix_micros(moment) % 1_000_000 != 0, F.date_format(moment, ".SSSSSS")).otherwise("")
    return F.when(moment.isNull(), text).otherwise(F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00")))


def english_date(text: Column) -> Column:
    return _first(F.regexp_replace(F.trim(text), r"^([A-Za-z]{3})\.", "$1"), "MMM d, yyyy", "MMMM d, yyyy", "yyyy-MM-dd")


#: Written forms beside ISO and Chinese ones.
FORMS = ("yyyy/M/d H:m:s", "yyyy/M/d H:m", "yyyy/M/d", "yyyyMMdd")
CHINESE = r"^(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日(?:\s*(\d{1,2})\s*[:：]\s*(\d{2})(?:\s*[:：]\s*(\d{2}))?)?$"
#: The last second of the year 9999.
LAST_SECOND = 253_402_300_799


def page_time(text: Column, zone: str = ZONE) -> Column:
    """A time as pages write it: struct of the instant and whether it has a time of day; both unknown for what cannot be read, relative times among it.

    Nine to fourteen digits are epoch seconds, or milliseconds from thirteen on. Dates, Chinese dates with or without a clock, ISO and slashed forms are read in the app's zone unless they name one.
    """
    raw = F.trim(text)
    seconds = F.when(F.length(raw) >= 13, raw.try_cast("decimal(20,3)") / 1000).otherwise(raw.try_cast("decimal(20,3)"))
    epoch = F.when(raw.rlike(r"^\d{9,14}$") & (seconds <= LAST_SECOND), F.timestamp_micros((seconds * 1_000_000).cast("bigint")))
    part = lambda i: F.regexp_extract(raw, CHINESE, i)
    clock = F.concat_ws(":", *[F.when(part(i) != "", part(i)).otherwise("0") for i in (4, 5, 6)])
    chinese = F.when(raw.rlike(CHINESE), F.try_to_timestamp(F.concat_ws(" ", F.concat_ws("-", part(1), part(2), part(3)), clock), F.lit("yyyy-M-d H:m:s")))
    plain = F.regexp_replace(raw, "：", ":")
    iso = F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"), F.try_to_timestamp(plain))
    zoned = F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(F.regexp_replace(plain, r"([+-]\d{2})(\d{2})$", "$1:$2")))
    local = F.coalesce(chinese, iso, *[F.try_to_timestamp(plain, F.lit(f)) for f in FORMS])
    moment = F.coalesce(epoch, zoned, F.to_utc_timestamp(local, zone))
    has_time = epoch.isNotNull() | F.when(chinese.isNotNull(), part(4) != "").otherwise(plain.rlike(r"\d{1,2}:\d{2}"))
    return F.struct(moment.alias("at"), (moment.isNotNull() & has_time).alias("has_time"))
