"""Timestamps; ``now`` is always a parameter."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from stowcheck.constants import REPORT_ZONE, ZONE_HOURS


def event_month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def event_month_key(ts: Column) -> Column:
    return F.concat(F.lit("_events/"), event_month(ts), F.lit("/events.jsonl"))


_ISO = (
    r"^(\d{4}-\d{2}-\d{2})"
    r"(?:[T ](\d{2})(?::(\d{2})(?::(\d{2})([.,]\d{1,6})?\d*)?)?(Z|[+-]\d{2}(?::?\d{2})?)?)?$"
)
_NAMED = rf"^(?:(\d{{4}}-\d{{1,2}}-\d{{1,2}}) )?(\d{{1,2}}:\d{{1,2}}) ({'|'.join(ZONE_HOURS)})$"
_OTHER_ZONE = r"^(?:\d{4}-\d{1,2}-\d{1,2} )?\d{1,2}:\d{1,2} \S+$"


def _part(text: Column, pattern: str, group: int, default: str) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found == "", default).otherwise(found)


def parse_event_time(text: Column) -> Column:
    """ISO-8601, ``YYYY-MM-DD HH:MM TZ`` or ``HH:MM TZ`` (dated 2000-01-01); bare means UTC.

    Anything else is NULL; ``reject_reason`` says why.
    """
    text = F.btrim(text)
    iso = F.concat(
        F.regexp_extract(text, _ISO, 1),
        F.lit("T"),
        _part(text, _ISO, 2, "00"),
        F.lit(":"),
        _part(text, _ISO, 3, "00"),
        F.lit(":"),
        _part(text, _ISO, 4, "00"),
        F.replace(F.regexp_extract(text, _ISO, 5), F.lit(","), F.lit(".")),
        F.regexp_replace(
            F.regexp_replace(_part(text, _ISO, 6, "Z"), r"^([+-]\d{2})$", "$1:00"),
            r"^([+-]\d{2})(\d{2})$",
            "$1:$2",
        ),
    ).try_cast("timestamp")
    hours = F.create_map(*[F.lit(v) for pair in ZONE_HOURS.items() for v in pair])
    zone = F.regexp_extract(text, _NAMED, 3)
    named = F.concat(
        _part(text, _NAMED, 1, "2000-01-01"),
        F.lit(" "),
        F.regexp_extract(text, _NAMED, 2),
        F.lit(":00"),
    ).try_cast("timestamp") - F.make_dt_interval(hours=F.try_element_at(hours, zone))
    return F.when(text.rlike(_ISO), iso).when(text.rlike(_NAMED), named)


def reject_reason(text: Column) -> Column:
    """Why ``parse_event_time`` finds no time in a text; NULL when it finds one."""
    parsed, text = parse_event_time(text), F.btrim(text)
    return (
        F.when(parsed.isNotNull(), F.lit(None).cast("string"))
        .when(F.coalesce(text, F.lit("")) == "", "empty")
        .when(text.rlike(_ISO) | text.rlike(_NAMED), "no such date or time")
        .when(text.rlike(_OTHER_ZONE), "unknown zone")
        .otherwise("unknown format")
    )


def local_report_date(ts: Column, zone: str = REPORT_ZONE) -> Column:
    """Calendar date in the reporting zone, daylight saving included."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def age_hours(now: Column, ts: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(ts)) / F.lit(3.6e9)
