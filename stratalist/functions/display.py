"""How times, deadlines, pay and scores are told. Stored times are UTC without a zone; days are floored, not counted by date."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs of currencies and periods, and score classes.
SIGNS = {"USD": "$", "EUR": "€", "GBP": "£"}
PERIODS = {"hourly": "/hr", "yearly": "/yr", "monthly": "/mo"}
SCORE_CLASSES = (90, 80, 70, 60)
URGENT_DAYS, SOON_DAYS = 2, 7


def _ntz(at: datetime) -> Column:
    return F.lit(at).cast("timestamp_ntz")


def _named(table: dict[str, str], value: Column, default: str = "") -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value), F.lit(default))


def _count(n: Column, unit: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))


def time_ago(at: Column, now: datetime) -> Column:
    seconds = F.timestamp_diff("SECOND", at, _ntz(now))
    whole = lambda n: F.floor(seconds / n).cast("long")
    days = whole(86400)
    out = F.when(at.isNull(), "unknown").when(seconds < 60, "just now").when(seconds < 3600, F.concat(whole(60).cast("string"), F.lit("m ago"))).when(seconds < 86400, F.concat(whole(3600).cast("string"), F.lit("h ago")))
    out = out.when(days == 1, "yesterday").when(days < 30, F.concat(days.cast("string"), F.lit(" days ago"))).when(days < 365, _count(F.floor(days / 30), "month"))
    return out.otherwise(_count(F.floor(days / 365), "year"))


def deadline_badge(deadline: Column, explicit: Column, now: datetime) -> Column:
    """level (none, passed, urgent, soon, ok) and text. A deadline that nobody stated is none."""
    days = F.floor(F.timestamp_diff("SECOND", _ntz(now), deadline) / 86400).cast("long")
    stated = deadline.isNotNull() & F.coalesce(explicit, F.lit(False))
    level = F.when(~stated, "none").when(days < 0, "passed").when(days <= URGENT_DAYS, "urgent").when(days <= SOON_DAYS, "soon").otherwise("ok")
    text = F.when(~stated, "No deadline listed").when(days < 0, "Deadline passed").otherwise(F.concat(F.lit("Deadline in "), days.cast("string"), F.lit(" day"), F.when(days == 1, "").otherwise("s")))
    return F.struct(level.alias("level"), text.alias("text"))


def local_hour(at: Column, zone: str) -> Column:
    """The hour of a stored time where the user is."""
    return F.hour(F.convert_timezone(F.lit("UTC"), F.lit(zone), at))


def when_text(at: Column, zone: str, now: datetime) -> Column:
    """today, tomorrow or the day, and the time, where the user is; null becomes empty."""
    local, today = (F.convert_timezone(F.lit("UTC"), F.lit(zone), x) for x in (at, _ntz(now)))
    ahead = F.date_diff(local.cast("date"), today.cast("date"))
    day = F.when(ahead == 0, "today").when(ahead == 1, "tomorrow").otherwise(F.date_format(local, "EEE dd MMM"))
    return F.when(at.isNull(), "").otherwise(F.concat(day, F.lit(" at "), F.date_format(local, "HH:mm")))


def _amount(value: Column) -> Column:
    small = F.regexp_replace(F.regexp_replace(F.format_number(value, 2), "0+$", ""), r"\.$", "")
    return F.when(value >= 1000, F.format_number(F.bround(value, 0), 0)).otherwise(small)


def salary_text(low: Column, high: Column, currency: Column, period: Column) -> Column:
    sign = _named(SIGNS, F.coalesce(F.nullif(currency, F.lit("")), F.lit("USD")))
    per = _named(PERIODS, F.coalesce(period, F.lit("")))
    one = F.concat(sign, _amount(low))
    both = F.coalesce(high > low, F.lit(False))
    return F.when(low.isNull(), "Not listed").otherwise(F.concat(one, F.when(both, F.concat(F.lit("–"), sign, _amount(high))).otherwise(""), per))


def humanize(value: Column) -> Column:
    return F.initcap(F.replace(F.coalesce(value, F.lit("")), F.lit("_"), F.lit(" ")))


def score_class(score: Column) -> Column:
    value, out = F.coalesce(score, F.lit(0.0)), F.lit("score-low")
    for least in reversed(SCORE_CLASSES):
        out = F.when(value >= least, f"score-{least}").otherwise(out)
    return out
