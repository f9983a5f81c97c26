"""Dates as they come: YYYYMMDD, YYYY-MM-DD, epoch seconds, ISO stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dashed(raw: Column) -> Column:
    """Eight digits get dashes, anything else passes unchanged; empty gives null."""
    d = F.trim(raw)
    return F.when(d == "", None).when(d.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))).otherwise(d)


def to_day(compact: Column, dash: Column, epoch: Column) -> Column:
    """The first that is a date: YYYYMMDD, YYYY-MM-DD, seconds since 1970 (UTC)."""
    a = F.when(compact.rlike("^[0-9]{8}$"), F.try_to_timestamp(compact, F.lit("yyyyMMdd")).cast("date"))
    b = F.when(dash.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(dash, F.lit("yyyy-MM-dd")).cast("date"))
    return F.coalesce(a, b, F.timestamp_seconds(epoch).cast("date"))


def days_apart(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def shown(day: Column) -> Column:
    """DD.MM.YYYY of YYYY-MM-DD, anything else as it is."""
    return F.when(day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.concat_ws(".", F.substring(day, 9, 2), F.substring(day, 6, 2), F.substring(day, 1, 4))).otherwise(day)


def in_window(day: Column, since: str | None, until: str | None) -> Column:
    """Inclusive on text dates; blank dates pass, open ends do not limit."""
    ok = F.lit(True)
    if since:
        ok = ok & (day >= since)
    if until:
        ok = ok & (day <= until)
    return (F.coalesce(F.trim(day), F.lit("")) == "") | ok


def utc_stamp(raw: Column, otherwise: Column) -> Column:
    """ISO text to UTC, whole seconds, Z at the end; without a zone it is UTC; what cannot be read takes otherwise."""
    t = F.coalesce(F.try_to_timestamp(raw), otherwise)
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
