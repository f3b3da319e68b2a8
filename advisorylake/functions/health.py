"""Source health labels."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from advisorylake.functions.dates import ts
from advisorylake.functions.text import strip


def coarse_error(message: Column) -> Column:
    """Leading identifier of the first line, so paths and hosts never leak."""
    first = strip(F.regexp_extract(strip(message), r"^([^\r\n]*)", 1))
    label = F.regexp_extract(first, r"(?U)^[A-Za-z_][\w.]{0,39}", 0)
    return F.when(message != "", F.when(label != "", label).otherwise("error"))


def age_seconds(moment: Column, as_of: dt.datetime) -> Column:
    return F.greatest(
        F.lit(0), F.floor((F.unix_micros(ts(as_of)) - F.unix_micros(moment)) / 1e6)
    ).cast("long") + F.when(moment.isNull(), None).otherwise(0)


def stale_after(cadence_seconds: Column) -> Column:
    return F.greatest(cadence_seconds * 2, F.lit(900))


def source_state(as_of: dt.datetime, *, name: Column, enabled: Column, cadence: Column,
                 last_success: Column, last_error: Column, active: list[str] = (),
                 queued: list[str] = ()) -> Column:
    error_is_current = last_error.isNotNull() & (
        last_success.isNull() | (last_error >= last_success))
    return (F.when(~enabled, "disabled")
            .when(name.isin(list(active)), "active")
            .when(name.isin(list(queued)), "queued")
            .when(error_is_current, "error")
            .when(last_success.isNull(), "never")
            .when(age_seconds(last_success, as_of) > stale_after(cadence), "stale")
            .otherwise("ok"))
