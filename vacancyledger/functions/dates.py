"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_ws

_TIME = r"([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d([.,]\d+)?)?|[0-5]\d([0-5]\d([.,]\d+)?)?)?"
_ZONE = r"([+-]([01]\d|2[0-3])(:?[0-5]\d(:?[0-5]\d([.,]\d+)?)?)?)?"
_TAIL = rf"(.{_TIME}{_ZONE})?$"
_DASHED = rf"(?s)^(?!0000)\d{{4}}-\d{{2}}-\d{{2}}{_TAIL}"
_COMPACT = rf"(?s)^(?!0000)\d{{8}}{_TAIL}"
_WEEK = rf"(?s)^(?!0000)(\d{{4}})-?W(0[1-9]|[1-4]\d|5[0-3])-?([1-7])?{_TAIL}"


def parse_iso_date(col: Column) -> Column:
    """Calendar date of an ISO date or date-time exactly as written, else null."""
    text = F.replace(strip_ws(col.cast("string")), F.lit("Z"), F.lit("+00:00"))
    compact = F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))
    year = F.regexp_extract(text, _WEEK, 1).try_cast("int")
    week = F.regexp_extract(text, _WEEK, 2).try_cast("int")
    day = F.coalesce(F.regexp_extract(text, _WEEK, 3).try_cast("int"), F.lit(1))
    january4 = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-01-04")).try_cast("date")
    week_day = F.date_add(F.trunc(january4, "week"), (week - 1) * 7 + day - 1)
    # Week 53 exists only when its Thursday still lies in the year.
    thursday = F.date_add(F.trunc(january4, "week"), (week - 1) * 7 + 3)
    return (
        F.when(text.rlike(_DASHED), F.substring(text, 1, 10).try_cast("date"))
        .when(text.rlike(_COMPACT), compact.try_cast("date"))
        .when(text.rlike(_WEEK) & (F.year(thursday) == year), week_day)
    )


def next_boundary(ts: Column, seconds: int = 21_600) -> Column:
    """Next multiple of ``seconds`` since the epoch, strictly after ``ts``."""
    epoch = F.unix_seconds(ts.cast("timestamp"))
    return F.timestamp_seconds((F.floor(epoch / F.lit(seconds)) + 1) * seconds)
