"""Dates as the data model keeps them: YYYYMMDD integers with zeroed parts, and epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = r"^\s*(\d{4})/(\d{2})/(\d{2}) \([A-Za-z]{3}\) (\d{2}):(\d{2})\s*$"


def event_date(text: Column) -> Column:
    """struct(t_event, t_prec) of 'YYYY-MM-DD', 'YYYY-MM' or 'YYYY'; (0, 'none') for anything else and null. Calendars aren't checked."""
    digits = F.regexp_replace(text, "-", "")
    day, month, year = text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.rlike(r"^\d{4}-\d{2}$"), text.rlike(r"^\d{4}$")
    number = F.when(day, digits).when(month, F.concat(digits, F.lit("00"))).when(year, F.concat(digits, F.lit("0000"))).otherwise(F.lit("0"))
    precision = F.when(day, "day").when(month, "month").when(year, "year").otherwise("none")
    return F.struct(number.cast("int").alias("t_event"), precision.alias("t_prec"))


def session_stamp(text: Column, strict: bool = False) -> Column:
    """struct(ts, date_int) of 'YYYY/MM/DD (Ddd) HH:MM' in UTC; null for anything else, or with `strict` an error."""
    stamp = F.try_to_timestamp(F.regexp_replace(text, STAMP, "$1-$2-$3 $4:$5"), F.lit("yyyy-MM-dd HH:mm"))
    parsed = F.when(text.rlike(STAMP) & stamp.isNotNull(), F.struct(F.unix_timestamp(stamp).alias("ts"), F.date_format(stamp, "yyyyMMdd").cast("int").alias("date_int")))
    return F.when(parsed.isNotNull(), parsed).otherwise(F.raise_error(F.concat(F.lit("no session date: "), F.coalesce(text, F.lit("null"))))) if strict else parsed


def shown_date(number: Column) -> Column:
    """20231130 as '30 Nov 2023'; null where a part is missing."""
    return F.date_format(F.try_to_date(number.cast("string"), "yyyyMMdd"), "d MMM yyyy")
