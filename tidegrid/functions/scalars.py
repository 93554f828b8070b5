"""Scalar expressions: times, horizons, names.

Times are epoch milliseconds (UTC).  Conversions go through zone-less timestamps, so that
results do not depend on the time zone of the session.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.params import DAY_MS, HOUR_MS, MINUTE_MS

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _named(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ntz_to_ms(name: str) -> Column:
    """Milliseconds of a zone-less timestamp column that holds UTC.

    Put together from its fields: a difference of timestamps would go through the session's
    time zone and its clock changes.
    """
    ts = F.col(name)
    day = F.unix_date(F.to_date(ts)).cast("long") * F.lit(DAY_MS)
    clock = (F.hour(ts) * 60 + F.minute(ts)).cast("long") * F.lit(MINUTE_MS)
    return day + clock + F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("long")


def ms_to_ntz(ms: Column | str) -> Column:
    return F.timestamp_add("MILLISECOND", _named(ms).cast("long"), F.expr(_EPOCH))


def ms_to_iso(ms: Column | str) -> Column:
    """ISO-8601 with milliseconds and a trailing Z."""
    return F.date_format(ms_to_ntz(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_to_ms(text: Column | str) -> Column:
    """Null where the text is no ISO time; a text without zone is read as UTC."""
    t = _named(text)
    zoned = F.when(t.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), t).otherwise(F.concat(t, F.lit("Z")))
    return F.unix_millis(F.try_to_timestamp(zoned))


def ms_to_date(ms: Column | str) -> Column:
    return F.to_date(ms_to_ntz(ms))


def month_start_ms(ms: Column | str) -> Column:
    month = F.trunc(ms_to_date(ms), "month")
    return F.unix_date(month).cast("long") * F.lit(DAY_MS)


def add_months_ms(month_ms: Column | str, months: int) -> Column:
    month = F.trunc(ms_to_date(month_ms), "month")
    return F.unix_date(F.add_months(month, months)).cast("long") * F.lit(DAY_MS)


def month_bounds(month_ms: Column | str, start_ms: int, end_ms: int) -> tuple[Column, Column]:
    """First and last millisecond of a month, clipped to the window [start, end)."""
    first = F.greatest(month_start_ms(month_ms), F.lit(start_ms))
    last = F.least(add_months_ms(month_ms, 1), F.lit(end_ms)) - F.lit(1)
    return first, last


def months_between(start_ms: int, end_ms: int) -> Column:
    """Array of month starts from the month of ``start_ms`` to that of ``end_ms``."""
    first = F.trunc(ms_to_date(F.lit(start_ms)), "month")
    last = F.trunc(ms_to_date(F.lit(end_ms)), "month")
    months = F.sequence(first, last, F.expr("interval 1 month"))
    return F.transform(months, lambda m: F.unix_date(m).cast("long") * F.lit(DAY_MS))


def days_between(first_date: Column, last_date: Column) -> Column:
    return F.sequence(first_date, last_date, F.expr("interval 1 day"))


def timeframe_ms(timeframe: Column | str) -> Column:
    """Length of a bar: '1m', '5m', '1h', '8h', '1d' and the like."""
    t = _named(timeframe)
    number = F.regexp_extract(t, r"^(\d+)", 1).cast("long")
    unit = F.substring(t, -1, 1)
    return number * (
        F.when(unit == "m", F.lit(MINUTE_MS)).when(unit == "h", F.lit(HOUR_MS)).when(unit == "d", F.lit(DAY_MS))
    )


def bars_per(timeframe: Column | str, span_ms: int) -> Column:
    return F.floor(F.lit(span_ms) / timeframe_ms(timeframe)).cast("int")


def horizon_bars(horizon: Column | str) -> Column:
    """'h+12' to 12; what cannot be read, or is below one, gives one."""
    text = F.lower(F.trim(_named(horizon)))
    number = F.when(text.startswith("h+"), F.trim(F.substring(text, 3, 20)).try_cast("int"))
    return F.greatest(F.lit(1), F.coalesce(number, F.lit(1)))


def short_event(event_type: Column | str) -> Column:
    return F.replace(_named(event_type), F.lit("EV_"), F.lit(""))


def event_id(symbol: str, timeframe: str, event_type: Column, ts: str) -> Column:
    """First sixteen hex digits of a SHA-1 over symbol, timeframe, type and time."""
    text = F.concat_ws("|", F.col(symbol), F.col(timeframe), event_type, F.col(ts).cast("string"))
    return F.substring(F.sha1(text), 1, 16)


def ratio(num: Column, den: Column) -> Column:
    """IEEE division: x/0 is infinite with the sign of x, 0/0 is missing."""
    return F.when(den != 0, num / den).when((den == 0) & (num != 0), num * F.lit(float("inf")))


def change(col: Column, before: Column) -> Column:
    """Relative change; missing when either side is missing."""
    return ratio(col, before) - F.lit(1.0)


def missing_to_null(col: str) -> Column:
    """NaN means missing in the sources; Spark would order it above every number."""
    return F.when(~F.isnan(F.col(col)), F.col(col))


def run_id_from_folder(folder: Column, fallback: Column) -> Column:
    """'BT0007_anything' to 'BT0007'; other names take 'BT' and the digits of the fallback."""
    found = F.regexp_extract(folder, r"^(BT\d{4})_", 1)
    return F.when(found != "", found).otherwise(F.concat(F.lit("BT"), F.ltrim(fallback, F.lit("H"))))


def split_window(text: Column) -> tuple[Column, Column]:
    """'start:end' at the first colon; a text without one gives two empty strings."""
    has = F.coalesce(F.instr(text, ":") > 0, F.lit(False))
    start = F.when(has, F.trim(F.substring_index(text, ":", 1))).otherwise(F.lit(""))
    end = F.when(has, F.trim(F.regexp_replace(text, r"^[^:]*:", ""))).otherwise(F.lit(""))
    return start, end


def unknown_timeframe(what: str) -> Column:
    """Fails the query with the timeframe that no table of parameters names."""
    return F.raise_error(F.concat(F.lit(f"no {what} for timeframe "), F.coalesce("timeframe", F.lit("null"))))
