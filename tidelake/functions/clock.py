"""Time as whole microseconds, without any time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Layouts of times in text without a zone, in the order in which they are tried; fixed values.
LAYOUTS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss")
_ZONED = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"
_FRACTION = r"(:\d\d)\.(\d+)$"
_CLOCK = r"\d\d:\d\d:\d\d(\.\d+)?"
#: RFC 3339 and all of LAYOUTS with years of four digits; a cast reads these once dashes stand in for slashes.
_COMMON = rf"^(\d{{4}}-\d\d-\d\d( {_CLOCK}|T{_CLOCK}(Z|[+-]\d\d:\d\d)?)|(\d{{4}}/\d\d/\d\d|\d\d/\d\d/\d{{4}}) {_CLOCK})\z"
#: Nothing else casts to a whole number or fits a layout. A failed cast or layout costs an exception, a failed pattern does not.
_DIGITS = r"^[\x00-\x20\x7F]*[+-]?0*\d{1,19}[\x00-\x20\x7F]*$"
_RARE = r"^[+-]?\d+[-/].*:\d\d(\.\d+)?$"


def micros(time: Column) -> Column:
    """Microseconds since 1970; the session's zone must be UTC for times without zone."""
    return F.unix_micros(time.cast("timestamp"))


def moment(micros: Column) -> Column:
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def epoch_bucket(time: Column, width: int) -> Column:
    """Start of the window of ``width`` microseconds, windows aligned to 1970."""
    at = micros(time)
    return at - F.pmod(at, F.lit(width))


def parse_time(text: Column) -> Column:
    """A time from nanoseconds in digits, RFC 3339 or one of ``LAYOUTS``; null where none fits.

    Seconds may have a fraction in every layout; digits beyond microseconds are cut off.
    """
    # A lambda, as its argument is computed once a row; written out, the text would be made at each of its uses.
    return F.get(F.transform(F.array(text), _read), F.lit(0))


def _read(text: Column) -> Column:
    return F.when(text.rlike(_COMMON), _dashed(text).try_cast("timestamp")).when(text.rlike(_DIGITS), _nanos(text)).when(text.rlike(_RARE), _layout(text)).when(text.rlike(_ZONED), text.try_cast("timestamp")).cast("timestamp_ntz")


def _dashed(text: Column) -> Column:
    """A text of ``_COMMON`` with its date as year-month-day; of two leading numbers the first is the month if it can be."""
    first, second = F.substring(text, 1, 2), F.substring(text, 4, 2)
    month, day = F.when(first <= "12", first).otherwise(second), F.when(first <= "12", second).otherwise(first)
    year_last = F.concat(F.substring(text, 7, 4), F.lit("-"), month, F.lit("-"), day, F.substr(text, F.lit(11)))
    return F.when(F.substring(text, 5, 1) == "/", F.translate(text, "/", "-")).when(F.substring(text, 3, 1) == "/", year_last).otherwise(text)


def _nanos(text: Column) -> Column:
    nanos = text.try_cast("bigint")
    below = F.when((nanos < 0) & (nanos % 1000 != 0), 1).otherwise(0)
    return F.timestamp_micros(F.call_function("div", nanos, F.lit(1000)) - below)


def _layout(text: Column) -> Column:
    plain = F.regexp_replace(text, _FRACTION, "$1")
    layout = F.coalesce(*[F.try_to_timestamp(plain, F.lit(x)) for x in LAYOUTS])
    part = F.rpad(F.substring(F.regexp_extract(text, _FRACTION, 2), 1, 6), 6, "0").cast("long")
    return F.timestamp_micros(F.unix_micros(layout) + part)
