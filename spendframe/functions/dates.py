"""Dates in mixed notations, read without any formatter or session time zone.

Every notation is rewritten to ISO text, which Spark casts on a fast path that never
throws; a chain of format attempts would raise and catch one exception per miss. The
usual numeric notations are recognised by one pattern. All others go through a small
grammar: the text is cut into date and time, the date's runs of digits and its month
name become a signature such as ``n-m-y``, and a table says what each run means.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendframe.functions.text import strip

# Years that need no further look; all others go through the grammar, which knows the limits.
_YEAR = r"(?:1[7-9]|2[01])\d\d"
_TIME = r"(?:[T ]\s*(\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?))?"
_DAY_MONTH_YEAR = rf"(\d{{1,2}})[-/.](\d{{1,2}})[-/.]({_YEAR})"
_NUMERIC = (
    rf"\A(?:({_YEAR})[-/.](\d{{1,2}})[-/.](\d{{1,2}})|({_YEAR})(\d{{2}})(\d{{2}})|{_DAY_MONTH_YEAR}){_TIME}\z"
)
_ISO = rf"\A{_YEAR}-\d\d-\d\d(?:[T ]\d\d:\d\d:\d\d(?:\.\d{{1,6}})?)?\z"

_MONTH_NAMES = "january february march april may june july august september october november december".split()
_MONTH_STARTS = "".join(name[:3] for name in _MONTH_NAMES)
_MONTH = "(?<![a-z])(" + "|".join(
    name if len(name) == 3 else f"{name[:3]}t?(?:ember)?" if name == "september" else f"{name[:3]}(?:{name[3:]})?"
    for name in _MONTH_NAMES
) + ")(?![a-z])"
_WEEKDAY = r"\A(?:mon|tues?(?=day)|tue|wed(?:nes(?=day))?|thu(?:rs(?=day))?|fri|sat(?:ur(?=day))?|sun)(?:day)?[., ]+"
_ORDINAL = r"(\d)(?:st|nd|rd|th)(?![a-z])(?: of(?![a-z]))?"
_QUARTER = r"\A(?:(\d{4})-?q([1-4])|([1-4])q(\d{4}))\z"
_CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?"
_ZONE = r"Z|UTC|GMT|[+-]\d{2}(?::?\d{2})?|(?-i:[A-Z]{3,5})"
# An hour needs minutes, AM or PM, or a full ISO date before it; else it could be a year.
_WITH_TIME = (
    r"(?i)\A(.+?)(?:[ T,]+(?:at )?"
    r"(?:(?=\d{1,2}(?::| ?[ap]m))|(?<=\A\d{4}-\d{2}-\d{2}[ T])(?=\d{2}\z))"
    rf"(\d{{1,2}})(?::(\d{{2}})(?::(\d{{0,2}})(?:(\.\d{{1,9}})|,\d+)?)?)? ?([ap]m)?(?: ?({_ZONE}))?)?\z"
)
_MAY_HAVE_TIME = r"(?i):|\d ?[ap]m|[T ]\d\d\z"
_COMPACT = r"(?i)\A(\d{4})(\d{2})(\d{2})[T ]?(\d{2})(\d{2})(\d{2})?\z"
# Notations with the time before the year, or before the date, and how they are put in order.
_TIME_FIRST = [
    (rf"(?i)\A(.*[a-z].*\d) ({_CLOCK})(?: (?:UTC|GMT))? (\d{{4}})\z", "$1 $3 $2"),
    (rf"\A({_CLOCK}) (.*\d)\z", "$2 $1"),
]
# What the runs of digits mean, by signature: ``n`` one or two digits, ``y`` four, ``m``
# a month name. Three readings each: if the first run is over 31, over 12, or neither.
_READINGS = {
    "y-n-n": ("ymd", "ymd", "ymd"),
    "n-n-y": ("dmy", "dmy", "mdy"),
    "n-n-n": ("ymd", "dmy", "mdy"),
    "y-n": ("ym", "ym", "ym"),
    "n-y": ("my", "my", "my"),
    "y": ("y", "y", "y"),
    "n-m-y": ("dy", "dy", "dy"),
    "m-n-y": ("dy", "dy", "dy"),
    "y-m-n": ("yd", "yd", "yd"),
    "m-y-n": ("yd", "yd", "yd"),
    "n-m-n": ("yd", "dy", "dy"),
    "m-n-n": ("yd", "dy", "dy"),
    "m-y": ("y", "y", "y"),
    "y-m": ("y", "y", "y"),
}
# The first and last moment that dates are taken for.
_FIRST, _LAST = "1677-09-21 00:12:43.145225", "2262-04-11 23:47:16.854775"


def _ntz(text: Column) -> Column:
    return F.rtrim(text).try_cast("timestamp_ntz")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once.

    A lambda is not part of the generated code, which keeps that small enough for the
    JVM to compile; only unusual notations pay for it.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _replaced(text: Column, *rules: tuple[str, str]) -> Column:
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def _clock(parts: Column) -> Column:
    """``hh:mm:ss.f`` of the parts of a text; null for an impossible hour before AM or PM."""
    hour, half = F.get(parts, F.lit(1)), F.lower(F.get(parts, F.lit(5)))
    twelve = F.when(hour.cast("int") <= 12, hour.cast("int") % 12 + F.when(half == "pm", 12).otherwise(0))

    def two(place: int) -> Column:
        value = F.get(parts, F.lit(place))
        return F.when(value == "", F.lit("00")).otherwise(value)

    return F.when(hour == "", F.lit("00:00:00")).otherwise(F.concat(
        F.when(half == "", hour).otherwise(twelve.cast("string")), F.lit(":"), two(2), F.lit(":"), two(3),
        F.get(parts, F.lit(4))))


def _zone_minutes(zone: Column) -> Column:
    """Minutes that a numeric zone is ahead of UTC; 0 for a name."""
    digits = F.translate(zone, "+-:", "")
    minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    return F.when(zone.startswith("-"), -minutes).when(zone.startswith("+"), minutes).otherwise(0)


def _month_number(date: Column) -> Column:
    """Place of the month named in a text, 0 without any."""
    letters = F.substring(F.regexp_extract(date, _MONTH, 1), 1, 3)
    return F.floor((F.instr(F.lit(_MONTH_STARTS), letters) + 2) / 3).cast("int")


def _day(date: Column) -> Column:
    """``y-m-d`` of the date part in lower case, null if it has none of the known signatures."""
    lettered = date.rlike("[a-z]")
    quarter = F.concat(_replaced(date, (_QUARTER, "$1$4")), F.lit("-"),
                       (_replaced(date, (_QUARTER, "$2$3")).try_cast("int") * 3 - 2).cast("string"))
    plain = F.when(lettered, _replaced(date, (_WEEKDAY, ""), (_ORDINAL, "$1"), (_MONTH, "-m-"))).otherwise(date)
    runs = F.btrim(_replaced(plain, (r"[-/., ']+", "-")), F.lit("-"))
    runs = F.when(runs.contains("-"), runs).otherwise(_replaced(runs, (r"\A(\d{2}|\d{4})(\d{2})(\d{2})\z", "$1-$2-$3")))
    readings = F.create_map(*[part for signature, orders in _READINGS.items()
                              for part in (F.lit(signature), F.array(*map(F.lit, orders)))])

    def read(text: Column) -> Column:
        signature = _replaced(text, (r"(?<!\d)\d{1,2}(?!\d)", "n"), (r"(?<!\d)\d{4}(?!\d)", "y"))
        fields = F.array_remove(F.split(text, "-"), "m")
        first = F.get(fields, F.lit(0)).try_cast("int")
        size = F.when(first > 31, 0).when(first > 12, 1).otherwise(2)
        return _let(F.get(F.try_element_at(readings, signature), size),
                    lambda order: F.when(order.isNotNull(), _let(fields, lambda parts: ordered(parts, order))))

    def ordered(fields: Column, order: Column) -> Column:
        def part(letter: str) -> Column:
            return F.get(fields, F.instr(order, letter) - 1)

        month = F.when(order.contains("m"), part("m")).when(lettered, F.nullif(_month_number(date), F.lit(0)).cast("string")).otherwise("1")
        return F.concat(_let(part("y"), _year), F.lit("-"), month, F.lit("-"), F.coalesce(part("d"), F.lit("1")))

    return _let(F.when(date.contains("q"), quarter).otherwise(runs), read)


def _year(text: Column) -> Column:
    """Four digits; a year of two is the one within 50 years of the current one."""
    this_year = F.year(F.current_date())
    near = text.try_cast("int") + F.floor(this_year / 100) * 100
    near = F.when(near >= this_year + 50, near - 100).when(near < this_year - 50, near + 100).otherwise(near)
    return F.when(F.length(text) > 2, text).otherwise(near.cast("string"))


def _unusual(value: Column) -> Column:
    """A date in any notation of the grammar."""

    def cut(text: Column) -> Column:
        in_order = F.when(text.contains(":"), _replaced(text, *_TIME_FIRST)).otherwise(text)
        timed = F.split(_replaced(in_order, (_WITH_TIME, "$1|$2|$3|$4|$5|$6|$7")), r"\|", -1)
        return _let(F.when(text.rlike(_MAY_HAVE_TIME), timed).otherwise(F.array(text, *[F.lit("")] * 6)), moment)

    def moment(parts: Column) -> Column:
        text = F.concat(_let(F.lower(F.get(parts, F.lit(0))), _day), F.lit(" "), _clock(parts))
        zone = F.get(parts, F.lit(6))
        edges = [F.lit(edge).cast("timestamp_ntz") for edge in (_FIRST, _LAST)]
        return _let(text.try_cast("timestamp_ntz"), lambda found: F.when(found.between(*edges), F.when(zone == "", found).otherwise(
            F.timestamp_add("MINUTE", -_zone_minutes(zone), found))))

    spaced = F.when(value.rlike(r"\s\s|[^\S ]"), _replaced(value, (r"\s+", " "))).otherwise(value)
    return _let(F.when(value.rlike(r"\A\d{8}"), _replaced(spaced, (_COMPACT, "$1-$2-$3 $4:$5:$6"))).otherwise(spaced), cut)


def parse_date(text: Column) -> Column:
    """``TIMESTAMP_NTZ`` for any supported notation, null for anything else.

    Year, month and day in figures with hyphens, slashes, dots or blanks, year first, or
    month first unless that is impossible; years of two digits, within 50 years of the
    current one; compact ``yyyyMMdd``, with or without a time; English month names, long
    or short, in any place, with ordinals and weekdays; month and year, year and quarter,
    or a year, for their first day. A time of day may follow (or precede), with AM or PM
    and with a zone: with an offset the result is in UTC, and a zone's name is ignored.
    Moments outside the years 1677 to 2262 are null.

    The alternatives of the first pattern share their replacement (a group that did not
    take part is empty in it), which keeps the generated code small.
    """
    value = strip(text)
    month_first = F.regexp_replace(value, _NUMERIC, "$1$4$9-$2$5$7-$3$6$8 $10")
    day_first = F.regexp_replace(value, rf"\A{_DAY_MONTH_YEAR}{_TIME}\z", "$3-$2-$1 $4")
    # Plain ISO text, the most common, is cast as it is.
    return (
        F.when(value.rlike(_ISO), value.try_cast("timestamp_ntz"))
        .when(value.rlike(_NUMERIC), F.coalesce(_ntz(month_first), _ntz(day_first)))
        .when(value.rlike(r"\d"), _let(value, _unusual))
    )


def as_timestamp(column: Column, data_type: str) -> Column:
    """A date column of any type as ``TIMESTAMP_NTZ``.

    Text goes through :func:`parse_date`; whole numbers are read as ``yyyyMMdd``.
    """
    if data_type in ("date", "timestamp", "timestamp_ntz"):
        return column.cast("timestamp_ntz")
    if data_type != "string":
        column = column.cast("decimal(20,0)").cast("string")
    return parse_date(column)
