"""Date and time functions with PostgreSQL semantics.

Intervals travel as structs of months, days and micros, which Parquet can hold; see interval().
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.base import col, val

MICROS = {"microseconds": 1, "milliseconds": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}
_UNIT = {"us": "microseconds", "ms": "milliseconds", "s": "second", "sec": "second", "m": "minute", "min": "minute", "h": "hour", "hr": "hour", "d": "day", "w": "week", "mon": "month", "y": "year", "yr": "year"}


def _unit(name: str) -> str:
    name = name.lower()
    for form in (name, name.removesuffix("s")):
        if form in _UNIT:
            return _UNIT[form]
        if form in MICROS or form in ("month", "quarter", "year", "decade", "century", "centurie", "millennium", "millennia"):
            return {"centurie": "century", "millennia": "millennium"}.get(form, form)
    return {"microsecond": "microseconds", "millisecond": "milliseconds"}.get(name, name)


def interval(text: str) -> Column:
    """An interval literal such as '1 year 2 mons 3 days 04:05:06' as struct of months, days, micros."""
    months = days = micros = 0
    for number, unit in re.findall(r"([+-]?\d+(?:\.\d+)?)\s*([a-zA-Z]+)", text):
        n, u = float(number), _unit(unit)
        if u in ("month", "quarter", "year", "decade", "century", "millennium"):
            months += round(n * {"month": 1, "quarter": 3, "year": 12, "decade": 120, "century": 1200, "millennium": 12000}[u])
        elif u in ("day", "week"):
            whole = n * (7 if u == "week" else 1)
            days += int(whole)
            micros += round((whole - int(whole)) * MICROS["day"])
        else:
            micros += round(n * MICROS[u])
    if m := re.search(r"([+-]?)(\d+):(\d\d)(?::(\d\d(?:\.\d+)?))?", text):
        clock = int(m[2]) * MICROS["hour"] + int(m[3]) * MICROS["minute"] + round(float(m[4] or 0) * MICROS["second"])
        micros += -clock if m[1] == "-" else clock
    return make_interval(F.lit(months), F.lit(days), F.lit(micros))


def make_interval(months, days, micros) -> Column:
    return F.struct(val(months).cast("int").alias("months"), val(days).cast("int").alias("days"), val(micros).cast("long").alias("micros"))


def interval_micros(i: Column) -> Column:
    """Length of an interval for comparisons: a month counts 30 days."""
    return (i["months"].cast("long") * 30 + i["days"]) * MICROS["day"] + i["micros"]


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _from_micros(micros: Column, like: Column | None = None) -> Column:
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def plus(ts, i: Column, sign: int = 1) -> Column:
    """A timestamp and an interval: first months, kept in the month, then days, then time."""
    ts = col(ts).cast("timestamp_ntz")
    day = F.to_date(ts)
    moved = F.date_add(F.add_months(day, sign * i["months"]), sign * i["days"])
    clock = _micros(ts) - _micros(day.cast("timestamp_ntz"))
    return _from_micros(_micros(moved.cast("timestamp_ntz")) + clock + sign * i["micros"])


def minus(ts, i: Column) -> Column:
    return plus(ts, i, -1)


date_add, date_subtract = plus, minus


def difference(a, b) -> Column:
    """a - b of two timestamps: days and time."""
    gap = _micros(val(a).cast("timestamp_ntz")) - _micros(val(b).cast("timestamp_ntz"))
    days = F.when(gap >= 0, F.floor(gap / MICROS["day"])).otherwise(F.ceil(gap / MICROS["day"])).cast("long")
    return make_interval(F.lit(0), days, gap - days * MICROS["day"])


def age(a, b=None) -> Column:
    """a - b in years and months, days and time, as one counts on a calendar; b is by default today's midnight."""
    if b is None:
        a, b = F.current_date().cast("timestamp_ntz"), a
    a, b = val(a).cast("timestamp_ntz"), val(b).cast("timestamp_ntz")
    swap = a < b
    hi, lo = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    whole = ((F.year(hi) - F.year(lo)) * 12 + F.month(hi) - F.month(lo)).cast("int")
    lo_day, hi_day = F.dayofmonth(lo), F.dayofmonth(hi)
    midnight = lambda t: _micros(t) - _micros(F.to_date(t).cast("timestamp_ntz"))
    time = midnight(hi) - midnight(lo)
    days = (hi_day - lo_day - F.when(time < 0, 1).otherwise(0)).cast("int")
    time = F.when(time < 0, time + MICROS["day"]).otherwise(time)
    # days are borrowed from the month of the earlier date
    borrow = F.dayofmonth(F.last_day(F.to_date(lo)))
    months = whole - F.when(days < 0, 1).otherwise(0)
    days = F.when(days < 0, days + borrow).otherwise(days)
    sign = F.when(swap, -1).otherwise(1)
    return make_interval(months * sign, days * sign, time * sign)


def justify_hours(i: Column) -> Column:
    more = F.floor(i["micros"] / MICROS["day"])
    return make_interval(i["months"], i["days"] + more, i["micros"] - more * MICROS["day"])


def justify_days(i: Column) -> Column:
    more = F.floor(i["days"] / 30)
    return make_interval(i["months"] + more, i["days"] - more * 30, i["micros"])


def justify_interval(i: Column) -> Column:
    return justify_days(justify_hours(i))


def date_bin(stride: str, ts, origin="2001-01-01 00:00:00") -> Column:
    """Start of the stride, counted from the origin, in which a timestamp lies."""
    m = re.match(r"\s*(\d+(?:\.\d+)?)\s*(\w+)", stride)
    width = round(float(m[1]) * MICROS[_unit(m[2])])
    start = _micros(F.lit(origin).cast("timestamp_ntz") if isinstance(origin, str) else origin)
    return _from_micros(start + F.floor((_micros(col(ts)) - start) / F.lit(width)) * width)


def date_trunc(unit: str, ts) -> Column:
    ts = col(ts)
    unit = _unit(unit)
    if unit in ("decade", "century", "millennium"):
        span = {"decade": 10, "century": 100, "millennium": 1000}[unit]
        # centuries begin with the year 1
        first = F.floor((F.year(ts) - (unit != "decade")) / span) * span + int(unit != "decade")
        return F.make_date(first.cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    return F.date_trunc({"microseconds": "microsecond", "milliseconds": "millisecond"}.get(unit, unit), ts).cast("timestamp_ntz")


def extract(field: str, x) -> Column:
    """A field of a date or timestamp; dow counts from Sunday as 0, isodow from Monday as 1."""
    x, field = col(x), field.lower()
    ts = x.cast("timestamp_ntz")
    clock = lambda: _micros(ts) - _micros(F.date_trunc("minute", ts).cast("timestamp_ntz"))
    of = {
        "year": lambda: F.year(ts),
        "isoyear": lambda: F.extract(F.lit("YEAROFWEEK"), ts),
        "month": lambda: F.month(ts),
        "day": lambda: F.dayofmonth(ts),
        "hour": lambda: F.hour(ts),
        "minute": lambda: F.minute(ts),
        "second": lambda: clock() / 1_000_000,
        "milliseconds": lambda: clock() / 1_000,
        "microseconds": clock,
        "dow": lambda: F.dayofweek(ts) - 1,
        "isodow": lambda: F.weekday(ts) + 1,
        "doy": lambda: F.dayofyear(ts),
        "week": lambda: F.weekofyear(ts),
        "quarter": lambda: F.quarter(ts),
        "decade": lambda: F.floor(F.year(ts) / 10),
        "century": lambda: F.floor((F.year(ts) + 99) / 100),
        "millennium": lambda: F.floor((F.year(ts) + 999) / 1000),
        "epoch": lambda: _micros(ts) / 1_000_000,
        "julian": lambda: F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")) + 2440588 + (_micros(ts) - _micros(F.to_date(ts).cast("timestamp_ntz"))) / MICROS["day"],
    }
    return of[field]()


def date_part(field: str, x) -> Column:
    return extract(field, x).cast("double")


def extract_interval(field: str, i: Column) -> Column:
    field = field.lower()
    of = {
        "year": lambda: (i["months"] / 12).cast("int"),
        "month": lambda: i["months"] % 12,
        "day": lambda: i["days"],
        "hour": lambda: (i["micros"] / MICROS["hour"]).cast("long"),
        "minute": lambda: (i["micros"] % MICROS["hour"] / MICROS["minute"]).cast("long"),
        "second": lambda: i["micros"] % MICROS["minute"] / 1_000_000,
        # a year counts 365.25 days
        "epoch": lambda: ((i["months"] / 12).cast("int") * 365.25 + i["months"] % 12 * 30 + i["days"]) * 86400 + i["micros"] / 1_000_000,
    }
    return of[field]()


def overlaps(s1, e1, s2, e2) -> Column:
    """Whether two periods share a moment; their ends count as outside, unless a period is one moment."""
    a, b, c, d = (val(x) for x in (s1, e1, s2, e2))
    lo1, hi1, lo2, hi2 = F.least(a, b), F.greatest(a, b), F.least(c, d), F.greatest(c, d)
    return (lo1 < hi2) & (lo2 < hi1) | (lo1 == lo2)


def make_date(y, m, d) -> Column:
    return F.make_date(val(y), val(m), val(d))


def make_timestamp(y, mo, d, h, mi, s) -> Column:
    return F.make_timestamp_ntz(val(y), val(mo), val(d), val(h), val(mi), val(s).cast("decimal(16,6)"))


def make_timestamptz(y, mo, d, h, mi, s, zone: str | None = None) -> Column:
    args = (val(y), val(mo), val(d), val(h), val(mi), val(s).cast("decimal(16,6)"))
    return F.make_timestamp_ltz(*args, *([F.lit(zone)] if zone else []))


def timezone(zone: str, ts, aware: bool = False) -> Column:
    """AT TIME ZONE: a local time of a zone as a moment, or (``aware``) a moment as the zone's local time."""
    ts = col(ts)
    if aware:
        return F.convert_timezone(F.current_timezone(), F.lit(zone), ts.cast("timestamp_ntz"))
    return F.convert_timezone(F.lit(zone), F.current_timezone(), ts.cast("timestamp_ntz")).cast("timestamp")


def now() -> Column:
    return F.current_timestamp()


def current_date() -> Column:
    return F.current_date()


def current_time() -> Column:
    return F.date_format(F.current_timestamp(), "HH:mm:ss.SSSSSS")


def localtimestamp() -> Column:
    return F.localtimestamp()


#: Patterns of to_char and Java's for the same, longest first.  Fixed values.
PATTERNS = (
    ("HH24", "HH"), ("HH12", "hh"), ("YYYY", "yyyy"), ("YYY", "yyy"), ("IYYY", "YYYY"), ("MONTH", "MMMM"), ("Month", "MMMM"), ("month", "MMMM"),
    ("DAY", "EEEE"), ("Day", "EEEE"), ("day", "EEEE"), ("MON", "MMM"), ("Mon", "MMM"), ("mon", "MMM"), ("DDD", "DDD"), ("DY", "EEE"), ("Dy", "EEE"), ("dy", "EEE"),
    ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("US", "SSSSSS"), ("YY", "yy"), ("MM", "MM"), ("DD", "dd"), ("AM", "a"), ("PM", "a"), ("am", "a"), ("pm", "a"), ("TZ", "zzz"), ("Q", "q"), ("D", "e"),
)


def java_pattern(pattern: str) -> list[tuple[str, str]]:
    """Pieces of a pattern: (kind, Java pattern or text); kinds tell case and padding."""
    out, i, fill = [], 0, True
    while i < len(pattern):
        if pattern[i] == '"':
            end = pattern.index('"', i + 1)
            out.append(("text", pattern[i + 1 : end]))
            i = end + 1
        elif pattern.startswith("FM", i):
            fill, i = False, i + 2
        else:
            for p, j in PATTERNS:
                if pattern.startswith(p, i) or pattern[i : i + len(p)].upper() == p and p not in ("D", "Q"):
                    name = j in ("MMMM", "EEEE", "MMM", "EEE", "a")
                    case = "upper" if name and p.isupper() else "lower" if name and p.islower() else "name" if name else "number"
                    out.append((case + ("" if fill or j in ("MMM", "EEE", "a") else "-trim") + ("-long" if j in ("MMMM", "EEEE") and fill else ""), j))
                    i += len(p)
                    break
            else:
                out.append(("text", pattern[i]))
                i += 1
    return out


def to_char(x, pattern: str) -> Column:
    """A timestamp by a pattern.  Names take the pattern's case and are padded to 9 places unless it says FM."""
    ts, parts = col(x).cast("timestamp_ntz"), []
    for kind, p in java_pattern(pattern):
        if kind == "text":
            parts.append(F.lit(p))
        elif p == "e":
            parts.append(F.dayofweek(ts).cast("string"))
        else:
            c = F.date_format(ts, p)
            if kind.startswith("upper"):
                c = F.upper(c)
            if kind.startswith("lower"):
                c = F.lower(c)
            if "trim" in kind and kind.startswith("number"):
                c = F.regexp_replace(c, "^0+(?=.)", "")
            if kind.endswith("long"):
                c = F.rpad(c, 9, " ")
            parts.append(c)
    return F.concat(*parts) if parts else F.lit("")


def to_char_number(x, pattern: str) -> Column:
    """A number by a pattern of 9, 0, comma, point, FM, MI and S: leading places are blank, one more is for the sign."""
    trim = pattern.startswith("FM")
    body = pattern.removeprefix("FM")
    x = col(x)
    signs = re.sub("[^MIS]", "", body)
    digits = re.sub("[MIS]", "", body)
    whole, _, part = digits.partition(".")
    rounded = F.round(F.abs(x).cast("decimal(38,10)"), len(part))
    places = len(whole.replace(",", ""))
    zeros = places - whole.replace(",", "").index("0") if "0" in whole else (0 if whole else 1)
    text = F.format_number(rounded.cast("double"), len(part)) if "," in whole else F.regexp_replace(F.format_number(rounded.cast("double"), len(part)), ",", "")
    lead = F.regexp_extract(text, r"^([^.]*)", 1)
    tail = F.regexp_extract(text, r"(\..*)?$", 0)
    lead = F.when((lead == "0") & F.lit(zeros == 0 and bool(part)), F.lit("")).otherwise(lead)
    if zeros:
        lead = F.when(F.length(lead) < zeros, F.lpad(lead, zeros, "0")).otherwise(lead)
    if trim:
        kept = F.regexp_replace(tail, "0+$", "") if "0" not in part else tail
        number = F.concat(lead, kept)
    else:
        number = F.concat(lead, tail)
    sign = F.when(x < 0, "-").otherwise("" if trim else " ") if not signs else F.lit("")
    made = F.concat(sign, number)
    width = len(digits) + (0 if signs else 1)
    if "MI" in signs:
        made = F.concat(number if trim else F.lpad(number, len(digits), " "), F.when(x < 0, "-").otherwise("" if trim else " "))
    elif "S" in signs:
        made = F.concat(F.when(x < 0, "-").otherwise("+"), number)
        width += 1
    over = F.length(F.replace(lead, F.lit(","), F.lit(""))) > places
    out = made if trim or "MI" in signs else F.lpad(made, width, " ")
    return F.when(over, F.concat(F.lit(" " if not trim else ""), F.lit(re.sub("[09]", "#", digits)))).otherwise(out)


def _read_pattern(pattern: str) -> str:
    return "".join(("'" + p.replace("'", "''") + "'" if p.isalpha() else p) if kind == "text" else p for kind, p in java_pattern(pattern))


def to_date(x, pattern: str) -> Column:
    return F.to_date(col(x), _read_pattern(pattern))


def to_timestamp(x, pattern: str | None = None) -> Column:
    """Seconds since 1970 as a moment, or a text by a pattern."""
    if pattern is None:
        return F.timestamp_micros(F.round(col(x).cast("double") * 1_000_000).cast("long"))
    return F.to_timestamp(col(x), F.lit(_read_pattern(pattern)))


def current_timestamp(precision: int = 6) -> Column:
    """The statement's moment, cut to some digits of a second."""
    step = 10 ** (6 - precision)
    return F.timestamp_micros(F.floor(F.unix_micros(F.current_timestamp()) / step) * step)


def localtime(precision: int = 6) -> Column:
    return F.date_format(current_timestamp(precision), "HH:mm:ss" + ("." + "S" * precision if precision else ""))


@F.pandas_udf(T.TimestampType())
def _clock(x: pd.Series) -> pd.Series:
    return pd.Series([pd.Timestamp.now(tz="UTC") for _ in range(len(x))])


def clock_timestamp() -> Column:
    """The moment at which a row is made, which moves on within a statement."""
    return _clock.asNondeterministic()(F.rand())


def timeofday() -> Column:
    return F.date_format(F.current_timestamp(), "EEE MMM dd HH:mm:ss.SSSSSS yyyy z")
