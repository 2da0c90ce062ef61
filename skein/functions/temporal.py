"""Dates, times and durations.

Dates are DATE, local date-times TIMESTAMP without zone, date-times TIMESTAMP (an instant, shown
in UTC) or, where an offset or a zone was given, a struct of the instant, its offset in seconds and
the zone's name, times a count of nanoseconds with or without an offset, durations a struct of months,
days, seconds and nanoseconds.
"""

from __future__ import annotations

import datetime as dt
import re
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.errors import ArgumentError, QueryTypeError
from skein.functions.typed import (
    DATE, DURATION, INSTANT, LOCAL, LOCALTIME, LONG, STRING, TIME, ZONED, Typed, fields, is_duration, is_map, is_null, is_string, is_temporal, is_time, is_zoned, null,
)

KINDS = {"date": DATE, "localdatetime": LOCAL, "datetime": INSTANT, "localtime": LOCALTIME, "time": TIME}
SECONDS_PER_MONTH = 2629746
_UNITS = {"years": ("months", 12), "quarters": ("months", 3), "months": ("months", 1), "weeks": ("days", 7), "days": ("days", 1), "hours": ("seconds", 3600), "minutes": ("seconds", 60), "seconds": ("seconds", 1), "milliseconds": ("nanos", 10**6), "microseconds": ("nanos", 10**3), "nanoseconds": ("nanos", 1)}
_DURATION = re.compile(r"^([-+]?)P(?:([-+.\d]+)Y)?(?:([-+.\d]+)M)?(?:([-+.\d]+)W)?(?:([-+.\d]+)D)?(?:T(?:([-+.\d]+)H)?(?:([-+.\d]+)M)?(?:([-+.\d]+)S)?)?$")


# --- values known while compiling


def parse_date(text: str) -> dt.date:
    """ISO dates: calendar, week and ordinal, with and without dashes, days or months left out."""
    if m := re.fullmatch(r"(\d{4})-?W(\d{2})(?:-?(\d))?", text):
        return dt.date.fromisocalendar(int(m[1]), int(m[2]), int(m[3] or 1))
    if m := re.fullmatch(r"(\d{4})-?(\d{3})", text):
        return dt.date(int(m[1]), 1, 1) + dt.timedelta(int(m[2]) - 1)
    if m := re.fullmatch(r"(\d{4})(?:-?(\d{2})(?:-?(\d{2}))?)?", text):
        return dt.date(int(m[1]), int(m[2] or 1), int(m[3] or 1))
    raise ArgumentError("InvalidDate", text)


def parse_time(text: str) -> tuple[int, int | None, str | None]:
    """Nanoseconds of the day, offset in seconds, zone name."""
    m = re.fullmatch(r"(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)?)?(Z|[+-]\d{2}(?::?\d{2})?)?(?:\[([^\]]+)\])?", text)
    if not m:
        raise ArgumentError("InvalidTime", text)
    ns = (int(m[1]) * 3600 + int(m[2] or 0) * 60 + int(m[3] or 0)) * 10**9 + int((m[4] or "0").ljust(9, "0"))
    return ns, _offset(m[5]) if m[5] else None, m[6]


def _offset(text: str) -> int:
    if text == "Z":
        return 0
    digits = text[1:].replace(":", "").ljust(4, "0")
    return (-1 if text[0] == "-" else 1) * (int(digits[:2]) * 3600 + int(digits[2:]) * 60)


def parse_duration(text: str) -> dict[str, int]:
    m = _DURATION.match(text)
    if not m or text.rstrip("T") in ("P", "-P", "+P"):
        raise ArgumentError("InvalidDuration", text)
    sign = -1 if m[1] == "-" else 1
    y, mo, w, d, h, mi, s = (sign * float(x) if x else 0.0 for x in m.groups()[1:])
    return spread({"years": y, "months": mo, "weeks": w, "days": d, "hours": h, "minutes": mi, "seconds": s})


def spread(parts: dict[str, float]) -> dict[str, int]:
    """Fractions of a unit carried into smaller ones."""
    months = parts.get("years", 0) * 12 + parts.get("quarters", 0) * 3 + parts.get("months", 0)
    whole = int(months)
    seconds = (months - whole) * SECONDS_PER_MONTH
    days = parts.get("weeks", 0) * 7 + parts.get("days", 0)
    carried, seconds = divmod(seconds, 86400) if seconds >= 0 else (-(-seconds // 86400), -(-seconds % 86400))
    days += carried
    day = int(days)
    seconds += (days - day) * 86400 + parts.get("hours", 0) * 3600 + parts.get("minutes", 0) * 60 + parts.get("seconds", 0)
    nanos = round(seconds * 10**9) + parts.get("milliseconds", 0) * 10**6 + parts.get("microseconds", 0) * 10**3 + parts.get("nanoseconds", 0)
    second, nano = divmod(abs(int(nanos)), 10**9)
    sign = -1 if nanos < 0 else 1
    return {"months": whole, "days": day, "seconds": sign * second, "nanos": sign * nano}


def duration_of(parts: dict[str, int]) -> Typed:
    return Typed(F.struct(*(F.lit(parts[n]).cast("long").alias(n) for n in fields(DURATION))), DURATION)


def from_text(kind: str, text: str) -> Typed:
    """A temporal value that is written in the query."""
    try:
        if kind == "duration":
            return duration_of(parse_duration(text))
        if kind == "date":
            return Typed(F.lit(parse_date(text.split("T")[0])), DATE)
        if kind in ("time", "localtime"):
            ns, offset, _ = parse_time(text.split("T")[-1])
            return _time(F.lit(ns).cast("long"), F.lit(offset or 0).cast("long") if kind == "time" else None)
        day, _, rest = text.partition("T")
        ns, offset, zone = parse_time(rest) if rest else (0, None, None)
        moment = dt.datetime.combine(parse_date(day), dt.time()) + dt.timedelta(microseconds=ns // 1000)
        if kind == "localdatetime":
            return Typed(F.lit(moment).cast(LOCAL), LOCAL)
        moment = moment.replace(tzinfo=ZoneInfo(zone)) if zone and offset is None else moment.replace(tzinfo=dt.timezone(dt.timedelta(seconds=offset or 0)))
        utc = moment.astimezone(dt.UTC)
        at = F.to_utc_timestamp(F.lit(utc.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz"), "UTC").cast(INSTANT)
        shift = int(moment.utcoffset().total_seconds())
        if not shift and not zone:
            return Typed(at, INSTANT)
        return Typed(F.struct(at.alias("at"), F.lit(shift).cast("long").alias("offset_s"), F.lit(zone).cast("string").alias("zone")), ZONED)
    except ValueError as e:
        raise ArgumentError(f"Invalid{kind.capitalize()}", f"{text}: {e}") from None


def _time(ns: Column, offset: Column | None) -> Typed:
    if offset is None:
        return Typed(F.struct(ns.alias("time_ns")), LOCALTIME)
    return Typed(F.struct(ns.alias("time_ns"), offset.alias("offset_s")), TIME)


# --- columns


def local_of(x: Typed) -> Typed:
    """What the clock of a zoned date-time's place shows."""
    return Typed(F.timestamp_micros(F.unix_micros(x.col["at"]) + x.col["offset_s"] * 10**6).cast(LOCAL), LOCAL)


def zoned(local: Column, offset: Column, zone: Column) -> Typed:
    """The date-time that a clock shows in a zone, or at an offset where the zone has no name."""
    wall = F.unix_micros(local.cast("timestamp"))
    named = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), zone))
    at = F.when(zone.isNotNull(), named).otherwise(wall - offset * 10**6)
    made = F.struct(F.timestamp_micros(at).alias("at"), ((wall - at) / 10**6).cast("long").alias("offset_s"), zone.cast("string").alias("zone"))
    return Typed(F.when(at.isNotNull(), made), ZONED)


def _again(x: Typed, local: Column) -> Typed:
    """Another clock time in the zone of ``x``."""
    return zoned(local, x.col["offset_s"], x.col["zone"])


def _zone_name(text: Column) -> Column:
    name = F.regexp_extract(text, r"\[([^\]]+)\]$", 1)
    return F.when(name != "", name)


def _micros(x: Typed) -> Column:
    return F.unix_micros(x.col.cast("timestamp"))


def _clock(text: Column) -> Column:
    """Nanoseconds of the day from hh[:mm[:ss[.f]]] text."""
    part = lambda k: F.coalesce(F.regexp_extract(text, r"^(\d{2})(?::?(\d{2}))?(?::?(\d{2}))?(?:[.,](\d{1,9}))?", k).try_cast("long"), F.lit(0))
    frac = F.rpad(F.coalesce(F.regexp_extract(text, r"[.,](\d{1,9})", 1), F.lit("")), 9, "0").cast("long")
    return (part(1) * 3600 + part(2) * 60 + part(3)) * 10**9 + frac


def _text_date(text: Column) -> Column:
    day = F.split_part(text, F.lit("T"), F.lit(1))
    week = lambda k: F.regexp_extract(day, r"^(\d{4})-?W(\d{2})(?:-?(\d))?$", k).try_cast("int")
    first = F.make_date(week(1), F.lit(1), F.lit(4))
    by_week = F.date_add(F.trunc(first, "week"), (week(2) - 1) * 7 + F.coalesce(week(3), F.lit(1)) - 1)
    shapes = [(r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{8}$", "yyyyMMdd"), (r"^\d{4}-\d{3}$", "yyyy-DDD"), (r"^\d{7}$", "yyyyDDD"), (r"^\d{4}-\d{2}$", "yyyy-MM"), (r"^\d{6}$", "yyyyMM"), (r"^\d{4}$", "yyyy")]
    out = F.when(day.rlike("W"), by_week)
    for shape, form in shapes:
        out = out.when(day.rlike(shape), F.to_date(day, form))
    return out


def convert(kind: str, x: Typed) -> Typed:
    """``date(x)`` and its like, for text and other temporal values."""
    t = KINDS.get(kind)
    if is_null(x.type):
        return null(t or DURATION)
    if kind == "duration":
        return _text_duration(x) if is_string(x.type) else x
    if is_string(x.type):
        if kind == "date":
            return Typed(_text_date(x.col), DATE)
        clock = F.when(x.col.contains("T"), F.split_part(x.col, F.lit("T"), F.lit(2))).otherwise(x.col if kind in ("time", "localtime") else F.lit("00:00"))
        if kind in ("time", "localtime"):
            return _time(_clock(clock), _text_offset(clock) if kind == "time" else None)
        micros = F.unix_micros(_text_date(x.col).cast("timestamp")) + (_clock(clock) / 1000).cast("long")
        if kind == "localdatetime":
            return Typed(F.timestamp_micros(micros).cast(LOCAL), LOCAL)
        local = F.timestamp_micros(micros)
        plain = clock.rlike(r"(?:Z|[+-]\d{2}(?::?\d{2})?)(?:\[[^\]]*\])?$")
        made = zoned(local, _text_offset(clock), F.when(~plain, _zone_name(clock)))
        # An offset that is written counts; the zone's name is kept beside it.
        name = _zone_name(clock)
        return Typed(F.when(made.col.isNotNull(), F.struct(made.col["at"].alias("at"), made.col["offset_s"].alias("offset_s"), name.alias("zone"))), ZONED)
    if is_zoned(x.type):
        if kind == "datetime":
            return x
        local = local_of(x)
        return convert("time", Typed(_time(convert("localtime", local).col["time_ns"], x.col["offset_s"]).col, TIME)) if kind == "time" else convert(kind, local)
    if not is_temporal(x.type):
        raise QueryTypeError("InvalidArgumentType", f"{kind}() of {x.type.simpleString()}")
    if kind in ("time", "localtime"):
        ns = x.col["time_ns"] if is_time(x.type) else F.pmod(_micros(x), F.lit(86400 * 10**6)) * 1000 if x.type != DATE else F.lit(0).cast("long")
        return _time(ns, (x.col["offset_s"] if x.type == TIME else F.lit(0).cast("long")) if kind == "time" else None)
    if is_time(x.type):
        raise QueryTypeError("InvalidArgumentType", f"{kind}() of a time")
    return Typed(x.col.cast(t), t)


def _text_offset(clock: Column) -> Column:
    part = F.regexp_extract(clock, r"(Z|[+-]\d{2}(?::?\d{2})?)(?:\[[^\]]*\])?$", 1)
    digits = F.rpad(F.regexp_replace(F.substring(part, 2, 9), ":", ""), 4, "0")
    value = F.substring(digits, 1, 2).try_cast("long") * 3600 + F.substring(digits, 3, 2).try_cast("long") * 60
    return F.when(part.isin("", "Z"), F.lit(0).cast("long")).when(part.startswith("-"), -value).otherwise(value)


def _text_duration(x: Typed) -> Typed:
    pattern = _DURATION.pattern
    part = lambda k: F.coalesce(F.regexp_extract(x.col, pattern, k).try_cast("double"), F.lit(0.0))
    sign = F.when(x.col.startswith("-"), -1.0).otherwise(1.0)
    months, days = part(2) * 12 + part(3), part(4) * 7 + part(5)
    seconds = part(6) * 3600 + part(7) * 60 + part(8)
    return Typed(F.when(x.col.rlike(pattern), _normal(sign * months, sign * days, sign * seconds)), DURATION)


def _normal(months: Column, days: Column, seconds: Column, nanos: Column | None = None) -> Column:
    """A duration struct from fractional parts, fractions carried down."""
    whole = months.cast("long")
    days = days + (months - whole) * F.lit(SECONDS_PER_MONTH / 86400)
    day = days.cast("long")
    total = F.round((seconds + (days - day) * 86400) * 1e9).cast("long")
    total = total if nanos is None else total + nanos.cast("long")
    sign = F.when(total < 0, F.lit(-1)).otherwise(F.lit(1)).cast("long")
    size = F.abs(total)
    return F.struct(whole.alias("months"), day.alias("days"), (sign * (size / 10**9).cast("long")).cast("long").alias("seconds"), (sign * F.pmod(size, F.lit(10**9))).cast("long").alias("nanos"))


def from_map(kind: str, m: Typed) -> Typed:
    if not is_map(m.type):
        raise QueryTypeError("InvalidArgumentType", f"{kind}() needs text or a map")
    have = {n: m.get(n) for n in fields(m.type)}
    if kind == "duration":
        total: dict[str, Column] = {}
        for name, x in have.items():
            if name not in _UNITS:
                raise ArgumentError("InvalidDurationComponent", name)
            unit, times = _UNITS[name]
            total[unit] = total.get(unit, F.lit(0.0)) + x.col.cast("double") * times
        zero = F.lit(0.0)
        return Typed(_normal(total.get("months", zero), total.get("days", zero), total.get("seconds", zero), total.get("nanos")), DURATION)
    base = next((have[k] for k in ("date", "datetime", "localdatetime", "time", "localtime") if k in have), None)

    def part(name: str, default: int, of: Typed | None = base) -> Column:
        if name in have:
            return have[name].col.cast("long")
        if of is not None and not (is_time(of.type) and name in ("year", "month", "day")):
            try:
                return component(of, name).col
            except QueryTypeError:
                pass
        return F.lit(default).cast("long")

    if "week" in have or "dayOfWeek" in have:
        first = F.make_date((have["year"].col if "year" in have else part("weekYear", 1970)).cast("int"), F.lit(1), F.lit(4))
        day = F.date_add(F.trunc(first, "week"), ((part("week", 1) - 1) * 7 + part("dayOfWeek", 1) - 1).cast("int"))
    elif "ordinalDay" in have:
        day = F.date_add(F.make_date(part("year", 1970).cast("int"), F.lit(1), F.lit(1)), (part("ordinalDay", 1) - 1).cast("int"))
    elif "quarter" in have:
        first = F.make_date(part("year", 1970).cast("int"), ((part("quarter", 1) - 1) * 3 + 1).cast("int"), F.lit(1))
        day = F.date_add(first, (part("dayOfQuarter", 1) - 1).cast("int"))
    elif kind in ("time", "localtime"):
        day = None
    else:
        day = F.make_date(part("year", 1970).cast("int"), part("month", 1).cast("int"), part("day", 1).cast("int"))
    if kind == "date":
        return Typed(day, DATE)
    clock = have.get("time") or have.get("localtime") or (base if base is not None and base.type != DATE else None)
    ns = (part("hour", 0, clock) * 3600 + part("minute", 0, clock) * 60 + part("second", 0, clock)) * 10**9
    sub = [n for n in ("millisecond", "microsecond", "nanosecond") if n in have]
    if sub:
        ns = ns + sum((have[n].col.cast("long") * {"millisecond": 10**6, "microsecond": 10**3, "nanosecond": 1}[n] for n in sub), F.lit(0))
    elif clock is not None:
        ns = ns + component(clock, "nanosecond").col
    zone = have.get("timezone")
    kept = next((have[k] for k in ("datetime", "time", "date") if k in have and (is_zoned(have[k].type) or have[k].type == TIME)), None) if zone is None else None
    offset = _text_offset(zone.col) if zone is not None else F.lit(0).cast("long")
    if kind in ("time", "localtime"):
        return _time(ns, offset if kind == "time" else None)
    micros = F.unix_micros(day.cast("timestamp")) + (ns / 1000).cast("long")
    if kind == "localdatetime":
        return Typed(F.timestamp_micros(micros).cast(LOCAL), LOCAL)
    if zone is not None:
        return zoned(F.timestamp_micros(micros), offset, F.when(~zone.col.rlike(r"^(?:[+-]|Z$)"), zone.col))
    if kept is not None and is_zoned(kept.type):
        return _again(kept, F.timestamp_micros(micros))
    if kept is not None:
        return zoned(F.timestamp_micros(micros), kept.col["offset_s"], F.lit(None).cast("string"))
    return Typed(F.timestamp_micros(micros), INSTANT)


def now(kind: str) -> Typed:
    if kind == "date":
        return Typed(F.current_date(), DATE)
    return convert(kind, Typed(F.current_timestamp(), INSTANT))


_PARTS = {
    "year": "year", "quarter": "quarter", "month": "month", "week": "week", "weekYear": "yearofweek", "day": "day", "ordinalDay": "doy",
    "hour": "hour", "minute": "minute",
}


def component(x: Typed, name: str) -> Typed:
    """``x.name`` of a temporal value."""
    name = {"weekDay": "dayOfWeek"}.get(name, name)
    c = x.col
    if is_duration(x.type):
        return _duration_part(c, name)
    if is_time(x.type):
        ns = c["time_ns"]
        parts = {"hour": (3600 * 10**9, 24), "minute": (60 * 10**9, 60), "second": (10**9, 60), "millisecond": (10**6, 1000), "microsecond": (10**3, 10**6), "nanosecond": (1, 10**9)}
        if name in parts:
            size, wrap = parts[name]
            return Typed(F.pmod(F.floor(ns / size).cast("long"), F.lit(wrap)).cast("long"), LONG)
        if x.type == TIME and name in ("offsetSeconds", "offsetMinutes"):
            return Typed(c["offset_s"] if name == "offsetSeconds" else (c["offset_s"] / 60).cast("long"), LONG)
        raise QueryTypeError("InvalidArgumentValue", f"no component {name}")
    if is_zoned(x.type):
        if name in ("offsetSeconds", "offsetMinutes"):
            return Typed(c["offset_s"] if name == "offsetSeconds" else (c["offset_s"] / 60).cast("long"), LONG)
        if name in ("timezone", "offset"):
            written = _offset_text(c["offset_s"])
            return Typed(F.coalesce(c["zone"], written) if name == "timezone" else written, STRING)
        return component(x.get("at") if name.startswith("epoch") else local_of(x), name)
    if name in _PARTS and (x.type != DATE or name not in ("hour", "minute")):
        return Typed(F.extract(F.lit(_PARTS[name]), c).cast("long"), LONG)
    if name == "dayOfWeek":
        return Typed((F.weekday(c) + 1).cast("long"), LONG)
    if name == "dayOfQuarter":
        return Typed((F.datediff(c, F.date_trunc("quarter", c).cast("date")) + 1).cast("long"), LONG)
    if x.type == DATE:
        raise QueryTypeError("InvalidArgumentValue", f"no component {name}")
    micros = _micros(x)
    sub = F.pmod(micros, F.lit(10**6))
    found = {
        "second": F.pmod(F.floor(micros / 10**6), F.lit(60)), "millisecond": F.floor(sub / 1000), "microsecond": sub, "nanosecond": sub * 1000,
        "epochSeconds": F.floor(micros / 10**6), "epochMillis": F.floor(micros / 1000), "offsetSeconds": F.lit(0), "offsetMinutes": F.lit(0),
    }.get(name)
    if found is not None:
        return Typed(found.cast("long"), LONG)
    if name in ("timezone", "offset"):
        return Typed(F.when(c.isNotNull(), F.lit("Z")), STRING)
    raise QueryTypeError("InvalidArgumentValue", f"no component {name}")


def _duration_part(c: Column, name: str) -> Typed:
    seconds, nanos = c["seconds"], c["nanos"]
    quot = lambda a, n: (a / n).cast("long")
    all_nanos = seconds * 10**9 + nanos
    found = {
        "years": quot(c["months"], 12), "quarters": quot(c["months"], 3), "months": c["months"], "weeks": quot(c["days"], 7), "days": c["days"], "hours": quot(seconds, 3600), "minutes": quot(seconds, 60),
        "seconds": seconds, "milliseconds": quot(all_nanos, 10**6), "microseconds": quot(all_nanos, 10**3), "nanoseconds": all_nanos,
        "quartersOfYear": quot(c["months"] % 12, 3), "monthsOfYear": c["months"] % 12, "monthsOfQuarter": c["months"] % 3, "daysOfWeek": c["days"] % 7, "minutesOfHour": quot(seconds % 3600, 60), "secondsOfMinute": seconds % 60,
        "millisecondsOfSecond": quot(nanos, 10**6), "microsecondsOfSecond": quot(nanos, 10**3), "nanosecondsOfSecond": nanos,
    }.get(name)
    if found is None:
        raise QueryTypeError("InvalidArgumentValue", f"no component {name}")
    return Typed(found.cast("long"), LONG)


def truncate(kind: str, unit: str, x: Typed, overrides: Typed | None) -> Typed:
    t = KINDS[kind]
    days = {"day": "day", "week": "week", "month": "month", "quarter": "quarter", "year": "year", "weekYear": None, "decade": 10, "century": 100, "millennium": 1000}
    if is_time(x.type):
        size = {"day": 86400, "hour": 3600, "minute": 60, "second": 1}.get(unit, None)
        size = size * 10**9 if size else {"millisecond": 10**6, "microsecond": 10**3}[unit]
        ns = x.col["time_ns"] - F.pmod(x.col["time_ns"], F.lit(size))
        return _overridden(kind, convert(kind, _time(ns, x.col["offset_s"] if x.type == TIME else None)), overrides)
    if is_zoned(x.type):
        local = truncate("localdatetime", unit, local_of(x), None)
        whole = _again(x, local.col)
        return _overridden(kind, whole if kind == "datetime" else convert(kind, whole), overrides)
    moment = x.col.cast("timestamp")
    if unit in ("hour", "minute", "second", "millisecond", "microsecond"):
        out = F.date_trunc(unit, moment)
    elif unit == "weekYear":
        out = F.trunc(F.make_date(F.extract(F.lit("yearofweek"), moment).cast("int"), F.lit(1), F.lit(4)), "week").cast("timestamp")
    elif isinstance(days.get(unit), int):
        year = F.year(moment)
        out = F.make_date((year - F.pmod(year, F.lit(days[unit]))).cast("int"), F.lit(1), F.lit(1)).cast("timestamp")
    elif unit in days:
        out = F.date_trunc(unit, moment)
    else:
        raise ArgumentError("InvalidArgumentValue", f"unit {unit}")
    return _overridden(kind, convert(kind, Typed(out.cast(INSTANT), INSTANT)) if t != DATE else Typed(out.cast("date"), DATE), overrides)


def _overridden(kind: str, x: Typed, overrides: Typed | None) -> Typed:
    if overrides is None or is_null(overrides.type) or fields(overrides.type) == ["_empty"]:
        return x
    key = {"date": "date", "time": "time", "localtime": "localtime"}.get(kind, "datetime")
    return from_map(kind, Typed(F.struct(x.col.alias(key), *(overrides.col[n].alias(n) for n in fields(overrides.type))), _with(key, x, overrides)))


def _with(key: str, x: Typed, m: Typed):
    from pyspark.sql import types as T

    return T.StructType([T.StructField(key, x.type), *m.type.fields])


def between(a: Typed, b: Typed, unit: str = "between") -> Typed:
    """Duration from ``a`` to ``b``: months, days and the rest; or in one unit only."""
    if is_null(a.type) or is_null(b.type):
        return null(DURATION)
    zero = F.lit(0).cast("long")
    if is_time(a.type) or is_time(b.type):
        ns = lambda x: x.col["time_ns"] - (x.col["offset_s"] * 10**9 if x.type == TIME else 0) if is_time(x.type) else convert("localtime", x).col["time_ns"]
        gap = ns(b) - ns(a)
        return Typed(F.struct(zero.alias("months"), zero.alias("days"), (zero if unit in ("inMonths", "inDays") else (gap / 10**9).cast("long")).alias("seconds"), (zero if unit in ("inMonths", "inDays") else gap % 10**9).alias("nanos")), DURATION)
    x, y = (v.col["at"] if is_zoned(v.type) else v.col.cast("timestamp") for v in (a, b))
    micros = F.unix_micros(y) - F.unix_micros(x)
    rest = lambda m, months, days: F.struct(months.alias("months"), days.alias("days"), (m / 10**6).cast("long").alias("seconds"), ((m % 10**6) * 1000).cast("long").alias("nanos"))
    if unit == "inSeconds":
        return Typed(F.when(micros.isNotNull(), rest(micros, zero, zero)), DURATION)
    if unit == "inDays":
        return Typed(F.when(micros.isNotNull(), rest(zero, zero, (micros / (86400 * 10**6)).cast("long"))), DURATION)
    guess = ((F.year(y) - F.year(x)) * 12 + F.month(y) - F.month(x)).cast("long")
    moved = _plus_months(x, guess)
    months = guess - F.when((guess > 0) & (moved > y), 1).when((guess < 0) & (moved < y), -1).otherwise(0)
    if unit == "inMonths":
        return Typed(F.when(micros.isNotNull(), rest(zero, months, zero)), DURATION)
    left = F.unix_micros(y) - F.unix_micros(_plus_months(x, months))
    day = (left / (86400 * 10**6)).cast("long")
    return Typed(F.when(micros.isNotNull(), rest(left - day * 86400 * 10**6, months.cast("long"), day)), DURATION)


def _plus_months(moment: Column, months: Column) -> Column:
    day = F.date_trunc("day", moment)
    clock = F.unix_micros(moment) - F.unix_micros(day)
    return F.timestamp_micros(F.unix_micros(F.add_months(day.cast("date"), months.cast("int")).cast("timestamp")) + clock)


def plus(x: Typed, d: Typed, sign: int = 1) -> Typed:
    """A temporal value moved by a duration."""
    months, days = d.col["months"] * sign, d.col["days"] * sign
    nanos = (d.col["seconds"] * 10**9 + d.col["nanos"]) * sign
    if is_time(x.type):
        ns = F.pmod(x.col["time_ns"] + nanos, F.lit(86400 * 10**9))
        return _time(ns, x.col["offset_s"] if x.type == TIME else None)
    if is_zoned(x.type):
        # Months and days go by the clock, the rest by the time that passes.
        zero = F.lit(0).cast("long")
        by_clock = _again(x, plus(local_of(x), Typed(F.struct(d.col["months"].alias("months"), d.col["days"].alias("days"), zero.alias("seconds"), zero.alias("nanos")), DURATION), sign).col)
        at = F.timestamp_micros(F.unix_micros(by_clock.col["at"]) + (nanos / 1000).cast("long"))
        there = F.when(x.col["zone"].isNotNull(), (F.unix_micros(F.from_utc_timestamp(at, x.col["zone"])) - F.unix_micros(at)) / 10**6).otherwise(x.col["offset_s"])
        return Typed(F.when(at.isNotNull(), F.struct(at.alias("at"), there.cast("long").alias("offset_s"), x.col["zone"].alias("zone"))), ZONED)
    if x.type == DATE:
        day = F.date_add(F.add_months(x.col, months.cast("int")), (days + (nanos / (86400 * 10**9)).cast("long")).cast("int"))
        return Typed(day, DATE)
    moved = F.unix_micros(_plus_months(x.col.cast("timestamp"), months)) + days * 86400 * 10**6 + (nanos / 1000).cast("long")
    return Typed(F.timestamp_micros(moved).cast(x.type), x.type)


def duration_sum(a: Typed, b: Typed, sign: int) -> Typed:
    nanos = (a.col["seconds"] + b.col["seconds"] * sign) * 10**9 + a.col["nanos"] + b.col["nanos"] * sign
    return Typed(F.struct((a.col["months"] + b.col["months"] * sign).alias("months"), (a.col["days"] + b.col["days"] * sign).alias("days"), (nanos / 10**9).cast("long").alias("seconds"), (nanos % 10**9).alias("nanos")), DURATION)


def duration_times(a: Typed, factor: Column) -> Typed:
    f = factor.cast("double")
    return Typed(_normal(a.col["months"] * f, a.col["days"] * f, a.col["seconds"] * f, a.col["nanos"] * f), DURATION)


def _offset_text(off: Column) -> Column:
    two = lambda v: F.lpad(F.floor(v).cast("string"), 2, "0")
    return F.when(off == 0, "Z").otherwise(F.concat(F.when(off < 0, "-").otherwise("+"), two(F.abs(off) / 3600), F.lit(":"), two(F.abs(off) % 3600 / 60)))


def text_of(x: Typed) -> Column:
    """ISO text."""
    c = x.col
    if x.type == DATE:
        return F.date_format(c, "yyyy-MM-dd")
    if is_duration(x.type):
        part = lambda v, unit: F.when(v != 0, F.concat(v.cast("string"), F.lit(unit))).otherwise("")
        months, s = c["months"], c["seconds"]
        total = s * 10**9 + c["nanos"]
        rest = total - (s / 60).cast("long") * 60 * 10**9
        whole = F.abs(rest)
        sec = F.concat(F.when(rest < 0, "-").otherwise(""), (whole / 10**9).cast("long").cast("string"), F.when(whole % 10**9 != 0, F.concat(F.lit("."), F.regexp_replace(F.lpad((whole % 10**9).cast("string"), 9, "0"), "0+$", ""))).otherwise(""), F.lit("S"))
        day = F.concat(part((months / 12).cast("long"), "Y"), part(months % 12, "M"), part(c["days"], "D"))
        time = F.concat(part((s / 3600).cast("long"), "H"), part((s % 3600 / 60).cast("long"), "M"), F.when(rest != 0, sec).otherwise(""))
        out = F.concat(F.lit("P"), day, F.when(time != "", F.concat(F.lit("T"), time)).otherwise(""))
        return F.when(out == "P", "PT0S").otherwise(out)
    if is_time(x.type):
        ns = c["time_ns"]
        two = lambda v: F.lpad(F.floor(v).cast("string"), 2, "0")
        sec, sub = F.floor(ns / 10**9) % 60, ns % 10**9
        out = F.concat(two(ns / (3600 * 10**9)), F.lit(":"), two(F.floor(ns / (60 * 10**9)) % 60), F.when((sec != 0) | (sub != 0), F.concat(F.lit(":"), two(sec))).otherwise(""), F.when(sub != 0, F.concat(F.lit("."), F.regexp_replace(F.lpad(sub.cast("string"), 9, "0"), "0+$", ""))).otherwise(""))
        if x.type == LOCALTIME:
            return out
        return F.concat(out, _offset_text(c["offset_s"]))
    if is_zoned(x.type):
        return F.concat(text_of(local_of(x)), _offset_text(c["offset_s"]), F.coalesce(F.concat(F.lit("["), c["zone"], F.lit("]")), F.lit("")))
    moment = c.cast("timestamp")
    micros = F.pmod(F.unix_micros(moment), F.lit(60 * 10**6))
    sub = F.regexp_replace(F.date_format(moment, "SSSSSS"), "0+$", "")
    tail = F.when(micros == 0, "").otherwise(F.concat(F.date_format(moment, ":ss"), F.when(sub != "", F.concat(F.lit("."), sub)).otherwise("")))
    return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm"), tail, F.lit("Z" if x.type == INSTANT else ""))

