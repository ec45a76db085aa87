"""The built-in functions as Column builders.

A builder takes the arguments (strings, never null), their values where they
are constants, and ``bind``, which makes a column of its own of an expression.
It returns (value, whether it fails), or None if it can't express the call.
"""

from __future__ import annotations

import re
from functools import lru_cache
from zoneinfo import available_timezones

from pyspark.sql import Column, SparkSession, functions as F

from ..operators.evaluate import SPACE
from . import datetimes as dt


def uuid_v3(s: Column) -> Column:
    """The name-based UUID (MD5) of a text in the nil namespace."""
    h = F.md5(F.concat(F.unhex(F.lit("00" * 16)), s.cast("binary")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def _coalesce(args, consts, bind):
    return F.coalesce(*[F.nullif(a, F.lit("")) for a in args], F.lit("")), None


# --- date-times -------------------------------------------------------------

_SEP = "\x1f"


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


@lru_cache(maxsize=1)
def zones() -> frozenset[str]:
    """The time zones that both Python and the JVM know."""
    jvm = SparkSession.active()._jvm
    known = set(jvm.java.lang.String.join(",", jvm.java.time.ZoneId.getAvailableZoneIds()).split(","))
    return frozenset(known & available_timezones())


def _groups(s: Column, pattern: re.Pattern, bind):
    """(function of a group's name to its text, whether the whole text matches); a group without a match is ""."""
    names = sorted(pattern.groupindex, key=pattern.groupindex.get)
    if pattern.groups != len(names) or not names:
        return None
    shape = rf"\A(?:{re.sub(r'[(][?]P<[A-Za-z0-9]+>', '(', pattern.pattern)})\z"
    parts = bind(F.split(F.regexp_replace(s, shape, _SEP.join(f"${pattern.groupindex[n]}" for n in names)), _SEP, -1))
    ok = F.size(parts) == len(names) if len(names) > 1 else s.rlike(shape)
    return (lambda n: F.get(parts, F.lit(names.index(n))) if n in names else F.lit("")), ok


def _int(c: Column) -> Column:
    return F.trim(c).try_cast("int")


def _local(year, month, day, hour, minute, second, fraction, bind) -> Column:
    """The date-time without a zone, null where there is none such."""
    micros = F.concat(second.cast("string"), F.lit("."), F.substring(F.rpad(fraction, 6, "0"), 1, 6)).try_cast("decimal(16,6)")
    fine = year.between(1, 9999) & hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    return bind(F.when(fine, F.try_make_timestamp_ntz(year, month, day, hour, minute, micros)))


def _shift(z: Column) -> Column:
    """Minutes of an offset such as +05, +0530 or +05:30."""
    digits = F.translate(F.substring(z, 2, 5), ":", "")
    minutes = _int(F.substring(digits, 1, 2)) * 60 + F.coalesce(_int(F.substring(digits, 3, 2)), F.lit(0))
    return F.when(minutes < 1440, F.when(F.startswith(z, F.lit("-")), -minutes).otherwise(minutes))


def _to_utc(zone: Column | str, local: Column) -> Column:
    return F.convert_timezone(F.lit(zone) if isinstance(zone, str) else zone, F.lit("UTC"), local)


def _smart(s: Column, bind):
    """(local, utc or null without a zone, whether it fails) of a text in one of the common shapes."""
    s = bind(F.btrim(s, F.lit(SPACE)))
    of, ok = _groups(s, dt.SMART, bind)
    first = lambda *names: F.coalesce(*[F.nullif(of(n), F.lit("")) for n in names], F.lit("0"))
    y = first("y", "y2", "y3")
    year = F.when(F.length(y) == 4, _int(y)).otherwise(_int(y) + F.when(_int(y) < 69, 2000).otherwise(1900))
    hour = bind(_int(first("H", "H2")))
    ap = F.lower(of("ap"))
    hour = F.when(ap == "", hour).when(hour.between(1, 12), hour % 12 + F.when(ap == "pm", 12).otherwise(0))
    local = _local(year, _int(first("m", "m2", "m3")), _int(first("d", "d2", "d3")), hour, _int(first("M", "M2")), _int(first("S", "S2")), first("f", "f2"), bind)
    z, name = bind(of("z")), bind(of("name"))
    named = F.find_in_set(name, F.lit(",".join(sorted(zones())))) > 0
    utc = bind(
        F.when(z == "", F.lit(None).cast("timestamp_ntz"))
        .when(z == "Z", local)
        .when(name == "", F.timestamp_add("MINUTE", -_shift(z), local))
        .when(named, _to_utc(F.when(named, name), local))
    )
    return local, utc, ~F.coalesce(ok, F.lit(False)) | local.isNull() | ((z != "") & utc.isNull())


def _zoned(local: Column, utc: Column, from_tz: str, to_tz: str, bind) -> tuple[Column, Column]:
    """A date-time without a zone is taken to be in ``from_tz``; then all are moved to ``to_tz``."""
    if from_tz:
        utc = bind(F.coalesce(utc, _to_utc(from_tz, local)))
    if to_tz:
        moved = bind(F.coalesce(F.convert_timezone(F.lit("UTC"), F.lit(to_tz), utc), local))
        return moved, bind(F.coalesce(utc, _to_utc(to_tz, local)))
    return local, utc


def _rfc3339(local: Column, utc: Column, bind) -> Column:
    offset = bind(F.floor(F.timestamp_diff("SECOND", utc, local) / 60).cast("int"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    size = F.abs(offset)
    told = F.concat(F.when(offset < 0, "-").otherwise("+"), two(F.floor(size / 60)), F.lit(":"), two(size % 60))
    return F.concat(F.translate(F.substring(local.cast("string"), 1, 19), " ", "T"), F.when(offset.isNull(), "").when(offset == 0, "Z").otherwise(told))


def _known(*names: str | None) -> bool:
    return all(n is not None and (n == "" or n in zones()) for n in names)


def _to_rfc3339(args, consts, bind):
    if not _known(*consts[1:3]):
        return None
    local, utc, fails = _smart(args[0], bind)
    value = _rfc3339(*_zoned(local, utc, consts[1], consts[2], bind), bind)
    return F.when(args[0] == "", "").otherwise(value), (args[0] != "") & fails


def _layout_to_rfc3339(args, consts, bind):
    layout, flag = consts[1], (consts[2] or "").lower()
    if layout is None or flag not in ("true", "false", "1", "0", "t", "f") or not _known(*consts[3:5]):
        return None
    if not layout:
        return _to_rfc3339([args[0], *args[3:5]], [None, *consts[3:5]], bind)
    try:
        found = _groups(args[0], dt.layout_pattern(layout), bind)
    except dt.DateTimeError:
        found = None
    if found is None:
        return None
    of, ok = found
    own = dt.layout_pattern(layout).groupindex
    number = lambda n, default: _int(of(n)) if n in own else F.lit(default)
    place = lambda n, texts: F.array_position(F.array(*map(F.lit, texts)), of(n)).cast("int")
    month = _int(of("m")) if "m" in own else place("B", dt.MONTHS) if "B" in own else place("b", [m[:3] for m in dt.MONTHS]) if "b" in own else F.lit(1)
    year = _int(of("Y")) if "Y" in own else _int(of("y")) + F.when(_int(of("y")) >= 69, 1900).otherwise(2000) if "y" in own else F.lit(1)
    hour = number("H", 0)
    if "I" in own:
        hour = _int(of("I")) % 12 + F.when(F.lower(of("p")) == "pm", 12).otherwise(0) if "p" in own else _int(of("I"))
    local = _local(year, month, number("d", 1), hour, number("M", 0), number("S", 0), of("f"), bind)
    utc, fails = F.lit(None).cast("timestamp_ntz"), ~F.coalesce(ok, F.lit(False)) | local.isNull()
    if flag in ("true", "1", "t"):
        z = bind(of("z")) if "z" in own else F.lit("Z")
        utc = bind(F.when(z.isin("", "Z"), local).otherwise(F.timestamp_add("MINUTE", -_shift(z), local)))
        fails = fails | utc.isNull()
    value = _rfc3339(*_zoned(local, utc, consts[3], consts[4], bind), bind)
    return F.when(args[0] == "", "").otherwise(value), (args[0] != "") & fails


_MILLIS = {"SECOND": 1000, "MILLISECOND": 1}


def _to_epoch(args, consts, bind):
    if not _known(consts[1]) or consts[2] not in _MILLIS:
        return None
    local, utc, fails = _smart(args[0], bind)
    utc = F.coalesce(utc, _to_utc(consts[1], local) if consts[1] else local)
    micros = F.timestamp_diff("MICROSECOND", _epoch(), utc)
    size = F.lit(_MILLIS[consts[2]] * 1000).cast("bigint")
    whole = F.call_function("div", micros - F.pmod(micros, size), size)
    return F.when(args[0] == "", "").otherwise(whole.cast("string")), (args[0] != "") & fails


def _epoch_to(args, consts, bind):
    if consts[1] not in _MILLIS or len(args) > 3 or not _known(*consts[2:3]):
        return None
    n = F.when(args[0].rlike(r"^[+-]?[0-9]{1,15}$"), args[0].try_cast("bigint"))
    n = n * _MILLIS[consts[1]]
    n = bind(F.when(n.between(-62_135_596_800_000, 253_402_300_799_999), n))
    utc = bind(F.timestamp_add("SECOND", F.call_function("div", n - F.pmod(n, F.lit(1000).cast("bigint")), F.lit(1000).cast("bigint")), _epoch()))
    to = consts[2] if len(args) == 3 else ""
    local = bind(F.convert_timezone(F.lit("UTC"), F.lit(to), utc)) if to else utc
    return F.when(args[0] == "", "").otherwise(_rfc3339(local, utc, bind)), (args[0] != "") & n.isNull()


COLUMN_FUNCTIONS = {
    "coalesce": _coalesce,
    "concat": lambda args, consts, bind: (F.concat_ws("", *args) if args else F.lit(""), None),
    "lower": lambda args, consts, bind: (F.lower(args[0]), None),
    "upper": lambda args, consts, bind: (F.upper(args[0]), None),
    "uuidv3": lambda args, consts, bind: (uuid_v3(args[0]), None),
    "dateTimeToRFC3339": _to_rfc3339,
    "dateTimeLayoutToRFC3339": _layout_to_rfc3339,
    "dateTimeToEpoch": _to_epoch,
    "epochToDateTimeRFC3339": _epoch_to,
}
