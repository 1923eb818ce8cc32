"""Number, byte, time and name formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NAME_MAX_BYTES = 200


def _in_units(b: Column, unit: int, digits: int) -> Column:
    """b / unit as text, rounded half to even in whole-number arithmetic."""
    div = lambda x, y: F.call_function("div", x, F.lit(y))
    scale = 10**digits
    rest = (b * scale) % unit
    whole = div(b * scale, unit)
    up = (rest > unit // 2) | ((rest == unit // 2) & (whole % 2 == 1))
    n = whole + up.cast("int")
    if digits == 0:
        return n.cast("string")
    return F.concat(div(n, scale).cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), digits, "0"))


def binary_bytes(b: Column) -> Column:
    kib, mib, gib = 1024, 1024**2, 1024**3
    return (F.when(b >= gib, F.concat(_in_units(b, gib, 2), F.lit(" GiB")))
            .when(b >= mib, F.concat(_in_units(b, mib, 1), F.lit(" MiB")))
            .when(b >= kib, F.concat(_in_units(b, kib, 0), F.lit(" KiB")))
            .otherwise(F.concat(b.cast("string"), F.lit(" B"))))


def decimal_gb(b: Column) -> Column:
    return b / F.lit(1e9)


def truncate(s: Column, n: int) -> Column:
    if n == 0:
        return F.lit("")
    return F.when(F.char_length(s) <= n, s).otherwise(F.concat(F.left(s, F.lit(n - 1)), F.lit("…")))


def basename(path: Column) -> Column:
    """Last path component; the whole string when there is none."""
    trimmed = F.regexp_replace(path, r"(/+\.?)+$", "")
    last = F.regexp_extract(trimmed, r"([^/]*)$", 1)
    return F.when((last == "") | (last == ".."), path).otherwise(last)


def fmt_secs(ns: Column) -> Column:
    return F.format_string("%.3fs", ns / 1e9)


def _sign(v: Column) -> Column:
    return F.when(v < 0, "-").when(v > 0, "+").otherwise("")


def _pct_suffix(pct: Column) -> Column:
    return F.when(pct.isNull(), " (n/a)").otherwise(F.format_string(" (%+.1f%%)", pct))


def fmt_delta(ns: Column, pct: Column) -> Column:
    return F.concat(_sign(ns), F.format_string("%.3fs", F.abs(ns) / 1e9), _pct_suffix(pct))


def fmt_delta_bytes(b: Column, pct: Column) -> Column:
    return F.concat(_sign(b), binary_bytes(F.abs(b)), _pct_suffix(pct))


def pct_change(a: Column, b: Column) -> Column:
    return F.when(a != 0, (b.cast("double") - a) / a * 100.0)


def budget_ratio(used: Column, budget: Column) -> Column:
    return F.when(budget == 0, 0.0).otherwise(used.cast("double") / budget)


def mmss(secs: Column) -> Column:
    h, m, s = F.floor(secs / 3600), F.floor(secs / 60) % 60, secs % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(
        F.format_string("%02d:%02d", m, s))


def rfc3339_ns(s: Column) -> Column:
    """Unix nanoseconds of an RFC 3339 text; null when it does not parse."""
    pat = r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2})(?:\.(\d+))?([Zz]|[+-]\d{2}:\d{2})$"
    day, clock = F.regexp_extract(s, pat, 1), F.regexp_extract(s, pat, 2)
    frac, zone = F.regexp_extract(s, pat, 3), F.upper(F.regexp_extract(s, pat, 4))
    secs = F.unix_seconds(F.try_to_timestamp(
        F.concat(day, F.lit(" "), clock, F.when(zone == "Z", "+00:00").otherwise(zone)),
        F.lit("yyyy-MM-dd HH:mm:ssxxx")))
    nanos = F.rpad(F.left(frac, F.lit(9)), 9, "0").cast("bigint")
    return F.when(s.rlike(pat), secs * 1_000_000_000 + nanos)


def short_id(session_id: Column) -> Column:
    return F.left(F.replace(session_id, F.lit("-"), F.lit("")), F.lit(8))


def session_dir_name(started: Column, session_id: Column) -> Column:
    """``YYYY-MM-DD-HHMMSS-<8 hex>`` in the offset the text itself carries."""
    pat = r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}):(\d{2}):(\d{2})"
    return F.concat(F.regexp_extract(started, pat, 1), F.lit("-"),
                    F.regexp_extract(started, pat, 2), F.regexp_extract(started, pat, 3),
                    F.regexp_extract(started, pat, 4), F.lit("-"), short_id(session_id))


def valid_session_name(raw: Column) -> Column:
    """Trimmed name, null when unusable, cut to 200 bytes on a character edge."""
    name = F.regexp_replace(raw, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    head = F.substring(F.encode(name, "UTF-8"), 1, NAME_MAX_BYTES + 1)
    # every character adds at least one byte, so the cut keeps 50 to 200 characters;
    # binary search over the character count is a filter over that fixed range
    fits = F.filter(F.sequence(F.lit(50), F.lit(NAME_MAX_BYTES)),
                    lambda n: F.octet_length(F.left(name, n)) <= NAME_MAX_BYTES)
    cut = F.left(name, F.array_max(fits))
    return F.when((name == "") | name.rlike(r"[\p{Cc}/]"), F.lit(None).cast("string")).otherwise(
        F.when(F.octet_length(head) <= NAME_MAX_BYTES, name).otherwise(cut))


def path_sha8(path: Column) -> Column:
    return F.left(F.sha2(path, 256), F.lit(8))


def typed_value(text: Column) -> Column:
    """Typed field value of a text: bool, then int, then float, then string."""
    v = F.trim(text)
    as_int = F.when(v.rlike(r"^[+-]?\d+$"), v.try_cast("bigint"))
    as_float = F.when(v.rlike(r"(?i)^[+-]?(\d+\.?\d*([e][+-]?\d+)?|\.\d+([e][+-]?\d+)?|inf(inity)?|nan)$"),
                      v.try_cast("double"))
    kind = (F.when(F.lower(v).isin("true", "false"), "bool")
            .when(as_int.isNotNull(), "int").when(as_float.isNotNull(), "float").otherwise("string"))
    canonical = (F.when(kind == "bool", F.lower(v)).when(kind == "int", as_int.cast("string"))
                 .when(kind == "float", as_float.cast("string")).otherwise(v))
    return F.struct(kind.alias("t"), canonical.alias("v"))


def parse_field(kv: Column) -> Column:
    """``key=value`` as a struct of key and typed value; null when malformed."""
    parts = F.split(kv, "=", 2)
    key = F.trim(F.get(parts, 0))
    return F.when((F.size(parts) == 2) & (key != ""),
                  F.struct(key.alias("key"), typed_value(F.get(parts, 1)).alias("value")))


def names_compatible(a: Column, b: Column) -> Column:
    """Equal on the shorter one's bytes, both non-empty (names are cut differently)."""
    x, y = F.encode(a, "UTF-8"), F.encode(b, "UTF-8")
    n = F.least(F.octet_length(a), F.octet_length(b))
    return (n > 0) & (F.substring(x, F.lit(1), n) == F.substring(y, F.lit(1), n))
