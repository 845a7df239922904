"""Scalar column functions.

Every function here returns a ``pyspark.sql.Column`` built only from built-in
expressions, so it stays inside whole-stage codegen.  The one exception is
:func:`decode_powershell`, a vectorised pandas UDF used on SP-001 hits only.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constants as K
from .patterns import java_regex

MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

US_PER_S = 1_000_000


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def computed_once(df, **cols: Column):
    """Add columns that later filters must not re-evaluate.

    A filter on a derived column is pushed below the projection that defines
    it with the definition substituted in, so an expensive expression (regex
    batteries, JSON parsing) would run twice and bloat generated code.  Going
    through a one-row ``inline`` generator keeps the values computed once.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once, however often the body names it.

    A one-element ``transform``: Catalyst does not substitute through the lambda, so generated code
    holds the value once, where copies of a nested expression would grow past what a method can hold.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lit_map(d: dict) -> Column:
    """A literal MAP from a small fixed dict, folded into one constant.

    (A lookup in ``create_map`` of literals is rewritten into a ``CASE`` with a branch per entry.)
    """
    return F.map_from_arrays(F.array(*[F.lit(k) for k in d]), F.array(*[F.lit(v) for v in d.values()]))


# --------------------------------------------------------------------------
# Time (J1-J4, J12, J15)
# --------------------------------------------------------------------------
def syslog_ts(mon, day, hms, year: int) -> Column:
    """``Mar`` ``7`` ``14:32:01`` + a given year -> UTC timestamp, null if invalid."""
    mon, day, hms = col(mon), col(day), col(hms)
    text = F.concat_ws(" ", F.lit(str(year)), mon, day, hms)
    ts = F.try_to_timestamp(text, F.lit("yyyy MMM d HH:mm:ss"))
    return F.when(mon.isin(MONTHS), ts)


def access_log_ts(text) -> Column:
    """``07/Mar/2026:14:32:01 +0000`` -> UTC timestamp."""
    return F.try_to_timestamp(col(text), F.lit("d/MMM/yyyy:HH:mm:ss xx"))


# Fixed value: the ISO-8601 forms accepted for a time (extended or compact, one character
# between date and time, optional fraction and offset).
ISO_RE = (r"^([0-9]{4})(?:-([0-9]{2})-([0-9]{2})|([0-9]{2})([0-9]{2}))"
          r"(?:[^0-9]([0-9]{2})(?::?([0-9]{2})(?::?([0-9]{2})(?:[.,]([0-9]+))?)?)?"
          r"(?:Z|([+-])([0-9]{2})(?::?([0-9]{2})(?::?([0-9]{2})(?:\.[0-9]+)?)?)?)?)?\z")
ISO_USUAL_RE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?(?:Z|[+-][0-9]{2}:[0-9]{2})?\z"


def iso_ts(text) -> Column:
    """ISO-8601 text; ``Z`` or an offset, naive means UTC (session zone is UTC).

    Only text that is a date, or a date and a time, passes: a bare time, a
    partial or padded date and a zone name are null.  Compact forms count.
    The usual form is cast at once; the rest is taken apart.
    """
    c = col(text)
    groups = F.split(F.regexp_replace(c, ISO_RE, ",".join(f"${i}" for i in range(1, 14))), ",", -1)
    # the parts are bound once (a one-element transform), which also keeps generated code small
    parsed = F.get(F.transform(F.array(groups), _ts_of_parts), F.lit(0))
    return F.when(c.startswith("0000"), F.lit(None).cast("timestamp")).when(
        c.rlike(ISO_USUAL_RE), c.try_cast("timestamp")).when(c.rlike(ISO_RE), parsed)


def _ts_of_parts(parts: Column) -> Column:
    """Time of the groups of ``ISO_RE``: year, month and day (extended, or compact), hour, minute,
    second, fraction, sign and parts of the offset; missing parts are empty."""
    def text(i: int) -> Column:
        return F.get(parts, F.lit(i - 1))

    def number(i: int) -> Column:
        return F.when(text(i) == "", F.lit(0)).otherwise(text(i).try_cast("int"))

    seconds = F.concat(F.lpad(number(8).cast("string"), 2, "0"), F.lit("."), F.rpad(F.substring(text(9), 1, 6), 6, "0"))
    local = F.try_make_timestamp(number(1), number(2) + number(4), number(3) + number(5), number(6), number(7),
                                 seconds.try_cast("decimal(8,6)"))
    offset = (number(11) * 3600 + number(12) * 60 + number(13)).cast("bigint")
    shift = F.when(text(10) == "-", -offset).otherwise(offset) * US_PER_S
    sound = (number(6) < 24) & (number(8) < 60) & (number(11) < 24) & (number(12) < 60) & (number(13) < 60)
    return F.when(sound, F.timestamp_micros(F.unix_micros(local) - shift))


def json_iso_ts(text, record, key: str) -> Column:
    """J3 for the value of a top-level JSON key: only a JSON string is a time.

    ``text`` is the value as text.  Numbers are the one other kind of value
    that can look like a time (``20260307``), so the JSON type is looked up
    for text of digits alone.
    """
    c = col(text)
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(col(record)), f"$['{key}']", "variant"))
    return F.when(~c.rlike(r"^[0-9]+\z") | (kind == "STRING"), iso_ts(c))


def iso_utc(ts) -> Column:
    """Python ``datetime.isoformat()`` of an aware UTC value."""
    ts = col(ts)
    micros = F.unix_micros(ts) % US_PER_S
    frac = F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(F.lit(""))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), frac, F.lit("+00:00"))


def timedelta_text(micros) -> Column:
    """``str(timedelta)`` for a non-negative span in microseconds."""
    m = col(micros)
    secs = F.floor(m / US_PER_S)
    frac = m - secs * US_PER_S
    days = F.floor(secs / 86400)
    rem = secs - days * 86400
    hms = F.format_string("%d:%02d:%02d", F.floor(rem / 3600), F.floor((rem % 3600) / 60), rem % 60)
    day_txt = F.when(days == 0, F.lit("")).otherwise(
        F.concat(days.cast("string"), F.when(days == 1, F.lit(" day, ")).otherwise(F.lit(" days, "))))
    frac_txt = F.when(frac == 0, F.lit("")).otherwise(F.format_string(".%06d", frac))
    return F.concat(day_txt, hms, frac_txt)


# --------------------------------------------------------------------------
# Geo (E1, E2, E8, J5)
# --------------------------------------------------------------------------
_OCT = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])"
IPV4_RE = rf"^{_OCT}\.{_OCT}\.{_OCT}\.{_OCT}$"
_H = "[0-9A-Fa-f]{1,4}"
IPV6_RE = ("^(" + "|".join([
    rf"({_H}:){{7}}{_H}", rf"({_H}:){{1,7}}:", rf"({_H}:){{1,6}}:{_H}",
    rf"({_H}:){{1,5}}(:{_H}){{1,2}}", rf"({_H}:){{1,4}}(:{_H}){{1,3}}",
    rf"({_H}:){{1,3}}(:{_H}){{1,4}}", rf"({_H}:){{1,2}}(:{_H}){{1,5}}",
    rf"{_H}:(:{_H}){{1,6}}", rf":((:{_H}){{1,7}}|:)",
    rf"({_H}:){{1,6}}:?([0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}", rf"::([fF]{{4}}(:0{{1,4}})?:)?([0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}",
]) + r")(%[0-9A-Za-z_.\-]+)?$")


def ipv4_value(ip) -> Column:
    """32-bit value of a dotted quad (null when not a valid IPv4 address): four parts of one
    to three digits without leading zeros, none above 255."""
    def part(text: Column) -> Column:
        n = text.try_cast("int")
        return F.when(n.between(0, 255) & (n.cast("string") == text), n.cast("bigint"))

    parts = F.transform(F.split(col(ip), r"\.", -1), part)
    return F.when(F.size(parts) == 4, F.aggregate(parts, F.lit(0).cast("bigint"), lambda v, p: v * 256 + p))


def _ip_to_int(s: str) -> int:
    a, b, c, d = (int(x) for x in s.split("."))
    return (a << 24) | (b << 16) | (c << 8) | d


def is_private_v4(v: Column) -> Column:
    """Membership in the fixed private/reserved IPv4 blocks (P10)."""
    conds = []
    for net, plen in K.PRIVATE_V4_BLOCKS:
        lo = _ip_to_int(net)
        hi = lo + (1 << (32 - plen)) - 1
        conds.append(v.between(lo, hi))
    exc = [_ip_to_int(x) for x in K.PRIVATE_V4_EXCEPTIONS]
    return reduce(lambda a, b: a | b, conds) & ~v.isin(exc)


def country_of_ip(ip) -> Column:
    """null/invalid -> null; private, loopback or IPv6 -> ZZ; first octet table; else XX."""
    ip = col(ip)

    def located(v: Column) -> Column:
        by_octet = F.coalesce(lit_map(K.OCTET_TO_COUNTRY)[F.floor(v / (1 << 24)).cast("int")], F.lit("XX"))
        return (F.when(ip.isNull() | (ip == ""), F.lit(None).cast("string"))
                 .when(v.isNotNull(), F.when(is_private_v4(v), F.lit("ZZ")).otherwise(by_octet))
                 .when(ip.rlike(IPV6_RE), F.lit("ZZ")))

    return bound(ipv4_value(ip), located)


def _coords_map(d: dict) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(k) for k in d]),
                             F.array(*[F.struct(F.lit(la).alias("lat"), F.lit(lo).alias("lon")) for la, lo in d.values()]))


def country_coords(cc) -> Column:
    """Country code (upper-cased) -> struct(lat, lon) or null."""
    return _coords_map(K.COUNTRY_COORDS)[F.upper(col(cc))]


def legacy_country_of_ip(ip) -> Column:
    """The legacy API's smaller octet table."""
    ip = col(ip)
    parts = F.split(ip, r"\.", -1)
    first = F.try_element_at(parts, F.lit(1))
    octet = first.try_cast("int")
    return (F.when(ip.isNull() | (ip == ""), F.lit(None).cast("string"))
             .when(F.size(parts) != 4, F.lit(None).cast("string"))
             .when(octet.isNull(), F.lit(None).cast("string"))
             .otherwise(F.coalesce(lit_map(K.LEGACY_COUNTRY_BY_OCTET)[octet], F.lit("XX"))))


def legacy_country_coords(cc) -> Column:
    return _coords_map(K.LEGACY_COUNTRY_COORDS)[F.upper(col(cc))]


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance, R = 6371 km."""
    lat1, lon1, lat2, lon2 = (col(c) for c in (lat1, lon1, lat2, lon2))
    dphi = F.radians(lat2 - lat1)
    dlmb = F.radians(lon2 - lon1)
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlmb / 2), 2)
    return 2 * K.EARTH_RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


# --------------------------------------------------------------------------
# Text (J7, J11, J14, J16, J17)
# --------------------------------------------------------------------------
def basename_lower(path) -> Column:
    """Last segment after ``\\`` or ``/``, lower-cased; '' for null."""
    p = F.coalesce(col(path), F.lit(""))
    return F.lower(F.regexp_extract(p, r"([^\\/]*)$", 1))


def truthy(c) -> Column:
    """J11 helper: Python truthiness for text (null and '' are false)."""
    return F.nullif(col(c), F.lit(""))


def first_truthy(*cols) -> Column:
    """``a or b or c`` over text values."""
    return F.coalesce(*[truthy(c) for c in cols])


def haystack(url, agent) -> Column:
    """``' '.join(filter(None, [url, agent]))``."""
    return F.concat_ws(" ", truthy(url), truthy(agent))


# --------------------------------------------------------------------------
# Severity (J8, J9)
# --------------------------------------------------------------------------
def severity_rank(sev) -> Column:
    """info=0 .. critical=4."""
    return F.array_position(F.array(*[F.lit(s) for s in K.SEVERITIES]), col(sev)).cast("int") - 1


def severity_name(rank) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in K.SEVERITIES]), col(rank) + 1)


def severity_from_score(score) -> Column:
    """Clamp int(score) to 0..100, then 90/70/40/10 thresholds."""
    s = F.greatest(F.lit(0), F.least(F.lit(100), col(score).try_cast("bigint")))
    return (F.when(s >= 90, "critical").when(s >= 70, "high").when(s >= 40, "medium")
             .when(s >= 10, "low").when(s.isNotNull(), "info"))


# --------------------------------------------------------------------------
# Fingerprint
# --------------------------------------------------------------------------
def _quoted(c: Column) -> Column:
    """Text as a JSON string, but for characters beyond printable ASCII (see :func:`ascii_json`)."""
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


#: JSON's short escapes, by UTF-16 unit.
SHORT_ESCAPES = {"0008": "\\b", "0009": "\\t", "000A": "\\n", "000C": "\\f", "000D": "\\r"}
#: A string of compact JSON text, or what stands between two strings.
JSON_PARTS_RE = r'("[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"]++)'


def ascii_json(text: Column) -> Column:
    """JSON text with every character outside space to tilde escaped, as Python's ``json`` does by default
    (such characters only stand inside strings): UTF-16 units as ``\\uxxxx``, or the short form."""
    def unit(h: Column) -> Column:
        out = F.when(h.between("0020", "007E"), F.char(F.conv(h, 16, 10).cast("int")))
        for code, short in SHORT_ESCAPES.items():
            out = out.when(h == code, F.lit(short))
        return out.otherwise(F.concat(F.lit("\\u"), F.lower(h)))

    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(.{4})"), 1)
    return F.when(text.rlike("[^ -~]"), F.array_join(F.transform(units, unit), "")).otherwise(text)


def spaced_json(text: Column) -> Column:
    """JSON text with sorted keys and ``", "`` and ``": "`` between the parts; null if it is not JSON.

    Through a variant, whose objects are sorted by key.  Differs from Python's text for fractions
    and exponents (``1.50``, ``1e3``), which keep the variant's decimal form, and for control
    characters without a short escape; objects that repeat a key are null.
    """
    compact = F.to_json(F.try_parse_json(text))
    parts = F.regexp_extract_all(compact, F.lit(JSON_PARTS_RE), 1)
    wide = F.transform(parts, lambda p: F.when(p.startswith('"'), p).otherwise(
        F.replace(F.replace(p, F.lit(","), F.lit(", ")), F.lit(":"), F.lit(": "))))
    return F.array_join(wide, "")


def canonical_value(c: Column, dtype: T.DataType, name: str = "") -> Column:
    """A field of an event as canonical JSON text."""
    if name == "raw":  # JSON text already; anything else counts as a string
        return F.coalesce(spaced_json(c), _quoted(c), F.lit("null"))
    if isinstance(dtype, T.TimestampType):
        return F.coalesce(_quoted(iso_utc(c)), F.lit("null"))
    if isinstance(dtype, T.MapType):
        entries = F.array_sort(F.map_entries(F.coalesce(c, F.create_map().cast(dtype))))
        items = F.transform(entries, lambda e: F.concat(_quoted(e["key"]), F.lit(": "), F.coalesce(_quoted(e["value"]), F.lit("null"))))
        return F.concat(F.lit("{"), F.array_join(items, ", "), F.lit("}"))
    if isinstance(dtype, T.StringType):
        return F.coalesce(_quoted(c), F.lit("null"))
    return F.coalesce(c.cast("string"), F.lit("null"))


def canonical_json(fields: list[tuple[str, T.DataType]], prefix: str = "") -> Column:
    """A record as one line of JSON with sorted keys, nulls included, in plain ASCII."""
    parts = [x for n, t in sorted(fields) for x in (F.lit(f', "{n}": '), canonical_value(F.col(prefix + n), t, n))]
    return ascii_json(F.concat(F.lit("{"), F.substring(F.concat(*parts), F.lit(3), F.lit((1 << 31) - 1)), F.lit("}")))


def fingerprint(fields: list[tuple[str, T.DataType]], prefix: str = "") -> Column:
    """SHA-256 of the record's canonical JSON.

    Stable for the same record, different when any field differs.
    """
    return F.sha2(canonical_json(fields, prefix), 256)


# --------------------------------------------------------------------------
# PowerShell payload
# --------------------------------------------------------------------------
def _decode_one(b64):
    import base64
    if b64 is None:
        return None
    try:
        return base64.b64decode(b64).decode("utf-16-le", errors="replace")
    except Exception:  # noqa: BLE001 - bad base64 gives null, as documented
        return None


@F.pandas_udf(T.StringType())
def _decode_ps_udf(s: pd.Series) -> pd.Series:
    return s.map(_decode_one)


def decode_powershell(cmd) -> Column:
    """base64 payload after ``-e/-enc/-EncodedCommand`` -> the whole UTF-16LE text.

    Python's base64 and codec rules (padding check, replacement of bad code
    units) decide the result, so the decode runs in an Arrow-batched pandas
    UDF; it is only evaluated on rows where the regex matched.
    """
    pat = java_regex(K.ENCODED_POWERSHELL_RE, True)
    c = col(cmd)
    hit = c.rlike(pat)
    return F.when(hit, _decode_ps_udf(F.regexp_extract(c, pat, 1)))
