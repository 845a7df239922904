"""Legacy API.

The older, smaller event model: ``(timestamp, event_type, source, host, user,
ip, raw_message, metadata)`` and ``findings`` with a confidence and a list of
evidence events.  Parsing is one ``coalesce`` over three line formats; the
detectors are window/aggregate jobs like the main rules.

Deviation (documented): a legacy SSH/web line whose time does not parse is
rejected instead of aborting the run, and naive JSON times are read as UTC.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions import scalar as X
from ..functions.patterns import java_regex
from ..session import stored
from . import sequence as S
from .parse import _is_blank

LEGACY_COLS = ["timestamp", "event_type", "source", "host", "user", "ip", "raw_message", "metadata"]


class DetectionConfig:
    def __init__(self, brute_force_threshold: int = 5, brute_force_window_minutes: int = 10,
                 impossible_travel_min_minutes: int = 60) -> None:
        self.brute_force_threshold = brute_force_threshold
        self.brute_force_window_minutes = brute_force_window_minutes
        self.impossible_travel_min_minutes = impossible_travel_min_minutes


def _legacy_struct(**cols: Column) -> Column:
    types = {"timestamp": T.TimestampType()}
    return F.struct(*[(cols[c] if c in cols else F.lit(None)).cast(types.get(c, T.StringType())).alias(c)
                      for c in LEGACY_COLS])


def _json_event(rec: Column, line: Column) -> Column:
    """C11: a JSON object with a string ``timestamp``; other keys go to ``metadata``."""
    ts = X.json_iso_ts(rec["timestamp"], line, "timestamp")  # a JSON string value, not a number or object

    def dflt(key, d):
        return F.when(F.map_contains_key(rec, key), rec[key]).otherwise(F.lit(d))

    meta = F.to_json(F.map_filter(rec, lambda k, v: ~k.isin(K.LEGACY_JSON_RESERVED)))
    ev = _legacy_struct(timestamp=ts, event_type=dflt("event_type", "unknown"), source=dflt("source", "json"),
                        host=rec["host"], user=rec["user"], ip=rec["ip"], raw_message=dflt("message", ""),
                        metadata=meta)
    return F.when(rec.isNotNull() & ts.isNotNull(), ev)


def _ssh_event(line: Column, hit: Column, year: int) -> Column:
    """Failed-password lines anywhere in the text."""
    p = java_regex(K.LEGACY_SSH_RE)

    def g(i):
        return F.regexp_extract(line, p, i)
    ts = X.syslog_ts(g(1), g(2), g(3), year)
    ev = _legacy_struct(timestamp=ts, event_type=F.lit("auth_failure"), source=F.lit("linux_auth"), host=g(4),
                        user=g(5), ip=g(6), raw_message=line)
    return F.when(hit & ts.isNotNull(), ev)


def _web_event(line: Column, hit: Column) -> Column:
    """Access lines (no referer/agent needed) with sqli / xss / traversal flags on the path."""
    p = java_regex(K.LEGACY_WEB_RE)

    def g(i):
        return F.regexp_extract(line, p, i)
    path = g(4)
    ts = X.access_log_ts(g(2))
    meta = F.to_json(F.struct(g(3).alias("method"), path.alias("path"), g(5).cast("int").alias("status"),
                              g(6).alias("size"),
                              path.rlike(java_regex(K.LEGACY_SQLI_RE, True)).alias("sqli"),
                              path.rlike(java_regex(K.LEGACY_XSS_RE, True)).alias("xss"),
                              path.rlike(java_regex(K.LEGACY_TRAVERSAL_RE, True)).alias("path_traversal")))
    ev = _legacy_struct(timestamp=ts, event_type=F.lit("web_request"), source=F.lit("web"), ip=g(1),
                        raw_message=line, metadata=meta)
    return F.when(hit & ts.isNotNull(), ev)


def parse_legacy(df: DataFrame, year: int | None = None, value_col: str = "value") -> DataFrame:
    """C14: JSON, then SSH failure, then web; first match wins.  Sorted by time (H3) by the caller.

    Staged: the stripped line, then the JSON map and the two regex tests, then
    the chosen record; each stage is computed once per line.
    """
    year = year or _dt.datetime.now(_dt.timezone.utc).year
    v = F.col(value_col)
    d = df.withColumn("_blank", _is_blank(v))
    d = X.computed_once(d, _line=F.regexp_replace(F.regexp_replace(v, r"(?U)^\s+", ""), r"(?U)\s+$", ""))
    line = F.col("_line")
    d = X.computed_once(d, _lrec=F.from_json(line, T.MapType(T.StringType(), T.StringType())),
                        _sshm=line.rlike(java_regex(K.LEGACY_SSH_RE)), _webm=line.rlike(java_regex(K.LEGACY_WEB_RE)))
    ev = F.coalesce(_json_event(F.col("_lrec"), line), _ssh_event(line, F.col("_sshm"), year),
                    _web_event(line, F.col("_webm")))
    d = X.computed_once(d, _l=F.when(~F.col("_blank"), ev))
    keep = [c for c in df.columns if c != value_col]
    return d.filter(F.col("_l").isNotNull()).select(*keep, "_l.*")


def read_legacy(spark, path: str, year: int | None = None) -> DataFrame:
    """A file or a directory tree, every line tried, sorted by time; ties keep arrival order (H3)."""
    from ..sources.files import with_arrival_order
    df = with_arrival_order(spark.read.option("recursiveFileLookup", True).text(path), [path]).drop("source_file")
    return parse_legacy(df, year).orderBy("timestamp", "ingest_seq")


def event_json(prefix: str = "") -> Column:
    """``NormalizedEvent.to_dict()`` as JSON text."""
    return F.to_json(F.struct(X.iso_utc(F.col(prefix + "timestamp")).alias("timestamp"),
                              *[F.col(prefix + c).alias(c) for c in LEGACY_COLS[1:-1]],
                              F.from_json(F.col(prefix + "metadata"), "map<string,string>").alias("metadata")),
                     {"ignoreNullFields": "false"})


def _finding(rule_id, severity: Column, title, description: Column, confidence: Column, evidence: Column,
             first: Column, last: Column) -> list[Column]:
    return [F.lit(rule_id).alias("rule_id"), severity.alias("severity"), F.lit(title).alias("title"),
            description.alias("description"), confidence.cast("double").alias("confidence"),
            evidence.alias("evidence"), F.size(evidence).cast("bigint").alias("n_evidence"), first.alias("first_seen"), last.alias("last_seen")]


def _failures(events: DataFrame) -> DataFrame:
    """Failed logins with their group: null user or ip is a group of its own, so a sentinel that
    cannot come out of the parsers stands in for null."""
    f = events.filter(F.col("event_type").isin("auth_failure", "login_failure"))
    none = F.lit("\u0000null")
    return (f.withColumn("_us", F.unix_micros("timestamp")).withColumn("_ku", F.coalesce("user", none))
             .withColumn("_ki", F.coalesce("ip", none)))


def _first_windows(f: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """``(_ku, _ki, start_us, n)``: the first window of each group that reaches the threshold."""
    w_us = cfg.brute_force_window_minutes * 60 * 1_000_000
    n = S.forward_counts(f, ["_ku", "_ki"], "_us", w_us).filter(F.col("n") >= cfg.brute_force_threshold)
    return n.groupBy("_ku", "_ki").agg(F.min(F.struct(F.col("_us").alias("start_us"), "n")).alias("_w")).select(
        "_ku", "_ki", "_w.start_us", "_w.n")


def legacy_brute_force_evidence(events: DataFrame, config: DetectionConfig | None = None) -> DataFrame:
    """G3 evidence as a long table: ``user, ip, start_us, timestamp, event`` for every failure of a finding's
    window; the starts are sorted in among the failures (:func:`burst_members`), so a hot group is spread."""
    cfg = config or DetectionConfig()
    w_us = cfg.brute_force_window_minutes * 60 * 1_000_000
    f = stored(_failures(events), "legacy-failures")
    m = S.burst_members(f, _first_windows(f, cfg), ["_ku", "_ki"], "_us", w_us)
    return m.select("user", "ip", "start_us", "timestamp", event_json().alias("event"))


def legacy_brute_force(events: DataFrame, config: DetectionConfig | None = None) -> DataFrame:
    """G3 + F10: first qualifying window per (user, ip); null keys form their own group.

    The finding has the number of its events (``n_evidence``); the events themselves are the long table
    of :func:`legacy_brute_force_evidence`, since a window can hold any number of them.

    D6 predicates: failures are ``auth_failure``/``login_failure`` here,
    ``process_creation``/``windows_event`` for G8, ``web_request`` for G9 and
    ``login_success``/``auth_success`` for G4."""
    cfg = config or DetectionConfig()
    w_us = cfg.brute_force_window_minutes * 60 * 1_000_000
    f = stored(_failures(events).select("_ku", "_ki", "_us"), "legacy-failures")
    keys = ["_ku", "_ki"]
    m = S.burst_members(f, _first_windows(f, cfg), keys, "_us", w_us)
    g = m.groupBy(*keys, "start_us").agg(F.count(F.lit(1)).alias("_n"), F.max("_us").alias("_end"))
    first, last = F.timestamp_micros("start_us"), F.timestamp_micros("_end")
    out = g.select("_n", *_finding(
        "brute_force_login_attempts", F.lit("high"), K.LEGACY_TITLES["brute_force"], F.lit(K.LEGACY_TEXTS["brute_force"]),
        F.least(F.lit(0.95), F.lit(0.6) + F.lit(0.05) * F.col("_n")),
        F.array().cast("array<string>"), X.iso_utc(first), X.iso_utc(last)))
    return out.withColumn("n_evidence", F.col("_n")).drop("_n")


def is_encoded_powershell(msg: Column) -> Column:
    """J16."""
    return msg.rlike(java_regex(K.LEGACY_POWERSHELL_RE, True))


def legacy_encoded_powershell(events: DataFrame) -> DataFrame:
    """G8."""
    flag = F.get_json_object("metadata", "$.encoded_powershell")
    truthy = flag.isNotNull() & ~flag.isin("", "false", "0", "0.0", "[]", "{}")
    e = events.filter(F.col("event_type").isin("process_creation", "windows_event")
                      & (is_encoded_powershell(F.coalesce(F.col("raw_message"), F.lit(""))) | truthy))
    iso = X.iso_utc("timestamp")
    return e.select(*_finding("encoded_powershell", F.lit("critical"), K.LEGACY_TITLES["powershell"],
                              F.lit(K.LEGACY_TEXTS["powershell"]), F.lit(0.99),
                              F.array(event_json()), iso, iso))


def legacy_web_attacks(events: DataFrame) -> DataFrame:
    """G9."""
    def flag(k):
        v = F.get_json_object("metadata", f"$.{k}")
        return v.isNotNull() & ~v.isin("", "false", "0", "0.0", "[]", "{}")
    ind = F.array_compact(F.array(*[F.when(flag(k), F.lit(k)) for k in ("sqli", "xss", "path_traversal")]))
    e = events.filter(F.col("event_type") == "web_request").withColumn("_ind", ind).filter(F.size("_ind") > 0)
    iso = X.iso_utc("timestamp")
    sev = F.when(F.array_contains("_ind", "path_traversal"), F.lit("high")).otherwise(F.lit("medium"))
    desc = F.format_string(K.LEGACY_TEXTS["web_attack"], F.array_join("_ind", ", "))
    return e.select(*_finding("web_attack_pattern", sev, K.LEGACY_TITLES["web_attack"], desc,
                              F.lit(0.9), F.array(event_json()), iso, iso))


def legacy_impossible_travel(events: DataFrame, config: DetectionConfig | None = None) -> DataFrame:
    """First qualifying consecutive pair per user."""
    cfg = config or DetectionConfig()
    e = events.filter(F.col("event_type").isin("login_success", "auth_success")
                      & (F.col("user") != "") & (F.col("ip") != ""))
    # ties of time keep arrival order; without it, the order of the record's own text
    seq = F.col("ingest_seq") if "ingest_seq" in events.columns else F.struct(*LEGACY_COLS)
    e = stored(e.select(*LEGACY_COLS, F.unix_micros("timestamp").alias("_us"), seq.alias("_seq")), "legacy-logins")
    p = S.lag_by_key(e, ["user"], ["_us", "_seq"], ["_us", *LEGACY_COLS])
    p = p.filter(F.col("prev__us").isNotNull())
    delta = F.col("_us") - F.col("prev__us")
    p = p.filter((delta < cfg.impossible_travel_min_minutes * 60 * 1_000_000) & (F.col("prev_ip") != F.col("ip")))
    ca, cb = X.legacy_country_of_ip("prev_ip"), X.legacy_country_of_ip("ip")
    p = X.computed_once(p, _ca=ca, _cb=cb)
    p = p.filter(F.col("_ca").isNotNull() & F.col("_cb").isNotNull() & ~F.col("_ca").isin("ZZ", "XX")
                 & ~F.col("_cb").isin("ZZ", "XX") & (F.col("_ca") != F.col("_cb")))
    dist = X.bound(X.legacy_country_coords("_ca"), lambda a: X.bound(X.legacy_country_coords("_cb"), lambda b: F.when(
        a.isNotNull() & b.isNotNull(), X.haversine_km(a["lat"], a["lon"], b["lat"], b["lon"]))))
    p = X.computed_once(p, _d=dist).withColumn("_dh", delta / 3.6e9)
    p = p.filter((F.col("_dh") > 0) & (F.col("_d") / F.col("_dh") > 900) & (F.col("_d") >= 500))
    first = p.groupBy("user").agg(F.min_by(
        F.struct("prev_timestamp", "timestamp", event_json("prev_").alias("prev__j"), event_json().alias("_j")),
        F.struct("_us", "_seq")).alias("_p"))
    return first.select(*_finding(
        "impossible_travel", F.lit("medium"), K.LEGACY_TITLES["travel"], F.lit(K.LEGACY_TEXTS["travel"]), F.lit(0.8),
        F.array("_p.prev__j", "_p._j"), X.iso_utc("_p.prev_timestamp"), X.iso_utc("_p.timestamp")))


def detect_legacy(events: DataFrame, config: DetectionConfig | None = None) -> DataFrame:
    """Brute force, encoded PowerShell, web attacks, impossible travel, concatenated."""
    parts = [legacy_brute_force(events, config), legacy_encoded_powershell(events),
             legacy_web_attacks(events), legacy_impossible_travel(events, config)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def findings_summary(findings: DataFrame) -> DataFrame:
    """total, per severity and per rule in one grouping-sets pass."""
    g = findings.groupingSets([["severity"], ["rule_id"], []], "severity", "rule_id").agg(
        F.count(F.lit(1)).alias("n_findings"))
    return g.select(F.coalesce("severity", F.lit("")).alias("severity"),
                    F.coalesce("rule_id", F.lit("")).alias("rule_id"), "n_findings")


def findings_summary_dict(findings: DataFrame) -> dict:
    rows = findings_summary(findings).collect()
    return {
        "total_findings": next((r["n_findings"] for r in rows if not r["severity"] and not r["rule_id"]), 0),
        "severity_counts": {r["severity"]: r["n_findings"] for r in rows if r["severity"]},
        "rule_counts": {r["rule_id"]: r["n_findings"] for r in rows if r["rule_id"]},
        "impact_note": K.LEGACY_IMPACT_NOTE,
    }
