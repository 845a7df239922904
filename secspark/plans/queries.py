"""Registered queries: each runs the library's operators over whole driver tables.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names and types match the DuckDB SQL in :mod:`secspark.plans.oracle`.
Timestamps leave as epoch microseconds and arrays as joined text, so the
results hash the same in both engines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalar as X
from ..operators import legacy as L
from ..operators import parse as P
from ..operators import report as R
from ..operators.rules import (AdminGroupAdd, BruteForce, CredentialStuffing, ImpossibleTravel,
                               SuspiciousProcess, WebAttack)
from ..sources import files as SRC
from . import testbed as TB

BF_THRESHOLD, BF_WINDOW_S = 3, 86400
CS_WINDOW_S = 21600
LEGACY_CONFIG = L.DetectionConfig(brute_force_threshold=3, brute_force_window_minutes=24 * 60,
                                  impossible_travel_min_minutes=24 * 60)


def _us(c="timestamp"):
    return F.unix_micros(F.col(c)).alias("ts_us")


def _se(spark, sf_dir):
    from ..session import prepare
    prepare(spark)
    return TB.sec_events(spark, sf_dir)


def _events(spark, sf_dir, ip_col="source_ip"):
    return TB.as_events(_se(spark, sf_dir), ip_col)


# --------------------------------------------------------------------------
# Parse jobs (C1-C10, A12) over rendered text
# --------------------------------------------------------------------------
def parsed_ssh(spark, sf_dir):
    return P.parse(TB.render_ssh(_se(spark, sf_dir)), "linux_auth", TB.SSH_YEAR)


def parse_ssh(spark, sf_dir):
    p = parsed_ssh(spark, sf_dir)
    return p.select("event_id", _us(), "user_name", "source_ip", F.col("source_port").cast("bigint").alias("source_port"),
                    "destination_host", "event_outcome", "auth_method",
                    F.col("process_pid").cast("bigint").alias("process_pid"), F.col("labels")["host"].alias("label_host"))


def parsed_access(spark, sf_dir, fmt="nginx"):
    return P.parse(TB.render_access(_se(spark, sf_dir)), fmt)


def _access_cols(p):
    return p.select("event_id", _us(), "source_ip", "user_name", "http_method", "http_url",
                    F.col("http_status_code").cast("bigint").alias("http_status_code"), "http_user_agent",
                    "event_outcome", "source_type")


def parse_access(spark, sf_dir):
    return _access_cols(parsed_access(spark, sf_dir, "nginx"))


def parse_access_apache(spark, sf_dir):
    return _access_cols(parsed_access(spark, sf_dir, "apache"))


def parsed_windows(spark, sf_dir):
    return P.parse(TB.render_windows(_se(spark, sf_dir)), "windows_json")


def parse_windows(spark, sf_dir):
    p = parsed_windows(spark, sf_dir)
    return p.select("event_id", _us(), "event_action", "event_outcome", "user_name", "source_ip", "auth_method",
                    F.col("labels")["event_id"].alias("label_event_id"), "process_name", "process_parent_name",
                    "process_command_line")


def parsed_jsonl(spark, sf_dir):
    return P.parse(TB.render_jsonl(_se(spark, sf_dir)), "json")


def parse_jsonl(spark, sf_dir):
    p = parsed_jsonl(spark, sf_dir)
    return p.select(F.col("labels")["event_id"].cast("bigint").alias("event_id"), _us(), "source_type", "user_name",
                    "source_ip", F.col("source_port").cast("bigint").alias("source_port"), "event_action",
                    "event_outcome", "http_url", F.col("http_status_code").cast("string").alias("http_status_code"),
                    "auth_method", F.array_join(F.array_sort(F.map_keys("labels")), ",").alias("label_keys"),
                    F.col("labels")["k"].alias("label_k"))


def parse_rejects(spark, sf_dir):
    se = _se(spark, sf_dir)
    parts = [
        P.parse_counts(TB.render_ssh(se).withColumn("fmt", F.lit("linux_auth")), "linux_auth", ["fmt"], TB.SSH_YEAR),
        P.parse_counts(TB.render_access(se).union(TB.render_bad_access(se)).withColumn("fmt", F.lit("nginx")), "nginx", ["fmt"]),
        P.parse_counts(TB.render_windows(se).union(TB.render_bad_windows(se)).withColumn("fmt", F.lit("windows_json")), "windows_json",
                       ["fmt"]),
        P.parse_counts(TB.render_jsonl(se).withColumn("fmt", F.lit("json")), "json", ["fmt"]),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts).select("fmt", "parsed", "skipped")


# --------------------------------------------------------------------------
# Routing and sniffing
# --------------------------------------------------------------------------
def route_paths(se: DataFrame) -> DataFrame:
    eid = F.col("event_id")
    path = F.concat(TB.pick(TB.LOG_DIRS, eid), F.lit("/"), TB.pick(TB.LOG_NAMES, (eid / 4).cast("bigint")))
    path = F.when(eid % 7 == 0, F.upper(path)).otherwise(path)
    return se.select("event_id", path.alias("path"))


def route_format(spark, sf_dir):
    p = route_paths(_se(spark, sf_dir))
    return p.select("event_id", "path", SRC.route_format_col(F.col("path")).alias("fmt"))


def sniff_lines(se: DataFrame) -> DataFrame:
    """One line per event, grouped into one pseudo-file per user (order: event id)."""
    eid, v = F.col("event_id"), F.col("event_id") % 6
    line = (F.when(v == 0, F.concat(F.lit('{"EventID": '), eid.cast("string"), F.lit(', "TimeCreated": "x"}')))
             .when(v == 1, F.concat(F.lit('  {"timestamp": "x", "user_name": "'), F.col("user_name"), F.lit('"}')))
             .when(v == 2, F.concat(F.lit("Jan  1 00:00:00 h sshd[1]: Failed password for "), F.col("user_name"),
                                    F.lit(" from 1.2.3.4 port 1 ssh2")))
             .when(v == 3, F.concat(F.coalesce(F.col("source_ip"), F.lit("1.1.1.1")), F.lit(' - - [x] "GET / HTTP/1.1" 200 1 "-" "-"')))
             .when(v == 4, F.concat(F.lit("1.1.1.1 - - [x] \"PUT / HTTP/1.1\" 200 "), eid.cast("string")))
             .otherwise(F.lit("   ")))
    return se.select(F.col("user_id").alias("file_id"), eid.alias("line_no"), line.alias("value"))


def sniff_format(spark, sf_dir):
    lines = sniff_lines(_se(spark, sf_dir)).filter(~F.col("value").rlike(r"(?U)^\s*$"))
    first = lines.groupBy("file_id").agg(F.min_by("value", "line_no").alias("first"))
    return first.select("file_id", SRC.sniff_format_col(F.col("first")).alias("fmt"))


# --------------------------------------------------------------------------
# Union of sources
# --------------------------------------------------------------------------
def union_events(spark, sf_dir):
    se = _se(spark, sf_dir)
    parts = [P.parse(TB.render_ssh(se), "linux_auth", TB.SSH_YEAR), P.parse(TB.render_access(se), "nginx"),
             P.parse(TB.render_windows(se), "windows_json"), P.parse(TB.render_jsonl(se), "json")]
    cols = ["source_type", "event_action", "event_outcome", "user_name", "source_ip", "timestamp"]
    return reduce(lambda a, b: a.unionByName(b), [p.select(*cols) for p in parts])


def union_sources(spark, sf_dir):
    u = union_events(spark, sf_dir)
    return u.select("source_type", "event_action", "event_outcome", "user_name", "source_ip", _us())


def count_by_source(spark, sf_dir):
    return R.by_source_type(union_events(spark, sf_dir))


# --------------------------------------------------------------------------
# BF-001 (G1, F5, E7)
# --------------------------------------------------------------------------
def _bf():
    return BruteForce(threshold=BF_THRESHOLD, window_seconds=BF_WINDOW_S)


def bf_bursts(spark, sf_dir):
    t = _bf().typed(_events(spark, sf_dir))
    return t.select("source_ip", "user_name", "start_us", F.col("failed_attempts").cast("bigint").alias("failed_attempts"))


def bf_context(spark, sf_dir):
    t = _bf().typed(_events(spark, sf_dir))
    return t.select("source_ip", "user_name", F.col("failed_attempts").cast("bigint").alias("failed_attempts"),
                    X.iso_utc("first_seen_ts").alias("first_seen"), X.iso_utc("last_seen_ts").alias("last_seen"),
                    F.array_join("auth_methods", ",").alias("auth_methods"),
                    F.array_join("source_types", ",").alias("source_types"), "severity", "description")


def bf_evidence(spark, sf_dir):
    m = _bf().members(_events(spark, sf_dir))
    return m.select("source_ip", "user_name", "start_us", "event_id")


# --------------------------------------------------------------------------
# IT-001 and geo
# --------------------------------------------------------------------------
def it_pairs(spark, sf_dir):
    p = ImpossibleTravel().pairs(_events(spark, sf_dir))
    return p.select("user_name", F.col("prev_country").alias("from_country"), F.col("country").alias("to_country"),
                    F.col("prev_source_ip").alias("from_ip"), F.col("source_ip").alias("to_ip"),
                    F.round("distance_km", 1).alias("distance_km"),
                    F.floor(F.col("delta_us") / 1_000_000).cast("bigint").alias("delta_s"),
                    F.round("implied_speed_kmh", 1).alias("implied_speed_kmh"),
                    F.col("prev__us").alias("first_us"), F.col("_us").alias("second_us"),
                    X.timedelta_text(F.col("delta_us")).alias("delta_text"))


def geo_ips(se: DataFrame) -> DataFrame:
    eid, ip = F.col("event_id"), F.col("source_ip")
    v = eid % 8
    out = (F.when(v == 1, F.concat(F.lit("::ffff:"), ip))
            .when(v == 2, F.concat(F.lit("2001:db8::"), (eid % 100).cast("string")))
            .when(v == 3, F.concat(ip, F.lit(".1")))
            .when(v == 4, F.concat(F.lit("0"), ip))
            .when(v == 5, F.regexp_replace(ip, r"\.", ":"))
            .when(v == 6, F.concat(F.lit("10."), (eid % 256).cast("string"), F.lit(".0.1")))
            .when(v == 7, F.concat(F.lit("192.0.0."), (eid % 12).cast("string")))
            .otherwise(ip))
    return se.filter(ip.isNotNull()).select(out.alias("ip"))


def geo_lookup(spark, sf_dir):
    ips = geo_ips(_se(spark, sf_dir)).distinct()
    return ips.select("ip", X.country_of_ip("ip").alias("country"))


def geo_distance(spark, sf_dir):
    se = _se(spark, sf_dir).filter(F.col("event_type").isin("signup", "click"))
    c1 = X.country_of_ip("source_ip")
    c2 = X.lit_map(K.OCTET_TO_COUNTRY)[(1 + (F.col("event_id") * 13 + 5) % 50).cast("int")]
    a, b = X.country_coords(c1), X.country_coords(c2)
    return se.select("event_id", c1.alias("c1"), c2.alias("c2"),
                     F.round(X.haversine_km(a["lat"], a["lon"], b["lat"], b["lon"]), 1).alias("distance_km"))


# --------------------------------------------------------------------------
# SP-001 and WA-001
# --------------------------------------------------------------------------
def sp_alerts(spark, sf_dir):
    t = SuspiciousProcess().typed(_events(spark, sf_dir), keep=["event_id"])
    ctx = F.from_json("context", "struct<mitre_attack_ids:array<string>>")
    return t.select("event_id", "severity", F.array_join("matched_patterns", ",").alias("matched_patterns"),
                    F.array_join(ctx["mitre_attack_ids"], ",").alias("mitre_attack_ids"), "description")


def sp_decode(spark, sf_dir):
    t = SuspiciousProcess().typed(_events(spark, sf_dir), keep=["event_id"])
    return t.filter(F.col("decoded_payload").isNotNull()).select("event_id", "decoded_payload")


def path_basename(spark, sf_dir):
    se = _se(spark, sf_dir).filter(F.col("event_type") == "purchase")
    return se.select("event_id", X.basename_lower("process_parent_name").alias("parent_base"),
                     X.basename_lower("process_name").alias("child_base"))


def _wa_cols(t, id_col):
    ctx = F.from_json("context", "struct<mitre_attack_ids:array<string>>")
    return t.select(id_col, "severity", F.array_join("matched_patterns", ",").alias("matched_patterns"),
                    F.array_join("families_matched", ",").alias("families"),
                    F.array_join(ctx["mitre_attack_ids"], ",").alias("mitre_attack_ids"))


def wa_alerts(spark, sf_dir):
    return _wa_cols(WebAttack().typed(_events(spark, sf_dir), keep=["event_id"]), "event_id")


def wa_families(spark, sf_dir):
    t = WebAttack().typed(_events(spark, sf_dir))
    return (t.groupBy(F.array_join("families_matched", ",").alias("families"), "severity")
             .agg(F.count(F.lit(1)).alias("n_alerts")))


def page_events(spark, sf_dir):
    from ..operators.parse import event_struct
    pg = TB.load(spark, sf_dir, "pages")
    ev = event_struct(timestamp=F.timestamp_seconds(F.lit(0)), source_type=F.lit("pages"),
                      event_action=F.lit("http_request"), http_url=F.col("url"), http_user_agent=F.col("html"))
    return pg.select("page_id", ev.alias("_e")).select("page_id", "_e.*")


def wa_pages(spark, sf_dir):
    t = WebAttack().typed(page_events(spark, sf_dir), keep=["page_id"])
    return _wa_cols(t, "page_id")


# --------------------------------------------------------------------------
# Custom rules
# --------------------------------------------------------------------------
def cs_alerts(spark, sf_dir):
    t = CredentialStuffing(window_seconds=CS_WINDOW_S).typed(_events(spark, sf_dir, ip_col="user_ip"))
    return t.select("source_ip", "user_name", F.col("_us").alias("success_us"),
                    F.col("failed_attempts").cast("bigint").alias("failed_attempts"),
                    F.col("first_us").alias("first_failure_us"), "description")


def cs_evidence(spark, sf_dir):
    c = CredentialStuffing(window_seconds=CS_WINDOW_S).covered_failures(_events(spark, sf_dir, ip_col="user_ip"))
    return c.select("event_id", "source_ip", F.col("_us").alias("failure_us"), F.col("next_us").alias("success_us"))


def ag_alerts(spark, sf_dir):
    ev = P.parse(TB.render_group_adds(_se(spark, sf_dir)), "json")
    t = AdminGroupAdd().typed(ev, keep=["event_id"])
    return t.select("event_id", "user_name", "group", "severity", "description")


# --------------------------------------------------------------------------
# Alerts, ordering and rollups
# --------------------------------------------------------------------------
def _rules():
    return [_bf(), SuspiciousProcess(), WebAttack(), ImpossibleTravel()]


def _shared(df: DataFrame) -> DataFrame:
    """Several rules scan the same events: write them once, partitioned by kind."""
    from ..session import stored
    kind = "event_action" if "event_action" in df.columns else "event_type"
    return stored(df, "events", partition_by=[kind])


def all_alerts(spark, sf_dir):
    from ..operators.rules import detect
    return detect(_shared(_events(spark, sf_dir)), _rules())


def alerts_union(spark, sf_dir):
    a = all_alerts(spark, sf_dir)
    return a.select("rule_id", "severity", F.col("severity_rank").cast("bigint").alias("severity_rank"), _us(),
                    "n_source_events")


def alerts_newest(spark, sf_dir, k: int = 50):
    """Top-k report: the ``k`` newest alerts (the limit is the feature)."""
    a = R.newest_first(all_alerts(spark, sf_dir)).limit(k)
    w = Window.orderBy(F.col("ts_us").desc(), R.rule_order_col())
    return a.select("rule_id", _us()).withColumn("rank", F.row_number().over(w).cast("bigint"))


def alert_samples(spark, sf_dir):
    s = R.alert_samples(all_alerts(spark, sf_dir))
    return s.select("rule_id", _us())


def summary_by_rule(spark, sf_dir):
    return R.by_rule(all_alerts(spark, sf_dir)).select("rule_id", "n_alerts", "true_positive_estimate",
                                                          "false_positive_note")


def summary_by_severity(spark, sf_dir):
    return R.by_severity(all_alerts(spark, sf_dir))


def summary_totals(spark, sf_dir):
    return R.totals(all_alerts(spark, sf_dir), _events(spark, sf_dir))


# --------------------------------------------------------------------------
# Scalars (J8, J10)
# --------------------------------------------------------------------------
def severity_from_score(spark, sf_dir):
    e = TB.load(spark, sf_dir, "events")
    score = F.col("value") * 2.5 - 20
    return e.select("event_id", score.alias("score"), X.severity_from_score(score).alias("severity"))


def fingerprint(spark, sf_dir):
    from ..operators.rules.base import event_fingerprint
    ev = _events(spark, sf_dir)
    return ev.select("event_id", event_fingerprint().alias("fp"))


# --------------------------------------------------------------------------
# Legacy API
# --------------------------------------------------------------------------
def legacy_events(spark, sf_dir):
    lines = TB.render_legacy_lines(_se(spark, sf_dir))
    return L.parse_legacy(lines, TB.SSH_YEAR).withColumnRenamed("event_id", "ingest_seq")


def legacy_parse(spark, sf_dir):
    e = legacy_events(spark, sf_dir)
    return e.select(_us(), "event_type", "source", "host", "user", "ip",
                    F.get_json_object("metadata", "$.path").alias("path"),
                    F.get_json_object("metadata", "$.sqli").alias("sqli"),
                    F.get_json_object("metadata", "$.line_no").alias("line_no"))


def _findings_cols(f):
    return f.select("rule_id", "severity", "title", "confidence", "n_evidence",
                    "first_seen", "last_seen")


def legacy_bf(spark, sf_dir):
    return _findings_cols(L.legacy_brute_force(legacy_events(spark, sf_dir), LEGACY_CONFIG))


def legacy_ps(spark, sf_dir):
    return _findings_cols(L.legacy_encoded_powershell(legacy_events(spark, sf_dir)))


def legacy_web(spark, sf_dir):
    f = L.legacy_web_attacks(legacy_events(spark, sf_dir))
    return f.select("rule_id", "severity", "description", "confidence", "first_seen")


def legacy_it(spark, sf_dir):
    return _findings_cols(L.legacy_impossible_travel(legacy_events(spark, sf_dir), LEGACY_CONFIG))


def legacy_summary(spark, sf_dir):
    f = L.detect_legacy(_shared(legacy_events(spark, sf_dir)), LEGACY_CONFIG)
    return L.findings_summary(f)


QUERIES = {
    "parse_ssh": parse_ssh, "parse_access": parse_access, "parse_access_apache": parse_access_apache,
    "parse_windows": parse_windows, "parse_jsonl": parse_jsonl, "parse_rejects": parse_rejects,
    "route_format": route_format, "sniff_format": sniff_format,
    "union_sources": union_sources, "count_by_source": count_by_source,
    "bf_bursts": bf_bursts, "bf_context": bf_context, "bf_evidence": bf_evidence,
    "it_pairs": it_pairs, "geo_lookup": geo_lookup, "geo_distance": geo_distance,
    "sp_alerts": sp_alerts, "sp_decode": sp_decode, "path_basename": path_basename,
    "wa_alerts": wa_alerts, "wa_families": wa_families, "wa_pages": wa_pages,
    "cs_alerts": cs_alerts, "cs_evidence": cs_evidence, "ag_alerts": ag_alerts,
    "alerts_union": alerts_union, "alerts_newest": alerts_newest, "alert_samples": alert_samples,
    "summary_by_rule": summary_by_rule, "summary_by_severity": summary_by_severity,
    "summary_totals": summary_totals,
    "severity_from_score": severity_from_score, "fingerprint": fingerprint,
    "legacy_parse": legacy_parse, "legacy_bf": legacy_bf, "legacy_ps": legacy_ps,
    "legacy_web": legacy_web, "legacy_it": legacy_it, "legacy_summary": legacy_summary,
}
