"""DuckDB SQL oracles: for each registered query, the same result computed in SQL.

The driver tables are views named after the tables.  ``sec_events`` is the
mapping of :mod:`secspark.plans.testbed` written in DuckDB SQL; parse queries
are checked by computing the expected fields straight from it (a round trip
through the rendered text), rule queries by re-implementing the rule in SQL
(``RANGE`` frames, ``lag``, a recursive CTE for the greedy burst chain).
"""

from __future__ import annotations

from ..functions import constants as K
from ..functions import scalar as X
from ..functions.patterns import re2_regex, sql_str
from ..operators import legacy as L
from . import queries as Q
from . import testbed as TB


def _lst(values) -> str:
    return "[" + ", ".join(sql_str(v) if isinstance(v, str) else repr(v) for v in values) + "]"


def _pick(values, idx: str) -> str:
    return f"({_lst(values)})[(({idx}) % {len(values)}) + 1]"


def _v(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def _iso(c: str) -> str:
    """Python isoformat() of a UTC instant."""
    return (f"(strftime({c}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({c}) % 1000000 <> 0 THEN '.' || "
            f"lpad({_v(f'epoch_us({c}) % 1000000')}, 6, '0') ELSE '' END || '+00:00')")


_USER_IP = f"'203.0.' || {_v('user_id % 256')} || '.' || {_v('(user_id // 256) % 256 + 1')}"
_SUCC_IP = (f"{_v('1 + (7 * event_id + user_id) % 60')} || '.' || {_v('event_id % 256')} || '.' || "
            f"{_v('user_id % 256')} || '.' || {_v('(event_id // 256) % 256')}")
_WEB_IP = f"{_v('1 + (user_id * 7) % 200')} || '.' || {_v('event_id % 256')} || '.0.' || {_v('user_id % 256')}"
_STATUS = _pick(TB.HTTP_STATUS, "event_id")

SEC_EVENTS = f"""sec_events AS (
  SELECT event_id, user_id, event_type, value,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    ts AS timestamp, epoch_us(ts) AS us,
    'user' || {_v('user_id')} AS user_name,
    CASE WHEN event_type IN ('error','signup','click') THEN 'login' WHEN event_type = 'view' THEN 'http_request'
         WHEN event_type = 'purchase' THEN 'process_create' END AS event_action,
    CASE WHEN event_type = 'error' THEN 'failure'
         WHEN event_type = 'view' THEN CASE WHEN {_STATUS} < 400 THEN 'success' ELSE 'failure' END
         ELSE 'success' END AS event_outcome,
    CASE WHEN event_type = 'error' THEN {_USER_IP} WHEN event_type IN ('signup','click') THEN {_SUCC_IP}
         WHEN event_type = 'view' THEN {_WEB_IP} END AS source_ip,
    {_USER_IP} AS user_ip,
    1024 + event_id % 60000 AS source_port,
    1000 + event_id % 30000 AS pid,
    'web-0' || {_v('user_id % 4')} AS host,
    CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'ssh' ELSE 'ssh2' END
         WHEN event_type IN ('signup','click') THEN CASE WHEN event_id % 2 = 0 THEN 'publickey' ELSE 'password' END
    END AS auth_method,
    CASE WHEN event_type = 'view' THEN {_pick(TB.HTTP_METHODS, 'event_id')} END AS http_method,
    CASE WHEN event_type = 'view' THEN replace({_pick(TB.WEB_PATHS, 'event_id')}, '{{id}}', {_v('event_id')}) END AS http_url,
    CASE WHEN event_type = 'view' THEN {_STATUS} END AS http_status_code,
    CASE WHEN event_type = 'view' THEN {_pick(TB.USER_AGENTS, 'event_id // 7')} END AS http_user_agent,
    CASE WHEN event_type = 'purchase' THEN {_pick([p[0] for p in TB.PROCESSES], 'event_id')} END AS process_parent_name,
    CASE WHEN event_type = 'purchase' THEN {_pick([p[1] for p in TB.PROCESSES], 'event_id')} END AS process_name,
    CASE WHEN event_type = 'purchase' THEN replace({_pick([p[2] for p in TB.PROCESSES], 'event_id')}, '{{id}}',
         {_v('event_id')}) END AS process_command_line
  FROM events)"""


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join((SEC_EVENTS,) + ctes) + "\n"


def _ts_s(c="timestamp") -> str:
    return f"epoch_us(date_trunc('second', {c}))"


# --------------------------------------------------------------------------
# E1 / E2 / J5 in SQL
# --------------------------------------------------------------------------
def _country(ip: str) -> str:
    parts = [f"CAST(split_part({ip}, '.', {i}) AS BIGINT)" for i in range(1, 5)]
    v = f"({parts[0]} * 16777216 + {parts[1]} * 65536 + {parts[2]} * 256 + {parts[3]})"
    priv = []
    for net, plen in K.PRIVATE_V4_BLOCKS:
        lo = X._ip_to_int(net)
        priv.append(f"{v} BETWEEN {lo} AND {lo + (1 << (32 - plen)) - 1}")
    exc = ", ".join(str(X._ip_to_int(e)) for e in K.PRIVATE_V4_EXCEPTIONS)
    octet = " ".join(f"WHEN {o} THEN '{c}'" for o, c in K.OCTET_TO_COUNTRY.items())
    return (f"(CASE WHEN {ip} IS NULL OR {ip} = '' THEN NULL "
            f"WHEN regexp_matches({ip}, {sql_str(X.IPV4_RE)}) THEN "
            f"(CASE WHEN ({' OR '.join(priv)}) AND {v} NOT IN ({exc}) THEN 'ZZ' "
            f"ELSE coalesce(CASE {parts[0]} {octet} END, 'XX') END) "
            f"WHEN regexp_matches({ip}, {sql_str(X.IPV6_RE)}) THEN 'ZZ' END)")


def _octet_country(expr: str) -> str:
    return "(CASE " + expr + " " + " ".join(f"WHEN {o} THEN '{c}'" for o, c in K.OCTET_TO_COUNTRY.items()) + " END)"


def _coords_cte(name="coords", table=None) -> str:
    table = table or K.COUNTRY_COORDS
    rows = ", ".join(f"('{c}', CAST({la} AS DOUBLE), CAST({lo} AS DOUBLE))" for c, (la, lo) in table.items())
    return f"{name}(cc, lat, lon) AS (VALUES {rows})"


def _haversine(la1, lo1, la2, lo2) -> str:
    return (f"(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians({la2} - {la1}) / 2), 2) + "
            f"cos(radians({la1})) * cos(radians({la2})) * pow(sin(radians({lo2} - {lo1}) / 2), 2)))))")


# --------------------------------------------------------------------------
# Pattern batteries
# --------------------------------------------------------------------------
def _hits(text: str, catalogue) -> list[tuple[str, str, int, str]]:
    """(hit-name SQL, family, rank, mitre) per catalogue entry."""
    return [(f"CASE WHEN regexp_matches({text}, {sql_str(re2_regex(rx, ci))}) THEN '{name}' END",
             name.split("_")[0], K.SEVERITIES.index(sev), mitre) for name, rx, ci, sev, mitre in catalogue]


def _sev_name(rank_sql: str) -> str:
    return f"({_lst(K.SEVERITIES)})[({rank_sql}) + 1]"


def _basename(c: str) -> str:
    return f"lower(regexp_extract(coalesce({c}, ''), {sql_str(r'([^\\/]*)$')}, 1))"


def _sp_select() -> str:
    cmd = "coalesce(process_command_line, '')"
    hits = _hits(cmd, K.PROCESS_PATTERNS)
    pb, cb = _basename("process_parent_name"), _basename("process_name")
    pair = " OR ".join(f"({pb} = '{p}' AND {cb} = '{c}')" for p, c in K.SUSPICIOUS_PARENT_CHILD)
    pc = f"CASE WHEN {pair} THEN 'suspicious_parent_child:' || {pb} || '->' || {cb} END"
    names = [h[0] for h in hits] + [pc]
    ranks = [f"CASE WHEN ({h[0]}) IS NOT NULL THEN {h[2]} END" for h in hits] + [f"CASE WHEN ({pc}) IS NOT NULL THEN 3 END"]
    mitres = [f"CASE WHEN ({h[0]}) IS NOT NULL THEN '{h[3]}' END" for h in hits] + [f"CASE WHEN ({pc}) IS NOT NULL THEN '{K.PARENT_CHILD_MITRE}' END"]
    return (f"SELECT event_id, {_sev_name('greatest(' + ', '.join(ranks) + ')')} AS severity, "
            f"concat_ws(',', {', '.join(names)}) AS matched_patterns, "
            f"array_to_string(list_sort(list_distinct([{', '.join(mitres)}])), ',') AS mitre_attack_ids, "
            f"'Suspicious process execution detected: ' || concat_ws(', ', {', '.join(names)}) AS description, "
            f"greatest({', '.join(ranks)}) AS _rank, timestamp, {cmd} AS _cmd "
            f"FROM sec_events WHERE event_type = 'purchase'")


def _wa_select(id_col: str, url: str, agent: str, source: str, extra: str = "") -> str:
    hay = f"concat_ws(' ', nullif({url}, ''), nullif({agent}, ''))"
    hits = _hits("_hay", K.WEB_PATTERNS)
    names = [h[0] for h in hits]
    ranks = [f"CASE WHEN ({h[0]}) IS NOT NULL THEN {h[2]} END" for h in hits]
    fams = [f"CASE WHEN ({h[0]}) IS NOT NULL THEN '{h[1]}' END" for h in hits]
    mitres = [f"CASE WHEN ({h[0]}) IS NOT NULL THEN '{h[3]}' END" for h in hits]
    fam_list = f"list_sort(list_distinct([{', '.join(fams)}]))"
    top = f"greatest({', '.join(ranks)})"
    rank = f"CASE WHEN len({fam_list}) >= 2 AND {top} < 3 THEN 3 ELSE {top} END"
    inner = f"SELECT *, {hay} AS _hay FROM {source}"
    return (f"SELECT {id_col}, {_sev_name(rank)} AS severity, concat_ws(',', {', '.join(names)}) AS matched_patterns, "
            f"array_to_string({fam_list}, ',') AS families, "
            f"array_to_string(list_sort(list_distinct([{', '.join(mitres)}])), ',') AS mitre_attack_ids"
            f"{extra} FROM ({inner}) WHERE _hay <> '' AND {top} IS NOT NULL")


# --------------------------------------------------------------------------
# Per-query SQL
# --------------------------------------------------------------------------
PARSE_SSH = (f"SELECT event_id, {_ts_s()} AS ts_us, user_name, source_ip, CAST(source_port AS BIGINT) AS source_port, "
             "host AS destination_host, event_outcome, auth_method, CAST(pid AS BIGINT) AS process_pid, host AS label_host "
             "FROM sec_events WHERE event_type IN ('error','signup','click')")


def _parse_access(fmt: str) -> str:
    return (f"SELECT event_id, {_ts_s()} AS ts_us, source_ip, CASE WHEN event_id % 4 = 0 THEN user_name END AS user_name, "
            "http_method, http_url, CAST(http_status_code AS BIGINT) AS http_status_code, http_user_agent, event_outcome, "
            f"'{fmt}' AS source_type FROM sec_events WHERE event_type = 'view'")


PARSE_WINDOWS = (
    "SELECT event_id, epoch_us(timestamp) AS ts_us, "
    "CASE WHEN event_type = 'purchase' THEN 'process_create' ELSE 'login' END AS event_action, "
    "CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS event_outcome, "
    "CASE WHEN event_type = 'purchase' AND event_id % 4 = 2 THEN NULL ELSE user_name END AS user_name, "
    "CASE WHEN event_type = 'purchase' THEN NULL WHEN event_id % 4 IN (2, 3) THEN '127.0.0.1' ELSE source_ip END AS source_ip, "
    "CASE WHEN event_type = 'purchase' THEN NULL WHEN event_id % 4 = 3 THEN 'windows' "
    f"ELSE 'windows_logon_type_' || {_v('2 + k % 10')} END AS auth_method, "
    "CASE WHEN event_type = 'purchase' THEN '4688' WHEN event_id % 4 = 2 THEN '0' "
    "WHEN event_type = 'error' THEN '4625' ELSE '4624' END AS label_event_id, "
    "CASE WHEN event_type = 'purchase' THEN process_name END AS process_name, "
    "CASE WHEN event_type = 'purchase' AND event_id % 4 IN (0, 1) THEN process_parent_name END AS process_parent_name, "
    "CASE WHEN event_type = 'purchase' THEN process_command_line END AS process_command_line "
    "FROM sec_events WHERE event_type <> 'view'")

PARSE_JSONL = (
    "SELECT event_id, epoch_us(timestamp) AS ts_us, CASE WHEN event_id % 3 = 0 THEN 'custom' ELSE 'json' END AS source_type, "
    "user_name, source_ip, CAST(source_port AS BIGINT) AS source_port, event_action, event_outcome, http_url, "
    "CAST(http_status_code AS VARCHAR) AS http_status_code, auth_method, "
    "CASE WHEN event_id % 3 = 0 THEN 'event_id,k,source_type' ELSE 'event_id,k' END AS label_keys, "
    f"{_v('k')} AS label_k FROM sec_events WHERE event_id % 17 <> 0 AND event_id % 19 <> 0")

PARSE_REJECTS = (
    "SELECT 'linux_auth' AS fmt, count(*) FILTER (WHERE event_type IN ('error','signup','click')) AS parsed, "
    "count(*) FILTER (WHERE event_type = 'purchase') AS skipped FROM sec_events "
    "UNION ALL SELECT 'nginx', count(*) FILTER (WHERE event_type = 'view'), count(*) FILTER (WHERE event_type <> 'view') FROM sec_events "
    "UNION ALL SELECT 'windows_json', count(*) FILTER (WHERE event_type <> 'view'), count(*) FILTER (WHERE event_type = 'view') FROM sec_events "
    "UNION ALL SELECT 'json', count(*) FILTER (WHERE event_id % 17 <> 0 AND event_id % 19 <> 0), "
    "count(*) FILTER (WHERE event_id % 17 = 0 OR event_id % 19 = 0) FROM sec_events")


def _route_case(path: str) -> str:
    base = f"regexp_extract(lower({path}), '([^/]*)$', 1)"
    out = f"CASE WHEN starts_with({base}, 'apache') THEN 'apache' WHEN starts_with({base}, 'nginx') THEN 'nginx' "
    for ext, name in sorted(K.EXTENSION_MAP.items(), key=lambda kv: len(kv[0]), reverse=True):
        out += f"WHEN ends_with(lower({path}), '{ext}') THEN '{name}' "
    return out + "END"


ROUTE_FORMAT = (
    f"SELECT event_id, path, {_route_case('path')} AS fmt FROM ("
    "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN upper(p) ELSE p END AS path FROM ("
    f"SELECT event_id, {_pick(TB.LOG_DIRS, 'event_id')} || '/' || {_pick(TB.LOG_NAMES, 'event_id // 4')} AS p FROM sec_events))")

SNIFF_FORMAT = (
    "SELECT file_id, CASE v WHEN 0 THEN 'windows_json' WHEN 1 THEN 'json' WHEN 2 THEN 'linux_auth' "
    "WHEN 3 THEN 'nginx' END AS fmt FROM (SELECT user_id AS file_id, arg_min(event_id % 6, event_id) AS v "
    "FROM sec_events WHERE event_id % 6 <> 5 GROUP BY user_id)")

_WIN_UNION = ("SELECT 'windows_json' AS source_type, event_action, event_outcome, user_name, source_ip, ts_us FROM ("
              + PARSE_WINDOWS + ")")
UNION_SOURCES = (
    f"SELECT 'linux_auth' AS source_type, event_action, event_outcome, user_name, source_ip, {_ts_s()} AS ts_us "
    "FROM sec_events WHERE event_type IN ('error','signup','click') "
    f"UNION ALL SELECT 'nginx', 'http_request', event_outcome, CASE WHEN event_id % 4 = 0 THEN user_name END, source_ip, "
    f"{_ts_s()} FROM sec_events WHERE event_type = 'view' "
    f"UNION ALL {_WIN_UNION} "
    "UNION ALL SELECT CASE WHEN event_id % 3 = 0 THEN 'custom' ELSE 'json' END, event_action, event_outcome, user_name, "
    "source_ip, epoch_us(timestamp) FROM sec_events WHERE event_id % 17 <> 0 AND event_id % 19 <> 0")

W_BF = Q.BF_WINDOW_S * 1_000_000
BF_CTES = (
    "f AS (SELECT source_ip, user_name, us, event_id, timestamp, auth_method FROM sec_events WHERE event_type = 'error')",
    f"cand AS (SELECT DISTINCT source_ip, user_name, us AS t, count(*) OVER (PARTITION BY source_ip, user_name ORDER BY us "
    f"RANGE BETWEEN CURRENT ROW AND {W_BF} FOLLOWING) AS n FROM f)",
    f"c AS (SELECT * FROM cand WHERE n >= {Q.BF_THRESHOLD})",
    f"nx AS (SELECT a.source_ip, a.user_name, a.t, a.n, (SELECT min(b.t) FROM c b WHERE b.source_ip = a.source_ip "
    f"AND b.user_name = a.user_name AND b.t > a.t + {W_BF}) AS nxt FROM c a)",
    "chain AS (SELECT nx.* FROM nx JOIN (SELECT source_ip, user_name, min(t) AS t FROM c GROUP BY ALL) h "
    "USING (source_ip, user_name, t) UNION ALL SELECT nx.* FROM chain JOIN nx ON chain.source_ip = nx.source_ip "
    "AND chain.user_name = nx.user_name AND nx.t = chain.nxt)",
    f"m AS (SELECT chain.t AS start_us, f.* FROM chain JOIN f ON f.source_ip = chain.source_ip AND "
    f"f.user_name = chain.user_name AND f.us BETWEEN chain.t AND chain.t + {W_BF})",
    "bursts AS (SELECT source_ip, user_name, start_us, count(*) AS failed_attempts, min(timestamp) AS first_ts, "
    "max(timestamp) AS last_ts, array_to_string(list_sort(list_distinct(list(coalesce(nullif(auth_method, ''), 'unknown')))), ',') "
    "AS auth_methods FROM m GROUP BY source_ip, user_name, start_us)",
)
BF_BURSTS = _with(*BF_CTES) + "SELECT source_ip, user_name, start_us, failed_attempts FROM bursts"
BF_CONTEXT = _with(*BF_CTES) + (
    f"SELECT source_ip, user_name, failed_attempts, {_iso('first_ts')} AS first_seen, {_iso('last_ts')} AS last_seen, "
    "auth_methods, 'driver' AS source_types, 'high' AS severity, "
    "printf('%d failed logins for user ''%s'' from %s within %ds', failed_attempts, user_name, source_ip, "
    "CAST(floor((epoch_us(last_ts) - epoch_us(first_ts)) / 1000000) AS BIGINT)) AS description FROM bursts")
BF_EVIDENCE = _with(*BF_CTES) + "SELECT source_ip, user_name, start_us, event_id FROM m"

IT_CTES = (
    _coords_cte(),
    f"l AS (SELECT user_name, us, event_id, source_ip, {_country('source_ip')} AS country FROM sec_events "
    "WHERE event_type IN ('signup','click'))",
    "p AS (SELECT *, lag(us) OVER w AS p_us, lag(source_ip) OVER w AS p_ip, lag(country) OVER w AS p_c FROM l "
    "WHERE country IS NOT NULL AND country NOT IN ('ZZ','XX') WINDOW w AS (PARTITION BY user_name ORDER BY us, event_id))",
    f"d AS (SELECT p.*, {_haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS dist, us - p_us AS delta FROM p "
    "JOIN coords a ON a.cc = upper(p.p_c) JOIN coords b ON b.cc = upper(p.country) WHERE p_us IS NOT NULL AND p_c <> country)",
    "it AS (SELECT *, dist / (delta / 3.6e9) AS speed FROM d WHERE dist >= 500 AND delta > 0 AND dist / (delta / 3.6e9) > 900)",
)
IT_PAIRS = _with(*IT_CTES) + (
    "SELECT user_name, p_c AS from_country, country AS to_country, p_ip AS from_ip, source_ip AS to_ip, "
    "round(dist, 1) AS distance_km, CAST(floor(delta / 1000000) AS BIGINT) AS delta_s, round(speed, 1) AS implied_speed_kmh, "
    "p_us AS first_us, us AS second_us, "
    # J12: days only if any, then H:MM:SS and the microseconds only if any
    "CASE WHEN delta // 86400000000 = 0 THEN '' WHEN delta // 86400000000 = 1 THEN '1 day, ' "
    "ELSE CAST(delta // 86400000000 AS VARCHAR) || ' days, ' END "
    "|| CAST(delta // 3600000000 % 24 AS VARCHAR) || ':' || lpad(CAST(delta // 60000000 % 60 AS VARCHAR), 2, '0') "
    "|| ':' || lpad(CAST(delta // 1000000 % 60 AS VARCHAR), 2, '0') "
    "|| CASE WHEN delta % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(delta % 1000000 AS VARCHAR), 6, '0') END AS delta_text "
    "FROM it")


def _geo_ip() -> str:
    v = "event_id % 8"
    return (f"CASE WHEN {v} = 1 THEN '::ffff:' || source_ip WHEN {v} = 2 THEN '2001:db8::' || {_v('event_id % 100')} "
            f"WHEN {v} = 3 THEN source_ip || '.1' WHEN {v} = 4 THEN '0' || source_ip "
            f"WHEN {v} = 5 THEN replace(source_ip, '.', ':') WHEN {v} = 6 THEN '10.' || {_v('event_id % 256')} || '.0.1' "
            f"WHEN {v} = 7 THEN '192.0.0.' || {_v('event_id % 12')} ELSE source_ip END")


GEO_LOOKUP = (f"SELECT ip, {_country('ip')} AS country FROM (SELECT DISTINCT {_geo_ip()} AS ip FROM sec_events "
              "WHERE source_ip IS NOT NULL)")
GEO_DISTANCE = _with(_coords_cte()) + (
    f"SELECT event_id, c1, c2, round({_haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 1) AS distance_km FROM ("
    f"SELECT event_id, {_country('source_ip')} AS c1, {_octet_country('1 + (event_id * 13 + 5) % 50')} AS c2 FROM sec_events "
    "WHERE event_type IN ('signup','click')) q LEFT JOIN coords a ON a.cc = upper(c1) LEFT JOIN coords b ON b.cc = upper(c2)")

SP_BASE = f"sp AS ({_sp_select()})"
SP_ALERTS = _with(SP_BASE) + "SELECT event_id, severity, matched_patterns, mitre_attack_ids, description FROM sp WHERE _rank IS NOT NULL"
SP_DECODE = _with(SP_BASE) + (
    f"SELECT event_id, replace(decode(from_base64(regexp_extract(_cmd, {sql_str(re2_regex(K.ENCODED_POWERSHELL_RE, True))}, 1))), "
    f"chr(0), '') AS decoded_payload FROM sp WHERE _rank IS NOT NULL AND "
    f"regexp_matches(_cmd, {sql_str(re2_regex(K.ENCODED_POWERSHELL_RE, True))})")
PATH_BASENAME = (f"SELECT event_id, {_basename('process_parent_name')} AS parent_base, {_basename('process_name')} AS child_base "
                 "FROM sec_events WHERE event_type = 'purchase'")

WA_BASE = "wa AS (" + _wa_select("event_id", "http_url", "http_user_agent", "sec_events WHERE event_type = 'view'") + ")"
WA_ALERTS = _with(WA_BASE) + "SELECT event_id, severity, matched_patterns, families, mitre_attack_ids FROM wa"
WA_FAMILIES = _with(WA_BASE) + "SELECT families, severity, count(*) AS n_alerts FROM wa GROUP BY families, severity"
WA_PAGES = _wa_select("page_id", "url", "html", "pages")

W_CS = Q.CS_WINDOW_S * 1_000_000
CS_ALERTS = _with(
    "l AS (SELECT event_id, us, user_ip AS source_ip, user_name, event_type FROM sec_events "
    "WHERE event_type IN ('error','signup','click'))",
    f"m AS (SELECT s.source_ip, s.user_name, s.us AS success_us, count(*) AS failed_attempts, min(f.us) AS first_failure_us "
    f"FROM l s JOIN l f ON f.source_ip = s.source_ip AND f.event_type = 'error' AND f.us >= s.us - {W_CS} "
    "AND (f.us < s.us OR (f.us = s.us AND f.event_id < s.event_id)) WHERE s.event_type IN ('signup','click') "
    "GROUP BY s.source_ip, s.user_name, s.us, s.event_id)") + (
    "SELECT source_ip, user_name, success_us, failed_attempts, first_failure_us, "
    f"'Successful login for ''' || user_name || ''' from ' || source_ip || ' followed ' || {_v('failed_attempts')} "
    f"|| ' failed login(s) within {Q.CS_WINDOW_S}s' AS description FROM m")

CS_EVIDENCE = _with(
    "l AS (SELECT event_id, us, user_ip AS source_ip, event_type FROM sec_events WHERE event_type IN ('error','signup','click'))",
    "n AS (SELECT f.event_id, f.source_ip, f.us AS failure_us, (SELECT min(s.us) FROM l s WHERE s.source_ip = f.source_ip "
    "AND s.event_type <> 'error' AND (s.us > f.us OR (s.us = f.us AND s.event_id > f.event_id))) AS success_us "
    "FROM l f WHERE f.event_type = 'error')") + (
    f"SELECT event_id, source_ip, failure_us, success_us FROM n WHERE success_us <= failure_us + {W_CS}")

_GROUP = _pick(TB.GROUPS, "event_id // 5")
AG_ALERTS = (
    f"SELECT event_id, user_name, grp AS \"group\", 'high' AS severity, "
    "'User ''' || user_name || ''' added to local admins group ''' || grp || '''' AS description FROM ("
    f"SELECT event_id, user_name, {_GROUP} AS grp FROM sec_events WHERE event_type = 'signup') "
    f"WHERE lower(grp) IN ({', '.join(sql_str(g) for g in K.ADMIN_GROUPS)})")

ALL_ALERTS = _with(*BF_CTES, *IT_CTES, SP_BASE, WA_BASE,
                   "alerts AS ("
                   "SELECT 'BF-001' AS rule_id, 'high' AS severity, epoch_us(last_ts) AS ts_us, failed_attempts AS n_source_events FROM bursts "
                   "UNION ALL SELECT 'SP-001', severity, epoch_us(timestamp), 1 FROM sp WHERE _rank IS NOT NULL "
                   "UNION ALL SELECT 'WA-001', w.severity, s.us, 1 FROM wa w JOIN sec_events s USING (event_id) "
                   "UNION ALL SELECT 'IT-001', 'medium', us, 2 FROM it)")
_RULE_ORDER = "CASE rule_id " + " ".join(f"WHEN '{r}' THEN {i + 1}" for i, r in enumerate(K.RULE_ORDER)) + " ELSE 5 END"
ALERTS_UNION = ALL_ALERTS + (
    "SELECT rule_id, severity, CAST(CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 "
    "WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END AS BIGINT) AS severity_rank, ts_us, "
    "CAST(n_source_events AS BIGINT) AS n_source_events FROM alerts")
ALERTS_NEWEST = ALL_ALERTS + (
    f"SELECT rule_id, ts_us, row_number() OVER (ORDER BY ts_us DESC, {_RULE_ORDER}) AS rank FROM alerts "
    f"ORDER BY ts_us DESC, {_RULE_ORDER} LIMIT 50")
ALERT_SAMPLES = ALL_ALERTS + "SELECT rule_id, max(ts_us) AS ts_us FROM alerts GROUP BY rule_id"
_PRIOR = "CASE rule_id " + " ".join(f"WHEN '{r}' THEN CAST({p} AS DOUBLE)" for r, p in K.TRUE_POSITIVE_ESTIMATES.items()) + " END"
_NOTE = "CASE rule_id " + " ".join(
    "WHEN '{}' THEN '{}'".format(*n.split(": ", 1)) for n in K.FALSE_POSITIVE_NOTES) + " END"
SUMMARY_BY_RULE = ALL_ALERTS + (f"SELECT rule_id, count(*) AS n_alerts, {_PRIOR} AS true_positive_estimate, "
                                f"{_NOTE} AS false_positive_note FROM alerts GROUP BY rule_id")
SUMMARY_BY_SEVERITY = ALL_ALERTS + "SELECT severity, count(*) AS n_alerts FROM alerts GROUP BY severity"
SUMMARY_TOTALS = ALL_ALERTS + ("SELECT (SELECT count(*) FROM alerts) AS total_alerts, "
                               "(SELECT count(*) FROM sec_events) AS event_count")

_SCORE = "(value * 2.5 - 20)"
_CLAMP = f"greatest(0, least(100, CAST(trunc({_SCORE}) AS BIGINT)))"
SEVERITY_FROM_SCORE = (
    f"SELECT event_id, {_SCORE} AS score, CASE WHEN {_CLAMP} >= 90 THEN 'critical' WHEN {_CLAMP} >= 70 THEN 'high' "
    f"WHEN {_CLAMP} >= 40 THEN 'medium' WHEN {_CLAMP} >= 10 THEN 'low' ELSE 'info' END AS severity FROM events")

def _js(x: str) -> str:
    """A JSON string of printable ASCII text, or null."""
    return f"coalesce(CAST(to_json({x}) AS VARCHAR), 'null')"


_FP_FIELDS = {
    # the fields that the mapping leaves empty
    **dict.fromkeys(["destination_ip", "destination_port", "event_reason", "raw", "source_geo_country", "user_id"], "'null'"),
    "auth_method": _js("auth_method"), "destination_host": _js("host"), "event_action": _js("event_action"),
    "event_outcome": _js("event_outcome"), "http_method": _js("http_method"),
    "http_status_code": f"coalesce({_v('http_status_code')}, 'null')",
    "http_url": _js("http_url"), "http_user_agent": _js("http_user_agent"), "labels": "'{}'",
    "process_command_line": _js("process_command_line"), "process_name": _js("process_name"),
    "process_parent_name": _js("process_parent_name"), "process_pid": f"coalesce({_v('pid')}, 'null')",
    "source_ip": _js("source_ip"), "source_port": f"coalesce({_v('source_port')}, 'null')",
    "source_type": _js("'driver'"), "timestamp": _js(_iso("timestamp")), "user_name": _js("user_name"),
}
FINGERPRINT = ("SELECT event_id, sha256('{' || "
               + " || ', ' || ".join(f"'\"{n}\": ' || {e}" for n, e in sorted(_FP_FIELDS.items())) + " || '}') AS fp FROM sec_events")

# --------------------------------------------------------------------------
# Legacy
# --------------------------------------------------------------------------
_LMETHOD = _pick(TB.LEGACY_METHODS, "event_id")
_LPATH = "http_url || ' HTTP/1.1'"
LEGACY_EVENTS = (
    "lev AS ("
    f"SELECT event_id, {_ts_s()} AS ts_us, date_trunc('second', timestamp) AS ts, 'auth_failure' AS event_type, "
    "'linux_auth' AS source, host, user_name AS \"user\", user_ip AS ip, NULL AS path, NULL AS sqli, NULL AS xss, "
    "NULL AS trav, NULL AS line_no, NULL AS cmd, false AS enc FROM sec_events WHERE event_type = 'error' "
    f"UNION ALL SELECT event_id, {_ts_s()}, date_trunc('second', timestamp), 'web_request', 'web', NULL, NULL, source_ip, "
    f"{_LPATH}, {_v('regexp_matches(' + _LPATH + ', ' + sql_str(re2_regex(K.LEGACY_SQLI_RE, True)) + ')')}, "
    f"{_v('regexp_matches(' + _LPATH + ', ' + sql_str(re2_regex(K.LEGACY_XSS_RE, True)) + ')')}, "
    f"{_v('regexp_matches(' + _LPATH + ', ' + sql_str(re2_regex(K.LEGACY_TRAVERSAL_RE, True)) + ')')}, NULL, NULL, false "
    f"FROM sec_events WHERE event_type = 'view' AND {_LMETHOD} <> 'HEAD' "
    "UNION ALL SELECT event_id, epoch_us(timestamp), timestamp, CASE WHEN event_id % 2 = 0 THEN 'login_success' "
    f"ELSE 'auth_success' END, 'vpn', host, user_name, source_ip, NULL, NULL, NULL, NULL, {_v('event_id')}, 'login ok', false "
    "FROM sec_events WHERE event_type IN ('signup','click') "
    "UNION ALL SELECT event_id, epoch_us(timestamp), timestamp, CASE WHEN event_id % 2 = 0 THEN 'process_creation' "
    f"ELSE 'windows_event' END, 'windows', host, user_name, NULL, NULL, NULL, NULL, NULL, {_v('event_id')}, "
    "process_command_line, event_id % 9 = 0 FROM sec_events WHERE event_type = 'purchase')")
LEGACY_PARSE = _with(LEGACY_EVENTS) + 'SELECT ts_us, event_type, source, host, "user", ip, path, sqli, line_no FROM lev'

_LC = Q.LEGACY_CONFIG
W_LBF = _LC.brute_force_window_minutes * 60 * 1_000_000
_CONF = "least(CAST(0.95 AS DOUBLE), CAST(0.6 AS DOUBLE) + CAST(0.05 AS DOUBLE) * n)"


def _legacy_country(ip: str) -> str:
    octet = f"TRY_CAST(split_part({ip}, '.', 1) AS INTEGER)"
    cases = " ".join(f"WHEN {o} THEN '{c}'" for o, c in K.LEGACY_COUNTRY_BY_OCTET.items())
    return (f"(CASE WHEN {ip} IS NULL OR {ip} = '' THEN NULL WHEN len(string_split({ip}, '.')) <> 4 THEN NULL "
            f"WHEN {octet} IS NULL THEN NULL ELSE coalesce(CASE {octet} {cases} END, 'XX') END)")


LEGACY_FINDING_CTES = (
    LEGACY_EVENTS,
    "lf AS (SELECT * FROM lev WHERE event_type IN ('auth_failure','login_failure'))",
    f"lc AS (SELECT \"user\", ip, ts_us AS t, count(*) OVER (PARTITION BY \"user\", ip ORDER BY ts_us RANGE BETWEEN "
    f"CURRENT ROW AND {W_LBF} FOLLOWING) AS n FROM lf)",
    f"lstart AS (SELECT \"user\", ip, min(t) AS t FROM lc WHERE n >= {_LC.brute_force_threshold} GROUP BY ALL)",
    f"lbf AS (SELECT 'brute_force_login_attempts' AS rule_id, 'high' AS severity, 'Brute force login attempts detected' AS title, "
    f"{_CONF} AS confidence, n AS n_evidence, {_iso('first_ts')} AS first_seen, {_iso('last_ts')} AS last_seen FROM ("
    "SELECT s.\"user\", s.ip, count(*) AS n, min(f.ts) AS first_ts, max(f.ts) AS last_ts FROM lstart s JOIN lf f "
    f"ON f.\"user\" IS NOT DISTINCT FROM s.\"user\" AND f.ip IS NOT DISTINCT FROM s.ip AND f.ts_us BETWEEN s.t AND s.t + {W_LBF} "
    "GROUP BY s.\"user\", s.ip, s.t))",
    "lps AS (SELECT 'encoded_powershell' AS rule_id, 'critical' AS severity, 'Encoded PowerShell detected' AS title, "
    f"CAST(0.99 AS DOUBLE) AS confidence, CAST(1 AS BIGINT) AS n_evidence, {_iso('ts')} AS first_seen, {_iso('ts')} AS last_seen "
    "FROM lev WHERE event_type IN ('process_creation','windows_event') AND "
    f"(regexp_matches(coalesce(cmd, ''), {sql_str(re2_regex(K.LEGACY_POWERSHELL_RE, True))}) OR enc))",
    "lweb AS (SELECT 'web_attack_pattern' AS rule_id, CASE WHEN trav = 'true' THEN 'high' ELSE 'medium' END AS severity, "
    "'The request path matched: ' || concat_ws(', ', CASE WHEN sqli = 'true' THEN 'sqli' END, "
    "CASE WHEN xss = 'true' THEN 'xss' END, CASE WHEN trav = 'true' THEN 'path_traversal' END) || '.' AS description, "
    f"CAST(0.9 AS DOUBLE) AS confidence, {_iso('ts')} AS first_seen FROM lev WHERE event_type = 'web_request' "
    "AND (sqli = 'true' OR xss = 'true' OR trav = 'true'))",
    _coords_cte("lcoords", K.LEGACY_COUNTRY_COORDS),
    "llog AS (SELECT * FROM lev WHERE event_type IN ('login_success','auth_success') AND \"user\" <> '' AND ip <> '')",
    "lpair AS (SELECT *, lag(ts_us) OVER w AS p_us, lag(ip) OVER w AS p_ip, lag(ts) OVER w AS p_ts FROM llog "
    "WINDOW w AS (PARTITION BY \"user\" ORDER BY ts_us, event_id))",
    "lcc AS (SELECT *, " + _legacy_country("p_ip") + " AS ca, " + _legacy_country("ip") + " AS cb FROM lpair "
    f"WHERE p_us IS NOT NULL AND ts_us - p_us < {_LC.impossible_travel_min_minutes * 60 * 1_000_000} AND p_ip <> ip)",
    f"ld AS (SELECT lcc.*, {_haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS dist, (ts_us - p_us) / 3.6e9 AS dh FROM lcc "
    "JOIN lcoords a ON a.cc = upper(ca) JOIN lcoords b ON b.cc = upper(cb) "
    "WHERE ca NOT IN ('ZZ','XX') AND cb NOT IN ('ZZ','XX') AND ca <> cb)",
    "lit AS (SELECT 'impossible_travel' AS rule_id, 'medium' AS severity, 'Impossible travel style anomaly detected' AS title, "
    f"CAST(0.8 AS DOUBLE) AS confidence, CAST(2 AS BIGINT) AS n_evidence, {_iso('p_ts')} AS first_seen, {_iso('ts')} AS last_seen "
    "FROM (SELECT *, row_number() OVER (PARTITION BY \"user\" ORDER BY ts_us, event_id) AS rn FROM ld "
    "WHERE dh > 0 AND dist / dh > 900 AND dist >= 500) WHERE rn = 1)",
)
_LCOLS = "rule_id, severity, title, confidence, n_evidence, first_seen, last_seen"
LEGACY_BF = _with(*LEGACY_FINDING_CTES) + f"SELECT {_LCOLS} FROM lbf"
LEGACY_PS = _with(*LEGACY_FINDING_CTES) + f"SELECT {_LCOLS} FROM lps"
LEGACY_WEB = _with(*LEGACY_FINDING_CTES) + "SELECT rule_id, severity, description, confidence, first_seen FROM lweb"
LEGACY_IT = _with(*LEGACY_FINDING_CTES) + f"SELECT {_LCOLS} FROM lit"
LEGACY_SUMMARY = _with(*LEGACY_FINDING_CTES) + (
    "SELECT coalesce(severity, '') AS severity, coalesce(rule_id, '') AS rule_id, count(*) AS n_findings FROM ("
    "SELECT rule_id, severity FROM lbf UNION ALL SELECT rule_id, severity FROM lps UNION ALL "
    "SELECT rule_id, severity FROM lweb UNION ALL SELECT rule_id, severity FROM lit) "
    "GROUP BY GROUPING SETS ((severity), (rule_id), ())")


def _plain(sql: str) -> str:
    return sql if sql.startswith("WITH") else _with() + sql


ORACLES: dict[str, str] = {k: _plain(v) for k, v in {
    "parse_ssh": PARSE_SSH, "parse_access": _parse_access("nginx"), "parse_access_apache": _parse_access("apache"),
    "parse_windows": PARSE_WINDOWS, "parse_jsonl": PARSE_JSONL, "parse_rejects": PARSE_REJECTS,
    "route_format": ROUTE_FORMAT, "sniff_format": SNIFF_FORMAT,
    "union_sources": UNION_SOURCES,
    "count_by_source": "SELECT source_type, count(*) AS n_events FROM (" + UNION_SOURCES + ") GROUP BY source_type",
    "bf_bursts": BF_BURSTS, "bf_context": BF_CONTEXT, "bf_evidence": BF_EVIDENCE,
    "it_pairs": IT_PAIRS, "geo_lookup": GEO_LOOKUP, "geo_distance": GEO_DISTANCE,
    "sp_alerts": SP_ALERTS, "sp_decode": SP_DECODE, "path_basename": PATH_BASENAME,
    "wa_alerts": WA_ALERTS, "wa_families": WA_FAMILIES, "wa_pages": WA_PAGES,
    "cs_alerts": CS_ALERTS, "cs_evidence": CS_EVIDENCE, "ag_alerts": AG_ALERTS,
    "alerts_union": ALERTS_UNION, "alerts_newest": ALERTS_NEWEST, "alert_samples": ALERT_SAMPLES,
    "summary_by_rule": SUMMARY_BY_RULE, "summary_by_severity": SUMMARY_BY_SEVERITY, "summary_totals": SUMMARY_TOTALS,
    "severity_from_score": SEVERITY_FROM_SCORE, "fingerprint": FINGERPRINT,
    "legacy_parse": LEGACY_PARSE, "legacy_bf": LEGACY_BF, "legacy_ps": LEGACY_PS, "legacy_web": LEGACY_WEB,
    "legacy_it": LEGACY_IT, "legacy_summary": LEGACY_SUMMARY,
}.items()}
