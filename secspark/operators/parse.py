"""Parse jobs: raw text / JSON records -> normalised ``events`` rows.

Each parser is a ``DataFrame -> DataFrame`` function over any frame with a
string ``value`` column (one log line or one JSON record).  It adds one
nullable struct column ``_evt`` holding the event fields, or null when the
record does not parse.  Everything is built from built-in column expressions,
so the same code runs on a batch scan or a ``readStream``, and all other
columns (``source_file``, ``ingest_seq``, ...) pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions import scalar as X
from ..functions.patterns import java_regex
from ..schema import EVENT_FIELDS

EVT = "_evt"

# --------------------------------------------------------------------------
# FIXED VALUES: SSH auth-log line formats (C1-C3), tried in this order.
# --------------------------------------------------------------------------
_SSH_HEAD = (r"^(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+"
             r"(\S+)\s+(sshd)\[(\d+)\]:\s+")
_IP = r"(\d{1,3}(?:\.\d{1,3}){3})"

# FIXED VALUES: combined access-log format (C4).
ACCESS_RE = (r"^(\d{1,3}(?:\.\d{1,3}){3})\s+-\s+(\S+)\s+\[([^\]]+)\]\s+\"([^\"]*)\"\s+"
             r"(\d{3})\s+(\d+)\s+\"([^\"]*)\"\s+\"([^\"]*)\"")

# FIXED VALUES: event id inside a Windows message text.
WIN_EVENT_ID_RE = r"\bEventID\s*[:=]?\s*(\d+)"


def _null(t: T.DataType = T.StringType()) -> Column:
    return F.lit(None).cast(t)


def _empty_labels() -> Column:
    return F.create_map().cast(T.MapType(T.StringType(), T.StringType()))


def event_struct(**cols: Column) -> Column:
    """Build the event struct; fields not given are null (labels: empty map)."""
    out = []
    for name, dtype in EVENT_FIELDS:
        if name in cols:
            out.append(cols[name].cast(dtype).alias(name))
        elif name == "labels":
            out.append(_empty_labels().alias(name))
        else:
            out.append(_null(dtype).alias(name))
    return F.struct(*out)


def _is_blank(value: Column) -> Column:
    return value.isNull() | value.rlike(r"(?U)^\s*$")


def raw_line(value: Column) -> Column:
    return F.to_json(F.struct(value.alias("line")))


# --------------------------------------------------------------------------
# Staged parsing.  Each format first materialises its raw fields as temporary
# columns (one regex / one JSON parse per record), then assembles the event
# struct from those columns.  Keeping the stages as separate projections lets
# Catalyst reuse each extraction instead of repeating it inside every branch.
# --------------------------------------------------------------------------
def _stage(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    return df.withColumns(cols)


# SSH auth log (C1 failed password, C2 accepted, C3 invalid user).
# One alternation covers the three message forms; the
# branches start with different literal words, so the first branch that
# matches is the one the sequential tries would pick.
SSH_ANY_RE = (_SSH_HEAD + r"(?:Failed password for\s+(?:invalid user\s+)?(\S+)\s+from\s+" + _IP
              + r"\s+port\s+(\d+)\s+(\S+)|Accepted\s+(\S+)\s+for\s+(\S+)\s+from\s+" + _IP
              + r"\s+port\s+(\d+)|Invalid user\s+(\S+)\s+from\s+" + _IP + r"\s+port\s+(\d+))")
_SSH_GROUPS = 17  # head 1-6; failed 7-10; accepted 11-14; invalid 15-17


def _ssh_stage(df: DataFrame, v: Column, year: int) -> tuple[DataFrame, Column]:
    p = java_regex(SSH_ANY_RE)
    # every group is made of non-space characters, so a newline is a safe separator
    repl = "\n".join(f"${i}" for i in range(1, _SSH_GROUPS + 1))
    df = _stage(df, {"_m": F.when(v.rlike(p), F.split(F.regexp_replace(v, p + "(?s:.*)$", repl), "\n"))})
    g = {i: F.col("_m")[i - 1] for i in range(1, _SSH_GROUPS + 1)}
    failed, accepted = g[7] != "", g[11] != ""
    kind = F.when(failed, F.lit("failure")).when(accepted, F.lit("success")).otherwise(F.lit("failure"))
    df = _stage(df, {
        "_ts": X.syslog_ts(g[1], g[2], g[3], year),
        "_user": F.when(failed, g[7]).when(accepted, g[12]).otherwise(g[15]),
        "_ip": F.when(failed, g[8]).when(accepted, g[13]).otherwise(g[16]),
        "_port": F.when(failed, g[9]).when(accepted, g[14]).otherwise(g[17]),
        "_method": F.when(failed, g[10]).when(accepted, g[11]),
        "_outcome": kind,
    })
    ev = event_struct(
        timestamp=F.col("_ts"), source_type=F.lit("linux_auth"),
        raw=raw_line(F.regexp_replace(v, r"(?U)\s+$", "")),
        user_name=F.col("_user"), source_ip=F.col("_ip"), source_port=F.col("_port").try_cast("int"),
        destination_host=g[4], event_action=F.lit("login"), event_outcome=F.col("_outcome"),
        process_name=g[5], process_pid=g[6].try_cast("int"),
        auth_method=F.coalesce(X.truthy(F.col("_method")), F.lit("ssh")),
        labels=F.create_map(F.lit("host"), g[4]))
    # a line whose date does not exist (e.g. Feb 30) is rejected, like a parse error
    return df, F.when(F.col("_m").isNotNull() & F.col("_ts").isNotNull(), ev)


def _access_stage(df: DataFrame, v: Column, source_type: str) -> tuple[DataFrame, Column]:
    """Combined access log (A2 nginx, A3 apache: same format, different stamp);
    request split at the first space and the last `` HTTP/``."""
    # one pass: the line is replaced by its groups.  No group can hold the separator: the user has no
    # space, the time no bracket, and the quoted groups no quotation mark
    p = java_regex(ACCESS_RE)
    repl = '"] '.join(f"${i}" for i in (1, 2, 3, 4, 5, 8))
    df = _stage(df, {"_m": F.when(v.rlike(p), F.split(F.regexp_replace(v, p + "(?s:.*)$", repl), r'"\] ', -1))})
    df = _stage(df, {"_hit": F.col("_m").isNotNull(),
                     **{f"_g{g}": F.col("_m")[i] for i, g in enumerate((1, 2, 3, 4, 5, 8))}})
    request = F.col("_g4")
    sp = F.instr(request, " ")
    rest = F.substring(request, sp + 1, F.length(request))
    df = _stage(df, {"_ts": X.access_log_ts(F.col("_g3")), "_status": F.col("_g5").try_cast("int"),
                     "_method": F.when(request != "", F.substring_index(request, " ", 1)),
                     "_url": (F.when((request == "") | (sp == 0), _null())
                               .when(F.locate(" HTTP/", rest) > 0, F.regexp_extract(rest, r"(?s)^(.*) HTTP/", 1))
                               .otherwise(rest))})
    ev = event_struct(
        timestamp=F.col("_ts"), source_type=F.lit(source_type), raw=raw_line(v),
        user_name=F.when(F.col("_g2") != "-", F.col("_g2")), source_ip=F.col("_g1"),
        event_action=F.lit("http_request"),
        event_outcome=F.when(F.col("_status") < 400, F.lit("success")).otherwise(F.lit("failure")),
        http_method=F.col("_method"), http_url=F.col("_url"), http_status_code=F.col("_status"),
        http_user_agent=F.col("_g8"))
    return df, F.when(F.col("_hit") & F.col("_ts").isNotNull(), ev)


# Windows security events (one JSON object per record)
_FALSY_JSON_TEXT = ["", "[]", "{}", "0", "0.0", "false"]


def json_truthy(c: Column) -> Column:
    """Python truthiness of a JSON value given as its text."""
    return F.when(c.isNotNull() & ~c.isin(_FALSY_JSON_TEXT), c)


def event_number(text: Column) -> Column:
    """A whole number, or a JSON number with a fraction, which is cut off (``4624.0``)."""
    t = F.trim(text)
    return F.coalesce(t.try_cast("bigint"), F.when(t.rlike(r"^-?[0-9]+\.[0-9]+\z"), t.try_cast("double").cast("bigint")))


def _props_entries(rec: Column) -> Column:
    """``Properties`` (or ``properties``) as array<struct<k, v>> in order."""
    src = F.coalesce(json_truthy(rec["Properties"]), json_truthy(rec["properties"]))
    items = F.from_json(src, T.ArrayType(T.MapType(T.StringType(), T.StringType())))

    def entry(x):
        upper = F.map_contains_key(x, "Key") & F.map_contains_key(x, "Value")
        lower = F.map_contains_key(x, "key") & F.map_contains_key(x, "value")
        return F.struct(F.when(upper, x["Key"]).when(lower, x["key"]).alias("k"),
                        F.when(upper, x["Value"]).when(lower, x["value"]).alias("v"))
    return F.coalesce(F.transform(items, entry), F.array().cast("array<struct<k:string,v:string>>"))


def _prop(entries: Column, key: str) -> Column:
    """Last value for ``key`` (later duplicates win, case-sensitive)."""
    return F.try_element_at(F.filter(entries, lambda e: e["k"] == F.lit(key)), F.lit(-1))["v"]


_WIN_PICKS = {
    "_tuser": ("TargetUserName", "TargetUserName", "user_name"),
    "_ipaddr": ("IpAddress", "IpAddress", "source_ip"),
    "_ltype": ("LogonType", "LogonType"),
    "_cmd": ("CommandLine", "CommandLine", "process_command_line"),
    "_pname": ("NewProcessName", "NewProcessName", "process_name"),
    "_parent": ("ParentProcessName", "ParentProcessName", "process_parent_name"),
    "_suser": ("SubjectUserName", "SubjectUserName", "user_name"),
}


def _windows_stage(df: DataFrame, v: Column) -> tuple[DataFrame, Column]:
    """C6 logons 4624/4625, C7 process creation 4688, C8 properties, C9 event id; J4, J11."""
    df = _stage(df, {"_rec": F.from_json(v, T.MapType(T.StringType(), T.StringType()))})
    rec = F.col("_rec")
    # With the LAST_WIN map-key policy a map built from the entries keeps the
    # last value per key (as a Python dict does) and gives O(1) lookups;
    # otherwise each lookup scans the entries for the last match.
    last_win = df.sparkSession.conf.get("spark.sql.mapKeyDedupPolicy", "EXCEPTION").upper() == "LAST_WIN"
    if last_win:
        df = _stage(df, {"_props": F.map_from_entries(F.filter(_props_entries(rec), lambda e: e["k"].isNotNull()))})

        def prop(key):
            return F.col("_props")[key]
    else:
        df = _stage(df, {"_props": _props_entries(rec)})

        def prop(key):
            return _prop(F.col("_props"), key)
    msg = F.coalesce(X.truthy(rec["Message"]), X.truthy(rec["message"]), F.lit(""))
    msg_id = F.regexp_extract(msg, java_regex(WIN_EVENT_ID_RE, True), 1)
    declared = F.coalesce(json_truthy(rec["EventID"]), json_truthy(rec["event_id"]))
    picks = {name: X.first_truthy(json_truthy(prop(keys[0])), *[json_truthy(rec[k]) for k in keys[1:]])
             for name, keys in _WIN_PICKS.items()}
    df = _stage(df, {
        "_wid": F.when(declared.isNotNull(), event_number(declared))
                 .otherwise(F.when(msg_id != "", msg_id.try_cast("bigint"))),
        "_ts": F.coalesce(*[X.json_iso_ts(rec[k], v, k) for k in K.WINDOWS_TIME_KEYS]),
        "_label": (F.when(F.map_contains_key(rec, "EventID"), F.coalesce(rec["EventID"], F.lit("None")))
                    .when(F.map_contains_key(rec, "event_id"), F.coalesce(rec["event_id"], F.lit("None")))
                    .otherwise(F.lit("0"))),
        **picks})
    wid = F.col("_wid")
    is_logon = wid.isin(4624, 4625)
    ip0 = F.coalesce(F.col("_ipaddr"), F.lit("::1"))
    ip = F.when(ip0.isin("::1", "::"), F.lit("127.0.0.1")).otherwise(ip0)
    lt = F.col("_ltype")
    ev = event_struct(
        timestamp=F.col("_ts"), source_type=F.lit("windows_json"), raw=v,
        user_name=F.when(is_logon, F.col("_tuser")).otherwise(F.col("_suser")),
        source_ip=F.when(is_logon, ip),
        event_action=F.when(is_logon, F.lit("login")).otherwise(F.lit("process_create")),
        event_outcome=F.when(wid == 4625, F.lit("failure")).otherwise(F.lit("success")),
        auth_method=F.when(is_logon, F.when(lt.isNotNull(), F.concat(F.lit("windows_logon_type_"), lt))
                                      .otherwise(F.lit("windows"))),
        process_name=F.when(~is_logon, F.col("_pname")),
        process_command_line=F.when(~is_logon, F.col("_cmd")),
        process_parent_name=F.when(~is_logon, F.col("_parent")),
        labels=F.create_map(F.lit("event_id"), F.when(is_logon, F.col("_label")).otherwise(F.lit("4688"))))
    ok = rec.isNotNull() & F.col("_ts").isNotNull() & wid.isin(*K.WINDOWS_EVENT_IDS)
    return df, F.when(ok, ev)


_INT_FIELDS = ("source_port", "destination_port", "process_pid", "http_status_code")


def _jsonl_stage(df: DataFrame, v: Column) -> tuple[DataFrame, Column]:
    """Known keys lifted; every other key except ``timestamp`` goes to ``labels``."""
    df = _stage(df, {"_rec": F.from_json(v, T.MapType(T.StringType(), T.StringType()))})
    rec = F.col("_rec")
    known = K.JSON_KNOWN_FIELDS
    df = _stage(df, {"_tstext": X.truthy(rec["timestamp"])})
    df = _stage(df, {"_ts": X.json_iso_ts(F.col("_tstext"), v, "timestamp")})
    ev = event_struct(
        timestamp=F.col("_ts"),
        source_type=F.when(F.map_contains_key(rec, "source_type"), rec["source_type"]).otherwise(F.lit("json")),
        raw=v,
        # every other key except the time, as text; a JSON null prints as None
        labels=F.transform_values(F.map_filter(rec, lambda k, _: ~k.isin(known + ["timestamp"])),
                                  lambda _, x: F.coalesce(x, F.lit("None"))),
        **{f: (rec[f].try_cast("int") if f in _INT_FIELDS else rec[f]) for f in known})
    return df, F.when(rec.isNotNull() & F.col("_tstext").isNotNull() & F.col("_ts").isNotNull(), ev)


# --------------------------------------------------------------------------
# Registry (L4) and the frame-level jobs
# --------------------------------------------------------------------------
_TEMP = ["_m", "_ts", "_user", "_ip", "_port", "_method", "_outcome", "_hit", "_g1", "_g2", "_g3", "_g4",
         "_g5", "_g8", "_status", "_url", "_rec", "_props", "_wid", "_label", "_tstext", *_WIN_PICKS]


def _default_year() -> int:
    import datetime as _dt
    return _dt.datetime.now(_dt.timezone.utc).year


def stage_format(df: DataFrame, fmt: str, v: Column, year: int | None = None) -> tuple[DataFrame, Column]:
    if fmt == "linux_auth":
        return _ssh_stage(df, v, year if year is not None else _default_year())
    if fmt in ("nginx", "apache"):
        return _access_stage(df, v, fmt)
    if fmt == "windows_json":
        return _windows_stage(df, v)
    if fmt == "json":
        return _jsonl_stage(df, v)
    raise ValueError(f"unknown format {fmt!r}; known: {K.FORMATS}")


def with_parsed(df: DataFrame, fmt: str, year: int | None = None, value_col: str = "value") -> DataFrame:
    """Add ``_evt`` (event struct, or null when the record does not parse), ``_ok`` and ``_blank``.

    The extracted fields and the ``_ok`` flag pass through a one-row generator
    (``computed_once``), so a later filter on ``_ok`` is not pushed below it
    with every extraction substituted in; the event struct is built above it.
    """
    v = F.col(value_col)
    df = df.withColumn("_blank", _is_blank(v))
    staged, ev = stage_format(df, fmt, v, year)
    temp = [c for c in staged.columns if c not in df.columns]
    ok = F.when(~F.col("_blank"), ev).isNotNull()
    # the event expression is evaluated here only for its null-ness; the
    # optimizer prunes the unused struct fields from this projection
    fields = {f"_f_{c}": F.col(c) for c in temp}
    barrier = staged.select(*df.columns, F.inline(F.array(F.struct(
        *[c.alias(n) for n, c in fields.items()], ok.alias("_ok")))))
    barrier = barrier.withColumnsRenamed({n: n[3:] for n in fields})
    out = barrier.withColumn(EVT, F.when(F.col("_ok"), ev))
    return out.drop(*temp)


def _ok_col() -> Column:
    return F.col("_ok")


def parse(df: DataFrame, fmt: str, year: int | None = None, value_col: str = "value",
          keep: list[str] | None = None, counters: Observation | str | None = None) -> DataFrame:
    """Records -> events.  Blank and unparsable records are dropped.

    ``counters`` counts ``parsed`` and ``skipped`` in the same pass (A12): an ``Observation`` that has them once
    the frame has been computed, or, on a stream, a name under which every batch's progress reports them.

    ``keep`` lists pass-through columns to keep next to the event fields
    (default: every input column except the record text).
    """
    p = with_parsed(df, fmt, year, value_col)
    if counters is not None:
        p = p.observe(counters, F.count_if(F.col("_ok")).alias("parsed"),
                      F.count_if(~F.col("_blank") & ~F.col("_ok")).alias("skipped"))
    if keep is None:
        keep = [c for c in df.columns if c != value_col]
    return p.filter(F.col("_ok")).select(*keep, f"{EVT}.*")


def rejects(df: DataFrame, fmt: str, year: int | None = None, value_col: str = "value") -> DataFrame:
    """Non-blank records that did not parse (the ``skipped`` set)."""
    p = with_parsed(df, fmt, year, value_col)
    return p.filter(~F.col("_blank") & ~F.col("_ok")).drop(EVT, "_blank", "_ok")


def parse_counts(df: DataFrame, fmt: str, by: list[str], year: int | None = None,
                 value_col: str = "value") -> DataFrame:
    """A12 counters: ``parsed`` and ``skipped`` per group (blank lines count in neither)."""
    p = with_parsed(df, fmt, year, value_col)
    return p.groupBy(*by).agg(
        F.count_if(F.col("_ok")).alias("parsed"),
        F.count_if(~F.col("_blank") & ~F.col("_ok")).alias("skipped"))


def lines_of_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Split text blobs into one row per line (the ``str.splitlines`` breaks)."""
    breaks = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
    return df.withColumn("value", F.explode(F.split(F.col(text_col), breaks))).drop(text_col)
