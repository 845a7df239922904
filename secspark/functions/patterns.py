"""Regex dialect helpers.

The catalogues in :mod:`constants` are written once.  Spark runs them on the
JVM, where ``(?d)`` makes ``.`` stop only at ``\\n`` and ``(?U)`` gives
``\\w``/``\\b``/``\\d``/``\\s`` their Unicode meaning, as in Python ``re``.
DuckDB (RE2) gets the plain text with only ``(?i)``; on ASCII input both agree.
"""

from __future__ import annotations


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    return ("(?dUi)" if ignore_case else "(?dU)") + pattern


def re2_regex(pattern: str, ignore_case: bool = False) -> str:
    return ("(?i)" if ignore_case else "") + pattern


def sql_str(s: str) -> str:
    """Quote a Python string as a SQL string literal (both dialects)."""
    return "'" + s.replace("'", "''") + "'"


# Dotted capital I, dotless i, long s, Kelvin sign -> the ASCII letter they match.
FOLDS_TO_ASCII = ("\u0130\u0131\u017f\u212a", "iisk")

# Literals each catalogue pattern cannot match without (a necessary condition,
# so testing them first never changes a result).  Checked on a lower-cased
# copy for case-insensitive patterns; the letters outside ASCII that a
# case-insensitive regex takes for an ASCII letter are mapped onto it first.
REQUIRED_LITERALS = {
    "sqli_union": ["union", "select"],
    "sqli_or_comment": ["'", "or", "1", "="],
    "sqli_sleep": ["sleep", "("],
    "sqli_select_from": ["select", "from"],
    "xss_script_tag": ["<", "script"],
    "xss_event_handler": ["on", "="],
    "xss_js_uri": ["javascript:"],
    "xss_img_tag": ["<", "img", "onerror", "="],
    "path_traversal_dotdot": ["../"],
    "path_traversal_encoded": ["%2e%2e"],
    "path_traversal_etc_passwd": ["/etc/passwd"],
    "cmd_injection_pipe": ["|", "="],
    "cmd_injection_semicolon": [";", "="],
    "cmd_injection_backtick": ["`"],
    "ssrf_metadata": ["169.254.169.254"],
    "ssrf_localhost": ["localhost"],
    "rfi_remote": ["=", "http"],
    "encoded_powershell": ["powershell", "-"],
    "powershell_download_cradle": ["downloadstring"],
    "mimikatz": ["mimikatz"],
    "procdump": ["procdump"],
    "rundll32_network": ["rundll32", "://"],
    "certutil_loldb": ["certutil", "-"],
}
