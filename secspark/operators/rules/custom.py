"""Rules built on the rule interface outside the default registry.

* CS-001: successful login preceded by failures from the same ip within W.
* AG-001: user added to a local administrators group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import constants as K
from ...functions import scalar as X
from .. import sequence as S
from .base import Rule, alert_key, event_fingerprint, json_context, py_str, seq_col


class CredentialStuffing(Rule):
    rule_id = "CS-001"
    rule_name = "Credential-stuffing success (failed then success from same IP)"
    default_severity = "critical"
    description = "A login that succeeds from an address which failed to log in shortly before."

    def __init__(self, window_seconds: int = 300) -> None:
        super().__init__()
        self.window_seconds = int(window_seconds)
        self.window_us = self.window_seconds * 1_000_000

    def _logins(self, events: DataFrame) -> DataFrame:
        e = events.filter((F.col("event_action") == "login") & (F.col("source_ip") != ""))
        return e.withColumn("_us", F.unix_micros("timestamp")).withColumn("_seq", seq_col(events))

    def matches(self, events: DataFrame) -> DataFrame:
        """Successes with ``n`` earlier failures in ``[t - W, t]`` and the first one's time."""
        e = self._logins(events)
        out = S.trailing_counts(e, ["source_ip"], "_us", "_seq",
                                F.col("event_outcome") == "success", F.col("event_outcome") == "failure",
                                self.window_us)
        return out.filter(F.col("n") > 0)

    def _id(self):
        return alert_key(self.rule_id, F.col("source_ip"), F.col("_us"), F.col("_seq"))

    def typed(self, events: DataFrame) -> DataFrame:
        return self.described(self.matches(events))

    def described(self, m: DataFrame) -> DataFrame:
        first_at = X.iso_utc(F.timestamp_micros("first_us"))
        return m.select(
            F.lit(self.severity).alias("severity"),
            F.concat(F.lit("Successful login for '"), py_str(F.col("user_name")), F.lit("' from "),
                     F.col("source_ip"), F.lit(" followed "), F.col("n").cast("string"),
                     F.lit(f" failed login(s) within {self.window_seconds}s")).alias("description"),
            F.col("timestamp"), self._id().alias("alert_id"), (F.col("n") + 1).alias("n_source_events"),
            json_context(F.col("source_ip"), F.col("user_name").alias("user"), F.col("n").alias("failed_attempts"),
                         first_at.alias("first_failure_at"), X.iso_utc("timestamp").alias("success_at"),
                         F.array(F.lit("T1110.004")).alias("mitre_attack_ids"),
                         F.lit(K.CS_NOTE).alias("note")).alias("context"),
            "source_ip", "user_name", F.col("n").alias("failed_attempts"), "first_us", "_us", "_seq")

    def covered_failures(self, events: DataFrame) -> DataFrame:
        """Every failure with a success of its ip within the window after it, once, with the next
        such success (``next_us``, ``next_seq``)."""
        e = S.next_within(self._logins(events), ["source_ip"], "_us", "_seq",
                          F.col("event_outcome") == "failure", F.col("event_outcome") == "success",
                          ["_us", "_seq"], self.window_us)
        return e.filter(F.col("next_us").isNotNull())

    def intervals(self, events: DataFrame) -> DataFrame:
        """One row per alert: the failures it rests on are those of ``source_ip`` from ``from_us`` on
        and before the success at ``to_us``; ``n_failures`` of them."""
        return self.matches(events).select(
            F.lit(self.rule_id).alias("rule_id"), self._id().alias("alert_id"), "source_ip",
            F.col("first_us").alias("from_us"), F.col("_us").alias("to_us"), F.col("n").alias("n_failures"))

    def evidence(self, events: DataFrame) -> DataFrame:
        """The success of each alert, and each failure once, under the first alert that it supports.

        Later alerts of the same ip share those failures; :meth:`intervals` says which.  Pairing every
        success with every failure of its window would grow with the product of both.
        """
        rid = F.lit(self.rule_id).alias("rule_id")
        won = self.matches(events).select(rid, self._id().alias("alert_id"),
                                          event_fingerprint().alias("event_fingerprint"))
        lost = self.covered_failures(events)
        first = alert_key(self.rule_id, F.col("source_ip"), F.col("next_us"), F.col("next_seq"))
        return won.unionByName(lost.select(rid, first.alias("alert_id"), event_fingerprint().alias("event_fingerprint")))


class AdminGroupAdd(Rule):
    rule_id = "AG-001"
    rule_name = "User added to local administrators group"
    default_severity = "high"
    description = "An account that joins a local administrators group."

    def matches(self, events: DataFrame) -> DataFrame:
        """``group_member_add`` into one of the admin groups (case-insensitive)."""
        grp = F.lower(F.coalesce(F.col("labels")["group"], F.lit("")))
        return (events.filter((F.col("event_action") == "group_member_add") & grp.isin(K.ADMIN_GROUPS))
                      .withColumn("_fp", event_fingerprint()))

    def _id(self):
        return alert_key(self.rule_id, F.col("_fp"))

    def typed(self, events: DataFrame, keep: list[str] = ()) -> DataFrame:
        m = self.matches(events)
        group = F.col("labels")["group"]
        return m.select(
            F.lit(self.severity).alias("severity"),
            F.concat(F.lit("User '"), py_str(F.col("user_name")), F.lit("' added to local admins group '"),
                     py_str(group), F.lit("'")).alias("description"),
            F.col("timestamp"), self._id().alias("alert_id"), F.lit(1).alias("n_source_events"),
            json_context(F.col("user_name").alias("user"), group.alias("group"),
                         F.col("labels")["event_id"].alias("event_id"),
                         F.array(F.lit("T1098")).alias("mitre_attack_ids"), F.lit(K.AG_NOTE).alias("note")).alias("context"),
            "user_name", group.alias("group"), "_fp", *keep)

    def evidence(self, events: DataFrame) -> DataFrame:
        return self.matches(events).select(F.lit(self.rule_id).alias("rule_id"), self._id().alias("alert_id"),
                                           F.col("_fp").alias("event_fingerprint"))
