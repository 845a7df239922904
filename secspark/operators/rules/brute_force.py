"""BF-001: greedy brute-force bursts per (source ip, user)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import constants as K
from ...functions import scalar as X
from ...session import stored
from .. import sequence as S
from .base import Rule, alert_key, event_fingerprint, json_context

KEYS = ["source_ip", "user_name"]


def failed_logins(events: DataFrame) -> DataFrame:
    """Failed logins with a non-empty ip and user."""
    return events.filter((F.col("event_action") == "login") & (F.col("event_outcome") == "failure")
                         & (F.col("source_ip") != "") & (F.col("user_name") != ""))


class BruteForce(Rule):
    rule_id = "BF-001"
    rule_name = "Brute-force login (SSH/Windows)"
    default_severity = "high"
    description = "Bursts of failed logins: one address, one account, at least the threshold within the window."

    def __init__(self, threshold: int = 5, window_seconds: int = 600, severity: str | None = None) -> None:
        super().__init__(severity)
        self.threshold = int(threshold)
        self.window_seconds = int(window_seconds)
        self.window_us = self.window_seconds * 1_000_000

    def members(self, events: DataFrame) -> DataFrame:
        """Failed logins that fall in a picked burst, with the burst's ``start_us``.

        The failed-login subset is read several times (counts, members), so it
        is written once, as Parquet, to the shared checkpoint folder first; the
        counts read only the keys and the time.
        """
        memo = getattr(self, "_memo", None)
        if memo is not None and memo[0] is events:  # alerts() and evidence() on the same input
            return memo[1]
        f = stored(failed_logins(events).withColumn("_us", F.unix_micros("timestamp")), "failed-logins")
        bursts = S.greedy_bursts(f, KEYS, "_us", self.window_us, self.threshold)
        out = S.burst_members(f, bursts, KEYS, "_us", self.window_us)
        self._memo = (events, out)
        return out

    def _id(self):
        return alert_key(self.rule_id, F.col("source_ip"), F.col("user_name"), F.col("start_us"))

    def typed(self, events: DataFrame) -> DataFrame:
        m = self.members(events)
        # F5; I3: distinct sorted sets of auth methods and source types inside one alert
        g = m.groupBy(*KEYS, "start_us").agg(
            F.count(F.lit(1)).alias("failed_attempts"),
            F.min("timestamp").alias("first_seen_ts"),
            F.max("timestamp").alias("last_seen_ts"),
            F.array_sort(F.collect_set(F.coalesce(F.nullif("auth_method", F.lit("")), F.lit("unknown")))).alias("auth_methods"),
            F.array_sort(F.collect_set("source_type")).alias("source_types"))
        return self.described(g)

    def described(self, g: DataFrame) -> DataFrame:
        """Bursts with their context (``failed_attempts, first_seen_ts, last_seen_ts, auth_methods, source_types``),
        batch or streaming, as alerts."""
        span = F.floor((F.unix_micros("last_seen_ts") - F.unix_micros("first_seen_ts")) / 1_000_000).cast("bigint")
        return g.select(
            F.lit(self.severity).alias("severity"),
            F.format_string("%d failed logins for user '%s' from %s within %ds",
                            "failed_attempts", "user_name", "source_ip", span).alias("description"),
            F.col("last_seen_ts").alias("timestamp"),
            self._id().alias("alert_id"),
            F.col("failed_attempts").alias("n_source_events"),
            json_context(F.col("source_ip"), F.col("user_name").alias("user"), F.col("failed_attempts"),
                         F.lit(self.window_seconds).alias("window_seconds"),
                         X.iso_utc("first_seen_ts").alias("first_seen"), X.iso_utc("last_seen_ts").alias("last_seen"),
                         F.col("auth_methods"), F.col("source_types"), F.lit(K.BF_NOTE).alias("note")).alias("context"),
            *KEYS, "start_us", "failed_attempts", "first_seen_ts", "last_seen_ts", "auth_methods", "source_types")

    def evidence(self, events: DataFrame) -> DataFrame:
        m = self.members(events)
        return m.select(F.lit(self.rule_id).alias("rule_id"), self._id().alias("alert_id"),
                        event_fingerprint().alias("event_fingerprint"))
