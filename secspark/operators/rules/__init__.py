"""Rule registry (L2): ordered rule-id -> rule class; ``detect`` runs a list of rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from .base import Rule, pack_alerts
from .brute_force import BruteForce
from .custom import AdminGroupAdd, CredentialStuffing
from .patterns import SuspiciousProcess, WebAttack
from .travel import ImpossibleTravel

RULES = {
    "BF-001": BruteForce,
    "SP-001": SuspiciousProcess,
    "WA-001": WebAttack,
    "IT-001": ImpossibleTravel,
}


def all_rules() -> list[Rule]:
    """Fresh instances of every registered rule, in registry order."""
    return [cls() for cls in RULES.values()]


def detect(events: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Bag union of every rule's alerts (common shape)."""
    rules = all_rules() if rules is None else list(rules)
    frames = [r.alerts(events) for r in rules]
    return reduce(lambda a, b: a.unionByName(b), frames)


def evidence(events: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    rules = all_rules() if rules is None else list(rules)
    return reduce(lambda a, b: a.unionByName(b), [r.evidence(events) for r in rules])


__all__ = ["Rule", "RULES", "all_rules", "detect", "evidence", "pack_alerts", "BruteForce",
           "SuspiciousProcess", "WebAttack", "ImpossibleTravel", "CredentialStuffing", "AdminGroupAdd"]
