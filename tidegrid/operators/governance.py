"""Definitions and limits from configuration, their validity in time, and the plan of segments.

Configuration is small and lives on the driver; ``frame`` gives it to joins.
Validity is half-open: a version holds from its first day up to, not including,
the day it ends.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidegrid.functions.ids import driver_id
from tidegrid.operators.limits import CONCENTRATION, VOLATILITY

#: Bounds of configuration, version of the plan.
FEWEST, MOST, MOST_VERSIONS, MOST_SEGMENTS = 2, 50, 100, 100
TOLERANCE = 1e-9
PLAN_VERSION = "governed-portfolio-segments-v1"


class ConfigError(ValueError):
    """A configuration that cannot be used, with the reason."""


@dataclass(frozen=True)
class Version:
    """Something that holds from ``start`` up to, not including, ``end`` (None: open)."""

    name: str
    owner: str
    start: date
    end: date | None
    content: Mapping[str, Any] = field(hash=False)
    fingerprint: str = ""

    def holds(self, day: date) -> bool:
        return self.start <= day and (self.end is None or day < self.end)


def _need(ok: bool, why: str) -> None:
    if not ok:
        raise ConfigError(why)


def _day(value: Any, what: str) -> date:
    if isinstance(value, date):
        return value
    try:
        return date.fromisoformat(str(value))
    except ValueError as e:
        raise ConfigError(f"{what} is no date") from e


def definition(portfolio_id: str, currency: str, constituents: Sequence[Mapping[str, Any]]) -> tuple[dict[str, Any], str]:
    """(content, fingerprint) of a portfolio: 2 to 50 different constituents, positive weights that add to 1."""
    _need(FEWEST <= len(constituents) <= MOST, f"{portfolio_id} needs {FEWEST} to {MOST} constituents")
    parts = sorted(({"source": str(c["source"]).strip(), "symbol": str(c["symbol"]).strip().upper(), "weight": float(c["weight"])} for c in constituents), key=lambda c: (c["source"], c["symbol"]))
    _need(len({(c["source"], c["symbol"]) for c in parts}) == len(parts), f"{portfolio_id} repeats a constituent")
    _need(all(math.isfinite(c["weight"]) and c["weight"] > 0 for c in parts), f"{portfolio_id} has a weight that is not positive")
    _need(abs(math.fsum(c["weight"] for c in parts) - 1) <= TOLERANCE, f"the weights of {portfolio_id} do not add to 1")
    content = {"base_currency": currency, "constituents": parts, "portfolio_id": portfolio_id}
    return content, driver_id("portfolio-", content)


def mandate(portfolio_id: str, entry: Mapping[str, Any]) -> Version:
    """An effective-dated definition."""
    content, identity = definition(portfolio_id, entry["base_currency"], entry["constituents"])
    start, end = _day(entry["effective_from"], "effective_from"), entry.get("effective_to") and _day(entry["effective_to"], "effective_to")
    dates = {"effective_from": start.isoformat(), "effective_to": end.isoformat() if end else None}
    whole = driver_id("portfolio-mandate-", dates | {"constituent_definition_fingerprint": identity, "mandate_id": entry["mandate_id"], "portfolio_id": portfolio_id})
    return Version(entry["mandate_id"], portfolio_id, start, end or None, content | {"definition_fingerprint": identity}, whole)


def policy(policy_id: str, entry: Mapping[str, Any]) -> Version:
    """An effective-dated set of limits; each has 0 <= warning < critical."""
    limits = {m: {k: float(entry["limits"][m][k]) for k in ("critical", "warning")} for m in (CONCENTRATION, VOLATILITY)}
    for m, t in limits.items():
        _need(0 <= t["warning"] < t["critical"], f"the thresholds of {m} in {policy_id} are not ordered")
    content = {"annualization_days": int(entry["annualization_days"]), "covariance_window": int(entry["covariance_window"]), "limits": limits, "policy_id": policy_id, "portfolio_id": entry["portfolio_id"]}
    identity = driver_id("risk-limit-policy-", content)
    start, end = _day(entry["effective_from"], "effective_from"), entry.get("effective_to") and _day(entry["effective_to"], "effective_to")
    dates = {"effective_from": start.isoformat(), "effective_to": end.isoformat() if end else None}
    whole = driver_id("risk-limit-policy-version-", dates | {"limit_definition_fingerprint": identity, "policy_id": policy_id, "policy_version_id": entry["policy_version_id"], "portfolio_id": entry["portfolio_id"]})
    return Version(entry["policy_version_id"], policy_id, start, end or None, content | {"limit_fingerprint": identity}, whole)


def timeline(versions: Sequence[Version]) -> list[Version]:
    """The versions in order of time; names differ, none overlap, only the last may be open."""
    _need(0 < len(versions) <= MOST_VERSIONS, f"1 to {MOST_VERSIONS} versions are needed")
    _need(len({v.name for v in versions}) == len(versions), "a version id is repeated")
    line = sorted(versions, key=lambda v: v.start)
    for v in line:
        _need(v.end is None or v.start < v.end, f"{v.name} ends before it starts")
    for a, b in zip(line, line[1:]):
        _need(a.end is not None, f"{a.name} is open but not the last")
        _need(a.end <= b.start, f"{a.name} and {b.name} overlap")
    return line


def as_of(versions: Sequence[Version], day: date) -> Version:
    """The one version that holds on the day."""
    found = [v for v in versions if v.holds(day)]
    _need(len(found) == 1, f"{len(found)} versions hold on {day}")
    return found[0]


@dataclass(frozen=True)
class Segment:
    start: date
    end: date  # included
    mandate: Version
    policy: Version

    @property
    def identity(self) -> str:
        return driver_id("governed-segment-", {"end_date": self.end.isoformat(), "mandate_fingerprint": self.mandate.fingerprint, "model_version": PLAN_VERSION, "policy_fingerprint": self.policy.fingerprint, "start_date": self.start.isoformat()})


def plan(mandates: Sequence[Version], policies: Sequence[Version], start: date, end: date) -> tuple[list[Segment], str]:
    """The segments of [start, end] on each of which one mandate and one policy hold, and the plan's id.

    Both timelines are walked together from boundary to boundary; a day that
    either leaves out is an error.
    """
    _need(start <= end, "the range ends before it starts")
    segments, at = [], start
    while at <= end:
        m, p = as_of(mandates, at), as_of(policies, at)
        last = min([end, *(v.end - timedelta(days=1) for v in (m, p) if v.end)])
        segments.append(Segment(at, last, m, p))
        _need(len(segments) <= MOST_SEGMENTS, f"more than {MOST_SEGMENTS} segments")
        at = last + timedelta(days=1)
    body = {"end_date": end.isoformat(), "model_version": PLAN_VERSION, "policy_id": policies[0].owner, "portfolio_id": mandates[0].owner, "segment_ids": [s.identity for s in segments], "start_date": start.isoformat()}
    return segments, driver_id("governed-plan-", body)


def frame(spark: SparkSession, versions: Sequence[Version]) -> DataFrame:
    """(name, owner, fingerprint, effective_from, effective_to) for joins; at most MOST_VERSIONS rows."""
    return spark.createDataFrame([(v.name, v.owner, v.fingerprint, v.start, v.end) for v in versions], "name string, owner string, fingerprint string, effective_from date, effective_to date")


def constituent_frame(spark: SparkSession, mandates: Sequence[Version]) -> DataFrame:
    """(portfolio_id, definition_fingerprint, base_currency, size, component, weight) of definitions, for alignment."""
    rows = [(v.owner, v.content["definition_fingerprint"], v.content["base_currency"], len(v.content["constituents"]), f"{c['source'].lower()}:{c['symbol']}", c["weight"]) for v in mandates for c in v.content["constituents"]]
    return spark.createDataFrame(rows, "portfolio_id string, definition_fingerprint string, base_currency string, size int, component string, weight double").distinct()
