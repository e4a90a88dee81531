"""Checks that must see what is missing, not only what is there."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import checks, limits
from tidegrid.sources.tables import table


@pytest.fixture(scope="module")
def alerts(spark, folder):
    stored = table(spark, folder, "portfolio_risk_limit_evaluations").where("ts_event is not null").dropDuplicates().cache()
    moves = limits.transitions(limits.latest_evaluations(stored)).cache()
    outbox = limits.current_outbox(table(spark, folder, "portfolio_risk_notification_outbox").dropDuplicates(), moves).cache()
    return stored, moves, outbox


def actual(rows):
    return {r.check_name: r.actual for r in rows.collect()}


def test_outbox_checks_see_a_lost_message(alerts):
    stored, moves, outbox = alerts
    lost = outbox.agg(F.min("event_id")).first()[0]
    kept = outbox.where(F.col("event_id") != lost)
    whole, less = (actual(checks.outbox_reconciliation(o, o, moves, stored)) for o in (outbox, kept))
    assert less["outbox_candidate_missing"] == whole["outbox_candidate_missing"] + 1
    assert less["outbox_current_per_actionable_transition"] == whole["outbox_current_per_actionable_transition"] - 1
    wrong = outbox.withColumn("subject_key", F.lit("other")).withColumn("payload_json", F.lit('{"metric": "other"}'))
    found = actual(checks.outbox_reconciliation(wrong, wrong, moves, stored))
    assert found["outbox_transition_metadata_differs"] == found["outbox_payload_identity_differs"] == outbox.count()


def test_lifecycle_checks_see_overlap(alerts):
    _, moves, _ = alerts
    episodes = limits.episodes(moves)
    n = episodes.count()
    twice = episodes.unionByName(episodes)
    found = actual(checks.lifecycle_reconciliation(moves, twice))
    assert n and found["lifecycle_episode_keys_surplus"] == n and found["lifecycle_episodes_overlap"] >= n


def test_a_snapshot_without_a_metric_fails(spark):
    row = lambda attribution, metric: ("p", "f", "q", "d", attribution, 1, metric)
    rows = [row("whole", "a"), row("whole", "b"), row("lacks", "a"), row("twice", "a"), row("twice", "a")]
    latest = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in checks.SNAPSHOT[:-1]) + ", ts_event int, metric_name string")
    assert actual(checks.snapshot_checks(latest)) == {"limits_snapshot_has_not_two_metrics": 2}
