"""Every block of a source finds a slot, however small its weight: the mix keeps every document it has placed."""

from __future__ import annotations

import random

import pytest

from tidegrid.llm import mixing


def test_a_small_source_draws_a_slot_for_each_block(spark):
    planned = spark.createDataFrame([("large", 0.99943, 15990), ("small", 0.00057, 9)], "source string, weight double, quota bigint")
    drawn = {r.source: r["count"] for r in mixing.schedule(planned, 8).groupBy("source").count().collect()}
    assert drawn["small"] >= 2 and drawn["large"] >= 1999


def test_random_weights_leave_no_block_without_a_slot(spark):
    rng = random.Random(5)
    for _ in range(50):
        shares = [rng.random() ** 3 + 1e-3 for _ in range(rng.randrange(2, 10))]
        planned = [(f"s{i}", w / sum(shares), int(rng.randrange(200, 9000) * w)) for i, w in enumerate(shares)]
        drawn = {r.source: r["count"] for r in mixing.schedule(spark.createDataFrame(planned, "source string, weight double, quota bigint"), 8).groupBy("source").count().collect()}
        for source, _, quota in planned:
            assert drawn.get(source, 0) >= -(-quota // 8)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_placed_documents_are_mixed(spark, seed):
    rng = random.Random(seed)
    shares = [rng.random() ** 3 + 1e-3 for _ in range(9)]
    rows = [(n, f"s{rng.randrange(9)}", rng.randrange(1, 300)) for n in range(4000)]
    docs = mixing.stage(spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint"), "docs")
    targets = spark.createDataFrame([(f"s{i}", w / sum(shares), rng.randrange(1, 4)) for i, w in enumerate(shares)], "source string, target_share double, max_repeats int")
    placed = mixing._lines(docs, mixing.stage(mixing.plan(docs, targets), "plan"), mixing.BLOCK_TOKENS)
    mixed = mixing.mix(docs, targets)
    assert mixed.count() == placed.count() == mixed.select("doc_id", "pass_no").distinct().count()
