"""Mixing: shares, repeats and the evenness of the schedule."""

from __future__ import annotations

import pytest

from tidegrid.llm import mixing

SIZED = "doc_id bigint, source string, tokens bigint"
TARGET = "source string, target_share double, max_repeats int"


def corpus(spark, per_source):
    rows, n = [], 0
    for source, count in per_source.items():
        for k in range(count):
            n += 1
            rows.append((n, source, 50 + (n * 37 + k) % 100))
    return spark.createDataFrame(rows, SIZED)


def test_shares_and_repeats(spark):
    docs = corpus(spark, {"a": 3000, "b": 200, "c": 800, "other": 50})
    targets = spark.createDataFrame([("A ", 0.5, 1), ("b", 0.2, 4), ("c", 0.2, 3), ("empty", 0.1, 9)], TARGET)
    mixed = mixing.mix(docs, targets)
    got = {r.source: r for r in mixing.shares(mixed, targets).collect()}
    for source, share in (("a", 0.5), ("b", 0.2), ("c", 0.2)):
        assert got[source].actual_share == pytest.approx(share / 0.9, abs=0.01)
        assert got[source].most_uses <= got[source].max_repeats
    assert got["empty"].actual_share == 0.0 and "other" not in got
    # b is the scarcest: all of it is used in each of its passes
    assert got["b"].documents == 200 and got["b"].most_uses == 4
    rows = mixed.collect()
    assert len({(r.doc_id, r.pass_no) for r in rows}) == len(rows)
    # every stretch of the sequence has the shares, too
    early = [r for r in rows if r.slot < max(x.slot for x in rows) // 4]
    assert sum(r.tokens for r in early if r.source == "a") / sum(r.tokens for r in early) == pytest.approx(0.5 / 0.9, abs=0.04)


def test_many_shards_give_one_line(spark, monkeypatch):
    docs, targets = corpus(spark, {"a": 400, "b": 100}), spark.createDataFrame([("a", 0.7, 1), ("b", 0.3, 2)], TARGET)
    monkeypatch.setattr(mixing, "SHARD_ROWS", 16)
    rows = mixing.mix(docs, targets, 256).collect()
    for source in "ab":
        line = sorted((r.at, r.tokens) for r in rows if r.source == source)
        assert line[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(line, line[1:]))


def test_nothing(spark):
    none, targets = spark.createDataFrame([], SIZED), spark.createDataFrame([("a", 1.0, 1)], TARGET)
    assert mixing.mix(none, targets).count() == 0
    assert mixing.mix(corpus(spark, {"a": 5}), targets.where("false")).count() == 0
    zero = spark.createDataFrame([(1, "a", 0), (2, "a", 10), (3, None, 10)], SIZED)
    assert sorted(r.doc_id for r in mixing.mix(zero, targets).collect()) in ([1, 2], [2])
