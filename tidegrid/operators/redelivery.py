"""Messages delivered more than once: keep exactly one copy of each identifier.

Deliveries are reduced within their time bucket (of ts_ingest) to one
representative per identifier; the representatives are the storage of the
buckets. Every bucket has a Bloom filter, all of one geometry, so that their
words can be compared: bits set by two buckets make up a summary filter. An
identifier whose bits are not all in the summary is definitely in one bucket
only. As equal identifiers set equal bits, all copies of a repeated one are
possible repeats; these alone are read again from their buckets' storage and
compared exactly. Filters have no false negatives, so nothing is lost; false
positives end in the exact comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import bloom
from tidegrid.functions.text import id_key
from tidegrid.functions.times import DAY, floor_div
from tidegrid.session import bounded_broadcast, stage, stage_counted

BUCKET_DAYS = 7
#: Time bucket of deliveries without ts_ingest (they sort last).
UNDATED = 1 << 30


def _keyed(deliveries: DataFrame, bucket_days: int) -> DataFrame:
    bucket = floor_div(F.unix_micros("ts_ingest"), bucket_days * DAY).cast("int")
    rows = deliveries.select(id_key(F.col("event_id")).alias("event_id"), F.coalesce(bucket, F.lit(UNDATED)).alias("bucket"), F.coalesce(F.unix_micros("ts_ingest"), F.lit((1 << 63) - 1)).alias("us"), "delivery_id")
    return rows.where(F.col("event_id").isNotNull())


def _twice(bits: Column) -> Column:
    """The bits that at least two of the collected words set."""
    zero = F.lit(0).cast("bigint")
    return F.aggregate(
        bits,
        F.struct(zero.alias("once"), zero.alias("twice")),
        lambda s, x: F.struct(s["once"].bitwiseOR(x).alias("once"), s["twice"].bitwiseOR(s["once"].bitwiseAND(x)).alias("twice")),
        lambda s: s["twice"],
    )


def _summary(storage: DataFrame, words: int) -> DataFrame:
    """The summary filter of the storage: (segment, words array) of the bits that two buckets set.

    The buckets' filters, rows of (bucket, word, bits), are made, compared and
    packed behind one shuffle by segment.
    """
    key = F.col("event_id")
    word = bloom.word_of(words, key)
    set_bits = storage.select("bucket", F.floor(word / bloom.SEGMENT).alias("segment"), word.alias("word"), bloom.mask_of(key).alias("mask")).repartition("segment")
    filters = set_bits.groupBy("segment", "bucket", "word").agg(F.bit_or("mask").alias("bits"))
    both = filters.groupBy("segment", "word").agg(_twice(F.collect_list("bits")).alias("bits")).where("bits <> 0")
    return bloom.pack(both)


def repeated_ids(deliveries: DataFrame, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """(event_id, keep): every identifier with copies, and its first delivery (us, delivery_id)."""
    first = F.min(F.struct("us", "delivery_id")).alias("first")
    storage, rows = stage_counted(_keyed(deliveries, bucket_days).groupBy("bucket", "event_id").agg(first, F.count("*").alias("copies")), "deliveries")
    words = bloom.words_for(rows)
    summary = stage(_summary(storage, words), "bucket-filters")
    screened = bloom.probe(storage.select("event_id", "first", "copies"), summary, words, F.col("event_id"))
    possible = screened.where(F.col("maybe") | (F.col("copies") > 1))
    verified = possible.groupBy("event_id").agg(F.min("first").alias("keep"), F.sum("copies").alias("copies"))
    return verified.where("copies > 1").select("event_id", "keep")


def surplus(deliveries: DataFrame, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """(event_id, delivery_id) of every delivery that is not the kept copy.

    Copies share an event_id, trimmed and in lower case; null and blank ids are
    copies of nothing. The kept copy has the least ts_ingest (null last), then
    the least delivery_id. Rows that repeat the kept delivery_id itself are that
    delivery. An empty table gives no rows.
    """
    keep = stage(repeated_ids(deliveries, bucket_days), "repeated-ids")
    rows = _keyed(deliveries, bucket_days).select("event_id", "delivery_id")
    return rows.join(bounded_broadcast(keep), "event_id").where(~F.col("delivery_id").eqNullSafe(F.col("keep.delivery_id"))).select("event_id", "delivery_id")


def keep_one(deliveries: DataFrame, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """The deliveries without the surplus ones; all columns, also those without an identifier."""
    gone = stage(surplus(deliveries, bucket_days).select("delivery_id"), "surplus")
    return deliveries.join(bounded_broadcast(gone), "delivery_id", "left_anti")
