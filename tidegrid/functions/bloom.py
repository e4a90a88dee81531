"""Bloom filters as tables of 64-bit words.

A key sets ``BITS_SET`` bits of one word (a register-blocked filter), so a
build is one ``bit_or`` aggregate with map-side combine and a probe is one word
look-up and one AND, all in generated code. Words are packed into segments of
``SEGMENT`` words, which makes the table small enough to broadcast: ten million
keys take 15 MB. A probe broadcasts only up to ``BROADCAST_BYTES``; a larger
filter is joined by segment through a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 12
BITS_SET = 4
SEGMENT = 1024
BROADCAST_BYTES = 64 << 20


def words_for(keys: int) -> int:
    """Number of words of a filter for so many keys (whole segments)."""
    segments = max(1, -(-keys * BITS_PER_KEY // (64 * SEGMENT)))
    return segments * SEGMENT


def word_of(words: int, *key: Column) -> Column:
    """Position of the key's word."""
    return F.pmod(F.xxhash64(*key), F.lit(words))


def mask_of(*key: Column) -> Column:
    """The key's bits within its word, from a second hash."""
    h = F.xxhash64(F.lit(97), *key)
    one = F.lit(1).cast("bigint")
    mask = None
    for i in range(BITS_SET):
        at = F.shiftrightunsigned(h, 13 * i).bitwiseAND(F.lit(63)).cast("int")
        bit = F.call_function("shiftleft", one, at)
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return mask


def pack(df: DataFrame) -> DataFrame:
    """(word, bits), one row per set word -> (segment, words array); words never set are zeros, or left out at the end.

    A segment without any set word has no row.
    """
    slots = df.select(F.floor(F.col("word") / SEGMENT).alias("segment"), F.struct((F.col("word") % SEGMENT).cast("int").alias("at"), "bits").alias("slot"))
    packed = slots.groupBy("segment").agg(F.array_sort(F.collect_list("slot")).alias("slots"))
    zero = F.lit(0).cast("bigint")
    before = lambda i: F.coalesce(F.get("slots", i - 1)["at"], F.lit(-1))
    dense = F.flatten(F.transform("slots", lambda x, i: F.concat(F.array_repeat(zero, x["at"] - F.when(i > 0, before(i)).otherwise(-1) - 1), F.array(x["bits"]))))
    return packed.select("segment", dense.alias("words"))


def build(keys: DataFrame, words: int, *cols: str) -> DataFrame:
    """The filter of the keys in ``cols`` as (segment, words)."""
    key = [F.col(c) for c in cols]
    return pack(keys.select(word_of(words, *key).alias("word"), mask_of(*key).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")))


def probe(df: DataFrame, packed: DataFrame, words: int, *key: Column, name: str = "maybe") -> DataFrame:
    """``df`` with a boolean column: false proves that the filter never saw the key."""
    small = words * 8 <= BROADCAST_BYTES
    table = packed.withColumnsRenamed({"segment": "_segment", "words": "_words"})
    at = df.withColumn("_word", word_of(words, *key)).withColumn("_mask", mask_of(*key)).withColumn("_segment", F.floor(F.col("_word") / SEGMENT))
    joined = at.join(F.broadcast(table) if small else table, "_segment", "left")
    found = F.get("_words", (F.col("_word") % SEGMENT).cast("int")).bitwiseAND(F.col("_mask")) == F.col("_mask")
    return joined.withColumn(name, F.coalesce(found, F.lit(False))).drop("_segment", "_word", "_mask", "_words")
