"""The queries of the problems on text, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import encoding, mixing, sentences
from tidegrid.sources.tables import table


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.encode(table(spark, folder, "documents"))


def p7_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """The texts decoded from their ids: the documents' own texts, null as empty."""
    return encoding.decode(encoding.encode(table(spark, folder, "documents")))


def p7_counts(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.token_counts(table(spark, folder, "documents"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_sized(spark, folder), table(spark, folder, "mix_targets"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of every source of the mix."""
    targets = table(spark, folder, "mix_targets")
    return mixing.shares(mixing.mix(_sized(spark, folder), targets), targets)


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return mixing.sized(documents, encoding.token_counts(documents))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentence_units(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p7_ids, p7_decoded, p7_counts, p8_mix, p8_shares, p9_found)}
ORACLES = {"p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
