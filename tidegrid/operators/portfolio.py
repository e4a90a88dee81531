"""Portfolios: constituents, complete-date alignment, returns, risk, contributions, rolling attribution."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.ids import content_id
from tidegrid.functions.text import id_key, is_number, json_object, symbol_key
from tidegrid.operators.versions import latest_by
from tidegrid.session import bounded_broadcast

#: Versions, methods and tolerances.
RETURN_VERSION = "portfolio-risk-v1"
ATTRIBUTION_VERSION = "portfolio-attribution-v1"
WEIGHTING_METHOD = "constant_weight_daily_rebalanced"
COVARIANCE_METHOD = "sample_covariance_ddof_1"
CORRELATION_METHOD = "pearson_from_sample_covariance"
TRADING_DAYS = 252
ZERO_VARIANCE = 1e-12
WEIGHT_TOLERANCE = 1e-9


def json_numbers(text: Column) -> Column:
    """A JSON object of numbers as map<string,double>; null for anything else."""
    return json_object(text, "double")


def constituents(portfolio_returns: DataFrame, tolerance: float = WEIGHT_TOLERANCE) -> DataFrame:
    """(portfolio_id, definition_fingerprint, base_currency, component, weight, size) of every definition in use.

    Definitions whose weights do not add to 1 within tolerance, or hold a weight
    of 0 or less, are left out.
    """
    defined = portfolio_returns.select("portfolio_id", "definition_fingerprint", "base_currency", json_numbers(F.col("weights_json")).alias("w")).where("w is not null and portfolio_id is not null")
    one = defined.groupBy("portfolio_id", "definition_fingerprint").agg(F.min("base_currency").alias("base_currency"), F.max(F.array_sort(F.map_entries("w"))).alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda s, e: s + e["value"])
    one = one.where((F.abs(total - 1) <= tolerance) & F.forall("w", lambda e: e["value"] > 0))
    spread = one.select("portfolio_id", "definition_fingerprint", "base_currency", F.size("w").alias("size"), F.explode("w").alias("e"))
    return spread.select("portfolio_id", "definition_fingerprint", "base_currency", "size", F.col("e.key").alias("component"), F.col("e.value").alias("weight"))


def current_returns(daily_returns: DataFrame) -> DataFrame:
    """(component, day, return_1d, calculation_id, ts_ingest): the latest version of each daily return; invalid ones left out."""
    r = F.col("return_1d")
    rows = daily_returns.where(is_number(r) & (r > -1) & F.col("ts_event").isNotNull()).select(F.concat_ws(":", id_key(F.col("source")), symbol_key(F.col("symbol"))).alias("component"), F.to_date("ts_event").alias("day"), "return_1d", "calculation_id", "ts_ingest")
    return latest_by(rows, ["component", "day"], ["ts_ingest", "calculation_id"])


def aligned_components(parts: DataFrame, returns: DataFrame) -> DataFrame:
    """One row per portfolio and day on which all constituents have a return.

    ``components``: structs (component, weight, return_1d, calculation_id) in the
    order of the components; their number is that of the constituents.
    """
    joined = returns.join(bounded_broadcast(parts), "component")
    entry = F.struct("component", "weight", "return_1d", "calculation_id")
    days = joined.groupBy("portfolio_id", "definition_fingerprint", "base_currency", "size", "day").agg(F.array_sort(F.collect_list(entry)).alias("components"), F.max("ts_ingest").alias("ts_ingest"))
    return days.where(F.size("components") == F.col("size"))


def alignment_diagnostics(parts: DataFrame, returns: DataFrame) -> DataFrame:
    """Per portfolio definition: days with any constituent's return, days with all of them, and those dropped as incomplete."""
    keys = ["portfolio_id", "definition_fingerprint"]
    days = returns.join(bounded_broadcast(parts), "component").groupBy(*keys, "size", "day").agg(F.count("*").alias("n"))
    whole = F.col("n") == F.col("size")
    out = days.groupBy(*keys).agg(F.count("*").alias("candidate_dates"), F.count_if(whole).alias("aligned_dates"), F.min(F.when(whole, F.col("day"))).alias("first_aligned"), F.max(F.when(whole, F.col("day"))).alias("last_aligned"))
    return out.withColumn("dropped_incomplete_dates", F.col("candidate_dates") - F.col("aligned_dates"))


def portfolio_returns(aligned: DataFrame) -> DataFrame:
    """Portfolio return per aligned day: the weighted sum of the component returns, with its identifier."""
    total = F.aggregate("components", F.lit(0.0), lambda s, c: s + c["weight"] * c["return_1d"])
    identity = content_id(
        f"{RETURN_VERSION}-return-",
        component_calculation_ids=F.col("components.calculation_id"),
        definition_fingerprint=F.col("definition_fingerprint"),
        metric=F.lit("return"),
        model_version=F.lit(RETURN_VERSION),
        parameters=F.struct(F.lit(WEIGHTING_METHOD).alias("weighting_method")),
    )
    return aligned.withColumn("portfolio_return_1d", total).withColumn("calculation_id", identity)


def portfolio_risk(returns: DataFrame, volatility_window: int = 20, var_window: int = 60, confidence: float = 0.95) -> DataFrame:
    """Per portfolio and day: volatility, value at risk and drawdown of compounded wealth (its peak is at least 1)."""
    line = Window.partitionBy("portfolio_id", "definition_fingerprint").orderBy("day")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    vol, var = line.rowsBetween(-(volatility_window - 1), 0), line.rowsBetween(-(var_window - 1), 0)
    r = "portfolio_return_1d"
    loss = F.greatest(F.lit(0.0), -F.percentile(r, F.lit(1 - confidence)).over(var))
    return (
        returns.withColumn("aligned_observations", F.row_number().over(line).cast("bigint"))
        .withColumn("volatility_annualized", F.when(F.col("aligned_observations") >= volatility_window, F.stddev_samp(r).over(vol) * math.sqrt(TRADING_DAYS)))
        .withColumn("var_observations", F.count(r).over(var))
        .withColumn("historical_var_loss", F.when(F.col("var_observations") >= 2, loss))
        .withColumn("_wealth", F.product(F.col(r) + 1).over(so_far))
        .withColumn("_peak", F.greatest(F.lit(1.0), F.max("_wealth").over(so_far)))
        .withColumn("maximum_drawdown", F.min(F.col("_wealth") / F.col("_peak") - 1).over(so_far))
        .withColumn("history_status", F.when(F.col("aligned_observations") >= max(volatility_window, var_window), "ready").otherwise("partial"))
        .drop("_wealth", "_peak")
    )


def contributions(stored: DataFrame) -> DataFrame:
    """(portfolio_id, day, calculation_id, component, weight, component_return, contribution) from the JSON maps of stored returns."""
    maps = stored.select("portfolio_id", F.to_date("ts_event").alias("day"), "calculation_id", json_numbers(F.col("weights_json")).alias("w"), json_numbers(F.col("component_returns_json")).alias("r"), json_numbers(F.col("contributions_json")).alias("c"))
    rows = maps.where("c is not null").select("portfolio_id", "day", "calculation_id", "w", "r", F.explode("c").alias("component", "contribution"))
    at = lambda m: F.try_element_at(m, F.col("component"))
    return rows.select("portfolio_id", "day", "calculation_id", "component", at("w").alias("weight"), at("r").alias("component_return"), "contribution")


def rolling_matrix(aligned: DataFrame, window: int = 20) -> DataFrame:
    """Annualised covariance and correlation of every pair of components over every full trailing window.

    One pass: pairs are spread from the day's components (no self-join) and
    windowed per pair. correlation is null where a variance is 0.
    """
    pairs = aligned.select("portfolio_id", "definition_fingerprint", "day", F.explode("components").alias("a"), "components").withColumn("b", F.explode("components")).drop("components")
    rows = pairs.select("portfolio_id", "definition_fingerprint", "day", F.col("a.component").alias("row_key"), F.col("b.component").alias("column_key"), F.col("a.weight").alias("row_weight"), F.col("b.weight").alias("column_weight"), F.col("a.return_1d").alias("x"), F.col("b.return_1d").alias("y"))
    line = Window.partitionBy("portfolio_id", "definition_fingerprint", "row_key", "column_key").orderBy("day")
    frame = line.rowsBetween(-(window - 1), 0)
    out = rows.withColumn("covariance", F.covar_samp("x", "y").over(frame)).withColumn("_n", F.count("x").over(frame)).withColumn("window_start", F.min("day").over(frame))
    out = out.withColumn("_sx", F.stddev_samp("x").over(frame)).withColumn("_sy", F.stddev_samp("y").over(frame))
    bound = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("covariance") / F.nullif(F.col("_sx") * F.col("_sy"), F.lit(0.0))))
    out = out.where(F.col("_n") == window).withColumn("correlation", F.when(F.col("_sx") * F.col("_sy") > 0, bound)).withColumn("covariance_annualized", F.col("covariance") * TRADING_DAYS)
    return out.drop("x", "y", "covariance", "_n", "_sx", "_sy")


def euler_attribution(matrix: DataFrame) -> DataFrame:
    """Per window and component: marginal and component contribution to volatility and its share.

    A volatility of 1e-12 or less counts as zero: all contributions are 0 and
    volatility_status is zero.
    """
    grain = ["portfolio_id", "definition_fingerprint", "day", "window_start"]
    rows = matrix.groupBy(*grain, F.col("row_key").alias("component"), F.col("row_weight").alias("weight")).agg(F.sum(F.col("covariance_annualized") * F.col("column_weight")).alias("_marginal"))
    whole = Window.partitionBy(*grain)
    rows = rows.withColumn("portfolio_variance", F.greatest(F.lit(0.0), F.sum(F.col("weight") * F.col("_marginal")).over(whole))).withColumn("portfolio_volatility", F.sqrt("portfolio_variance"))
    positive = F.col("portfolio_volatility") > ZERO_VARIANCE
    rows = rows.withColumn("volatility_status", F.when(positive, "positive").otherwise("zero")).withColumn("marginal_contribution", F.when(positive, F.col("_marginal") / F.nullif("portfolio_volatility", F.lit(0.0))).otherwise(0.0))
    rows = rows.withColumn("component_contribution", F.col("weight") * F.col("marginal_contribution"))
    rows = rows.withColumn("contribution_share", F.when(positive, F.col("component_contribution") / F.nullif("portfolio_volatility", F.lit(0.0))).otherwise(0.0))
    return rows.drop("_marginal")


def attribution_snapshots(aligned: DataFrame, matrix: DataFrame, window: int = 20) -> DataFrame:
    """One row per portfolio and window: variance, volatility, shares as a map, Euler residual, identifier."""
    grain = ["portfolio_id", "definition_fingerprint", "day", "window_start"]
    parts = euler_attribution(matrix)
    snaps = parts.groupBy(*grain, "portfolio_variance", "portfolio_volatility", "volatility_status").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("component", "contribution_share")))).alias("shares"),
        F.sum("component_contribution").alias("_euler"),
    )
    undefined = matrix.groupBy(*grain).agg(F.count_if(F.col("correlation").isNull()).alias("undefined_correlation_cells"))
    line = Window.partitionBy("portfolio_id", "definition_fingerprint").orderBy("day").rowsBetween(-(window - 1), 0)
    inputs = portfolio_returns(aligned).select("portfolio_id", "definition_fingerprint", "base_currency", "day", F.collect_list("calculation_id").over(line).alias("inputs"), F.max("ts_ingest").over(line).alias("ts_ingest"))
    out = snaps.join(undefined, grain).join(inputs, ["portfolio_id", "definition_fingerprint", "day"])
    identity = content_id(
        f"{ATTRIBUTION_VERSION}-snapshot-",
        annualization_days=F.lit(TRADING_DAYS),
        correlation_method=F.lit(CORRELATION_METHOD),
        covariance_method=F.lit(COVARIANCE_METHOD),
        covariance_window=F.lit(window),
        definition_fingerprint=F.col("definition_fingerprint"),
        input_calculation_ids=F.col("inputs"),
        model_version=F.lit(ATTRIBUTION_VERSION),
        weighting_method=F.lit(WEIGHTING_METHOD),
    )
    out = out.withColumn("calculation_id", identity).withColumn("euler_residual", F.col("_euler") - F.when(F.col("volatility_status") == "positive", F.col("portfolio_volatility")).otherwise(0.0))
    return out.withColumn("correlation_status", F.when(F.col("undefined_correlation_cells") == 0, "complete").otherwise("undefined_zero_variance")).drop("_euler", "inputs")
