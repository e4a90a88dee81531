"""Reporting views over the stored tables: lazy frames that can be registered as temporary views.

``Warehouse`` holds the stored tables by name. Every view is a method of no
arguments; a view only touches the tables it needs, so a warehouse may be partial.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import limits, portfolio
from tidegrid.operators.versions import latest_by, one_per
from tidegrid.session import bounded_broadcast

VERSION = ["ts_ingest", "calculation_id"]
PORTFOLIO = ["portfolio_id", "definition_fingerprint", "model_version", "weighting_method"]
SNAPSHOT = [*PORTFOLIO, "covariance_method", "correlation_method", "covariance_window", "annualization_days", "ts_event"]
#: Figures of an attribution snapshot that are JSON objects by constituent.
BY_CONSTITUENT = {
    "weight": "weights_json",
    "constituent_volatility_annualized": "constituent_volatility_annualized_json",
    "marginal_volatility_contribution": "marginal_volatility_contribution_json",
    "component_volatility_contribution": "component_volatility_contribution_json",
    "contribution_share": "component_contribution_share_json",
}


def matrix_rows(df: DataFrame, column: str, value: str) -> DataFrame:
    """A nested JSON object {row: {column: value}} as rows; a null value stays null and is told as undefined."""
    nested = df.select("*", F.explode(F.from_json(column, "map<string,map<string,double>>")).alias("row_constituent_key", "_cells"))
    cells = nested.select("*", F.explode("_cells").alias("column_constituent_key", value)).drop("_cells")
    return cells.withColumn(f"{value}_undefined", F.col(value).isNull())


class Warehouse:
    def __init__(self, tables: Mapping[str, DataFrame]):
        self.tables = dict(tables)

    def _t(self, name: str) -> DataFrame:
        return self.tables[name]

    # ---- minute and daily ----------------------------------------------------
    def latest_risk_summary(self) -> DataFrame:
        return latest_by(self._t("risk_summary"), ["symbol"], ["ts_ingest"])

    def latest_data_quality_status(self) -> DataFrame:
        return self._t("data_quality_metrics").orderBy(F.col("ts_ingest").desc_nulls_last(), F.col("metric_id").desc()).limit(1)

    def current_symbol_dimension(self) -> DataFrame:
        return self._t("symbol_dimension_history").where("is_current")

    def latest_daily_risk_summary(self) -> DataFrame:
        return latest_by(self._t("daily_risk_summary"), ["source", "symbol", "ts_event", "model_version", "volatility_window", "var_window", "var_confidence", "annualization_days"], VERSION)

    def daily_risk_semantic_model(self) -> DataFrame:
        dims = self.current_symbol_dimension().select("symbol", "source", "asset_class", "reporting_currency", "sector")
        return self.latest_daily_risk_summary().join(bounded_broadcast(dims), ["symbol", "source"], "left")

    def finance_risk_semantic_model(self) -> DataFrame:
        """Risk by symbol with the dimension of its alphabetically first source and the latest quality row."""
        dims = self.current_symbol_dimension().groupBy("symbol").agg(F.min(F.struct("source", "asset_class", "reporting_currency", "sector")).alias("d")).select("symbol", "d.*")
        quality = self.latest_data_quality_status().select("required_fields_status", "null_rate_status", "value_validity_status")
        return self.latest_risk_summary().join(bounded_broadcast(dims), "symbol", "left").join(F.broadcast(quality), F.lit(True), "left")  # one row

    # ---- portfolios ----------------------------------------------------------
    def latest_portfolio_daily_returns(self) -> DataFrame:
        return latest_by(self._t("portfolio_daily_returns"), [*PORTFOLIO, "ts_event"], VERSION)

    def latest_portfolio_daily_risk_summary(self) -> DataFrame:
        return latest_by(self._t("portfolio_daily_risk_summary"), [*PORTFOLIO, "volatility_window", "var_window", "var_confidence", "annualization_days", "ts_event"], VERSION)

    def portfolio_risk_semantic_model(self) -> DataFrame:
        return self.latest_portfolio_daily_risk_summary().withColumnRenamed("ts_event", "metric_ts").drop("weights_json", "loaded_at")

    def portfolio_daily_contribution_model(self) -> DataFrame:
        return portfolio.contributions(self.latest_portfolio_daily_returns())

    # ---- attribution ---------------------------------------------------------
    def latest_portfolio_risk_attribution(self) -> DataFrame:
        return latest_by(self._t("portfolio_risk_attribution"), SNAPSHOT, VERSION)

    def portfolio_attribution_semantic_model(self) -> DataFrame:
        latest = self.latest_portfolio_risk_attribution()
        return latest.withColumnRenamed("ts_event", "metric_ts").drop(*[c for c in latest.columns if c.endswith("_json")], "loaded_at")

    def portfolio_covariance_model(self) -> DataFrame:
        head = self.latest_portfolio_risk_attribution().select(*SNAPSHOT, "calculation_id", "window_start", "window_end", "covariance_annualized_json")
        return matrix_rows(head, "covariance_annualized_json", "covariance_annualized").drop("covariance_annualized_json", "covariance_annualized_undefined")

    def portfolio_correlation_model(self) -> DataFrame:
        head = self.latest_portfolio_risk_attribution().select(*SNAPSHOT, "calculation_id", "window_start", "window_end", "correlation_json")
        return matrix_rows(head, "correlation_json", "correlation").drop("correlation_json")

    def portfolio_volatility_contribution_model(self) -> DataFrame:
        """One row per constituent; figures whose JSON column the table lacks are null."""
        latest = self.latest_portfolio_risk_attribution()
        maps = {out: portfolio.json_numbers(F.col(c)) if c in latest.columns else F.lit(None).cast("map<string,double>") for out, c in BY_CONSTITUENT.items()}
        keys = next(c for c in ("component_volatility_contribution_json", "component_contribution_share_json") if c in latest.columns)
        rows = latest.withColumns({f"_{k}": v for k, v in maps.items()}).withColumn("constituent_key", F.explode(F.json_object_keys(keys)))
        figures = [F.try_element_at(f"_{k}", F.col("constituent_key")).alias(k) for k in maps]
        return rows.select(*SNAPSHOT, "calculation_id", "constituent_key", *figures, "portfolio_volatility_annualized", "volatility_status")

    # ---- limits --------------------------------------------------------------
    def latest_portfolio_risk_limit_evaluations(self) -> DataFrame:
        return limits.latest_evaluations(self._t("portfolio_risk_limit_evaluations"))

    def portfolio_risk_limit_breaches(self) -> DataFrame:
        return self.latest_portfolio_risk_limit_evaluations().where("is_breach")

    def portfolio_risk_limit_snapshot_status(self) -> DataFrame:
        return limits.snapshot_status(self.latest_portfolio_risk_limit_evaluations(), ["policy_id", "policy_fingerprint", "portfolio_id", "definition_fingerprint", "attribution_calculation_id", "ts_event"])

    def portfolio_risk_limit_acknowledgement_history(self) -> DataFrame:
        about = self._t("portfolio_risk_limit_evaluations").select("calculation_id", "policy_id", "portfolio_id", "metric_name", "ts_event", "status", "observed_value")
        about = one_per(about, ["calculation_id"], ["ts_event"])
        return self._t("portfolio_risk_limit_acknowledgements").join(about, "calculation_id")

    def portfolio_risk_limit_breach_status(self) -> DataFrame:
        return limits.breach_status(self.latest_portfolio_risk_limit_evaluations(), self._t("portfolio_risk_limit_acknowledgements"))

    def portfolio_risk_limit_open_breaches(self) -> DataFrame:
        return self.portfolio_risk_limit_breach_status().where("acknowledgement_status = 'open'")

    def portfolio_risk_limit_acknowledged_breaches(self) -> DataFrame:
        return self.portfolio_risk_limit_breach_status().where("acknowledgement_status = 'acknowledged'")

    # ---- lifecycle -----------------------------------------------------------
    def portfolio_risk_limit_metric_transitions(self) -> DataFrame:
        return limits.transitions(self.latest_portfolio_risk_limit_evaluations())

    def portfolio_risk_limit_actionable_transitions(self) -> DataFrame:
        return limits.actionable(self.portfolio_risk_limit_metric_transitions())

    def portfolio_risk_limit_breach_episodes(self) -> DataFrame:
        return limits.episodes(self.portfolio_risk_limit_metric_transitions())

    def portfolio_risk_limit_open_episodes(self) -> DataFrame:
        return self.portfolio_risk_limit_breach_episodes().where("episode_status = 'open'")

    # ---- outbox --------------------------------------------------------------
    def current_portfolio_risk_notification_outbox(self) -> DataFrame:
        return limits.current_outbox(self._t("portfolio_risk_notification_outbox"), self.portfolio_risk_limit_metric_transitions())

    def portfolio_risk_notification_pending(self) -> DataFrame:
        return self.current_portfolio_risk_notification_outbox().where("delivery_disposition = 'pending'")

    def portfolio_risk_notification_suppressed(self) -> DataFrame:
        return self.current_portfolio_risk_notification_outbox().where("delivery_disposition = 'suppressed'")

    def portfolio_risk_notification_outbox_summary(self) -> DataFrame:
        outbox, moves = self._t("portfolio_risk_notification_outbox"), self.portfolio_risk_limit_metric_transitions()
        carry = [c for c in limits.SUMMARY_KEYS if c not in outbox.columns]
        return limits.outbox_summary(limits.current_outbox(outbox, moves, carry))

    # ---- operations ----------------------------------------------------------
    def pipeline_health(self) -> DataFrame:
        """The latest quality row with its rates in percent, rounded half up as decimals."""
        percent = lambda c: F.round(F.col(c).cast("decimal(38,12)") * 100, 2).cast("double").alias(f"{c}_pct")
        return self.latest_data_quality_status().select("metric_id", "total_events", "deduped_events", "duplicate_events", percent("duplicate_rate"), "late_events", percent("late_rate"), "late_status", "duplicate_status")

    def recent_incidents(self, most: int = 50) -> DataFrame:
        """The newest quality rows with any status but ok."""
        bad = F.array_contains(F.transform(F.array("required_fields_status", "null_rate_status", "value_validity_status", "late_status", "duplicate_status"), lambda s: s != "ok"), True)
        return self._t("data_quality_metrics").where(bad).orderBy(F.col("ts_ingest").desc_nulls_last(), F.col("metric_id").desc()).limit(most)

    def elevated_symbols(self, as_of: str | None = None, hours: int = 24) -> DataFrame:
        """Symbols with an elevated status in the hours before ``as_of`` (now, if not given)."""
        since = (F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()) - F.make_dt_interval(hours=F.lit(hours))
        return self._t("risk_summary").where((F.col("ts_ingest") >= since) & (F.col("volatility_status") != "ok")).orderBy(F.desc("ts_ingest"), "symbol")

    def names(self) -> list[str]:
        return [n for n in dir(type(self)) if not n.startswith("_") and n not in ("names", "register")]

    def register(self, spark: SparkSession, prefix: str = "") -> list[str]:
        """Register every view whose tables and columns are there as a temporary view; returns their names."""
        made = []
        for name in self.names():
            try:
                view = getattr(self, name)()
            except (KeyError, StopIteration, AnalysisException):
                continue
            view.createOrReplaceTempView(prefix + name)
            made.append(prefix + name)
        return made
