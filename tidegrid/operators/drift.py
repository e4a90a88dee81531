"""Column-level quality profile of loads, and what changed between them.

One scan compresses the rows of every load to weighted cells: the state of each
column (present, null, defect), the decade of each level, and the sum of the levels
in it. A load has a bounded number of cells however many rows it has. Exact base
aggregates (null, blank and invalid counts, mean levels) are sums over the cells.

The changes are found by a classifier two-sample test. For every load a logistic
regression is trained on its cells to tell the load from the reference: the cells
of all loads together, every row counted, with the null rates and mean levels of
``field_baseline`` where it has them. The loads are trained in parallel on the
executors. Five folds are cross-fitted: each fifth of the load's rows is scored by
a model that has not seen it. ``discrimination`` is the mean score of the load's
rows less that of the reference (0: alike); ``ablation`` is what of it is lost when
one column's terms are held at their reference mean. The columns whose ablation
loses something are the changed ones; the exact rules of ``changes`` then verify
these columns and look at no others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.text import is_blank, is_number, json_object, trimmed
from tidegrid.session import bounded_broadcast, stage

TEXT_FIELDS = ("event_id", "symbol", "source")
LEVEL_FIELDS = ("price", "volume")
TIME_FIELDS = ("ts_event", "ts_ingest")
FIELDS = ("event_id", "symbol", "price", "volume", "ts_event", "ts_ingest", "source")
#: Every column of a delivery, in the table's order.
COLUMNS = ("delivery_id", *FIELDS, "batch_id", "loaded_at")
COLUMN_TEXTS = (*TEXT_FIELDS, "batch_id")
COLUMN_TIMES = (*TIME_FIELDS, "loaded_at")
FOLDS = 5
#: A column tells a load apart if ablating its null term loses more than this many times its usual null rate,
NOMINATE_SHARE = 1.0
#: or ablating its level term loses more than this (both in log odds).
NOMINATE_LEVEL = 0.05
#: Ridge of indicator terms; of level terms per row of the load, so that a shifted level does not drown the others.
RIDGE, LEVEL_RIDGE = 0.1, 0.05
#: With fewer rows, or fewer values of a level, the test has no power: its figures are null, the column is untested.
LEAST_ROWS = 100
#: A cell's level is the logarithm in decades, within these limits.
LEVEL_RANGE = (-3, 12)


def invalid(field: str) -> Column:
    """Non-null values outside the field's range: price not above 0 (or NaN), volume below 0."""
    c = F.col(field)
    if field == "price":
        return F.coalesce(~(is_number(c.cast("double")) & (c > 0)), F.lit(False)) & c.isNotNull()
    return F.coalesce(c < 0, F.lit(False)) if field == "volume" else F.lit(False)


def level(field: str) -> Column:
    """log10 of a value above 0, null for all others."""
    c = F.col(field).cast("double")
    return F.when(is_number(c) & (c > 0), F.log10(c))


def base_profile(rows: DataFrame, load: str = "batch_id") -> DataFrame:
    """Exact figures, one row per load and field.

    Columns: load, field, rows, nulls, blanks, invalid, level_mean (mean log10 of
    the values above 0), low, high (as text). A null load id is a load of its own.
    """
    aggs: list[Column] = [F.count("*").alias("rows")]
    for f in FIELDS:
        aggs.append(F.count_if(F.col(f).isNull()).alias(f"nulls_{f}"))
        aggs.append(F.count_if(is_blank(F.col(f))).alias(f"blanks_{f}") if f in TEXT_FIELDS else F.lit(0).cast("bigint").alias(f"blanks_{f}"))
        aggs.append(F.count_if(invalid(f)).alias(f"invalid_{f}") if f in LEVEL_FIELDS else F.lit(0).cast("bigint").alias(f"invalid_{f}"))
        aggs.append(F.avg(level(f)).alias(f"level_{f}") if f in LEVEL_FIELDS else F.lit(None).cast("double").alias(f"level_{f}"))
        value = F.when(is_number(F.col(f)), F.col(f)) if f == "price" else F.col(f)
        aggs += [F.min(value).alias(f"low_{f}"), F.max(value).alias(f"high_{f}")]
    wide = rows.groupBy(F.col(load).alias("load")).agg(*aggs)
    entries = [F.struct(F.lit(f).alias("field"), *(F.col(f"{n}_{f}").alias(n) for n in ("nulls", "blanks", "invalid")), F.col(f"level_{f}").alias("level_mean"), F.col(f"low_{f}").cast("string").alias("low"), F.col(f"high_{f}").cast("string").alias("high")) for f in FIELDS]
    return wide.select("load", "rows", F.explode(F.array(*entries)).alias("p")).select("load", "rows", "p.*")


def distinct_values(rows: DataFrame, load: str = "batch_id") -> DataFrame:
    """(load, field, distinct): exact counts of distinct values, text trimmed.

    Values are first made distinct per load and field with map-side combine, so
    a frequent value reaches the shuffle once per task.
    """
    entries = [F.struct(F.lit(f).alias("field"), (trimmed(F.col(f)) if f in TEXT_FIELDS else F.col(f).cast("string")).alias("value")) for f in FIELDS]
    long = rows.select(F.col(load).alias("load"), F.explode(F.array(*entries)).alias("e")).select("load", "e.field", "e.value")
    return long.where("value is not null").distinct().groupBy("load", "field").agg(F.count("*").alias("distinct_values"))


def column_profile(rows: DataFrame, load: str = "batch_id") -> DataFrame:
    """Exact figures with ranges, one row per load and column of ``COLUMNS``.

    Columns: load, field, rows, nulls, blanks, invalid, distinct_values,
    level_mean, and the range without NaN: low_text and high_text of text,
    low_value and high_value of numbers and of times (microseconds of the epoch).
    """
    none = lambda kind: F.lit(None).cast(kind)
    aggs, entries, values = [F.count("*").alias("rows")], [], []
    for f in COLUMNS:
        text, c = f in COLUMN_TEXTS, F.col(f)
        number = F.unix_micros(f) if f in COLUMN_TIMES else F.when(is_number(c), c) if f == "price" else c
        figures = {
            "nulls": F.count_if(c.isNull()),
            "blanks": F.count_if(is_blank(c)) if text else F.min(F.lit(0)).cast("bigint"),
            "invalid": F.count_if(invalid(f)) if f in LEVEL_FIELDS else F.min(F.lit(0)).cast("bigint"),
            "level_mean": F.avg(level(f)) if f in LEVEL_FIELDS else F.max(none("double")),
            "low_text": F.min(c) if text else F.max(none("string")),
            "high_text": F.max(c) if text else F.max(none("string")),
            "low_value": F.max(none("double")) if text else F.min(number).cast("double"),
            "high_value": F.max(none("double")) if text else F.max(number).cast("double"),
        }
        aggs += [figure.alias(f"{name}_{f}") for name, figure in figures.items()]
        entries.append(F.struct(F.lit(f).alias("field"), *(F.col(f"{name}_{f}").alias(name) for name in figures)))
        values.append(F.struct(F.lit(f).alias("field"), (trimmed(c) if text else c.cast("string")).alias("value")))
    wide = rows.groupBy(F.col(load).alias("load")).agg(*aggs)
    exact = wide.select("load", "rows", F.explode(F.array(*entries)).alias("p")).select("load", "rows", "p.*")
    long = rows.select(F.col(load).alias("_load"), F.explode(F.array(*values)).alias("e")).select("_load", F.col("e.field").alias("_field"), F.col("e.value").alias("value"))
    distinct = long.where("value is not null").distinct().groupBy("_load", "_field").agg(F.count("*").alias("distinct_values"))
    out = exact.join(distinct, F.col("load").eqNullSafe(F.col("_load")) & (F.col("field") == F.col("_field")), "left").drop("_load", "_field")
    return out.withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0)))


def _state(field: str) -> Column:
    """The column's state as a small integer: 0 present, 1 null, 2 blank or invalid."""
    c = F.col(field)
    bad = is_blank(c) if field in TEXT_FIELDS else invalid(field)
    return F.when(c.isNull(), 1).when(bad, 2).otherwise(0).cast("int")


def cells(rows: DataFrame, load: str = "batch_id") -> DataFrame:
    """(load, states, decades, weight, level sums): the compressed rows of each load."""
    lo, hi = LEVEL_RANGE
    decades = [F.when(level(f).isNotNull(), F.floor(F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), level(f))))).cast("int").alias(f"decade_{f}") for f in LEVEL_FIELDS]
    coded = rows.select(F.col(load).alias("load"), *(_state(f).alias(f"state_{f}") for f in FIELDS), *decades, *(level(f).alias(f"level_{f}") for f in LEVEL_FIELDS))
    sums = [F.sum(f"level_{f}").alias(f"sum_{f}") for f in LEVEL_FIELDS]
    return coded.groupBy("load", *(f"state_{f}" for f in FIELDS), *(f"decade_{f}" for f in LEVEL_FIELDS)).agg(F.count("*").alias("weight"), *sums)


def cell_profile(parts: DataFrame) -> DataFrame:
    """Exact figures from the cells, one row per load and field: load, field, rows, nulls, blanks, invalid, level_mean."""
    counted = lambda test: F.sum(F.when(test, F.col("weight")).otherwise(0))
    aggs, entries = [F.sum("weight").alias("rows")], []
    for f in FIELDS:
        aggs += [counted(F.col(f"state_{f}") == 1).alias(f"nulls_{f}"), counted(F.col(f"state_{f}") == 2).alias(f"bad_{f}")]
        if f in LEVEL_FIELDS:
            aggs.append((F.sum(f"sum_{f}") / counted(F.col(f"decade_{f}").isNotNull())).alias(f"level_{f}"))
            aggs.append(counted(F.col(f"decade_{f}").isNotNull()).alias(f"levels_{f}"))
        bad, none = F.col(f"bad_{f}"), F.lit(0).cast("bigint")
        entries.append(
            F.struct(
                F.lit(f).alias("field"),
                F.col(f"nulls_{f}").alias("nulls"),
                (bad if f in TEXT_FIELDS else none).alias("blanks"),
                (bad if f in LEVEL_FIELDS else none).alias("invalid"),
                (F.col(f"level_{f}") if f in LEVEL_FIELDS else F.lit(None).cast("double")).alias("level_mean"),
                (F.col(f"levels_{f}") if f in LEVEL_FIELDS else F.col("rows")).alias("tested"),
            )
        )
    wide = parts.groupBy("load").agg(*aggs)
    return wide.select("load", "rows", F.explode(F.array(*entries)).alias("p")).select("load", "rows", "p.*")


#: Feature columns: per field a null and a defect indicator (times have no defects), per level field its level.
FEATURES = [f"{f}:null" for f in FIELDS] + [f"{f}:bad" for f in TEXT_FIELDS + LEVEL_FIELDS] + [f"{f}:level" for f in LEVEL_FIELDS]
OWNERS = [None, *(name.split(":")[0] for name in FEATURES)]


def _features(columns: dict[str, np.ndarray], centre: dict[str, float], shift: dict[str, float] | None = None) -> np.ndarray:
    """One row per cell: 1 and the features; a cell's level is the mean of its levels, 0 (the centre) where it has none."""
    cols = [(columns[f"state_{f}"] == 1).astype(float) for f in FIELDS]
    cols += [(columns[f"state_{f}"] == 2).astype(float) for f in TEXT_FIELDS + LEVEL_FIELDS]
    for f in LEVEL_FIELDS:
        cols.append(np.nan_to_num(_levels(columns, f) + (shift or {}).get(f, 0.0) - centre[f]))
    return np.column_stack([np.ones(len(cols[0])), *cols])


def _levels(columns: dict[str, np.ndarray], field: str) -> np.ndarray:
    return np.clip(columns[f"sum_{field}"] / columns["weight"], *LEVEL_RANGE)


def _columns(batch: pa.RecordBatch | pa.Table) -> dict[str, np.ndarray]:
    """The numeric columns of cells as doubles, null as NaN."""
    return {name: batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(name).cast(pa.float64()).to_numpy() for name in batch.schema.names if name != "load"}


def _reference(pooled: pa.Table, usual: dict[str, tuple[float | None, float | None]]) -> tuple[np.ndarray, np.ndarray, dict[str, float]]:
    """(features, weights, centres) of the reference: the pooled cells, with the usual null rates and mean levels; the weights add to 1."""
    columns = _columns(pooled)
    w = columns["weight"]
    centre, shift = {}, {}
    for f in LEVEL_FIELDS:
        t = _levels(columns, f)
        known = ~np.isnan(t)
        mean = float(np.average(t[known], weights=w[known])) if known.any() else 0.0
        wanted = usual.get(f, (None, None))[1]
        centre[f] = mean if wanted is None else wanted
        shift[f] = centre[f] - mean
    w = w / w.sum() if len(w) else w
    for f in FIELDS:
        rate = usual.get(f, (None, None))[0]
        null = columns[f"state_{f}"] == 1
        share = w[null].sum()
        if rate is not None and 0 < share < 1:
            w = np.where(null, w * (rate / share), w * ((1 - rate) / (1 - share)))
    return _features(columns, centre, shift), w, centre


def _score(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


class _Trainer:
    """Ridge logistic regressions of many loads against one reference, all by the same Newton steps."""

    def __init__(self, x: np.ndarray, w: np.ndarray, starts: np.ndarray, x0: np.ndarray, w0: np.ndarray):
        self.x, self.w, self.starts, self.x0, self.w0 = x, w, starts, x0, w0
        self.owner = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(x)]))
        self.outer = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
        self.outer0 = (x0[:, :, None] * x0[:, None, :]).reshape(len(x0), -1)

    def per_load(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts, axis=0)

    def fit(self, w: np.ndarray, beta: np.ndarray, steps: int) -> np.ndarray:
        """``beta`` of each load after so many steps; ``w``: the training weights of the cells. Both classes weigh the same."""
        n = self.per_load(w)
        ridge = np.full((len(n), beta.shape[1]), RIDGE)
        ridge[:, 0] = 1e-6
        ridge[:, -len(LEVEL_FIELDS) :] = np.maximum(RIDGE, LEVEL_RIDGE * n)[:, None]
        at = np.arange(beta.shape[1])
        for _ in range(steps):
            p, p0 = _score((self.x * beta[self.owner]).sum(1)), _score(self.x0 @ beta.T)
            w0 = self.w0[:, None] * n
            grad = self.per_load((w * (1 - p))[:, None] * self.x) - (w0 * p0).T @ self.x0 - ridge * beta
            hess = self.per_load((w * p * (1 - p))[:, None] * self.outer) + (w0 * p0 * (1 - p0)).T @ self.outer0
            hess = hess.reshape(len(n), len(at), -1)
            hess[:, at, at] += ridge + 1e-9
            beta = beta + np.clip(np.linalg.solve(hess, grad[:, :, None])[:, :, 0], -4, 4)
        return beta


def _fold_weights(w: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(cells, FOLDS): how many rows of each cell every fold gets.

    The rows of a load are ranked by cell and dealt out in turn. Rows of a cell are
    equal in all features, so it does not matter which of them a fold gets, and
    every state is spread over the folds as evenly as can be.
    """
    whole = w.astype(np.int64)
    end = np.cumsum(whole)
    end = (end - np.repeat(end[starts] - whole[starts], np.diff(np.r_[starts, len(w)])))[:, None]
    start = end - whole[:, None]
    fold = np.arange(FOLDS)[None, :]
    upto = lambda n: (n - fold + FOLDS - 1) // FOLDS  # noqa: E731  ranks below n that are in the fold
    return (upto(end) - upto(start)).astype(float)


def _tell_apart(x: np.ndarray, w: np.ndarray, starts: np.ndarray, x0: np.ndarray, w0: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per load: cross-fitted discrimination, and per feature what ablating it loses and its mean coefficient."""
    trainer = _Trainer(x, w, starts, x0, w0)
    n = trainer.per_load(w)
    first = trainer.fit(w, np.zeros((len(n), x.shape[1])), 5)
    held = _fold_weights(w, starts)
    total, lost, slope = np.zeros(len(n)), np.zeros((len(n), x.shape[1])), np.zeros((len(n), x.shape[1]))
    mean0 = w0 @ x0
    for fold in range(FOLDS):
        out = held[:, fold]
        beta = trainer.fit(w - out, first, 2)
        share = trainer.per_load(out) / n
        # sums over the held rows are divided by all rows, so a fold counts by its size
        total += trainer.per_load(out * _score((x * beta[trainer.owner]).sum(1))) / n - share * (w0 @ _score(x0 @ beta.T))
        lost += beta * (trainer.per_load(out[:, None] * x) / n[:, None] - share[:, None] * mean0)
        slope += share[:, None] * beta
    return total, lost, slope


RESULT = "load string, field string, discrimination double, null_ablation double, level_ablation double"


def _test_loads(batches: Iterator[pa.RecordBatch], reference: tuple[np.ndarray, np.ndarray, dict[str, float]]) -> Iterator[pa.RecordBatch]:
    """The test of every load of a partition of cells sorted by load; whole loads are taken together as the batches come."""
    x0, w0, centre = reference
    names = [None, *FEATURES]

    def tested(cells_: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        columns = _columns(cells_)
        enough = np.add.reduceat(columns["weight"], starts) >= LEAST_ROWS
        d, lost, slope = _tell_apart(_features(columns, centre), columns["weight"], starts, x0, w0)
        d[~enough] = np.nan
        nulls, levels = [], []
        for f in FIELDS:
            at = names.index(f"{f}:null")
            nulls.append(np.where(enough, lost[:, at] * np.sign(slope[:, at]), np.nan))
            levels.append(np.where(enough, lost[:, names.index(f"{f}:level")] if f in LEVEL_FIELDS else 0.0, np.nan))
        loads = cells_.column("load").combine_chunks().take(pa.array(np.repeat(starts, len(FIELDS))))
        fields = pa.array(list(FIELDS) * len(starts))
        figures = [np.repeat(d, len(FIELDS)), np.column_stack(nulls).ravel(), np.column_stack(levels).ravel()]
        return pa.RecordBatch.from_arrays([loads, fields, *(pa.array(v, from_pandas=True) for v in figures)], [c.split()[0] for c in RESULT.split(", ")])

    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
        codes = table.column("load").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        starts = np.r_[0, np.flatnonzero(np.diff(codes)) + 1] if len(codes) else np.array([], int)
        if len(starts) > 1:  # the last load may go on in the next batch
            yield tested(table.slice(0, starts[-1]), starts[:-1])
        rest = table.slice(starts[-1]) if len(starts) else rest
    if rest is not None and rest.num_rows:
        yield tested(rest, np.array([0]))


def load_discrimination(parts: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """(load, field, discrimination, null_ablation, level_ablation): the test of each load's cells against the reference.

    The ablations are log odds lost by holding the field's null or level term at its
    reference mean; null_ablation is below 0 where nulls are rarer than usual.
    Loads with fewer than LEAST_ROWS rows have null figures. The reference has one
    row per cell of the pooled table, a number bounded by states and decades; it
    is collected and sent to the executors.
    """
    spark = parts.sparkSession
    grain = [c for c in parts.columns if c.startswith(("state_", "decade_"))]
    pooled = parts.groupBy(*grain).agg(F.sum("weight").alias("weight"), *(F.sum(f"sum_{f}").alias(f"sum_{f}") for f in LEVEL_FIELDS)).orderBy(*grain).toArrow()
    usual = {r.field: (r.usual_null_rate, r.usual_log10_mean) for r in _usual(baseline).where(F.col("field").isin(*FIELDS)).collect()} if baseline is not None else {}  # a row per field
    shared = spark.sparkContext.broadcast(_reference(pooled, usual))
    lined = parts.repartition("load").sortWithinPartitions("load", *grain)
    return lined.mapInArrow(lambda batches: _test_loads(batches, shared.value), RESULT)


def _usual(baseline: DataFrame) -> DataFrame:
    return baseline.groupBy("field").agg(F.min("usual_null_rate").alias("usual_null_rate"), F.min("usual_log10_mean").alias("usual_log10_mean"))


def profile_loads(rows: DataFrame, baseline: DataFrame, load: str = "batch_id") -> DataFrame:
    """One row per load and field: exact figures, the baseline, the test's figures and its verdict.

    ``by_classifier``: ablating the field's null term loses more than NOMINATE_SHARE times
    its usual null rate, or ablating its level term more than NOMINATE_LEVEL.
    ``untested``: the load has too few rows, or values of the
    level, for the test. ``by_figures``: the exact null share or mean level lies off
    the baseline; it is reported and decides nothing.
    """
    parts = stage(cells(rows, load), "load-cells")
    figures, tests = cell_profile(parts), load_discrimination(parts, baseline)
    joined = figures.join(tests, (figures["load"].eqNullSafe(tests["load"])) & (figures["field"] == tests["field"]), "left").drop(tests["load"]).drop(tests["field"])
    out = joined.join(bounded_broadcast(_usual(baseline)), "field", "left").withColumn("null_rate", F.col("nulls") / F.col("rows"))
    off = (F.col("null_rate") > F.col("usual_null_rate")) | (F.col("level_mean") != F.col("usual_log10_mean"))
    loses = (F.col("null_ablation") > NOMINATE_SHARE * F.coalesce("usual_null_rate", F.lit(0.0))) | (F.col("level_ablation") > NOMINATE_LEVEL)
    out = out.withColumn("untested", F.col("null_ablation").isNull() | (F.col("tested") < LEAST_ROWS)).drop("tested")
    return out.withColumn("by_classifier", F.coalesce(loses, F.lit(False))).withColumn("by_figures", F.coalesce(off, F.lit(False)))


def changes(profile: DataFrame) -> DataFrame:
    """(load, field, finding): the columns the classifier tells apart, or could not test, that the exact rules verify.

    null_rate_shift: at least 5 nulls and a null share above 3 times the usual one.
    level_shift: the mean log10 differs from the usual one by more than 0.3.
    """
    nulls = F.when((F.col("nulls") >= 5) & (F.col("null_rate") > 3 * F.col("usual_null_rate")), F.lit("null_rate_shift"))
    levels = F.when(F.abs(F.col("level_mean") - F.col("usual_log10_mean")) > 0.3, F.lit("level_shift"))
    named = profile.where(F.col("by_classifier") | F.col("untested"))
    return named.select("load", "field", F.explode(F.array_compact(F.array(nulls, levels))).alias("finding"))


def recorded(metrics: DataFrame, column: str, fields: tuple[str, ...]) -> DataFrame:
    """(metric_id, load, field, value) of a JSON object of figures.

    Names are compared trimmed and in lower case, numbers may be quoted, an
    absent or unreadable entry records 0; of several spellings of a name the
    greatest counts. Null text and text that is no JSON object gives no rows.
    """
    entries = F.map_entries(json_object(F.col(column), "string"))
    value = lambda f: F.coalesce(F.array_max(F.transform(F.filter("_e", lambda e: F.lower(trimmed(e["key"])) == f), lambda e: e["value"].try_cast("double"))), F.lit(0.0))
    rows = metrics.select("metric_id", F.col("batch_id").alias("load"), entries.alias("_e")).where("_e is not null")
    return rows.select("metric_id", "load", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), value(f).alias("value")) for f in fields))).alias("v")).select("metric_id", "load", "v.*")


def contradictions(metrics: DataFrame, profile: DataFrame) -> DataFrame:
    """(metric_id, field, finding): recorded figures that the rows of the load contradict."""
    p = profile.select("load", "field", "null_rate", "blanks", "invalid")
    kinds = (("null_rates_by_name", FIELDS, F.abs(F.col("value") - F.col("null_rate")) > 0.0005, "null_rate_wrong"), ("missing_required_fields_by_name", FIELDS, F.col("value") != F.col("blanks"), "missing_wrong"), ("invalid_values_by_name", LEVEL_FIELDS, F.col("value") != F.col("invalid"), "invalid_wrong"))
    said = None
    for column, fields, wrong, finding in kinds:
        rows = recorded(metrics, column, fields).withColumn("finding", F.lit(finding))
        said = rows if said is None else said.unionByName(rows)
    wrong = None
    for _, _, test, finding in kinds:
        here = (F.col("finding") == finding) & test
        wrong = here if wrong is None else wrong | here
    return said.join(p, ["load", "field"]).where(wrong).select("metric_id", "field", "finding").distinct()


def findings(metrics: DataFrame, rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """(metric_id, field, finding): contradictions and changes, for every recorded profile.

    A metric whose load has no rows has no findings.
    """
    profile = stage(profile_loads(rows, baseline), "load-profiles")
    changed = metrics.select("metric_id", F.col("batch_id").alias("load")).distinct().join(changes(profile), "load").select("metric_id", "field", "finding")
    return contradictions(metrics, profile).unionByName(changed)
