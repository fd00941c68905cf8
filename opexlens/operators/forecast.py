"""Daily grid, calendar features and the linear OpEx forecast.

The record table is reduced to one row per day first (partial aggregation,
a hot day costs nothing extra), so everything after that -- calendar, join,
model fit -- works on a table of at most (last day - first day + 1) rows,
however large the records are.  The regression is Spark ML's normal-
equation solver, aggregated over executors.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import ratio, sum0
from ..schema import BUDGET_OVERRUN_PLACEHOLDER, DEFAULT_HORIZON, FORECAST_FEATURES, FUTURE_KPI_SCHEMA, NOT_AVAILABLE
from ..session import cut_lineage, small_frame
from .charts import numeric_columns
from .kpis import _ranked_ends, factory_costs

MIN_DAYS = 10
FORECAST_SCHEMA = "day_index int, date date, prediction double"


def daily_grid(df: DataFrame, measures: list[str] | None = None) -> DataFrame:
    """Sum of each measure per calendar day between the first and last
    date, days without records filled with 0 (T1)."""
    measures = measures or numeric_columns(df)
    # Written once (a row per day): its ends, the calendar join and whatever
    # follows read it instead of the records.
    daily = cut_lineage(df.where(F.col("date").isNotNull()).groupBy(F.to_date("date").alias("date")).agg(
        *[sum0(m).cast("double").alias(m) for m in measures]), "daily")
    bounds = daily.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    calendar = bounds.where(F.col("lo").isNotNull()).select(
        F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("date"))
    return (calendar.join(daily, on="date", how="left")
                    .na.fill(0.0, subset=measures))


def calendar_features(grid: DataFrame) -> DataFrame:
    """weekday (Monday = 0), month, day of month, days since the first day."""
    start = grid.agg(F.min("date")).scalar()
    return grid.withColumns({
        "dayofweek": F.weekday("date").cast("int"),
        "month": F.month("date").cast("int"),
        "day": F.dayofmonth("date").cast("int"),
        "days_since_start": F.datediff("date", start).cast("int"),
    })


def forecast_split(features: DataFrame) -> DataFrame:
    """Deterministic 80/20 holdout: every fifth day (days_since_start % 5 = 4)
    is a test day (T3)."""
    return features.withColumn("is_test", (F.col("days_since_start") % 5) == 4)


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=FORECAST_FEATURES, outputCol="features")


def fit_forecast(df: DataFrame) -> tuple[LinearRegressionModel | None, DataFrame]:
    """Fit OLS of daily total_opex on the calendar features over the
    training days (T4).  Returns (model or None when fewer than 10 days,
    split feature table)."""
    if "date" not in df.columns or "total_opex" not in df.columns:
        return None, None
    grid = daily_grid(df, ["total_opex"])
    # One row per calendar day: materialised once in the shared checkpoint
    # folder, so the count, the fit and the scoring do not rescan records.
    feats = cut_lineage(forecast_split(calendar_features(grid)))
    if feats.count() < MIN_DAYS:
        return None, feats
    train = _assembler().transform(feats.where(~F.col("is_test")))
    lr = LinearRegression(featuresCol="features", labelCol="total_opex", solver="normal",
                          regParam=0.0, elasticNetParam=0.0, standardization=False)
    return lr.fit(train), feats


def future_grid(feats: DataFrame, horizon: int = DEFAULT_HORIZON) -> DataFrame:
    """The ``horizon`` days after the last day, with features."""
    last = feats.agg(F.max("date")).scalar()
    start = feats.agg(F.min("date")).scalar()
    fut = feats.sparkSession.range(1, horizon + 1).select(
        F.col("id").cast("int").alias("day_index"))
    fut = fut.withColumn("date", F.date_add(last, F.col("day_index")))
    return fut.withColumns({
        "dayofweek": F.weekday("date").cast("int"),
        "month": F.month("date").cast("int"),
        "day": F.dayofmonth("date").cast("int"),
        "days_since_start": F.datediff("date", start).cast("int"),
    })


def predict_future(model: LinearRegressionModel, feats: DataFrame,
                   horizon: int = DEFAULT_HORIZON, digits: int = 2) -> DataFrame:
    fut = _assembler().transform(future_grid(feats, horizon))
    return model.transform(fut).select(
        "day_index", "date", F.round("prediction", digits).alias("prediction"))


def forecast(df: DataFrame, horizon: int = DEFAULT_HORIZON, digits: int = 2) -> DataFrame:
    """Predicted daily OpEx for the next ``horizon`` days (T4, T6, T10);
    empty with the same schema when there are fewer than 10 days (T7)."""
    model, feats = fit_forecast(df)
    if model is None:
        return small_frame(df.sparkSession, [], FORECAST_SCHEMA)
    return predict_future(model, feats, horizon, digits)


def forecast_metrics(df: DataFrame, digits: int = 6) -> DataFrame:
    """Holdout R^2, MAE and RMSE of the fitted model (T5)."""
    model, feats = fit_forecast(df)
    if model is None:
        return small_frame(df.sparkSession, [], "r2 double, mae double, rmse double")
    test = model.transform(_assembler().transform(feats.where(F.col("is_test"))))
    err = F.col("total_opex") - F.col("prediction")
    s = test.agg(F.avg("total_opex").alias("ybar"), F.count("*").alias("n"),
                 F.sum(F.abs(err)).alias("sae"), F.sum(err * err).alias("sse"))
    # Two-pass total sum of squares; the test mean is one number.
    ybar = s.select("ybar").first()[0]
    sst = test.agg(F.sum((F.col("total_opex") - F.lit(ybar)) ** 2)).first()[0]
    return s.select(
        F.round(F.lit(1.0) - F.try_divide(F.col("sse"), F.lit(sst)), digits).alias("r2"),
        F.round(F.col("sae") / F.col("n"), digits).alias("mae"),
        F.round(F.sqrt(F.col("sse") / F.col("n")), digits).alias("rmse"))


def forecast_total(df: DataFrame, horizon: int = DEFAULT_HORIZON, digits: int = 2) -> DataFrame:
    """Total, mean and number of forecast days (T8); no row without a
    forecast."""
    fc = forecast(df, horizon, digits=12)
    return fc.agg(F.round(sum0("prediction"), digits).alias("total_forecast"),
                  F.round(F.avg("prediction"), digits).alias("avg_daily_forecast"),
                  F.count("*").cast("long").alias("days")).where("days > 0")


def future_kpis(df: DataFrame, horizon: int = DEFAULT_HORIZON, digits: int = 2) -> DataFrame:
    """Forecast summary cards (T9): next-period total and daily mean,
    energy demand = forecast total x (energy / OpEx), the most expensive
    factory (sum) and shift (mean), and the fixed overrun placeholder.  No
    row when there is no forecast (a missing column, under 10 days).

    The records are read once, into sums per (date, factory, shift)."""
    nothing = small_frame(df.sparkSession, [], FUTURE_KPI_SCHEMA)
    if "date" not in df.columns or "total_opex" not in df.columns:
        return nothing
    dims = [c for c in ("factory", "shift") if c in df.columns]
    measures = [c for c in ("total_opex", "total_energy") if c in df.columns]
    cells = cut_lineage(df.groupBy(F.to_date("date").alias("date"), *dims).agg(
        *[F.sum(c).alias(c) for c in measures], F.count("total_opex").alias("_n")), "future-cells")
    fc = forecast(cells, horizon, digits=12)
    tot = fc.agg(sum0("prediction").alias("t"), F.avg("prediction").alias("a"), F.count("*").alias("d")).where("d > 0")
    demand = F.col("t") * cells.agg(ratio(sum0("total_energy"), sum0("total_opex"))).scalar() if "total_energy" in measures else F.lit(0.0)
    top_f = top_s = F.lit(NOT_AVAILABLE)
    if "factory" in dims:
        top_f = _ranked_ends(factory_costs(cells), "factory", "total_opex")[0]
    if "shift" in dims:
        by_shift = cells.groupBy("shift").agg((F.sum("total_opex") / F.sum("_n")).alias("avg_opex"))
        top_s = _ranked_ends(by_shift, "shift", "avg_opex")[0]
    return tot.select(
        F.round("t", digits).alias("next_month_total_cost"),
        F.round(demand, digits).alias("estimated_energy_demand"),
        F.lit(BUDGET_OVERRUN_PLACEHOLDER).cast("int").alias("budget_overrun_prob"),
        top_f.alias("most_expensive_factory"), top_s.alias("most_expensive_shift"),
        F.round("a", digits).alias("avg_daily_cost_next_month"))


def trend_line(df: DataFrame, digits: int = 6) -> DataFrame:
    """Least-squares line of daily OpEx over days since start (T11); the
    records are read once, into the daily grid."""
    feats = calendar_features(daily_grid(df, ["total_opex"]))
    y, x = F.col("total_opex"), F.col("days_since_start").cast("double")
    return feats.agg(F.round(F.regr_slope(y, x), digits).alias("slope"),
                     F.round(F.regr_intercept(y, x), digits).alias("intercept"),
                     F.round(F.regr_r2(y, x), digits).alias("r2"),
                     F.count("*").cast("long").alias("days"))


def save_forecast_model(model: LinearRegressionModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def forecast_reload(df: DataFrame, path: str, horizon: int = DEFAULT_HORIZON,
                    digits: int = 2) -> DataFrame:
    """Score the future grid with a stored model (M9); the base dates come
    from the current records' daily grid."""
    model = LinearRegressionModel.load(path)
    feats = calendar_features(daily_grid(df, ["total_opex"]))
    return predict_future(model, feats, horizon, digits)
