"""Forecasting jobs on Spark ML and `boosting`.

A national daily series gets a trend-and-season regression, occupancy also a boosted-tree model of
its residual; waiting times and workforce get pooled boosted trees over all series. Training data
is distributed; only the national series (one row per day) is small.

Fits that do not need each other run side by side. Each reads a stored table of assembled vectors in as
many partitions as its bytes ask for. The residual of the national series is boosted by Spark ML, in several
small jobs per tree with its lineage cut by checkpoints in the shared folder; the pooled models by `boosting`.
"""

from __future__ import annotations

import datetime as dt

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.calendar import seasonal_index, seasonal_temperature
from ..functions.numbers import scaled_band
from ..functions.scoring import shortage_label
from ..operators.cleaning import project
from ..operators.dedup import distinct_pairs, union_all
from ..operators.positions import with_position
from ..operators.snapshots import latest
from ..operators.windows import (
    SERIES, forward_fill, known_lag, known_rolling, series_window, waiting_features, workforce_features,
)
from ..sources.layers import shared_folder, store
from .boosting import PooledClassifier, PooledRegressor
from .together import run_together
from .trend import TooLittleHistory, fit_baseline

LAGS, ROLLS = (1, 7, 14, 30), (7, 14, 30)
EXOGENOUS = ("flu_index", "covid_index", "avg_temp_c")
# Booster settings.
TREES, DEPTH, RATE, SUBSAMPLE, SEED = 300, 4, 0.05, 0.9, 42
WAITING_TREES = 400
#: Rounds between cuts of a booster's lineage, and stored bytes of vectors per partition.
CHECKPOINT, VECTOR_BYTES = 10, 2 << 20


def gbt(kind, label: str, trees: int = TREES, **extra):
    if kind is GBTRegressor:
        extra = {"checkpointInterval": CHECKPOINT, **extra}
    return kind(
        featuresCol="features", labelCol=label, maxIter=trees, maxDepth=DEPTH, stepSize=RATE,
        subsamplingRate=SUBSAMPLE, seed=SEED, **extra,
    )


def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")


def _some(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise TooLittleHistory(f"no rows to fit {what} on")
    return df


def vectors(df: DataFrame, features: list[str], *kept: str) -> DataFrame:
    """A stored table of the assembled features and the kept columns, spread evenly by its bytes.

    A level of a tree is one pass over all rows, so a partition holds some ten thousand rows: enough to outweigh
    the start of its task, and few enough for all cores to share the pass.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    table = store(_assembler(features).transform(df).select("features", *kept), "vectors")
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = size // VECTOR_BYTES + 1
    # rows of a stored table lie in few row groups, which only a shuffle can part
    return table.repartition(wanted) if wanted > 1 else table.coalesce(1)


def national_daily(fact: DataFrame, target: str, how: str) -> DataFrame:
    """One row per day: mean or sum of the target and means of the exogenous columns."""
    agg = F.avg(F.col(target).cast("double")) if how == "mean" else F.sum(target).cast("double")
    known = [c for c in EXOGENOUS if c in fact.columns]
    daily = fact.groupBy("date_key").agg(
        agg.alias(target), *[F.avg(F.col(c).cast("double")).alias(c) for c in known]
    )
    return daily.filter(F.col(target).isNotNull())


def future_days(history: DataFrame, horizon: int) -> DataFrame:
    newest = latest(history)
    days = history.sparkSession.range(1, horizon + 1)
    return days.select(F.date_add(newest, F.col("id").cast("int")).alias("date_key"))


def _occupancy_features(df: DataFrame, target: str) -> tuple[DataFrame, list[str]]:
    """Lags and rolling means of the daily series: one row per day, so one short window."""
    w = Window.partitionBy(F.lit(0)).orderBy("date_key")
    columns = {f"{target}_lag{n}": F.lag(target, n).over(w) for n in LAGS}
    columns |= {f"{target}_roll{n}": F.avg(target).over(w.rowsBetween(-(n - 1), 0)) for n in ROLLS}
    columns |= {"month": F.month("date_key"), "dow": F.weekday("date_key")}
    return df.withColumns(columns), [*columns, *EXOGENOUS]


def occupancy_forecast(
    fact: DataFrame, horizon: int = 90, target: str = "bed_occupancy_pct", trees: int = TREES
) -> DataFrame:
    """Hybrid forecast: baseline plus boosted residual for the days after the history."""
    daily = store(national_daily(fact, target, "mean"), "daily")
    baseline = fit_baseline(daily, target, multiplicative=True)
    x, names = _occupancy_features(daily, target)
    fitted = baseline.predict(daily.select("date_key"))
    x = (
        x.join(fitted, "date_key", "left")
        .withColumn("residual", F.col(target) - F.col("yhat"))
        .dropna(subset=[*names, "residual"])
    )
    booster = PipelineModel([
        _assembler(names),
        gbt(GBTRegressor, "residual", trees).fit(_some(vectors(x, names, "residual"), "the residual")),
    ])
    future = future_days(daily, horizon)
    last = daily.agg(F.max_by(target, "date_key")).scalar()
    d = F.col("date_key")
    rows = future
    for n in LAGS:
        rows = known_lag(rows, daily, target, n, last)
    both = rows.unionByName(daily.select("date_key", target), allowMissingColumns=True)
    both = both.withColumns({f"{target}_roll{n}": known_rolling(both, target, n, last) for n in ROLLS})
    rows = both.filter(d > latest(daily)).drop(target).withColumns(
        {
            "flu_index": seasonal_index(d, 1, 5.0, 2.0),
            "covid_index": seasonal_index(d, 12, 1.5, 2.0),
            "avg_temp_c": seasonal_temperature(d),
            "month": F.month(d),
            "dow": F.weekday(d),
        }
    )
    out = baseline.predict(booster.transform(rows).withColumnRenamed("prediction", "residual").select("date_key", "residual"))
    r = F.col("residual")
    return out.select(
        "date_key", (F.col("yhat") + r).alias("yhat"),
        (F.col("yhat_lower") + r * 0.6).alias("yhat_lower"),
        (F.col("yhat_upper") + r * 0.6).alias("yhat_upper"),
        F.lit(True).alias("is_future"),
    )


def attendance_forecast(fact: DataFrame, horizon: int = 90, target: str = "ae_attendances") -> DataFrame:
    """Baseline over the history and the horizon; is_future tells them apart."""
    daily = store(national_daily(fact, target, "sum").select("date_key", target), "daily")
    baseline = fit_baseline(daily, target)
    days = daily.select("date_key", F.lit(False).alias("is_future")).unionByName(
        future_days(daily, horizon).withColumn("is_future", F.lit(True))
    )
    return baseline.predict(days)


class WaitingTimes:
    """One pooled model per horizon that predicts the wait a number of rows ahead."""

    def __init__(self, horizons: tuple[int, ...] = (30, 60, 90), trees: int = WAITING_TREES):
        self.horizons, self.trees = horizons, trees
        self.models: dict[int, PipelineModel] = {}

    def _features(self, fact: DataFrame) -> tuple[DataFrame, list[str]]:
        df, names = waiting_features(fact)
        return forward_fill(df.withColumns({c: F.col(c).cast("double") for c in names}), names), names

    def fit(self, fact: DataFrame, target: str = "median_wait_days") -> WaitingTimes:
        df, names = self._features(fact)
        leads = {h: f"_ahead{h}" for h in self.horizons}
        y = F.col(target).cast("double")
        ahead = df.withColumns({c: F.lead(y, h).over(series_window()) for h, c in leads.items()})
        table = vectors(ahead, names, *leads.values())

        def job(h: int):
            rows = table.filter(F.col(leads[h]).isNotNull())
            return lambda: gbt(PooledRegressor, leads[h], self.trees).fit(_some(rows, f"waiting times {h} rows ahead"))

        fits = run_together(fact.sparkSession, {f"waiting times {h}": job(h) for h in self.horizons})
        self.models = {h: PipelineModel([_assembler(names), fits[f"waiting times {h}"]]) for h in self.horizons}
        return self

    def predict(self, fact: DataFrame, horizon: int) -> DataFrame:
        """date_key is the origin, target_date the day the prediction is for."""
        if horizon not in self.models:
            raise KeyError(f"no model for horizon {horizon}")
        df, _ = self._features(fact)
        return self.models[horizon].transform(df).select(
            "date_key", *SERIES, F.date_add("date_key", horizon).alias("target_date"),
            F.col("prediction").alias(f"pred_{horizon}d"),
        )


class WorkforceModels:
    """Shortage probability and expected staff per trust and role."""

    def __init__(self, trees: int = TREES):
        self.trees = trees

    def _features(self, staff: DataFrame) -> tuple[DataFrame, list[str]]:
        df, names = workforce_features(staff)
        return forward_fill(df.withColumns({c: F.col(c).cast("double") for c in names}), names,
                            ["trust_code", "role"]), [*names, "role_code"]

    def fit(self, staff: DataFrame) -> WorkforceModels:
        df, names = self._features(staff)
        df = store(df.withColumn("label", shortage_label(F.col("vacancy_rate")).cast("double")), "staff")
        code = StringIndexer(
            inputCol="role", outputCol="role_code", stringOrderType="alphabetAsc", handleInvalid="keep"
        )
        coded = code.fit(df)
        self.head = PipelineModel([coded, _assembler(names)])
        x = vectors(coded.transform(df), names, "label", "staff_count")
        fits = run_together(staff.sparkSession, {
            "shortage": lambda: gbt(PooledClassifier, "label", self.trees).fit(x),
            "demand": lambda: gbt(PooledRegressor, "staff_count", self.trees).fit(x.filter(F.col("staff_count").isNotNull())),
        })
        self.classifier, self.regressor = fits["shortage"], fits["demand"]
        return self

    def _inputs(self, staff: DataFrame) -> DataFrame:
        return self.head.transform(self._features(staff)[0])

    def shortage(self, staff: DataFrame) -> DataFrame:
        return self.classifier.transform(self._inputs(staff)).select(
            "date_key", "trust_code", "role", F.col("probability").alias("shortage_proba")
        )

    def demand(self, staff: DataFrame) -> DataFrame:
        return self.regressor.transform(self._inputs(staff)).select(
            "date_key", "trust_code", "role", F.col("prediction").alias("demand_fte")
        )


def labelled(df: DataFrame, target: str, model: str, horizon: int) -> DataFrame:
    return df.withColumns(
        {"target": F.lit(target), "model": F.lit(model), "horizon_days": F.lit(horizon)}
    )


def occupancy_rows(fact: DataFrame, trees: int | None = None) -> DataFrame:
    return labelled(occupancy_forecast(fact, 90, trees=trees or TREES), "bed_occupancy", "trend_gbt", 90)


def attendance_rows(fact: DataFrame) -> DataFrame:
    return labelled(attendance_forecast(fact, 90), "ae_demand", "trend", 90)


def waiting_rows(fact: DataFrame, trees: int | None = None, horizons: tuple[int, ...] = (30, 60, 90)) -> DataFrame:
    """Predictions of every horizon; date_key is the day a prediction is for."""
    model, frames = WaitingTimes(horizons, trees or WAITING_TREES).fit(fact), []
    for h in horizons:
        p = model.predict(fact, h).withColumnRenamed(f"pred_{h}d", "yhat")
        p = p.withColumns({**scaled_band(F.col("yhat"), 0.92, 1.08), "date_key": F.col("target_date")})
        future = F.col("date_key") > latest(fact)
        frames.append(labelled(p.withColumn("is_future", future), "waiting_time", "gbt", h))
    return union_all(frames)


def workforce_rows(
    workforce: DataFrame, hospitals: DataFrame, run_date: dt.date | str, trees: int | None = None
) -> DataFrame:
    """Expected staff per hospital and role, with the probability of a shortage."""
    staff = workforce.withColumn("date_key", F.lit(str(run_date)).cast("date"))
    model = WorkforceModels(trees or TREES).fit(staff)
    demand = model.demand(staff).withColumnRenamed("demand_fte", "yhat")
    demand = demand.join(model.shortage(staff), ["date_key", "trust_code", "role"])
    sites = distinct_pairs(hospitals, "trust_code", "hospital_id").dropna()
    demand = demand.withColumns(scaled_band(F.col("yhat"), 0.95, 1.05)).join(sites, "trust_code", "left")
    return labelled(demand.withColumn("is_future", F.lit(True)), "workforce_demand", "gbt", 60)


def train_all(
    fact: DataFrame,
    workforce: DataFrame,
    hospitals: DataFrame,
    run_date: dt.date | str,
    trees: int | None = None,
    horizons: tuple[int, ...] = (30, 60, 90),
) -> DataFrame:
    """Run the four jobs side by side and return the forecast table (pass a stored fact: each job reads it)."""
    jobs = {
        "occupancy": lambda: occupancy_rows(fact, trees),
        "attendance": lambda: attendance_rows(fact),
        "waiting": lambda: waiting_rows(fact, trees, horizons),
        "workforce": lambda: workforce_rows(workforce, hospitals, run_date, trees),
    }
    frames = run_together(fact.sparkSession, jobs)
    # numbered in two readings, so the predictions are stored first
    out = store(project(union_all([frames[name] for name in jobs]), schemas.FORECAST), "forecast")
    keys = {c: F.coalesce(F.col(c), F.lit("")) for c in ("hospital_id", "specialty_id", "role")}
    sortable = out.withColumns({f"_{c}": v for c, v in keys.items()}).drop("forecast_id")
    levels = [["target", "horizon_days"], ["date_key"], ["_hospital_id"], ["_specialty_id", "_role"]]
    return project(with_position(sortable, levels, name="forecast_id"), schemas.FORECAST)
