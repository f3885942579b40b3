"""Keyword routing and audits over tables of questions and query texts, and summary texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def route(questions: DataFrame, col: str = "question") -> DataFrame:
    """Adds the intent and the reporting agents of every question."""
    return questions.withColumns(
        {"intent": text.intent(F.col(col)), "agents": text.agent_plan(F.col(col))}
    )


def answer(spark: SparkSession, question: str, views: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """The rows that answer one question: its intent chooses among the views, one per intent."""
    chosen = spark.range(1).select(text.intent(F.lit(question)).alias("intent")).first()["intent"]
    return views[chosen]()


def checked_query(spark: SparkSession, sql: str) -> DataFrame:
    """Run one query text if the audit accepts it."""
    reason = spark.range(1).select(text.audit_reason(F.lit(sql)).alias("reason")).first()["reason"]
    if reason is not None:
        raise ValueError(f"query refused: {reason}")
    return spark.sql(sql)


def audit(log: DataFrame, col: str = "sql") -> DataFrame:
    """Adds why each logged text would be refused and whether it passes."""
    return log.withColumn("reason", text.audit_reason(F.col(col))).withColumn(
        "accepted", F.col("reason").isNull()
    )


def forecast_summary(recent: DataFrame) -> DataFrame:
    """One text with a line per target and horizon.

    The input is the aggregated forecast mean, a handful of rows, so collecting it in one row is
    bounded by the number of targets and horizons.
    """
    line = text.forecast_line(F.col("target"), F.col("horizon_days"), F.col("yhat"))
    rows = F.sort_array(F.collect_list(F.struct("target", "horizon_days", line.alias("line"))))
    joined = F.concat_ws("\n", F.transform(rows, lambda r: r["line"]))
    return recent.agg(joined.alias("_text")).select(
        F.when(F.col("_text") == "", "No forecasts available.").otherwise(F.col("_text")).alias("summary")
    )


def pressure_summary(metrics: DataFrame) -> DataFrame:
    return metrics.select("*", text.pressure_sentence().alias("summary"))
