"""Training curves: metric points by run, name and step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_per_step(points: DataFrame) -> DataFrame:
    """The value logged first for every step; later ones for the same step are left out."""
    return points.groupBy("run", "metric", "step").agg(F.min_by("value", "line_no").alias("value"))


def restored(points: DataFrame) -> DataFrame:
    """The value on the last line of every series of more than one line."""
    return points.groupBy("run", "metric").agg(F.max_by("value", "line_no").alias("value"), F.count(F.lit(1)).alias("lines")).where("lines > 1").drop("lines")


def best_step(points: DataFrame) -> DataFrame:
    """The step of least value for losses (the first of equal ones), of greatest value otherwise (the last)."""
    p = first_per_step(points)
    pair = F.struct("value", "step")
    loss = F.contains(F.col("metric"), F.lit("loss"))
    return p.groupBy("run", "metric").agg(F.min(pair).alias("low"), F.max(pair).alias("high")).select("run", "metric", F.when(loss, F.col("low.step")).otherwise(F.col("high.step")).alias("best_step"), F.when(loss, F.col("low.value")).otherwise(F.col("high.value")).alias("best_value"))


def error_band(value: Column, n: Column) -> Column:
    """Standard error of a share of n."""
    return F.sqrt(value * (1 - value) / n)


def early_stop(points: DataFrame, patience: int = 2) -> DataFrame:
    """The step at which a loss series stops: ``patience`` evaluations in a row without a new least value;
    its last step if that never happens."""
    w = Window.partitionBy("run", "metric").orderBy("step")
    best_before = F.min("value").over(w.rowsBetween(Window.unboundedPreceding, -1))
    p = first_per_step(points).withColumn("worse", F.coalesce(F.col("value") >= best_before, F.lit(False)).cast("int"))
    p = p.withColumn("bad", F.sum("worse").over(w.rowsBetween(1 - patience, 0)) == patience)
    return p.groupBy("run", "metric").agg(F.coalesce(F.min(F.when(F.col("bad"), F.col("step"))), F.max("step")).alias("stop_step"))


def trainer_points(states: DataFrame) -> DataFrame:
    """Metric points from trainer states with a nested ``log_history`` of rows with a step and named values."""
    rows = states.select("run", F.posexplode("log_history").alias("line_no", "e"))
    names = [f for f in states.schema["log_history"].dataType.elementType.names if f not in ("step", "epoch")]
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"e.{n}").cast("double").alias("value")) for n in names]))
    return rows.select("run", F.col("line_no").cast("long").alias("line_no"), F.col("e.step").cast("long").alias("step"), values.alias("v")).select("run", "v.metric", "line_no", "v.value", "step").where("value IS NOT NULL")
