"""Structured Streaming over event logs.

Batch and stream share the expressions of the batch operators. Event order is the log's sequence number,
so late and repeated events need no watermark for the latest state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import latest_state


def latest_state_stream(events: DataFrame, key: str = "problem_id", order: str = "event_seq") -> DataFrame:
    """The latest event per key as a streaming aggregation, for update or complete mode."""
    row = F.struct(*[F.col(c) for c in events.columns])
    return events.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max_by(row, F.col(order)).alias("r")).select("r.*")


def running_rates(graded: DataFrame, *by: str) -> DataFrame:
    """Continuous counts and rates, brought up to date by every batch instead of computed anew."""
    total = F.count(F.lit(1))
    correct = F.count_if(F.coalesce("is_correct", F.lit(False)))
    return graded.groupBy(*by).agg(total.alias("n"), correct.alias("correct"), (correct / total).alias("accuracy"))


def upsert_latest(events: DataFrame, path: str, checkpoint: str, key: str = "problem_id", order: str = "event_seq", buckets: int = 64) -> StreamingQuery:
    """Keep the latest state as Parquet in ``path``, one folder per bucket of the key.

    Each batch rewrites only the buckets it touches, from the newest complete version of each. A version
    carries the batch's number, so a batch that runs again writes the same version anew.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = latest_state(batch, key, order).drop("first_seq")
        try:
            old = spark.read.parquet(path).where(F.col("version") < number)
            newest = old.groupBy("bucket").agg(F.max("version").alias("version"))
            old = old.join(F.broadcast(newest), ["bucket", "version"]).drop("version")
            touched = fresh.select(bucket.alias("bucket")).distinct()
            fresh = old.join(F.broadcast(touched), "bucket", "left_semi").drop("bucket").unionByName(fresh)
            fresh = latest_state(fresh, key, order).drop("first_seq")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        out = fresh.withColumn("bucket", bucket).withColumn("version", F.lit(number).cast("long"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "bucket").parquet(path)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table_of(result: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a streaming query to the end of its input and return its result table.

    Each batch's result is written as Parquet under ``path``, in parallel and by its number, so a batch that runs
    again replaces its own. In complete mode the last batch is the result, in append mode all are.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:09}")

    query = result.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    out = result.sparkSession.read.option("basePath", path).parquet(f"{path}/batch=*")
    if mode == "complete":
        out = out.where(F.col("batch") == out.agg(F.max("batch")).first()[0])
    return out.drop("batch")


def read_latest(spark, path: str) -> DataFrame:
    """The state that :func:`upsert_latest` keeps."""
    every = spark.read.parquet(path)
    newest = every.groupBy("bucket").agg(F.max("version").alias("version"))
    return every.join(F.broadcast(newest), ["bucket", "version"]).drop("bucket", "version")


def first_holders(events: DataFrame, hash_col: str = "reasoning_hash") -> DataFrame:
    """Only the first event of each hash, across batches. For a bounded state give the stream a watermark first."""
    return events.dropDuplicates([hash_col])


def carried_totals(events: DataFrame, key: str, values: tuple[str, ...], order: str = "event_seq") -> DataFrame:
    """Lifetime totals per key, one output row per event, with keyed state."""
    names = ", ".join(f"lifetime_{v} double" for v in values)

    def step(keys, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        count, *totals = state.get if state.exists else (0, *([0.0] * len(values)))
        for pdf in batches:
            pdf = pdf.sort_values(order)
            rounds = range(count + 1, count + 1 + len(pdf))
            sums = [t + pdf[v].fillna(0).astype(float).cumsum() for v, t in zip(values, totals)]
            count, totals = count + len(pdf), [float(s.iloc[-1]) for s in sums]
            yield pd.DataFrame({key: pdf[key], order: pdf[order], "generation_round": list(rounds), **{f"lifetime_{v}": s for v, s in zip(values, sums)}})
        state.update((count, *totals))

    kind = events.schema[key].dataType.simpleString()
    out = f"{key} {kind}, {order} long, generation_round long, {names}"
    kept = "n long, " + ", ".join(f"s{i} double" for i in range(len(values)))
    return events.groupBy(key).applyInPandasWithState(step, out, kept, "append", "NoTimeout")


# Extensions beyond the batch operators: event-time windows over a stream of events.


def windowed_counts(events: DataFrame, ts: str = "ts", width: str = "1 day", slide: str | None = None, late: str = "1 hour", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Tumbling or sliding window counts with a watermark."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    w = F.window("__ts", width, slide) if slide else F.window("__ts", width)
    return timed.groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour", by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return timed.groupBy(F.session_window("__ts", gap), *by).agg(F.count(F.lit(1)).alias("n"))
