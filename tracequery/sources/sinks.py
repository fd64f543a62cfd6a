"""Sinks: append-only logs, snapshots, small documents and tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.errors import class_counts, first_examples
from ..operators.state import latest_state
from ..schemas import SFT_FIELDS
from .logs import read_log


def append_log(events: DataFrame, path: str) -> None:
    """Append events to a log folder. Spark's commit shows files whole or not at all, so no line is torn."""
    events.write.mode("append").json(path, ignoreNullFields=False)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _swap_in(spark: SparkSession, fresh: str, path: str) -> None:
    """Move ``fresh`` to ``path``. What stood there is moved aside first and deleted last, so a crash in between
    leaves it under a name that ends in ``.old``, whole."""
    fs, target = _file_system(spark, path)
    source, aside = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (fresh, f"{path.rstrip('/')}.{uuid.uuid4().hex}.old"))
    there = fs.exists(target)
    if there and not fs.rename(target, aside):
        raise OSError(f"cannot move {path} aside")
    moved = False
    try:
        moved = fs.rename(source, target)
    finally:
        if not moved and there:
            fs.rename(aside, target)
    if not moved:
        raise OSError(f"cannot move {fresh} to {path}")
    if there:
        fs.delete(aside, True)


def replace_folder(df: DataFrame, path: str, file_format: str = "json", files: int | None = None) -> None:
    """Write a folder anew beside the old one and swap it in, through the file system that holds it."""
    fresh = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.format(file_format).save(fresh)
    _swap_in(df.sparkSession, fresh, path)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small document's text from any file system; None if there is none."""
    fs, target = _file_system(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small document in one step on any file system."""
    fresh = f"{path}.{uuid.uuid4().hex}"
    fs, target = _file_system(spark, fresh)
    stream = fs.create(target, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    _swap_in(spark, fresh, path)


def repair_log(spark: SparkSession, path: str, schema: str, into: str) -> int:
    """Copy the good lines of a log with a torn end to ``into``; the number of lines dropped."""
    from .logs import parsed_lines

    good = read_log(spark, path, schema)
    dropped = parsed_lines(spark, path, schema).where("broken").count()
    replace_folder(good.orderBy("file", "event_seq").drop("file", "event_seq"), into)
    return dropped


def write_snapshots(events: DataFrame, path: str, fmt: str = "json") -> None:
    """Accepted, rejected and training rows of a log's latest state, each sorted by id.

    The state is cached for the three writes.
    """
    state = latest_state(events).persist()
    try:
        for name, df in snapshots(state).items():
            replace_folder(df.orderBy("problem_id"), f"{path}/{name}", fmt)
    finally:
        state.unpersist()


def snapshots(state: DataFrame) -> dict[str, DataFrame]:
    accepted = state.where("status = 'accepted'")
    have = [c for c in SFT_FIELDS if c in state.columns]
    return {"accepted": accepted, "rejected": state.where("status = 'rejected'"), "sft": accepted.select(*have)}


def write_snapshots_every(events: DataFrame, path: str, checkpoint: str, log: str, schema: str, every: int = 50, fmt: str = "json") -> StreamingQuery:
    """Append a stream's events to ``log`` and write the snapshots anew whenever ``every`` or more events have come
    since the last time; call :func:`write_snapshots` at the end of a run for the rest.

    A batch's events are a folder of their own in the log, so one that runs again after a crash replaces its
    own, and the events since the last snapshot are those of the batches after the one it was made in.
    """
    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        out = batch.withColumn("batch", F.lit(number).cast("long"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").json(log, ignoreNullFields=False)
        mark = f"{path.rstrip('/')}.mark"
        since = int(read_text(spark, mark) or "-1")
        whole = spark.read.schema(f"{schema}, batch long").json(log)
        if whole.where(F.col("batch") > since).limit(every).count() >= every:
            write_snapshots(whole.drop("batch"), path, fmt)
            write_text(spark, str(number), mark)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_document(row: DataFrame, path: str) -> None:
    """A one-row table as a JSON document, in one step."""
    rows = row.limit(2).toJSON().collect()
    if len(rows) != 1:
        raise ValueError("a document is one row")
    write_json(row.sparkSession, json.loads(rows[0]), path)


def write_json(spark: SparkSession, payload: dict, path: str) -> None:
    write_text(spark, json.dumps(payload, indent=2, ensure_ascii=False, sort_keys=True) + "\n", path)


def read_json(spark: SparkSession, path: str) -> dict | None:
    text = read_text(spark, path)
    return None if text is None else json.loads(text)


def write_or_verify(spark: SparkSession, payload: dict, path: str) -> bool:
    """Write a manifest once; later runs must bring the same one. True if it was written."""
    known = read_json(spark, path)
    if known is None:
        write_json(spark, payload, path)
        return True
    if known != json.loads(json.dumps(payload)):
        keys = sorted(k for k in {*known, *payload} if known.get(k) != payload.get(k))
        raise ValueError(f"{path} differs in {keys}")
    return False


def write_training_manifest(spark: SparkSession, path: str, train: DataFrame, validation: DataFrame, settings: dict) -> dict:
    """What a training run starts from: its settings and the number of examples on either side."""
    payload = {**settings, "train_examples": train.count(), "val_examples": validation.count()}
    write_json(spark, payload, path)
    return payload


#: Columns of the table of classified errors, in the order in which files hold them; fixed values.
ERROR_FIELDS = ("problem_id", "label", "evidence", "gold_answer", "predicted_answer", "completion_tokens", "question")


def write_error_report(labelled: DataFrame, total: int, source: str, path: str, order: str = "event_seq", examples: int = 5) -> dict:
    """Classified errors as JSON lines and as a table, the first examples of each class, and a summary document."""
    spark = labelled.sparkSession
    replace_folder(labelled, f"{path}/labeled.jsonl")
    write_csv(labelled, f"{path}/labeled.csv", ERROR_FIELDS)
    replace_folder(first_examples(labelled, order, examples), f"{path}/examples_by_class", files=1)
    counts = {r.label: r.n for r in class_counts(labelled).collect()}
    summary = {"source_predictions": source, "total_predictions": total, "wrong_but_valid": sum(counts.values()), "counts": counts}
    write_json(spark, summary, f"{path}/summary.json")
    return summary


def write_csv(df: DataFrame, path: str, fields: tuple[str, ...], files: int | None = None) -> None:
    """A table with fixed column order, null as empty, in a folder of as many files as the table has parts; in
    ``files`` of them if that is given, which is for tables of a few rows."""
    cols = [F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields]
    out = df.select(*cols)
    (out.coalesce(files) if files else out).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="", quote='"', escape='"')


def append_metrics(points: DataFrame, path: str) -> None:
    """Append ``run, metric, ts, value, step`` points to a tracking table."""
    points.write.mode("append").partitionBy("run").parquet(path)


def append_params(spark: SparkSession, run: str, params: dict, path: str) -> None:
    """Append a run's parameters to a tracking table, as texts."""
    rows = [(run, k, None if v is None else str(v)) for k, v in sorted(params.items())]
    spark.createDataFrame(rows, "run string, key string, value string").coalesce(1).write.mode("append").partitionBy("run").parquet(path)


def append_artifact(spark: SparkSession, run: str, name: str, text: str, path: str) -> str:
    """Keep a run's document beside its metrics; the place where it is."""
    to = f"{path.rstrip('/')}/run={run}/artifacts/{name}"
    write_text(spark, text, to)
    return to


def back_up(spark: SparkSession, path: str) -> str:
    """Copy a file or folder beside itself before it is changed, through the file system that holds it."""
    to = f"{path.rstrip('/')}.{uuid.uuid4().hex}.bak"
    fs, source = _file_system(spark, path)
    target = spark._jvm.org.apache.hadoop.fs.Path(to)
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, fs, target, False, spark._jsc.hadoopConfiguration()):
        raise OSError(f"cannot copy {path}")
    return to
