"""Documents, tables, metric files, parameters and listings as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import gold_answer, strip
from ..operators.ordering import number_rows
from ..schemas import MESSAGE


def read_table(spark: SparkSession, path: str, version: str | None = None, file_format: str = "parquet") -> DataFrame:
    """A dataset, pinned to a version's folder if one is named."""
    return spark.read.format(file_format).load(f"{path}/{version}" if version else path)


def problems(df: DataFrame, order: str, question: str = "question", answer: str = "answer", prefix: str = "problem", digits: int = 4, limit: int | None = None) -> DataFrame:
    """Problem rows: index in the given order, id with zero-padded index, question, gold answer.

    With a limit only the first rows are kept before numbering, so the order is a top-k and not a sort;
    without one the rows are numbered in parallel (:func:`..operators.ordering.number_rows`).
    """
    rows = df.select(F.col(order).alias("__o"), F.col(question).alias("question"), gold_answer(F.col(answer)).alias("gold_answer"))
    if limit is not None:
        rows = rows.orderBy("__o").limit(limit)
    rows = number_rows(rows, "__o", into="source_index")
    return rows.select(F.format_string(f"{prefix}_%0{digits}d", "source_index").alias("problem_id"), "source_index", "question", "gold_answer")


def require_rows(df: DataFrame, expected: int, what: str = "table") -> DataFrame:
    """The table itself; an error unless it has ``expected`` rows."""
    n = df.count()
    if n != expected:
        raise ValueError(f"{what} has {n} rows, not {expected}")
    return df


def read_document(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ("exact_match_accuracy",)) -> DataFrame:
    """A JSON document as one row; a missing required key is an error."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    for key in required:
        if not df.where(F.col(key).isNull()).isEmpty():
            raise ValueError(f"{path} has no {key}")
    return df


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A table with a header, all columns text."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def read_metric_files(spark: SparkSession, path: str, run: str) -> DataFrame:
    """``run, metric, line_no, ts, value, step`` from files of ``ts value step`` lines, one file per metric;
    shorter lines are left out."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("metric"), "value")
    lines = text.select("metric", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    parts = lines.withColumn("p", F.split(F.trim("line"), r"\s+")).where(F.size("p") >= 3)
    return parts.select(F.lit(run).alias("run"), "metric", F.col("line_no").cast("long").alias("line_no"), F.col("p")[0].cast("long").alias("ts"), F.col("p")[1].cast("double").alias("value"), F.col("p")[2].cast("long").alias("step"))


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """``key, value`` from a folder of one file per key."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("key"), strip(F.col("value")).alias("value"))


def param(params: DataFrame, key: str, default: str) -> str:
    row = params.where(F.col("key") == key).first()
    return row.value if row else default


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, folder, modified, size`` of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def checkpoints(files: DataFrame) -> DataFrame:
    """``folder, step`` of every folder named with a number at its end, in order of the number; others are ignored."""
    return files.select("folder").distinct().withColumn("step", F.regexp_extract("folder", r"-(\d+)$", 1).try_cast("long")).where("step IS NOT NULL").orderBy("step")


def newest_checkpoint(files: DataFrame) -> DataFrame:
    """``folder, step`` of the folder with the greatest number at its end; no row without one."""
    return checkpoints(files).orderBy(F.desc("step")).limit(1)


def latest_run(files: DataFrame, part: str = "metrics") -> DataFrame:
    """``run`` of the run folder changed last, of those that hold a folder ``part``; no row without one."""
    run = F.regexp_extract("path", rf"^(.*/[^/]+)/{part}/[^/]+$", 1)
    runs = files.select(run.alias("run"), "modified").where("run != ''").groupBy("run").agg(F.max("modified").alias("modified"))
    return runs.orderBy(F.desc("modified"), F.desc("run")).limit(1).select("run")


def size_gib(files: DataFrame) -> DataFrame:
    """Total size in GiB; null of no files."""
    return files.agg((F.sum("size") / (1024**3)).alias("size_gib"))


def rows_of(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, messages`` from one row per turn, in order. A conversation's turns are gathered in one cell."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(F.transform(rows, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).cast(f"array<{MESSAGE}>").alias("messages"))
