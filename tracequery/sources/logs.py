"""JSON-lines sources with the degrees of tolerance that event logs need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import strip

CORRUPT = "_corrupt_record"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, value`` of every line. Whole files are cut into lines, so numbers are those of the file;
    a log of many files should hold files of moderate size."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", "\r\n|\n")).alias("line_no", "value"))


def parsed_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """``file, line_no, value, row, broken`` of every line that is not blank."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = numbered_lines(spark, path).where(F.length(strip(F.col("value"))) > 0)
    parsed = F.from_json("value", kind.add(CORRUPT, "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = rows.withColumn("row", parsed)
    return rows.withColumn("broken", F.col(f"row.{CORRUPT}").isNotNull() | ~F.col("value").rlike(r"(?s)\A\s*\{.*\}\s*\z"))


def _columns(rows: DataFrame) -> DataFrame:
    names = [f for f in rows.schema["row"].dataType.names if f != CORRUPT]
    return rows.select("file", F.col("line_no").cast("long").alias("event_seq"), *[F.col(f"row.{n}").alias(n) for n in names])


def read_log(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of a log whose last line may be torn: a broken last line of a file is dropped, any other is an error.

    ``event_seq`` is the line's number in its file. A missing path gives no rows.
    """
    try:
        rows = parsed_lines(spark, path, schema)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return spark.createDataFrame([], StructType([*StructType.fromDDL("file string, event_seq long").fields, *kind.fields]))
    last = rows.groupBy("file").agg(F.max("line_no").alias("__last"))
    rows = rows.join(last, "file")
    bad = rows.where(F.col("broken") & (F.col("line_no") < F.col("__last"))).select("file", "line_no").limit(1).collect()
    if bad:
        raise ValueError(f"broken line {bad[0].line_no + 1} in {bad[0].file}")
    return _columns(rows.where(~F.col("broken")))


def read_conversations(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict scan: broken lines, conversations that do not end with the assistant and empty files are errors."""
    rows = parsed_lines(spark, path, schema)
    m = F.col("row.messages")
    fine = ~F.col("broken") & F.coalesce((F.size(m) >= 2) & (F.try_element_at(m, F.lit(-1))["role"] == "assistant"), F.lit(False))
    bad = rows.where(~fine).select("file", "line_no").limit(1).collect()
    if bad:
        raise ValueError(f"line {bad[0].line_no + 1} in {bad[0].file} is not a conversation")
    if rows.isEmpty():
        raise ValueError(f"no rows in {path}")
    return _columns(rows)


def read_plain(spark: SparkSession, path: str, schema: str, blank_lines: bool = True) -> DataFrame:
    """Any broken line is an error; blank ones too unless ``blank_lines``."""
    if not blank_lines:
        every = numbered_lines(spark, path)
        ends = every.groupBy("file").agg(F.max("line_no").alias("__last"))
        if not every.join(ends, "file").where((F.length(strip(F.col("value"))) == 0) & (F.col("line_no") < F.col("__last"))).isEmpty():
            raise ValueError(f"blank line in {path}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Broken lines are left out."""
    return _columns(parsed_lines(spark, path, schema).where(~F.col("broken")))


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.length(strip(F.col("value"))) > 0).count()
