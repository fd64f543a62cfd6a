"""Row numbers in a total order, without a sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import materialize


def number_rows(df: DataFrame, *order: str | Column, into: str = "row_no") -> DataFrame:
    """Adds each row's place, from 0, in the order of ``order`` (nulls first unless a column says otherwise).

    Rows are range-partitioned, sorted within partitions and written once with their partition and place in it;
    how many rows the partitions before hold is then counted from what was written, so both agree. Rows
    alike in ``order`` stand in the order of a hash of the whole row, which also lets a common value span
    partitions.
    """
    ranged = df.withColumn("__tie", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    ranged = ranged.repartitionByRange(*order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
    ranged = materialize(ranged.withColumn("__at", F.monotonically_increasing_id()), "numbered").withColumn("__p", F.shiftright("__at", 33))
    counts = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    # A row per partition.
    before = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))
    place = F.col("__before") + F.col("__at") - F.shiftleft("__p", 33)
    return ranged.join(F.broadcast(before), "__p").withColumn(into, place.cast("long")).drop("__p", "__at", "__before")


def positional_join(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Rows of two tables side by side by their place in either's order; the longer one's rest is left out."""
    a, b = number_rows(left, left_order, into="__place"), number_rows(right, right_order, into="__place")
    return a.join(b, "__place").drop("__place")


def ranking(df: DataFrame, *order: str | Column, into: str = "place") -> DataFrame:
    """Adds the place from 1 in the given order."""
    return number_rows(df, *order, into=into).withColumn(into, F.col(into) + 1)


def position_within(df: DataFrame, by: str, order: str, into: str = "position") -> DataFrame:
    """Adds the place from 1 of each row among those of its group.

    All rows are numbered in the order of group and ``order``, and the group's first number is taken off, so a large
    group spans tasks.
    """
    numbered = number_rows(df, by, order, into=into)
    first = numbered.groupBy(F.col(by).alias("__by")).agg(F.min(into).alias("__first"))
    return numbered.join(first, F.col(by).eqNullSafe(F.col("__by"))).withColumn(into, F.col(into) - F.col("__first") + 1).drop("__by", "__first")
