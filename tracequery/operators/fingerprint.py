"""Ordered fingerprints of tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def _hash_in_order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    h, n = hashlib.sha256(), 0
    for batch in batches:
        n += batch.num_rows
        for t in batch.column(0):
            h.update(t.as_buffer())
    yield pa.RecordBatch.from_pylist([{"fingerprint": h.hexdigest(), "n": n}])


def fingerprint(df: DataFrame, text: Column, order: str) -> DataFrame:
    """SHA-256 over the rows' texts in order (of equal ``order`` in order of text; null texts add nothing), for tables of any size.

    A SHA-256 is one chain, so one task hashes, but it holds no more than a batch: rows reach it through a sort
    that spills. :func:`tree_fingerprint` hashes in all tasks.
    """
    rows = df.select(F.col(order).alias("o"), F.coalesce(text.cast("string").cast("binary"), F.lit(b"")).alias("t"))
    rows = rows.repartition(1).sortWithinPartitions("o", "t").select("t")
    got = rows.mapInArrow(_hash_in_order, "fingerprint string, n long")
    # An empty table may have no task at all.
    empty = F.lit(hashlib.sha256().hexdigest())
    return got.agg(F.coalesce(F.max("fingerprint"), empty).alias("fingerprint"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


def tree_fingerprint(df: DataFrame, text: Column, order: str, leaf: int = 100_000) -> DataFrame:
    """SHA-256 over the hashes of runs of ``leaf`` values of ``order``, for tables of any size: a leaf gathers
    row hashes only, and the root gathers one hash per leaf."""
    rows = df.select(F.floor(F.col(order) / leaf).alias("leaf"), F.col(order).alias("o"), F.sha2(text, 256).alias("t"))
    leaves = rows.groupBy("leaf").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda r: r["t"]), ""), 256).alias("t"))
    return fingerprint(leaves, F.col("t"), "leaf").select("fingerprint")


def python_json(df: DataFrame, columns: list[str], into: str = "json") -> DataFrame:
    """Adds each row as Python writes it with sorted keys and ASCII escapes, nulls included."""
    schema = StructType([*df.schema.fields, StructField(into, StringType())])
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            clean = pdf[columns].astype(object).where(pdf[columns].notna(), None)
            yield pdf.assign(**{into: [json.dumps(dict(zip(columns, r)), sort_keys=True) for r in clean.itertuples(index=False)]})[[*names, into]]

    return df.mapInPandas(run, schema)


def of_rows(rows: list[dict]) -> str:
    """The fingerprint that :func:`fingerprint` gives over :func:`python_json`, for small lists."""
    h = hashlib.sha256()
    for r in rows:
        h.update(json.dumps(r, sort_keys=True).encode())
    return h.hexdigest()
