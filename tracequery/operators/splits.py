"""Train/validation splits without duplicates, and checks for leakage."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normalized_question
from ..policies import SplitSpec
from ..sources.sinks import read_json, replace_folder, write_json
from .ordering import number_rows

MOST_GROUPS = 5_000_000


def question_groups(problems: DataFrame) -> DataFrame:
    """``norm, source_index``: every distinct normalised question with its first index."""
    return problems.groupBy(normalized_question(F.col("question")).alias("norm")).agg(F.min("source_index").alias("source_index"))


def hash_split(problems: DataFrame, spec: SplitSpec = SplitSpec()) -> DataFrame:
    """``subset, position, source_index``: distinct questions in the order of a seeded hash, the first ``n_train``
    for training and the next ``n_val`` for validation. Only the rows taken are ever sorted in one place."""
    order = F.sha2(F.concat(F.lit(f"{spec.seed}:"), F.col("norm")), 256)
    taken = question_groups(problems).withColumn("h", order).orderBy("h", "norm").limit(spec.n_train + spec.n_val)
    place = taken.withColumn("n", F.row_number().over(Window.orderBy("h", "norm")))
    train = F.col("n") <= spec.n_train
    return place.select(F.when(train, "train").otherwise("val").alias("subset"), F.when(train, F.col("n")).otherwise(F.col("n") - spec.n_train).alias("position"), "source_index")


def seeded_split(problems: DataFrame, spec: SplitSpec = SplitSpec()) -> DataFrame:
    """The same with Python's seeded shuffle, exact to the draw: groups are numbered by their first index,
    the permutation depends on their number only. Raises if there are too few groups, or more than
    ``MOST_GROUPS`` (the permutation is made on the driver)."""
    groups = question_groups(problems)
    n = groups.count()
    if n < spec.n_train + spec.n_val:
        raise ValueError(f"{n} distinct questions are too few for {spec.n_train} + {spec.n_val}")
    if n > MOST_GROUPS:
        raise ValueError("too many questions for a shuffle on the driver; use hash_split")
    order = list(range(n))
    random.Random(spec.seed).shuffle(order)
    chosen = [(g, "train" if i < spec.n_train else "val", i + 1 - (i >= spec.n_train) * spec.n_train) for i, g in enumerate(order[: spec.n_train + spec.n_val])]
    picked = problems.sparkSession.createDataFrame(chosen, "g long, subset string, position int")
    return number_rows(groups, "source_index", into="g").join(picked, "g").select("subset", "position", "source_index")


def cached_split(spark: SparkSession, path: str, identity: dict, problems: DataFrame, spec: SplitSpec, make: Callable[[DataFrame, SplitSpec], DataFrame] = hash_split) -> DataFrame:
    """The split kept at ``path``; made and written there if there is none.

    Its document must name the same ``identity`` (of the source, its fingerprint, the seed and the sizes) and hold
    as many rows as ``spec`` asks for, and the split must be safe; else an error.
    """
    expected = {**identity, "seed": spec.seed, "n_train": spec.n_train, "n_val": spec.n_val}
    document = f"{path.rstrip('/')}.json"
    known = read_json(spark, document)
    if known is None:
        replace_folder(make(problems, spec), path, "parquet")
        write_json(spark, expected, document)
    else:
        for key, value in expected.items():
            if known.get(key) != value:
                raise ValueError(f"the split at {path} was made with {key} {known.get(key)!r}, not {value!r}")
    split = spark.read.parquet(path)
    sizes = {r.subset: r["count"] for r in split.groupBy("subset").count().collect()}
    if (sizes.get("train", 0), sizes.get("val", 0)) != (spec.n_train, spec.n_val):
        raise ValueError(f"the split at {path} holds {sizes}, not {spec.n_train} and {spec.n_val} rows")
    assert_safe(split, problems)
    return split


def seeded_sample(df: DataFrame, k: int, order: str, seed: int = 42) -> DataFrame:
    """``k`` rows (all if there are fewer) by Python's seeded sample of their places in the order of ``order``,
    with their place in the sample as ``draw``. Only the places drawn are made on the driver."""
    numbered = number_rows(df, order, into="__place")
    drawn = random.Random(seed).sample(range(n := numbered.count()), min(k, n))
    places = df.sparkSession.createDataFrame(list(enumerate(drawn)), "draw long, __place long")
    return numbered.join(places, "__place").drop("__place")


def split_violations(split: DataFrame, problems: DataFrame) -> DataFrame:
    """``check, detail`` for everything that makes a split unsafe; no rows if it is safe.

    Checks indices out of range, duplicates within a subset, overlap of the subsets, and normalised
    questions that occur more than once.
    """
    size = problems.agg(F.count(F.lit(1)).alias("n"))
    ranged = split.crossJoin(F.broadcast(size)).where("source_index IS NULL OR source_index < 0 OR source_index >= n")
    parts = [ranged.select(F.lit("out_of_range").alias("check"), F.concat_ws(":", "subset", F.col("source_index").cast("string")).alias("detail"))]
    twice = split.groupBy("subset", "source_index").count().where("count > 1")
    parts.append(twice.select(F.lit("duplicate_index"), F.concat_ws(":", "subset", F.col("source_index").cast("string"))))
    both = split.where("subset = 'train'").select("source_index").intersect(split.where("subset = 'val'").select("source_index"))
    parts.append(both.select(F.lit("overlap"), F.col("source_index").cast("string")))
    asked = split.join(problems.select("source_index", "question"), "source_index").groupBy(normalized_question(F.col("question")).alias("norm")).count().where("count > 1")
    parts.append(asked.select(F.lit("duplicate_question"), F.col("norm")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def assert_safe(split: DataFrame, problems: DataFrame) -> None:
    found = split_violations(split, problems).limit(5).collect()
    if found:
        raise ValueError("unsafe split: " + "; ".join(f"{r.check} {r.detail}" for r in found))


def pilot(split: DataFrame, n_train: int = 10, n_val: int = 5) -> DataFrame:
    """The first positions of either subset."""
    return split.where(((F.col("subset") == "train") & (F.col("position") <= n_train)) | ((F.col("subset") == "val") & (F.col("position") <= n_val)))
