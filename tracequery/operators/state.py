"""Event logs: latest state, resume, retries, lifetime totals, duplicates, attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_state(events: DataFrame, key: str = "problem_id", order: str = "event_seq") -> DataFrame:
    """The last event of every key with ``first_seq``, the place of its first one; rows without a key go.

    A partially aggregated maximum, so a key with many events does not gather them anywhere.
    """
    row = F.struct(*[F.col(c) for c in events.columns])
    out = events.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max_by(row, F.col(order)).alias("r"), F.min(order).alias("first_seq"))
    return out.select("r.*", "first_seq")


def pending(problems: DataFrame, state: DataFrame, done: Column, key: str = "problem_id") -> DataFrame:
    """Problems whose latest state does not satisfy ``done``. Joined before anything costly runs."""
    return problems.join(state.where(done).select(key), key, "left_anti")


def is_accepted() -> Column:
    return F.col("status") == "accepted"


def is_done(retry_rejected: bool = True) -> Column:
    """Accepted rows are never done again; rejected ones only if asked for."""
    return is_accepted() if retry_rejected else F.col("status").isin("accepted", "rejected")


def keep_targets(state: DataFrame, problems: DataFrame, key: str = "problem_id") -> DataFrame:
    return state.join(problems.select(key), key, "left_semi")


def missing_records(problems: DataFrame, records: DataFrame, key: str = "problem_id") -> DataFrame:
    """Problems without a record."""
    return problems.join(records.select(key), key, "left_anti")


def ids_in_both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def ids_in_either(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def first_match(df: DataFrame, by: str, order: str, *values: str) -> DataFrame:
    """The least ``order`` of every group, and the values of the row that has it."""
    return df.groupBy(by).agg(F.min(order).alias(order), *[F.min_by(v, order).alias(v) for v in values])


def target_by_text(df: DataFrame, text: str, target: str, into: str = "target") -> DataFrame:
    """Adds the greatest target among the rows of equal text, null for null texts. Texts are told apart by their
    SHA-256, so no text is shuffled; the greatest per text is a partially aggregated maximum."""
    keyed = df.withColumn("__h", F.sha2(text, 256))
    last = keyed.where("__h IS NOT NULL").groupBy("__h").agg(F.max(target).alias(into))
    return keyed.join(last, "__h", "left").drop("__h")


def in_dataset_order(problems: DataFrame, records: DataFrame, key: str = "problem_id", order: str = "source_index", strict: bool = False) -> DataFrame:
    """Records of the problems in dataset order. With ``strict`` a problem without a record is an error."""
    if strict and not missing_records(problems, records, key).isEmpty():
        raise ValueError("some problems have no record")
    own = [c for c in records.columns if c == key or c not in problems.columns]
    return problems.join(records.select(*own), key).orderBy(order)


def with_lifetime(records: DataFrame, prior: DataFrame, key: str = "problem_id") -> DataFrame:
    """Adds generation_round and lifetime totals: those of the prior record count only if it was rejected.
    Token totals of zero are null."""
    totals = ("attempts", "prompt_tokens", "completion_tokens", "total_tokens")

    def own(name: str) -> Column:
        return F.coalesce(f"lifetime_{name}", name) if f"lifetime_{name}" in prior.columns else F.col(name)

    rounds = F.coalesce("generation_round", F.lit(1)) if "generation_round" in prior.columns else F.lit(1)
    before = prior.where(F.col("status") == "rejected").select(key, rounds.alias("__round"), own("elapsed_seconds").alias("__elapsed_seconds"), *[own(c).alias(f"__{c}") for c in totals])
    out = records.join(before, key, "left")
    out = out.withColumn("generation_round", F.coalesce(F.col("__round") + 1, F.lit(1)))
    out = out.withColumn("lifetime_elapsed_seconds", F.round(F.coalesce("__elapsed_seconds", F.lit(0.0)) + F.coalesce("elapsed_seconds", F.lit(0.0)), 3))
    for c in totals:
        total = F.coalesce(F.col(f"__{c}"), F.lit(0)) + F.coalesce(c, F.lit(0))
        out = out.withColumn(f"lifetime_{c}", total if c == "attempts" else F.when(total > 0, total))
    return out.drop("__round", "__elapsed_seconds", *[f"__{c}" for c in totals])


def lifetime_totals(events: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """Running totals of ``values`` over the events of each key, with the round's number."""
    w = Window.partitionBy(key).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumns({"generation_round": F.row_number().over(w), **{f"lifetime_{v}": F.sum(v).over(upto) for v in values}})


def flag_duplicates(df: DataFrame, hash_col: str, *order: str) -> DataFrame:
    """Adds ``is_duplicate``: an earlier row in the order has the same hash; null hashes never repeat.

    The first holder is a partially aggregated minimum joined back, so a common hash does not meet in one task.
    """
    place = F.struct(*[F.col(c) for c in order])
    first = df.where(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("__h")).agg(F.min(place).alias("__first"))
    out = df.join(first, F.col(hash_col) == F.col("__h"), "left")
    return out.withColumn("is_duplicate", F.coalesce(place > F.col("__first"), F.lit(False))).drop("__h", "__first")


def chosen_attempt(attempts: DataFrame, key: str = "problem_id", order: str = "attempt", valid: str = "is_valid") -> DataFrame:
    """The first valid attempt of every key, else the last one, with usage summed over all attempts."""
    row = F.struct(*[F.col(c) for c in attempts.columns])
    sums = [F.sum(c).alias(f"total_{c}") for c in ("elapsed_seconds", "prompt_tokens", "completion_tokens") if c in attempts.columns]
    out = attempts.groupBy(F.col(key).alias("__key")).agg(
        F.min_by(row, F.when(F.col(valid), F.col(order))).alias("good"), F.max_by(row, F.col(order)).alias("last"), F.count(F.lit(1)).alias("attempts"), *sums
    )
    return out.select(F.coalesce("good", "last").alias("r"), "attempts", *[f"total_{c}" for c in ("elapsed_seconds", "prompt_tokens", "completion_tokens") if c in attempts.columns]).select("r.*", "attempts", *[c for c in out.columns if c.startswith("total_")])
