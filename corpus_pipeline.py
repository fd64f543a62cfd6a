"""A corpus pipeline of five training-data operators.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracequery import scratch
from tracequery.llm import decontamination, mixing, simhash, token_output, toxicity
from tracequery.llm.common import materialize
from tracequery.llm.queries import TOKENIZER, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. Null and empty texts are scored like a clean one and stay; an
    empty table stays empty; without labels all stay."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies (five-word shingles, similarity 0.8 and more) the document of smallest id stays.
    Null, empty and blank texts are copies of one another; an empty table stays empty."""
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go. Null and empty texts have none and stay; empty tables are fine."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated so that sources meet their target weights. Texts without words have size 0 and are taken
    like the others of their source; an empty table stays empty."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids are written in directly addressable codes; a digest per document is returned. Null texts are empty and
    have their end mark only; an empty table gives no rows."""
    return token_output.token_output(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: Learned models, near-duplicate classes, alignment and tokenization have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again in the shared scratch folder.

    A stage's own tables are deleted once its result is written, its result once the next one's is; the token
    files and the digest of the last stage stay.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch.recorded() as made:
            docs = materialize(stage(spark, docs, sf_dir), name)
        last = name == STAGES[-1][0]
        scratch.remove(spark, before if last else [*before, *made[:-1]])
        before = made[-1:]
    return docs
