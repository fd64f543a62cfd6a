"""Chat messages, templates, label masks and padded batches for fine-tuning."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..policies import ANSWER_ONLY_PROMPT, SYSTEM_PROMPT, USER_PREFIX
from .ordering import number_rows
from .validation import student_target

IGNORED = -100


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def prompt(question: Column, system: str = SYSTEM_PROMPT) -> Column:
    return F.array(message("system", F.lit(system)), message("user", F.concat(F.lit(USER_PREFIX), question)))


def last_assistant(messages: Column) -> Column:
    """Content of the last assistant message that has any; null without one."""
    own = F.filter(messages, lambda m: (m["role"] == "assistant") & T.present(m["content"]))
    return F.try_element_at(own, F.lit(-1))["content"]


def fields(df: DataFrame) -> DataFrame:
    """Adds ``q, r, a, target`` from whatever of the known columns a row has; tag text wins over columns."""
    have = set(df.columns)

    def any_of(*names: str) -> list[Column]:
        return [F.col(n).cast("string") for n in names if n in have]

    target = T.first_present(*any_of("student_target"), *([last_assistant(F.col("messages"))] if "messages" in have else []))
    out = df.withColumn("target", target)
    tagged_r, tagged_a = T.tag(F.col("target"), "reasoning"), T.tag(F.col("target"), "final_answer")
    answer = F.coalesce(tagged_a, T.first_present(*any_of("teacher_final_answer", "gold_answer", "answer")))
    return out.withColumns({
        "q": T.strip(T.first_present(*any_of("question"))),
        "r": T.strip(T.first_present(tagged_r, *any_of("reasoning", "teacher_reasoning"))),
        "a": T.strip(T.first_present(answer, *any_of("answer"))),
    })


def build_messages(df: DataFrame, answer_only: bool = False) -> DataFrame:
    """Adds ``chat``: system and user message made anew, and the training target as the assistant's."""
    out = fields(df)
    if answer_only:
        said = F.concat(F.lit("<final_answer>"), F.col("a"), F.lit("</final_answer>"))
    else:
        said = T.first_present(F.col("target"), student_target(F.col("r"), F.col("a")))
    system = ANSWER_ONLY_PROMPT if answer_only else SYSTEM_PROMPT
    return out.withColumn("chat", F.concat(prompt(F.col("q"), system), F.array(message("assistant", said)))).drop("q", "r", "a", "target")


def ends_with_assistant(messages: Column) -> Column:
    """Two messages or more, the last of them the assistant's."""
    return F.coalesce((F.size(messages) >= 2) & (F.try_element_at(messages, F.lit(-1))["role"] == "assistant"), F.lit(False))


def prompt_completion(messages: Column) -> Column:
    """Struct (prompt, completion): all messages but the last, and the last. Fewer than two messages, or a last
    one that is not the assistant's, is an error."""
    n = F.size(messages)
    checked = F.when(ends_with_assistant(messages), messages).otherwise(F.raise_error(F.lit("a conversation must end with an assistant message")).cast("array<struct<role:string,content:string>>"))
    return F.struct(F.slice(checked, F.lit(1), n - 1).alias("prompt"), F.slice(checked, F.lit(-1), F.lit(1)).alias("completion"))


def render(messages: Column, head: str = "<|{role}|>\n", tail: str = "\n") -> Column:
    """A conversation as one text by a template for the head of a message and what follows it."""
    before, after = head.split("{role}")
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit(before), m["role"], F.lit(after), m["content"], F.lit(tail))), "")


def response_template(rendered: str, marker: str) -> str:
    """The text between the end of a prompt and the start of a marked response: what a collator looks for."""
    at = rendered.rindex(marker)
    return rendered[rendered.rfind("\n", 0, max(at - 1, 0)) + 1 : at]


def label_mask(prompt_ids: Column, ids: Column, longest: int | None = None) -> Column:
    """Struct (input_ids, attention_mask, labels): prompt tokens are ignored. Ids that do not start with the
    prompt's, or are more than ``longest``, are an error."""
    n, k = F.size(ids), F.size(prompt_ids)
    fine = F.slice(ids, F.lit(1), k) == prompt_ids
    if longest is not None:
        fine = fine & (n <= longest)
    checked = F.when(fine, ids).otherwise(F.raise_error(F.lit("tokens must start with the prompt's and fit the length")).cast("array<int>"))
    labels = F.concat(F.array_repeat(F.lit(IGNORED), k), F.slice(checked, k + 1, F.greatest(n - k, F.lit(0))))
    return F.struct(checked.alias("input_ids"), F.array_repeat(F.lit(1), n).alias("attention_mask"), labels.alias("labels"))


def token_counts(labels: Column) -> tuple[Column, Column]:
    """Supervised and ignored tokens of a row."""
    kept = F.size(F.filter(labels, lambda x: x != IGNORED))
    return kept, F.size(labels) - kept


def pad_batches(df: DataFrame, batch: int, order: str, multiple: int = 8, pad: int = 0) -> DataFrame:
    """Pads ids, mask and labels to the longest row of each batch, rounded up to ``multiple``.

    Rows are numbered by :func:`.ordering.number_rows`, without a sort in one task.
    """
    out = number_rows(df, order, into="__i").withColumn("batch", F.floor(F.col("__i") / batch))
    most = F.max(F.size("input_ids")).over(Window.partitionBy("batch"))
    out = out.withColumn("width", (F.ceil(most / multiple) * multiple).cast("int"))

    def padded(name: str, fill: int) -> Column:
        return F.concat(name, F.array_repeat(F.lit(fill), F.col("width") - F.size(name)))

    return out.withColumns({"input_ids": padded("input_ids", pad), "attention_mask": padded("attention_mask", 0), "labels": padded("labels", IGNORED)}).drop("__i")


def tokenize(df: DataFrame, column: str, encode: Callable[[], Callable[[str], list[int]]], into: str = "ids") -> DataFrame:
    """Adds token ids from a pluggable tokenizer; ``encode`` makes it once per worker."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = encode()
        for s in batches:
            yield s.map(lambda t: None if t is None else f(t))

    return df.withColumn(into, ids(F.col(column)))
