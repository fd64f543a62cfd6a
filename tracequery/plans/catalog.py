"""Registered queries over the sample tables: each operator applied to a whole table, and the same in SQL.

Names start with the operator's handle. Queries without SQL have none that a database could run on the
tables alone; their tests are in ``tests``.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..operators import chat, compare, curves, errors, fingerprint, metrics, ordering, splits, state
from ..operators.generate import attempt_seed
from ..operators.grading import training_score
from ..operators.validation import falsely_rejected, rescue, student_target, validate
from ..policies import ERROR_CLASSES, SplitSpec
from ..scratch import materialize, scratch_path
from ..sources import files
from ..streaming import events as streams
from .fixtures import GRADED_SQL, OUTPUTS_SQL, REASONS_SQL, graded, outputs, q, spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def log(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as an event log: users are problems, purchases are accepted."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("problem_id"), F.col("event_id").alias("event_seq"), F.when(F.col("event_type") == "purchase", "accepted").otherwise("rejected").alias("status"),
        F.col("event_type"), (F.col("value") > 50).alias("is_correct"), F.col("value").alias("elapsed_seconds"), (F.col("event_id") % 7).alias("attempts"),
        F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 11).alias("prompt_tokens"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 13).alias("completion_tokens"),
    )


LOG_SQL = """log as (select user_id problem_id, event_id event_seq, case when event_type = 'purchase' then 'accepted' else 'rejected' end status, event_type, value > 50 is_correct,
 value elapsed_seconds, event_id % 7 attempts, case when event_id % 5 <> 0 then event_id % 11 end prompt_tokens, case when event_id % 3 <> 0 then event_id % 13 end completion_tokens from events)"""
STATE_SQL = f"{LOG_SQL}, state as (select * from log qualify row_number() over (partition by problem_id order by event_seq desc) = 1)"


def big(c: Column) -> Column:
    return c.cast("long")


def joined(c: Column) -> Column:
    return F.array_join(c, "|")


# --- scans, projections, filters -------------------------------------------------------------------

_PROBLEMS = "select printf('doc_%04d', row_number() over (order by doc_id) - 1) problem_id, row_number() over (order by doc_id) - 1 source_index, replace(nullif(regexp_extract(text, '(\\S+)\\s*$', 1), ''), ',', '') gold_answer from documents"


@register(_PROBLEMS)
def a1_problem_scan(spark, sf):
    return files.problems(docs(spark, sf), "doc_id", "text", "text", prefix="doc").drop("question")


@register(f"select * from ({_PROBLEMS}) order by source_index limit 25")
def a2_limited_scan(spark, sf):
    return files.problems(docs(spark, sf), "doc_id", "text", "text", prefix="doc", limit=25).drop("question")


@register("select event_id, cast(json_extract(props, '$.k') as bigint) k from events")
def a5_json_scan(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.from_json("props", "k long", {"mode": "FAILFAST"})["k"].alias("k"))


@register("select conv_id, count(*) turns, max(case when rn = 1 then role end) last_role from (select *, row_number() over (partition by conv_id order by turn desc) rn from conversations) group by 1")
def a4_conversation_scan(spark, sf):
    c = files.conversations(table(spark, sf, "conversations"))
    return c.select("conv_id", big(F.size("messages")).alias("turns"), F.element_at("messages", -1)["role"].alias("last_role"))


@register("select doc_id, lang, source from documents")
def c1_minimal_projection(spark, sf):
    return docs(spark, sf).select("doc_id", "lang", "source")


@register("select doc_id, 'documents' source_dataset, 'train' source_split, 42::bigint seed, 0.6::double temperature from documents")
def c2_constant_metadata(spark, sf):
    return docs(spark, sf).select("doc_id", F.lit("documents").alias("source_dataset"), F.lit("train").alias("source_split"), big(F.lit(42)).alias("seed"), F.lit(0.6).alias("temperature"))


@register(f"with {STATE_SQL} select status, count(*) n from state group by 1")
def c3_status_filter(spark, sf):
    s = state.latest_state(log(spark, sf))
    return s.where(state.is_accepted()).unionByName(s.where("status = 'rejected'")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register(GRADED_SQL + " select pid, k, predicted_answer from g where not is_correct and is_valid_format and not is_truncated")
def c4_wrong_but_valid(spark, sf):
    return errors.wrong_but_valid(graded(spark, sf)).select("pid", "k", "predicted_answer")


@register(OUTPUTS_SQL.join(["with o as (", ") select pid, k from o where (regexp_matches(raw_output, '\\d\\s*[+\\-*/=×÷]\\s*\\$?\\s*\\d')) and not regexp_matches(raw_output, '\\d\\s*[+\\-*/=×÷]\\s*\\d{9}')"]))
def c5_false_reject_predicate(spark, sf):
    o = outputs(spark, sf).withColumns({"is_correct": F.lit(True), "validation_errors": F.array(F.lit("reasoning_lacks_calculation_detail")), "teacher_reasoning": F.col("raw_output")})
    return o.where(falsely_rejected(strict=r"\d\s*[+\-*/=×÷]\s*\d{9}")).select("pid", "k")


@register("select event_type, count(*) n from events where value > 0 group by 1 having count(*) > 0 order by n desc")
def c6_positive_counts(spark, sf):
    return table(spark, sf, "events").where("value > 0").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).where("n > 0").orderBy(F.desc("n"))


@register(GRADED_SQL + " select grp, count(*) n, round(sum(elapsed_seconds), 2) total_seconds from g where elapsed_seconds >= 0 and not list_contains(validation_errors, 'generation_error') group by 1")
def c7_numeric_guard(spark, sf):
    return graded(spark, sf).withColumn("s", metrics.seconds_of()).where("s IS NOT NULL").groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s"), 2).alias("total_seconds"))


@register(f"with o as ({OUTPUTS_SQL}) select (err is null) done, count(*) n from o group by 1")
def c8_done_or_retry(spark, sf):
    return outputs(spark, sf).groupBy(F.col("err").isNull().alias("done")).agg(F.count(F.lit(1)).alias("n"))


@register("select event_id, coalesce(nullif(case when event_id % 3 = 0 then '' else event_type end, ''), nullif(case when event_id % 2 = 0 then '' else props end, ''), '') chosen from events")
def c9_first_non_empty(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", T.first_present(F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")), F.when(F.col("event_id") % 2 == 0, "").otherwise(F.col("props"))).alias("chosen"))


@register("select doc_id, contains(lower(text), 'tion') has_part, regexp_matches(lower(text), '\\bthe\\b') has_word, regexp_matches(lower(text), 'one|and|les') has_any from documents")
def c12_text_conditions(spark, sf):
    t = F.lower("text")
    return docs(spark, sf).select("doc_id", F.contains(t, F.lit("tion")).alias("has_part"), t.rlike(r"\bthe\b").alias("has_word"), t.rlike("one|and|les").alias("has_any"))


# --- joins -------------------------------------------------------------------------------------------


@register(f"with {STATE_SQL} select problem_id from (select distinct problem_id from log) p where problem_id not in (select problem_id from state where status = 'accepted')")
def d1_pending(spark, sf):
    e = log(spark, sf)
    return state.pending(e.select("problem_id").distinct(), state.latest_state(e), state.is_done())


@register(f"with {STATE_SQL} select problem_id, event_seq from state where problem_id in (select c_custkey from customer where c_nationkey < 12)")
def d2_keep_targets(spark, sf):
    targets = table(spark, sf, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("problem_id"))
    return state.keep_targets(state.latest_state(log(spark, sf)), targets).select("problem_id", "event_seq")


_LIFETIME = f"""with {LOG_SQL}, prior as (select * from (select * from log where event_seq % 2 = 0 qualify row_number() over (partition by problem_id order by event_seq desc) = 1) where status = 'rejected'),
cur as (select * from log where event_seq % 2 = 1 qualify row_number() over (partition by problem_id order by event_seq desc) = 1)
select c.problem_id, case when p.problem_id is null then 1 else 2 end::bigint generation_round, round(c.elapsed_seconds + coalesce(p.elapsed_seconds, 0), 3) lifetime_elapsed_seconds,
 coalesce(p.attempts, 0) + coalesce(c.attempts, 0) lifetime_attempts, nullif(coalesce(p.prompt_tokens, 0) + coalesce(c.prompt_tokens, 0), 0) lifetime_prompt_tokens
from cur c left join prior p using (problem_id)"""


@register(_LIFETIME)
def d3_j5_lifetime_carry(spark, sf):
    e = log(spark, sf).withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    prior, now = (state.latest_state(e.where(F.col("event_seq") % 2 == r)).drop("first_seq") for r in (0, 1))
    out = state.with_lifetime(now, prior)
    return out.select("problem_id", big(F.col("generation_round")).alias("generation_round"), "lifetime_elapsed_seconds", "lifetime_attempts", "lifetime_prompt_tokens")


@register("select doc_id, h is not null and row_number() over (partition by h order by doc_id) > 1 is_duplicate from (select doc_id, sha256(regexp_replace(trim(lower(text), ' \n\t\r'), '\\s+', ' ', 'g')) h from documents)")
def d4_duplicate_hash(spark, sf):
    # Texts are hashed once; the flags need ids and hashes only.
    d = materialize(docs(spark, sf).select("doc_id", T.reasoning_hash(F.col("text")).alias("h")), "hashes")
    return state.flag_duplicates(d, "h", "doc_id").select("doc_id", "is_duplicate")


_PAIRS = f"""with {LOG_SQL}, a as (select * from log where event_seq % 2 = 0 qualify row_number() over (partition by problem_id order by event_seq desc) = 1),
b as (select * from log where event_seq % 2 = 1 qualify row_number() over (partition by problem_id order by event_seq desc) = 1),
pairs as (select a.problem_id, coalesce(a.is_correct, false) a_correct, coalesce(b.is_correct, false) b_correct from a join b using (problem_id))"""


def pairs(spark, sf):
    e = log(spark, sf)
    return compare.paired(e.where("event_seq % 2 = 0"), e.where("event_seq % 2 = 1"))


@register(_PAIRS + " select * from pairs")
def d5_paired_outcomes(spark, sf):
    return pairs(spark, sf)


@register("select o_orderkey source_index, o_custkey problem_id, c_name from orders join customer on o_custkey = c_custkey order by 1")
def d6_dataset_order(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("source_index"), F.col("o_custkey").alias("problem_id"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("problem_id"), "c_name")
    return state.in_dataset_order(o, c)


@register("select count(*) missing from orders where o_custkey not in (select c_custkey from customer)")
def d7_missing_records(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("problem_id"))
    return state.missing_records(o, table(spark, sf, "customer").select(F.col("c_custkey").alias("problem_id"))).agg(F.count(F.lit(1)).alias("missing"))


@register("select doc_id from documents where doc_id % 3 = 0 intersect select doc_id from documents where doc_id % 2 = 0")
def d9_h3_index_overlap(spark, sf):
    d = docs(spark, sf).select("doc_id")
    return state.ids_in_both(d.where("doc_id % 3 = 0"), d.where("doc_id % 2 = 0"), "doc_id")


_ERRORS = GRADED_SQL + """, e as (select pid, unnest(validation_errors) reason from g), b as (select reason, count(*) n from e where pid % 2 = 0 group by 1), a as (select reason, count(*) n from e where pid % 2 = 1 group by 1)
select reason, coalesce(b.n, 0) "before", coalesce(a.n, 0) "after" from b full join a using (reason) order by 2 + 3 desc, reason"""


@register(_ERRORS)
def d10_g7_error_table(spark, sf):
    g = graded(spark, sf).select("pid", "validation_errors")
    return compare.error_table(g.where("pid % 2 = 0"), g.where("pid % 2 = 1"))


@register("with t as (select text, max(doc_id) target from documents group by 1) select d.doc_id, t.target from documents d left join t using (text)")
def d11_target_by_text(spark, sf):
    return state.target_by_text(docs(spark, sf).select("doc_id", "text"), "text", "doc_id").select("doc_id", "target")


_NORM_SQL = r"trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g'))"


@register(f"select sha256({_NORM_SQL}) norm, count(*) n, min(doc_id) first_id from documents group by 1 having count(*) > 1")
def d16_e11_duplicate_questions(spark, sf):
    d = docs(spark, sf).groupBy(F.sha2(T.normalized_question(F.col("text")), 256).alias("norm"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


# --- grading, metrics ---------------------------------------------------------------------------------


@register(GRADED_SQL + " select pid, k, predicted_answer, answer_source, is_correct, is_valid_format, is_correct_and_valid, is_truncated, array_to_string(validation_errors, '|') validation_errors, length(reasoning) reasoning_length from g")
def j2_grade_outputs(spark, sf):
    return graded(spark, sf).select("pid", "k", "predicted_answer", "answer_source", "is_correct", "is_valid_format", "is_correct_and_valid", "is_truncated", joined(F.col("validation_errors")).alias("validation_errors"), big(F.length("reasoning")).alias("reasoning_length"))


_RATE = "round(count(*) filter ({}) / count(*), 6)"


@register(GRADED_SQL + f""" select grp, count(*) total_examples, {_RATE.format('is_correct')} exact_match_accuracy, {_RATE.format('is_valid_format')} valid_format_rate,
 {_RATE.format('answer_extracted')} answer_extraction_success_rate, {_RATE.format('is_correct_and_valid')} correct_and_valid_rate, {_RATE.format('is_truncated')} truncation_rate from g group by 1""")
def e1_rates(spark, sf):
    out = metrics.rates(graded(spark, sf), "grp")
    return out.select("grp", "total_examples", *[F.round(c, 6).alias(c) for c in out.columns if c.endswith(("accuracy", "_rate"))])


@register("select event_type, round(avg(value), 6) mean, round(median(value), 6) median, round(quantile_cont(value, 0.95), 6) p95, count(*) n, sum(event_id % 9) tokens, round(sum(event_id % 9) / sum(value), 6) per_second from events group by 1")
def e2_e3_percentiles_throughput(spark, sf):
    e = table(spark, sf, "events")
    out = metrics.timing(e, F.col("value"), F.col("event_id") % 9, "event_type")
    n = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("event_id") % 9).alias("tokens"))
    return out.join(n, "event_type").select("event_type", F.round("average_inference_seconds", 6).alias("mean"), F.round("median_inference_seconds", 6).alias("median"), F.round("p95_inference_seconds", 6).alias("p95"), "n", "tokens", F.round("completion_tokens_per_second", 6).alias("per_second"))


@register(f"with {LOG_SQL} select problem_id, sum(prompt_tokens)::bigint prompt_tokens, sum(case when event_type = 'none' then 1 end)::bigint none_tokens, max(elapsed_seconds) most from log group by 1")
def e4_e15_optional_sums(spark, sf):
    return log(spark, sf).groupBy("problem_id").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum(F.when(F.col("event_type") == "none", big(F.lit(1)))).alias("none_tokens"), F.max("elapsed_seconds").alias("most"))


@register(GRADED_SQL + f", e as (select unnest(validation_errors) reason from g) select known.reason, count(e.reason) n from {REASONS_SQL} left join e using (reason) group by 1")
def e5_failure_histogram(spark, sf):
    return metrics.tag_histogram(graded(spark, sf))


@register(f"with {LOG_SQL} select l.*, f.first_seq from (select * from log qualify row_number() over (partition by problem_id order by event_seq desc) = 1) l join (select problem_id, min(event_seq) first_seq from log group by 1) f using (problem_id)")
def e6_latest_state(spark, sf):
    return state.latest_state(log(spark, sf))


@register(GRADED_SQL + ", e as (select unnest(validation_errors) reason from g) select reason, count(*) n from e group by 1 order by 2 desc, 1 limit 5")
def e7_g3_top_reasons(spark, sf):
    h = metrics.tag_histogram(graded(spark, sf)).where("n > 0")
    return h.orderBy(F.desc("n"), "reason").limit(5)


_SUBSET = f"""with {LOG_SQL}, t as (select *, sum(attempts) over w lifetime_attempts, sum(elapsed_seconds) over w lifetime_elapsed_seconds, sum(prompt_tokens) over w lifetime_prompt_tokens, sum(completion_tokens) over w lifetime_completion_tokens from log
 window w as (partition by problem_id order by event_seq rows between unbounded preceding and current row)), s as (select * from t qualify row_number() over (partition by problem_id order by event_seq desc) = 1)
select count(*) filter (status = 'accepted') accepted, count(*) filter (status = 'rejected') rejected, sum(lifetime_attempts)::bigint total_attempts, round(sum(lifetime_elapsed_seconds), 2) total_elapsed_seconds,
 sum(lifetime_prompt_tokens)::bigint total_prompt_tokens, sum(lifetime_completion_tokens)::bigint total_completion_tokens, (sum(lifetime_prompt_tokens) + sum(lifetime_completion_tokens))::bigint total_tokens,
 round(sum(lifetime_completion_tokens) / sum(lifetime_elapsed_seconds), 3) completion_tokens_per_second, round(count(*) filter (status = 'accepted') / 2000, 3) acceptance_rate from s"""


@register(_SUBSET)
def e8_subset_metrics(spark, sf):
    t = state.lifetime_totals(log(spark, sf), "problem_id", "event_seq", "attempts", "elapsed_seconds", "prompt_tokens", "completion_tokens")
    out = metrics.subset_metrics(state.latest_state(t), 2000)
    return out.withColumn("total_elapsed_seconds", F.round("total_elapsed_seconds", 2))


@register("select count(distinct user_id) ids, count(*) n from events")
def e9_distinct_ids(spark, sf):
    return metrics.distinct_ids(table(spark, sf, "events"), "user_id")


@register(f"select sha256({_NORM_SQL}) norm, min(doc_id) source_index from documents group by 1")
def e10_question_groups(spark, sf):
    g = splits.question_groups(docs(spark, sf).select(F.col("text").alias("question"), F.col("doc_id").alias("source_index")))
    return g.select(F.sha2("norm", 256).alias("norm"), "source_index")


@register(_PAIRS + " select count(*) filter (a_correct and b_correct) both_correct, count(*) filter (not a_correct and not b_correct) both_wrong, count(*) filter (a_correct and not b_correct) only_a_correct, count(*) filter (not a_correct and b_correct) only_b_correct from pairs")
def e12_contingency(spark, sf):
    return compare.contingency(pairs(spark, sf))


@register(_PAIRS + " select case when not a_correct and b_correct then 'improvement' when a_correct and not b_correct then 'regression' when a_correct then 'same_correct' else 'same_wrong' end transition, count(*) n from pairs group by 1")
def e13_transitions(spark, sf):
    return pairs(spark, sf).groupBy(compare.transition(F.col("a_correct"), F.col("b_correct")).alias("transition")).agg(F.count(F.lit(1)).alias("n"))


_SECS = "case when elapsed_seconds >= 0 and not list_contains(validation_errors, 'generation_error') then elapsed_seconds end"
_DOC = GRADED_SQL + f""" select grp, count(*) total_examples, {_RATE.format('is_correct')} exact_match_accuracy, {_RATE.format("list_contains(validation_errors, 'generation_error')")} generation_error_rate,
 round(avg(completion_tokens), 6) average_completion_tokens, round(median({_SECS}), 6) median_inference_seconds, round(quantile_cont({_SECS}, 0.95), 6) p95_inference_seconds,
 round(sum(completion_tokens) / sum({_SECS}), 6) completion_tokens_per_second, sum(prompt_tokens)::bigint total_prompt_tokens, max(peak_memory_bytes) peak_memory_bytes, count(*) filter (list_contains(validation_errors, 'wrong_answer')) wrong_answers from g group by 1"""


@register(_DOC)
def e14_metrics_document(spark, sf):
    m = metrics.metrics_document(graded(spark, sf), "grp")
    r = ("exact_match_accuracy", "generation_error_rate", "average_completion_tokens", "median_inference_seconds", "p95_inference_seconds", "completion_tokens_per_second")
    return m.select("grp", "total_examples", *[F.round(c, 6).alias(c) for c in r], "total_prompt_tokens", "peak_memory_bytes", F.col("failure_reason_counts")["wrong_answer"].alias("wrong_answers"))


@register(f"with o as ({OUTPUTS_SQL}) select count(*) records, count(distinct pid) unique_ids, count(distinct case when err is null then pid end) error_free_ids, count(err) errors, round(count(distinct pid) * 100.0 / 100000, 6)::double percent_done, greatest(100000 - count(distinct pid), 0) remaining from o")
def e17_progress(spark, sf):
    p = metrics.progress(outputs(spark, sf), 100_000, "pid", "err")
    return p.withColumn("percent_done", F.round("percent_done", 6))


# --- ordered operators, sorts, sets --------------------------------------------------------------------


def points(spark, sf):
    """Metric points: event types are metrics, users are steps, event ids are line numbers."""
    e = table(spark, sf, "events")
    name = F.concat(F.col("event_type"), F.when(F.col("event_type") == "view", "_loss").otherwise("_score"))
    return e.select(F.lit("r").alias("run"), name.alias("metric"), F.col("event_id").alias("line_no"), F.col("value"), F.col("user_id").alias("step"))


_POINTS = "p as (select event_type || case when event_type = 'view' then '_loss' else '_score' end metric, event_id line_no, value, user_id step from events), f as (select metric, step, arg_min(value, line_no) as value from p group by 1, 2)"


@register(f"with {_POINTS} select metric, step, value from f")
def f1_first_per_step(spark, sf):
    return curves.first_per_step(points(spark, sf)).drop("run")


@register(f"with {_POINTS} select metric, arg_max(value, line_no) as value from p group by 1 having count(*) > 1")
def f2_restored_value(spark, sf):
    return curves.restored(points(spark, sf)).drop("run")


@register(f"""with {_POINTS}, lo as (select metric, step, value from f where contains(metric, 'loss') qualify row_number() over (partition by metric order by value, step) = 1),
 hi as (select metric, step, value from f where not contains(metric, 'loss') qualify row_number() over (partition by metric order by value desc, step desc) = 1)
 select metric, step best_step, value best_value from lo union all select * from hi""")
def f3_best_step(spark, sf):
    return curves.best_step(points(spark, sf)).drop("run")


@register("select event_type, round(sqrt(r * (1 - r) / n), 9) band from (select event_type, count(*) filter (value > 50) / count(*) r, count(*) n from events group by 1)")
def f4_error_band(spark, sf):
    r = table(spark, sf, "events").groupBy("event_type").agg((F.count_if(F.col("value") > 50) / F.count(F.lit(1))).alias("r"), F.count(F.lit(1)).alias("n"))
    return r.select("event_type", F.round(curves.error_band(F.col("r"), F.col("n")), 9).alias("band"))


@register("select user_id, event_id, row_number() over (partition by user_id order by event_id) as position from events")
def f5_position(spark, sf):
    return ordering.position_within(table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id")


@register("select source, n, row_number() over (order by n desc, source) as place from (select source, count(*) n from documents group by 1)")
def f6_ranking(spark, sf):
    n = docs(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return ordering.ranking(n, F.desc("n"), "source")


@register("select lang, doc_id from documents qualify row_number() over (partition by lang order by doc_id) <= 3")
def f7_first_k_per_class(spark, sf):
    return errors.first_examples(docs(spark, sf).select(F.col("lang").alias("label"), "doc_id"), "doc_id", 3).select(F.col("label").alias("lang"), "doc_id")


@register("select lang, min(doc_id) doc_id, arg_min(source, doc_id) source from documents group by 1")
def f8_first_match(spark, sf):
    return state.first_match(docs(spark, sf), "lang", "doc_id", "source")


@register(f"with {LOG_SQL} select problem_id, event_seq, row_number() over w generation_round, sum(attempts) over w::bigint lifetime_attempts, sum(completion_tokens) over w::bigint lifetime_completion_tokens from log window w as (partition by problem_id order by event_seq rows between unbounded preceding and current row)")
def f10_lifetime_totals(spark, sf):
    t = state.lifetime_totals(log(spark, sf), "problem_id", "event_seq", "attempts", "completion_tokens")
    return t.select("problem_id", "event_seq", big(F.col("generation_round")).alias("generation_round"), "lifetime_attempts", "lifetime_completion_tokens")


@register("""with a as (select *, event_id attempt, value > 95 is_valid from events), v as (select * from a where is_valid qualify row_number() over (partition by user_id order by attempt) = 1),
 l as (select * from a qualify row_number() over (partition by user_id order by attempt desc) = 1)
 select l.user_id problem_id, coalesce(v.attempt, l.attempt) attempt, c.attempts from l left join v using (user_id) join (select user_id, count(*) attempts from a group by 1) c using (user_id)""")
def f11_j6_chosen_attempt(spark, sf):
    a = table(spark, sf, "events").select(F.col("user_id").alias("problem_id"), F.col("event_id").alias("attempt"), (F.col("value") > 95).alias("is_valid"))
    return state.chosen_attempt(a).select("problem_id", "attempt", "attempts")


@register("select source, doc_id from documents order by source, doc_id")
def g1_sort_by_text(spark, sf):
    return docs(spark, sf).select("source", "doc_id").orderBy("source", "doc_id")


_SPLIT = f"""with g as (select {_NORM_SQL} norm, min(doc_id) source_index from documents group by 1), r as (select source_index, row_number() over (order by sha256('42:' || norm), norm) n from g)
select case when n <= 100 then 'train' else 'val' end subset, case when n <= 100 then n else n - 100 end as position, source_index from r where n <= 130"""


@register(_SPLIT)
def g4_hash_split(spark, sf):
    p = docs(spark, sf).select(F.col("text").alias("question"), F.col("doc_id").alias("source_index"))
    return splits.hash_split(p, SplitSpec(100, 30)).withColumn("position", big(F.col("position")))


def _shuffled(n: int, train: int, val: int) -> str:
    """Rows (group, subset, position) of Python's seeded shuffle of n groups, by a plain loop."""
    order = list(range(n))
    random.Random(42).shuffle(order)
    return ", ".join(f"({g}, '{'train' if i < train else 'val'}', {i + 1 if i < train else i + 1 - train})" for i, g in enumerate(order[: train + val]))


@register(f"with g as (select n_nationkey source_index, row_number() over (order by n_nationkey) - 1 g from nation) select subset, position::int as position, source_index from g join (values {_shuffled(25, 15, 8)}) v(g, subset, position) using (g)")
def g4_seeded_split(spark, sf):
    p = table(spark, sf, "nation").select(F.col("n_name").alias("question"), F.col("n_nationkey").alias("source_index"))
    return splits.seeded_split(p, SplitSpec(15, 8))


@register(f"select * from ({_SPLIT}) where (subset = 'train' and position <= 10) or (subset = 'val' and position <= 5)")
def c10_pilot_slice(spark, sf):
    return splits.pilot(g4_hash_split(spark, sf))


_BAD_SPLIT = """with split as (select 'train' subset, doc_id source_index from documents where doc_id % 2 = 0 union all select 'val', doc_id from documents where doc_id % 3 = 0 union all select 'val', -1)"""


@register(_BAD_SPLIT + f""", n as (select s.subset, s.source_index, sha256({_NORM_SQL}) norm from split s join documents on doc_id = source_index)
select 'out_of_range' "check", 'val:-1' detail union all select 'overlap', doc_id::varchar from documents where doc_id % 6 = 0 union all select 'duplicate_question', norm from n group by norm having count(*) > 1""")
def j10_split_violations(spark, sf):
    d = docs(spark, sf)
    split = d.where("doc_id % 2 = 0").select(F.lit("train").alias("subset"), F.col("doc_id").alias("source_index")).unionByName(d.where("doc_id % 3 = 0").select(F.lit("val").alias("subset"), F.col("doc_id").alias("source_index")))
    split = split.unionByName(split.limit(0).sparkSession.sql("select 'val' subset, cast(-1 as bigint) source_index"))
    found = splits.split_violations(split, d.select(F.col("doc_id").alias("source_index"), F.col("text").alias("question")))
    return found.withColumn("detail", F.when(F.col("check") == "duplicate_question", F.sha2("detail", 256)).otherwise(F.col("detail")))


@register("""select 'a' source_file, c_mktsegment condition, count(*)::varchar model from customer where c_mktsegment < 'F' group by 2 union all
 select 'b', c_mktsegment, count(*)::varchar from customer where c_mktsegment > 'F' group by 2""")
def h1_merge_summaries(spark, sf):
    n = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("condition")).agg(F.count(F.lit(1)).alias("model")).withColumn("row_no", F.col("condition"))
    return compare.merge_summaries([("a", n.where("condition < 'F'")), ("b", n.where("condition > 'F'"))]).select("source_file", "condition", "model")


@register("select distinct user_id id from events where event_type = 'purchase' union select distinct user_id from events where event_type = 'click'")
def h2_union_of_ids(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("id"), "event_type")
    return state.ids_in_either(e.where("event_type = 'purchase'"), e.where("event_type = 'click'"), "id")


# --- text and number functions -------------------------------------------------------------------------

_TAGGED = GRADED_SQL.split("s3 as")[0].rstrip().rstrip(",")


@register(_TAGGED + " select pid, k, rtag, ftag, rmiss, fmiss, rbad or (not rmiss and not fmiss and not rbad and not fbad and instr(lo, '<final_answer>') < instr(lo, '</reasoning>')) rbad from s2")
def i2_i5_tags(spark, sf):
    raw = F.col("raw_output")
    o = outputs(spark, sf).withColumn("s", T.tag_structure(raw))
    return o.select("pid", "k", T.tag(raw, "reasoning").alias("rtag"), T.tag(raw, "final_answer").alias("ftag"), F.col("s.reasoning_missing").alias("rmiss"), F.col("s.final_missing").alias("fmiss"), F.col("s.reasoning_malformed").alias("rbad"))


@register(_TAGGED + f" select pid, k, array_to_string(rawc, '|') found, regexp_replace(regexp_replace(rawc[1], '\\s+', ' ', 'g'), '\\s*/\\s*', '/', 'g') first_number, regexp_replace(regexp_replace(rawc[-1], '\\s+', ' ', 'g'), '\\s*/\\s*', '/', 'g') last_number from s2")
def i6_i9_numbers(spark, sf):
    raw = F.col("raw_output")
    return outputs(spark, sf).select("pid", "k", joined(N.candidates(raw)).alias("found"), N.first_number(raw).alias("first_number"), N.last_number(raw).alias("last_number"))


@register(GRADED_SQL + " select pid, k, predicted_answer, amb from g where ftag is null")
def i10_i11_fallback(spark, sf):
    o = outputs(spark, sf).where(T.tag(F.col("raw_output"), "final_answer").isNull()).withColumn("f", N.committed_answer(F.col("raw_output")))
    return o.select("pid", "k", F.col("f.answer").alias("predicted_answer"), F.col("f.ambiguous").alias("amb"))


@register("""with v as (select p_partkey, (p_partkey % 8)::varchar || '/4' a, ((p_partkey % 8) / 4)::double b, case when p_partkey % 2 = 0 then (p_partkey % 8 * 25)::varchar || '%' else ' ' || (p_partkey % 8)::varchar || '.0 ' end c from part)
 select p_partkey, b = (p_partkey % 4) as frac_equal, case when p_partkey % 2 = 0 then (p_partkey % 8) * 0.25 = (p_partkey % 4) else (p_partkey % 8) = (p_partkey % 4) end other_equal from v""")
def i12_i13_exact_match(spark, sf):
    k = F.col("p_partkey") % 8
    gold = (F.col("p_partkey") % 4).cast("string")
    other = F.when(F.col("p_partkey") % 2 == 0, F.concat((k * 25).cast("string"), F.lit("%"))).otherwise(F.concat(F.lit(" "), k.cast("string"), F.lit(".0 ")))
    return table(spark, sf, "part").select("p_partkey", N.same_number(F.concat(k.cast("string"), F.lit("/4")), gold).alias("frac_equal"), N.same_number(other, gold).alias("other_equal"))


@register(GRADED_SQL + " select pid, k, coalesce(abs(try_cast(replace(replace(ftag, ',', ''), '$', '') as double) - gold_answer::double) < 1e-6, false) correct, contains(raw_output, '<final_answer>') and contains(raw_output, '</final_answer>') and contains(raw_output, '<reasoning>') and contains(raw_output, '</reasoning>') as valid from g")
def i14_i43_l8_training_score(spark, sf):
    return outputs(spark, sf).withColumn("s", training_score(F.col("raw_output"), F.col("gold_answer"))).select("pid", "k", "s.correct", "s.valid")


_EQ = "regexp_extract_all(raw_output, '(-?\\d[\\d,]*(?:\\.\\d+)?)\\s*([+\\-*/x×])\\s*(-?\\d[\\d,]*(?:\\.\\d+)?)\\s*=\\s*(-?\\d[\\d,]*(?:\\.\\d+)?)', {})"


@register(f"with o as ({OUTPUTS_SQL}) select pid, k, len({_EQ.format(0)}) equations, {_EQ.format(4)}[-1]::double last_value, len(list_filter(regexp_extract_all(raw_output, '(?i)Step\\s+\\d+:'), lambda x: true)) steps, array_to_string(regexp_extract_all(question, '-?\\d[\\d,]*(?:\\.\\d+)?'), '|') asked from o")
def i17_i20_equations(spark, sf):
    e = N.equations(F.col("raw_output"))
    return outputs(spark, sf).select("pid", "k", big(F.size(e)).alias("equations"), F.try_element_at(e, F.lit(-1))["c"].alias("last_value"), big(T.named_steps(F.col("raw_output"))).alias("steps"), joined(N.numbers(F.col("question"))).alias("asked"))


@register("""with l as (select doc_id, list_filter(list_transform(string_split_regex(lower(text), '\\r\\n|[\\n\\x0b\\x0c\\r]'), lambda x: regexp_replace(trim(x, ' \t'), '\\s+', ' ', 'g')), lambda x: x <> '') ls,
 list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1~~', 'g'), '~~|\\n+'), lambda x: trim(x, ' \n\t')), lambda x: length(x) >= 12) ss from documents)
 select doc_id, len(ls) n_lines, coalesce(list_max(map_values(list_histogram(ls))) > 3, false) lines_repeat, coalesce(list_max(map_values(list_histogram(list_transform(ss, lambda x: regexp_replace(lower(x), '\\s+', ' ', 'g'))))) > 3, false) sentences_repeat from l""")
def i25_i27_repetition(spark, sf):
    ls = T.lines(F.col("text"))
    return docs(spark, sf).select("doc_id", big(F.size(ls)).alias("n_lines"), T.repeated_more_than(ls, 3).alias("lines_repeat"), T.repeated_more_than(T.sentences(F.col("text")), 3).alias("sentences_repeat"))


@register(f"select doc_id, sha256({_NORM_SQL}) question_hash, sha256(regexp_replace(trim(lower(text), ' \n\t\r'), '\\s+', ' ', 'g')) reasoning_hash from documents")
def i28_i29_hashes(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2(T.normalized_question(F.col("text")), 256).alias("question_hash"), T.reasoning_hash(F.col("text")).alias("reasoning_hash"))


@register("select p_partkey, coalesce(nullif(trim(regexp_replace(p_name || '/' || p_type, '[^A-Za-z0-9._-]+', '_', 'g'), '_'), ''), 'model') slug from part")
def i32_slug(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.slug(F.concat_ws("/", "p_name", "p_type")).alias("slug"))


@register("select sha256(string_agg(doc_id::varchar || ':' || text || chr(10), '' order by doc_id)) fingerprint, count(*) n from documents")
def i34_fingerprint(spark, sf):
    """One chain over all texts, hashed by one task as they stream by; :func:`i34_tree_fingerprint` hashes in all tasks."""
    return fingerprint.fingerprint(docs(spark, sf), F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("text"), F.lit("\n")), "doc_id")


@register("""with l as (select doc_id // 250 leaf, sha256(string_agg(sha256(text), '' order by doc_id)) t from documents where text is not null group by 1)
 select sha256(string_agg(t, '' order by leaf)) fingerprint from l""")
def i34_tree_fingerprint(spark, sf):
    return fingerprint.tree_fingerprint(docs(spark, sf).where("text IS NOT NULL"), F.col("text"), "doc_id", leaf=250)


@register("select doc_id, 42 + doc_id * 100 + 2 seed, length(text) characters, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) words from documents")
def i35_i36_seed_and_counts(spark, sf):
    return docs(spark, sf).select("doc_id", attempt_seed(42, F.col("doc_id"), 2).alias("seed"), big(F.length("text")).alias("characters"), big(T.word_count(F.col("text"))).alias("words"))


@register("select source, printf('%.1f%%', 100.0 * count(*) filter (lang = 'en') / count(*)) share from documents group by 1")
def i40_percent(spark, sf):
    return docs(spark, sf).groupBy("source").agg(T.percent(F.count_if(F.col("lang") == "en") / F.count(F.lit(1))).alias("share"))


@register("""with w as (select page_id, list_distinct(regexp_extract_all(lower(url), '[a-z]{4,}')) t, list_distinct(regexp_extract_all(lower(html), '[a-z]{4,}')) s from pages)
 select page_id, case when len(t) > 0 then round(len(list_intersect(t, s)) / len(t), 6) end overlap from w""")
def i41_lexical_overlap(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.round(T.overlap(F.col("url"), F.col("html")), 6).alias("overlap"))


@register("""with r as (select event_type, count(*) filter (event_id % 2 = 0 and value > 50) / greatest(count(*) filter (event_id % 2 = 0), 1) b, count(*) filter (event_id % 2 = 1 and value > 50) / greatest(count(*) filter (event_id % 2 = 1), 1) a from events group by 1)
 select event_type, round(a - b, 6) absolute_improvement, case when b > 0 then round((a - b) / b, 6) end relative_improvement, round(0.9 - a, 6) gap_to_teacher_accuracy from r""")
def i44_k6_improvement(spark, sf):
    e, even = table(spark, sf, "events"), F.col("event_id") % 2 == 0
    high = F.col("value") > 50
    r = e.groupBy("event_type").agg((F.count_if(even & high) / F.greatest(F.count_if(even), F.lit(1))).alias("b"), (F.count_if(~even & high) / F.greatest(F.count_if(~even), F.lit(1))).alias("a"))
    return r.select("event_type", *[F.round(c, 6).alias(n) for n, c in compare.improvement(F.col("b"), F.col("a"), F.lit(0.9)).items()])


# --- rule engines ----------------------------------------------------------------------------------------


def validated(spark, sf):
    return validate(outputs(spark, sf))


_OUTSIDE = "trim(regexp_replace(regexp_replace(raw_output, '(?is)<reasoning>.*?</reasoning>', '', 'g'), '(?is)<final_answer>.*?</final_answer>', '', 'g'), ' \n')"
_VALID = GRADED_SQL + f""", v as (select *, coalesce(rtag, '') r, {_OUTSIDE} outside, case when ftag is not null then {"regexp_replace(tc[1], '\\s*/\\s*', '/', 'g')"} else coalesce({"regexp_replace(pc[1], '\\s*/\\s*', '/', 'g')"}, {"regexp_replace(rawc[-1], '\\s*/\\s*', '/', 'g')"}) end ans from g),
x as (select *, coalesce(case when ans like '%/%' then split_part(ans, '/', 1)::decimal(18,0) = gold_answer::decimal(18,0) * split_part(ans, '/', 2)::decimal(18,0) else try_cast(ans as decimal(30,6)) = gold_answer::decimal(30,6) end, false) ok,
 len(list_filter(string_split_regex(r, '\\s+'), lambda w: w <> '')) nw, len(regexp_extract_all(r, '(?im)^\\s*(?:step\\s*)?\\d+\\s*[:.)-]')) steps from v)
select pid, k, ans teacher_final_answer, array_to_string(list_filter([case when rbad or crossed then 'duplicate_or_malformed_reasoning_tags' end, case when fbad or crossed then 'duplicate_or_malformed_final_answer_tags' end,
 case when ftag is not null and not regexp_full_match(trim(replace(ftag, '$', '')), {q(N.STRICT)}) then 'non_numeric_text_inside_final_answer_tag' end, case when ftag is null then 'missing_tagged_final_answer' end,
 case when ans is null then 'missing_or_invalid_numeric_answer' end, case when r = '' then 'missing_tagged_reasoning' end, case when r <> '' and (length(r) < 20 or nw < 8) then 'reasoning_too_short' end,
 case when r <> '' and not regexp_matches(r, '\\d\\s*[\\w/%]*\\s*[+\\-*/=×÷]\\s*[$€]?\\s*\\d') then 'reasoning_lacks_calculation_detail' end,
 case when rtag is not null and ftag is not null and length(outside) > 20 then 'significant_text_outside_required_tags' end, case when ans is not null and not ok then 'wrong_answer' end], lambda e: e is not null), '|') validation_errors,
 array_to_string(list_filter([case when steps > 0 and steps not between 2 and 20 then 'step_count_outside_recommended_range' end, case when steps = 0 then 'no_numbered_steps_detected' end, case when outside <> '' then 'text_outside_required_tags' end], lambda e: e is not null), '|') format_warnings,
 steps numbered_step_count, nw reasoning_word_count from x"""


@register(_VALID)
def j1_validate_outputs(spark, sf):
    return validated(spark, sf).select("pid", "k", "teacher_final_answer", joined(F.col("validation_errors")).alias("validation_errors"), joined(F.col("format_warnings")).alias("format_warnings"), big(F.col("numbered_step_count")).alias("numbered_step_count"), big(F.col("reasoning_word_count")).alias("reasoning_word_count"))


def questions(spark, sf):
    """Wrong answers to simple questions, of many kinds."""
    o = spread(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"))
    k = F.pmod(F.col("l_orderkey") * 5 + F.col("l_linenumber"), F.lit(9))
    g = big(F.col("l_quantity")) + 20
    pred = F.when(k == 0, g + 1).when(k == 1, g * 10).when(k == 2, g * 2).when(k == 3, g + 7).when(k == 4, g + 9).when(k == 5, g + 11).when(k == 6, g + 13).when(k == 7, g + 17).otherwise(g)
    steps = F.concat(F.lit("Step 1: take "), g.cast("string"), F.lit("\nStep 2: keep\nStep 3: done"))
    reason = F.when(k == 3, F.concat(F.lit("Step 1: 6 * 7 = 49\nStep 2: a\nStep 3: b"))).when(k == 4, F.lit("Step 1: x")).when(k == 6, F.concat(steps, F.lit("\nStep 4: 111 and 222 and 333"))).when(k == 8, F.concat(F.lit("Step 1: 1 * "), g.cast("string"), F.lit(" = "), g.cast("string"))).otherwise(steps)
    ask = F.when(k == 5, F.concat(F.lit("There are "), g.cast("string"), F.lit(", 61 and 72"))).when(k == 7, F.concat(F.lit("Take "), g.cast("string"), F.lit(" then 1 after"))).otherwise(F.concat(F.lit("Count "), g.cast("string")))
    return o.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), k.alias("k"), ask.alias("question"), reason.alias("reasoning"), g.cast("string").alias("gold_answer"), F.when(k == 8, g + 100).otherwise(pred).cast("string").alias("predicted_answer"))


_CLASSES = """with o as (select l_orderkey o, l_linenumber n, (l_orderkey * 5 + l_linenumber) % 9 k, l_quantity::bigint + 20 g from lineitem)
select o, n, case when k = 3 and g = 49 then 'correct_reasoning_wrong_extraction' else case k when 0 then 'off_by_one' when 1 then 'unit_error' when 2 then 'wrong_operation' when 3 then 'arithmetic_mistake' when 4 then 'premature_answer' when 5 then 'misunderstood_question' when 8 then 'correct_reasoning_wrong_extraction'
 when 6 then 'hallucinated_reasoning' else 'dropped_intermediate_step' end end label from o"""


@register(_CLASSES)
def j3_classify_errors(spark, sf):
    return errors.classify(questions(spark, sf)).select("o", "n", "label")


@register(f"""with c as ({_CLASSES.replace('select o, n, case', 'select o, n, k, g, case')}) select o, n, label, case label when 'correct_reasoning_wrong_extraction' then 'last equation gives ' || g || ', as asked; answered ' || (case k when 3 then g + 7 else g + 100 end)
 when 'off_by_one' then 'answered ' || (g + 1) || ' for ' || g when 'unit_error' then 'answer is 10 times the right one' when 'wrong_operation' then 'answer is 2 times the right one' when 'arithmetic_mistake' then '6*7=49 (gives 42)'
 when 'premature_answer' then '1 steps only' when 'misunderstood_question' then 'numbers of the question not used: ' || array_to_string(list_sort(list_filter([g || ',', '61', '72'], lambda x: x <> g::varchar)), ', ') when 'hallucinated_reasoning' then 'numbers from nowhere: 111, 222, 333'
 else 'a question of many parts, but 0 equations and 3 steps' end evidence from c""")
def j3_error_evidence(spark, sf):
    return errors.classify(questions(spark, sf)).select("o", "n", "label", "evidence")


@register(f"select known.label, count(c.label) n from (values {', '.join(f'({q(c)})' for c in ERROR_CLASSES)}) as known(label) left join ({_CLASSES}) c on c.label = known.label group by 1")
def e16_class_counts(spark, sf):
    return errors.class_counts(errors.classify(questions(spark, sf)))


@register(OUTPUTS_SQL.join(["with o as (", ") select pid, 'accepted' status from o where k in (0, 1, 3, 9, 10)"]))
def j4_rescue(spark, sf):
    o = outputs(spark, sf).withColumns({"is_correct": F.lit(True), "validation_errors": F.array(F.lit("reasoning_lacks_calculation_detail")), "teacher_reasoning": T.tag(F.col("raw_output"), "reasoning")})
    return rescue(o, strict=r"\d\s*[+\-*/=×÷]\s*\d{9}").select("pid", "status")


# --- statistics --------------------------------------------------------------------------------------------


@register(_PAIRS + """, c as (select count(*) filter (a_correct and not b_correct) a, count(*) filter (not a_correct and b_correct) b from pairs)
select a only_a_correct, b only_b_correct, case when a + b < 25 then 'exact_binomial' else 'chi_square_continuity' end as method, case when a + b >= 25 then round(pow(abs(a - b) - 1.0, 2) / (a + b), 9) end statistic from c""")
def k2_mcnemar(spark, sf):
    m = compare.mcnemar(compare.contingency(pairs(spark, sf)))
    return m.select("only_a_correct", "only_b_correct", "method", F.round("statistic", 9).alias("statistic"))


#: The chi-square tail from the series erf(x) = 2/sqrt(pi) exp(-x^2) sum 2^n x^(2n+1) / (2n+1)!!, whose terms are positive.
@register("with recursive " + _PAIRS.removeprefix("with ") + """, c as (select count(*) filter (a_correct and not b_correct) a, count(*) filter (not a_correct and b_correct) b from pairs),
x as (select a, b, a + b n, sqrt(pow(abs(a - b) - 1.0, 2) / greatest(a + b, 1) / 2) x from c),
s as (select 0 i, x term, x total, x from x union all select i + 1, term * 2 * x * x / (2 * i + 3), total + term * 2 * x * x / (2 * i + 3), x from s where i < 300),
mass as (select i, factorial(n::int) / factorial(i::int) / factorial((n - i)::int) * pow(0.5, n) m, i = least(a, b) here from x, lateral (select unnest(range(0, case when n < 25 then n + 1 else 0 end)) i))
select a only_a_correct, b only_b_correct, n discordant, round(case when n = 0 then 1.0 when n < 25 then (select least(sum(m), 1.0) from mass where m <= (select max(m) from mass where here) + 1e-12)
 else 1 - 2 / sqrt(pi()) * exp(-x * x) * (select max(total) from s) end, 9)::double p_value from x""")
def k2_mcnemar_p_value(spark, sf):
    return compare.mcnemar(compare.contingency(pairs(spark, sf))).select("only_a_correct", "only_b_correct", big(F.col("discordant")).alias("discordant"), F.round("p_value", 9).alias("p_value"))


@register("""with t as (select distinct (l_linenumber + 5)::int n, (l_linenumber % 4)::int k from lineitem), m as (select n, k, i, factorial(n::int) / factorial(i::int) / factorial((n - i)::int) * pow(0.5, n) mass from t, lateral (select unnest(range(0, n + 1)) i))
 select a.n::bigint n, a.k::bigint k, round(least(sum(b.mass), 1.0), 9) p from m a join m b on a.n = b.n and a.k = b.k and a.i = a.k and b.mass <= a.mass + 1e-12 group by 1, 2""")
def k3_exact_binomial(spark, sf):
    t = table(spark, sf, "lineitem").select((F.col("l_linenumber") + 5).cast("int").alias("n"), (F.col("l_linenumber") % 4).cast("int").alias("k")).distinct()
    return t.select(big(F.col("n")).alias("n"), big(F.col("k")).alias("k"), F.round(compare.binomial_two_sided(F.col("n"), F.col("k")), 9).alias("p"))


def _resampled(flags: list[bool], resamples: int = 2000) -> tuple[float, float]:
    """The percentile interval of seeded resamples, by a plain loop."""
    rng, n = random.Random(42), len(flags)
    means = sorted(sum(flags[rng.randrange(n)] for _ in range(n)) / n for _ in range(resamples))
    return means[50], means[1949]


@register("select {}::double ci_lower, {}::double ci_upper".format(*_resampled([i % 3 == 0 for i in range(25)])))
def k1_bootstrap_interval(spark, sf):
    e = table(spark, sf, "nation").select((F.col("n_nationkey") % 3 == 0).alias("is_correct"), F.col("n_nationkey").alias("source_index"))
    return compare.bootstrap_interval(e)


@register("with e as (select count(*) n, count(*) filter (c_acctbal > 4000) k from customer) select true as near from e")
def k1_bootstrap_from_counts(spark, sf):
    """The interval from the two counts lies within a tenth of its width of the normal one."""
    e = table(spark, sf, "customer").select((F.col("c_acctbal") > 4000).alias("is_correct"))
    n = e.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("is_correct").cast("int")).alias("p"))
    wide = 1.959964 * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))
    out = compare.bootstrap_large(e).crossJoin(F.broadcast(n))
    return out.select(((F.abs(F.col("ci_lower") - F.col("p") + wide) < 0.2 * wide) & (F.abs(F.col("ci_upper") - F.col("p") - wide) < 0.2 * wide)).alias("near"))


# --- further idioms ------------------------------------------------------------------------------------------


@register("select l_orderkey, l_linenumber, list_distinct(list_filter([l_quantity, l_tax * 100, l_discount * 100], lambda v: abs(v - l_linenumber) > 1e-6 and abs(v - 4) > 1e-6)).len() far from lineitem")
def d14_unmatched_numbers(spark, sf):
    known = F.array(F.col("l_linenumber").cast("double"), F.lit(4.0))
    values = F.array("l_quantity", F.col("l_tax") * 100, F.col("l_discount") * 100)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", big(F.size(N.far_values(values, known))).alias("far"))


@register("select a.o_orderkey, b.c_name from (select o_orderkey, row_number() over (order by o_orderkey) n from orders) a join (select c_name, row_number() over (order by c_custkey) n from customer) b using (n)")
def d8_d12_positional_join(spark, sf):
    left, right = table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "customer").select("c_custkey", "c_name")
    return ordering.positional_join(left, right, "o_orderkey", "c_custkey").select("o_orderkey", "c_name")


@register(f"with o as ({OUTPUTS_SQL}) select pid, k, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(question, '-?\\d[\\d,]*(?:\\.\\d+)?')), lambda x: not list_contains(regexp_extract_all(raw_output, '-?\\d[\\d,]*(?:\\.\\d+)?'), x) and x not in ('1', '2'))), '|') unused from o")
def h4_unused_numbers(spark, sf):
    left = N.unused_numbers(F.col("question"), F.col("raw_output"))
    return outputs(spark, sf).select("pid", "k", joined(F.array_sort(left)).alias("unused"))


@register(GRADED_SQL + ", e as (select pid, unnest(validation_errors) reason from g) select distinct reason from e where pid % 2 = 0 union select distinct reason from e where pid % 2 = 1")
def h5_distinct_reasons(spark, sf):
    g = graded(spark, sf).select("pid", "validation_errors")
    return state.ids_in_either(metrics.distinct_tags(g.where("pid % 2 = 0")), metrics.distinct_tags(g.where("pid % 2 = 1")), "reason")


_ACC = "count(*) filter (is_correct) / count(*)"


@register(GRADED_SQL + f""", b as (select {_ACC} acc, max(peak_memory_bytes) / 1073741824.0 gib from g where pid % 2 = 0), a as (select {_ACC} acc, max(peak_memory_bytes) / 1073741824.0 gib from g where pid % 2 = 1)
select 'before' condition, round(acc, 6) exact_match_accuracy, round(gib, 9)::double peak_cuda_memory_gb, null::double absolute_improvement_over_before, null::double gap_to_teacher_accuracy from b
union all select 'after', round(a.acc, 6), round(a.gib, 9)::double, round(a.acc - b.acc, 6), round(0.9 - a.acc, 6) from a, b""")
def h6_i45_k5_comparison_table(spark, sf):
    from .runs import compare_conditions

    g = graded(spark, sf)
    t = compare_conditions(g.where("pid % 2 = 0"), g.where("pid % 2 = 1"), 0.9)
    return t.select("condition", *[F.round(c, d).alias(c) for c, d in (("exact_match_accuracy", 6), ("peak_cuda_memory_gb", 9), ("absolute_improvement_over_before", 6), ("gap_to_teacher_accuracy", 6))])


@register("select p_partkey, try_cast(replace(replace('1,' || p_size::varchar || '.5', ',', ''), '$', '') as double) as number, p_name like '%q%' has from part")
def i15_lenient_number(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", N.lenient_float(F.concat(F.lit(" $1,"), F.col("p_size").cast("string"), F.lit(".5 "))).alias("number"), F.contains("p_name", F.lit("q")).alias("has"))


@register("select l_orderkey, l_linenumber, l_quantity + l_linenumber plus, l_quantity * l_linenumber times, case when l_linenumber % 3 <> 0 then l_quantity / (l_linenumber % 3) end ratio from lineitem")
def i16_arithmetic(spark, sf):
    def said(op, right):
        return F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(f" {op} "), right.cast("string"), F.lit(" = 0"))

    n = F.col("l_linenumber")
    t = F.concat_ws("; ", said("+", n), said("x", n), said("/", n % 3))
    return table(spark, sf, "lineitem").withColumn("e", N.equations(t)).select("l_orderkey", "l_linenumber", *[F.element_at("e", i)["value"].alias(a) for i, a in ((1, "plus"), (2, "times"), (3, "ratio"))])


@register("select p_partkey, 'Problem:' || chr(10) || p_name as prompt, '<reasoning>' || chr(10) || p_type || chr(10) || '</reasoning>' || chr(10) || '<final_answer>' || p_size::varchar || '</final_answer>' target from part")
def i30_i42_prompt_and_target(spark, sf):
    return table(spark, sf, "part").select("p_partkey", chat.prompt(F.col("p_name"))[1]["content"].alias("prompt"), student_target(F.concat(F.lit(" "), F.col("p_type"), F.lit("\n")), F.col("p_size").cast("string")).alias("target"))


# --- training data -------------------------------------------------------------------------------------------

@register("select p_partkey, '<|system|>' || chr(10) || 'Solve the mathematical problem. Return only the numerical answer inside <final_answer> tags.' || chr(10) || '<|user|>' || chr(10) || 'Problem:' || chr(10) || p_name || chr(10) || '<|assistant|>' || chr(10) || '<final_answer>' || p_size::varchar || '</final_answer>' || chr(10) as text from part")
def l1_l3_render_messages(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("question"), F.col("p_size").cast("string").alias("gold_answer"))
    return chat.build_messages(p, answer_only=True).select("p_partkey", chat.render(F.col("chat")).alias("text"))


@register("""with m as (select conv_id, count(*) n, max(turn) last from conversations group by 1), f as (select m.conv_id, n, c.text, coalesce(c.role = 'assistant' and n >= 2, false) fits from m join conversations c on c.conv_id = m.conv_id and c.turn = m.last)
 select conv_id, fits, case when fits then n - 1 end prompt_messages, case when fits then text end completion from f""")
def l2_prompt_completion(spark, sf):
    """All conversations; those that do not end with the assistant would be an error and are told by ``fits``."""
    c = files.conversations(table(spark, sf, "conversations")).withColumn("fits", chat.ends_with_assistant(F.col("messages")))
    c = c.withColumn("p", F.when(F.col("fits"), chat.prompt_completion(F.col("messages"))))
    return c.select("conv_id", "fits", F.when(F.col("fits"), big(F.size("p.prompt"))).alias("prompt_messages"), F.get("p.completion", F.lit(0))["content"].alias("completion"))


@register("select p_partkey, p_size % 5 + 3 supervised, 3::bigint ignored from (select p_partkey, p_size::bigint p_size from part)")
def l5_e18_label_mask(spark, sf):
    prompt = F.array(F.lit(1), F.lit(2), F.lit(3))
    ids = F.concat(prompt, F.sequence(F.lit(4), F.col("p_size") % 5 + 6))
    kept, ignored = chat.token_counts(F.col("m.labels"))
    return table(spark, sf, "part").withColumn("m", chat.label_mask(prompt, ids, 100)).select("p_partkey", big(kept).alias("supervised"), big(ignored).alias("ignored"))


@register("select p_partkey, (row_number() over (order by p_partkey) - 1) // 4 batch, (ceil(max(p_size) over (partition by b) / 8.0) * 8)::bigint width from (select p_partkey, p_size::bigint p_size, (row_number() over (order by p_partkey) - 1) // 4 b from part)")
def l6_pad_batches(spark, sf):
    ids = F.sequence(F.lit(1), F.col("p_size"))
    p = table(spark, sf, "part").select("p_partkey", ids.alias("input_ids"), F.transform(ids, lambda _: F.lit(1)).alias("attention_mask"), ids.alias("labels"))
    return chat.pad_batches(p, 4, "p_partkey").select("p_partkey", big(F.col("batch")).alias("batch"), big(F.size("labels")).alias("width"))


@register(f"""with {_POINTS}, w as (select metric, step, coalesce(value >= min(value) over (partition by metric order by step rows between unbounded preceding and 1 preceding), false)::int worse from f),
b as (select metric, step, sum(worse) over (partition by metric order by step rows between 1 preceding and current row) = 2 bad from w)
select metric, coalesce(min(step) filter (bad), max(step)) stop_step from b group by 1""")
def l10_early_stop(spark, sf):
    return curves.early_stop(points(spark, sf)).drop("run")


# --- streaming ---------------------------------------------------------------------------------------------


def event_stream(spark, sf) -> DataFrame:
    return spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")


def _stream(spark, sf, build, mode: str) -> DataFrame:
    """Run a streaming query over the events table to its end and return its result table."""
    return streams.table_of(build(event_stream(spark, sf)), scratch_path(spark, "stream"), scratch_path(spark, "offsets"), mode)


@register("select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def m2_latest_state_stream(spark, sf):
    def build(e):
        return streams.latest_state_stream(e.select("user_id", "event_id", "event_type"), "user_id", "event_id")

    return _stream(spark, sf, build, "complete")


@register("select event_type, count(*) n, count(*) filter (value > 50) correct, count(*) filter (value > 50) / count(*) accuracy from events group by 1")
def m4_running_rates_stream(spark, sf):
    def build(e):
        return streams.running_rates(e.withColumn("is_correct", F.col("value") > 50), "event_type")

    return _stream(spark, sf, build, "complete")


@register("select date_trunc('day', ts) as day, event_type, count(*) n from events group by 1, 2")
def x_tumbling_windows_stream(spark, sf):
    def tumbling(e):
        return streams.windowed_counts(e)

    out = _stream(spark, sf, tumbling, "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


from . import catalog_io  # noqa: E402, F401  registers the queries of sources, sinks and runs
