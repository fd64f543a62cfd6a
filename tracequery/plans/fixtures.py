"""Synthetic model outputs over the sample tables, the same rows in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import CANDIDATE, PHRASE, STRICT
from ..operators.grading import grade
from ..policies import FAILURE_REASONS, FORMAT_FAILURES

#: Twelve kinds of output over lineitem; {n} is a line break.
_OUTPUTS = """
select pid, grp, k, cut, err, secs, toks, cast(g as {text}) as gold_answer, case k
 when 0 then concat('<reasoning>{n}', r, '{n}</reasoning>{n}<final_answer>', cast(g as {text}), '</final_answer>')
 when 1 then concat('<reasoning>{n}', r, '{n}</reasoning>{n}<final_answer>', cast(g as {text}), '.0</final_answer>')
 when 2 then concat('<reasoning>{n}', r, '{n}</reasoning>{n}<final_answer>', cast(g+1 as {text}), '</final_answer>')
 when 3 then concat('<reasoning>{n}', r, '{n}</reasoning>{n}<final_answer>$', cast(g as {text}), '</final_answer>')
 when 4 then concat('<reasoning>{n}', r, '{n}<final_answer>', cast(g as {text}), '</final_answer>')
 when 5 then concat(r, ' The answer is ', cast(g as {text}), ' units')
 when 6 then concat('<reasoning></reasoning><final_answer>', cast(g as {text}), '</final_answer>')
 when 7 then concat('<reasoning>', r, '</reasoning><final_answer>', cast(g as {text}), ' or ', cast(g+2 as {text}), '</final_answer>')
 when 8 then concat('<final_answer>', cast(g as {text}), '</final_answer><reasoning>', r, '</reasoning>')
 when 9 then concat('<reasoning>', r, '</reasoning><final_answer>', cast(2*g as {text}), '/2</final_answer>')
 when 10 then concat('<REASONING>', r, '</REASONING><FINAL_ANSWER>', cast(g as {text}), '</FINAL_ANSWER>')
 else 'no idea' end as raw_output, concat('What is ', cast(q as {text}), ' times ', cast(n as {text}), '?') as question
from (select *, concat('Step 1: Take ', cast(q as {text}), ' items.{n}Step 2: ', cast(q as {text}), ' * ', cast(n as {text}), ' = ', cast(g as {text})) r
 from (select cast(l_orderkey*10 + l_linenumber as bigint) pid, l_returnflag grp, cast(l_quantity as int) q, l_linenumber n,
  cast(cast(l_quantity as int)*l_linenumber as int) g, cast((l_orderkey*7 + l_linenumber*3 + cast(l_quantity as int)) % 12 as int) k,
  (l_orderkey % 17) = 0 cut, case when l_orderkey % 23 = 0 then 'Timeout: x' end err, l_extendedprice / 1000 secs, cast(l_quantity as bigint) toks
  from lineitem) b) t
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table whose files give fewer tasks than there are cores, dealt out before costly expressions.

    Larger inputs have splits enough and are read as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _OUTPUTS.format(text="string", n="\\n").replace("from lineitem", "from {lineitem}")
    columns = ("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice")
    return spark.sql(sql, lineitem=spread(table(spark, sf_dir, "lineitem").select(*columns)))


#: DuckDB's literals hold real line breaks.
OUTPUTS_SQL = _OUTPUTS.format(text="varchar", n="\n").strip()


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded outputs with the columns of a prediction. All number forms here are settled in the JVM."""
    out = grade(outputs(spark, sf_dir), truncated="cut", error="err", arrow=False)
    return out.withColumns({"elapsed_seconds": F.col("secs"), "completion_tokens": F.col("toks"), "prompt_tokens": F.col("toks") * 2, "peak_memory_bytes": F.col("toks") * 1048576})


def q(text: str) -> str:
    """A pattern as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


_NORM = "trim(regexp_replace(regexp_replace(trim({}, ' \n'), '[,$€£₹]', '', 'g'), '\\\\boxed\\{{|\\}}', '', 'g'), ' \n')"
_CANDS = f"regexp_extract_all({{}}, {q('(' + CANDIDATE + ')')}, 1)"
_TIDY = r"regexp_replace(regexp_replace({}, '\s+', ' ', 'g'), '\s*/\s*', '/', 'g')"


def _structure(name: str) -> tuple[str, str]:
    o, c = f"len(regexp_extract_all(raw_output, '(?i)<{name}>'))", f"len(regexp_extract_all(raw_output, '(?i)</{name}>'))"
    return o, c


_RO, _RC = _structure("reasoning")
_FO, _FC = _structure("final_answer")

#: The grading rules in SQL, over any relation ``o`` with the columns of the outputs.
GRADE_SQL = f"""
s1 as (select *, {_RO} ro, {_RC} rc, {_FO} fo, {_FC} fc, lower(raw_output) lo,
  case when regexp_matches(raw_output, '(?is)<reasoning>.*?</reasoning>') then trim(regexp_extract(raw_output, '(?is)<reasoning>(.*?)</reasoning>', 1), ' \n') end rtag,
  case when regexp_matches(raw_output, '(?is)<final_answer>.*?</final_answer>') then trim(regexp_extract(raw_output, '(?is)<final_answer>(.*?)</final_answer>', 1), ' \n') end ftag from o),
s2 as (select *, ro = 0 and rc = 0 rmiss, fo = 0 and fc = 0 fmiss,
  not (ro = 0 and rc = 0) and (ro <> 1 or rc <> 1 or instr(lo, '<reasoning>') > instr(lo, '</reasoning>')) rbad,
  not (fo = 0 and fc = 0) and (fo <> 1 or fc <> 1 or instr(lo, '<final_answer>') > instr(lo, '</final_answer>')) fbad,
  {_CANDS.format(_NORM.format('ftag'))} tc,
  case when regexp_matches(raw_output, {q('(?i)' + PHRASE)}) then {_CANDS.format(_NORM.format("regexp_extract(raw_output, " + q('(?i)' + PHRASE) + ", 1)"))} end pc,
  {_CANDS.format(_NORM.format('raw_output'))} rawc,
  regexp_matches(raw_output, {q('(?i)(?:' + CANDIDATE + r')\s+or\s+(?:' + CANDIDATE + ')')}) eor from s1),
s3 as (select *, (not rmiss and not fmiss and not rbad and not fbad and instr(lo, '<final_answer>') < instr(lo, '</reasoning>')) crossed,
  case when ftag is not null then len(tc) > 1 else coalesce(len(pc), 0) > 1 or (coalesce(len(pc), 0) < 1 and eor) end amb from s2),
s4 as (select *, case when amb then null when ftag is not null then {_TIDY.format('tc[1]')} when coalesce(len(pc), 0) = 1 then {_TIDY.format('pc[1]')} else {_TIDY.format('rawc[-1]')} end predicted_answer from s3),
s5 as (select *, predicted_answer is not null found,
  coalesce(case when predicted_answer like '%/%' then try_cast(split_part(predicted_answer, '/', 1) as decimal(18,0)) = try_cast(gold_answer as decimal(18,0)) * try_cast(split_part(predicted_answer, '/', 2) as decimal(18,0))
    else try_cast(predicted_answer as decimal(30,6)) = try_cast(gold_answer as decimal(30,6)) end, false) is_correct from s4),
s6 as (select *, list_filter([
  case when found and not is_correct then 'wrong_answer' end, case when rmiss then 'missing_reasoning_tag' end, case when fmiss then 'missing_final_answer_tag' end,
  case when rbad or crossed then 'malformed_reasoning_tag' end, case when rtag = '' then 'empty_reasoning' end, case when fbad or crossed then 'malformed_final_answer_tag' end,
  case when ftag is not null and not regexp_full_match(ftag, {q(STRICT)}) then 'non_numeric_final_answer' end, case when amb then 'ambiguous_final_answer' end,
  case when not found and not amb then 'no_extractable_answer' end, case when cut then 'truncated_output' end, case when err is not null then 'generation_error' end], lambda x: x is not null) validation_errors from s5),
g as (select *, coalesce(rtag, '') reasoning, case when ftag is not null then 'final_answer_tag' when found then 'fallback' else 'missing' end answer_source, found answer_extracted, cut is_truncated,
  not list_has_any(validation_errors, [{', '.join(map(q, FORMAT_FAILURES))}]) is_valid_format,
  is_correct and not list_has_any(validation_errors, [{', '.join(map(q, FORMAT_FAILURES))}]) is_correct_and_valid,
  secs elapsed_seconds, toks completion_tokens, toks * 2 prompt_tokens, toks * 1048576 peak_memory_bytes from s6)
"""

GRADED_SQL = f"with o as ({OUTPUTS_SQL}), {GRADE_SQL.strip()}"
REASONS_SQL = "(values " + ", ".join(f"({q(r)})" for r in FAILURE_REASONS) + ") as known(reason)"
