"""Registered queries of sources, sinks, runs, charts and tracking: tables go out through a sink, come back
through a source, and are the same in SQL."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ..operators import charts, chat, compare, curves, errors, generate, splits, state
from ..policies import RunConfig, SplitSpec, short_hash
from ..scratch import scratch_path
from ..sources import files, logs, sinks
from ..streaming import events as streams
from . import runs
from .catalog import _POINTS, _SPLIT, LOG_SQL, STATE_SQL, big, docs, event_stream, log, points, questions, register, table

_EVENT_SQL = f"with {LOG_SQL}"


def _log_folder(spark, sf: str) -> str:
    path = scratch_path(spark, "log")
    sinks.append_log(log(spark, sf).selectExpr("problem_id", "event_seq as seq", "status", "event_type", "elapsed_seconds"), path)
    return path


_LOG_ROW = "problem_id long, seq long, status string, event_type string, elapsed_seconds double"


@register(f"{_EVENT_SQL} select problem_id, event_seq seq, status, event_type, elapsed_seconds from log")
def a3_b1_log_round_trip(spark, sf):
    """Events appended to a log and read with a tolerance for torn last lines."""
    return logs.read_log(spark, _log_folder(spark, sf), _LOG_ROW).drop("file", "event_seq")


@register("select conv_id, count(*) + max(case when last and role <> 'assistant' then 1 else 0 end) turns from (select *, turn = max(turn) over (partition by conv_id) last from conversations) group by 1")
def a5b_strict_conversations(spark, sf):
    """Conversations as JSON lines, each closed by the assistant, read by the strict scan."""
    c = files.conversations(table(spark, sf, "conversations"))
    fine = F.element_at("messages", -1)["role"] == "assistant"
    c = c.withColumn("messages", F.when(fine, F.col("messages")).otherwise(F.concat("messages", F.array(chat.message("assistant", F.lit("yes"))))))
    path = scratch_path(spark, "conversations")
    c.write.json(path)
    return logs.read_conversations(spark, path, "conv_id long, messages array<struct<role:string,content:string>>").select("conv_id", big(F.size("messages")).alias("turns"))


@register("select event_id, user_id from events where event_id % 7 <> 0")
def a6_lenient_log(spark, sf):
    """Every seventh line is broken and left out."""
    path = scratch_path(spark, "lines")
    line = F.when(F.col("event_id") % 7 == 0, F.lit('{"event_id": 1, "us')).otherwise(F.to_json(F.struct("event_id", "user_id")))
    table(spark, sf, "events").select(line.alias("value")).write.text(path)
    return logs.read_lenient(spark, path, "event_id long, user_id long").select("event_id", "user_id")


@register("select count(*) total, round(avg(value), 6) mean from events")
def a7_b6_document(spark, sf):
    path = f"{scratch_path(spark, 'document')}/metrics.json"
    sinks.write_document(table(spark, sf, "events").agg(F.count(F.lit(1)).alias("total"), F.round(F.avg("value"), 6).alias("mean")), path)
    return files.read_document(spark, path, "total long, mean double", required=("total",))


@register("select c_custkey::varchar c_custkey, c_name, null::varchar missing from customer")
def a8_b8_table(spark, sf):
    path = scratch_path(spark, "table")
    sinks.write_csv(table(spark, sf, "customer"), path, ("c_custkey", "c_name", "missing"))
    return files.read_csv(spark, path)


@register("select 'r' run, 'm' || n_regionkey metric, n_nationkey * 10 ts, n_nationkey / 4.0::double as value, n_nationkey step from nation")
def a9_metric_files(spark, sf):
    """A file of lines for every region's metric; broken lines are left out."""
    path, lines = scratch_path(spark, "metrics"), {}
    for n in table(spark, sf, "nation").orderBy("n_nationkey").collect():
        lines.setdefault(f"m{n.n_regionkey}", ["broken"]).append(f"{n.n_nationkey * 10} {n.n_nationkey / 4} {n.n_nationkey}")
    for name, rows in lines.items():
        sinks.write_text(spark, "\n".join(rows), f"{path}/{name}")
    return files.read_metric_files(spark, path, "r").drop("line_no")


@register("select 'p' || r_regionkey as key, r_name as value from region")
def a10_params(spark, sf):
    path = scratch_path(spark, "params")
    for r in table(spark, sf, "region").collect():
        sinks.write_text(spark, f" {r.r_name}\n", f"{path}/p{r.r_regionkey}")
    return files.read_params(spark, path)


def _checkpoints(spark, sf):
    path = scratch_path(spark, "checkpoints")
    for n in table(spark, sf, "nation").collect():
        sinks.write_text(spark, "x" * (n.n_nationkey + 1), f"{path}/checkpoint-{n.n_nationkey}/weights.bin")
    sinks.write_text(spark, "x", f"{path}/final/weights.bin")
    return files.listing(spark, path)


@register("select 'checkpoint-' || max(n_nationkey) folder, max(n_nationkey) step from nation")
def a11_newest_checkpoint(spark, sf):
    return files.newest_checkpoint(_checkpoints(spark, sf))


@register("select 'checkpoint-' || n_nationkey folder, n_nationkey step from nation order by step")
def g8_checkpoints_in_order(spark, sf):
    return files.checkpoints(_checkpoints(spark, sf))


@register("select (sum(n_nationkey + 1) + 1) / (1024.0 ** 3) size_gib from nation")
def i38_storage(spark, sf):
    return files.size_gib(_checkpoints(spark, sf))


@register("select 'new' run")
def a11_latest_run(spark, sf):
    """Of the runs that hold metrics, the one changed last."""
    listed = spark.createDataFrame(
        [("x/old/metrics/loss", 1), ("x/new/metrics/loss", 3), ("x/old/metrics/score", 2), ("x/none/other/loss", 9)], "path string, at int"
    ).select("path", F.timestamp_seconds("at").alias("modified"))
    return files.latest_run(listed).select(F.element_at(F.split("run", "/"), -1).alias("run"))


@register(f"{_EVENT_SQL} select count(*) good, 1::bigint dropped from log")
def b2_repaired_log(spark, sf):
    """A log whose last line is torn: the good lines are copied, the torn one is counted."""
    torn, into = scratch_path(spark, "torn"), scratch_path(spark, "good")
    good = F.to_json(F.struct("seq", "status"))
    rows = log(spark, sf).select(F.col("event_seq").alias("seq"), "status").withColumn("value", good).select("seq", "value")
    tail = spark.createDataFrame([((1 << 62), '{"seq": 1, "st')], "seq long, value string")
    rows.unionByName(tail).orderBy("seq").coalesce(1).select("value").write.text(torn)
    dropped = sinks.repair_log(spark, torn, "seq long, status string", into)
    return logs.read_plain(spark, into, "seq long, status string").agg(F.count(F.lit(1)).alias("good"), F.lit(dropped).cast("long").alias("dropped"))


@register(f"with {STATE_SQL} select status as name, count(*) n, min(problem_id) lowest from state group by 1 union all select 'sft', count(*), min(problem_id) from state where status = 'accepted'")
def b3_b4_snapshots(spark, sf):
    """Snapshots of the latest state, written twice over each other and read back."""
    path, e = scratch_path(spark, "snapshots"), log(spark, sf)
    sinks.write_snapshots(e.limit(10), path, "parquet")
    sinks.write_snapshots(e, path, "parquet")
    out = None
    for name in ("accepted", "rejected", "sft"):
        part = spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.min("problem_id").alias("lowest"))
        out = part if out is None else out.unionByName(part)
    return out


@register(f"with {STATE_SQL} select status, count(*) n from state group by 1")
def b5_m6_snapshots_of_a_stream(spark, sf):
    path, kept, marks = (scratch_path(spark, n) for n in ("snapshots", "log", "offsets"))
    e = event_stream(spark, sf).select(F.col("user_id").alias("problem_id"), F.col("event_id").alias("event_seq"), F.when(F.col("event_type") == "purchase", "accepted").otherwise("rejected").alias("status"))
    sinks.write_snapshots_every(e, path, marks, kept, "problem_id long, event_seq long, status string", fmt="parquet").awaitTermination()
    rows = spark.read.parquet(f"{path}/accepted").unionByName(spark.read.parquet(f"{path}/rejected"))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register("select true as written, false as again, 'n' as refused")
def b7_manifest(spark, sf):
    path, n = f"{scratch_path(spark, 'manifest')}/run.json", table(spark, sf, "nation").count()
    written, again = (sinks.write_or_verify(spark, {"n": n, "seed": 42}, path) for _ in range(2))
    try:
        sinks.write_or_verify(spark, {"n": n + 1, "seed": 42}, path)
        refused = None
    except ValueError as e:
        refused = str(e).split("'")[1]
    return spark.createDataFrame([(written, again, refused)], "written boolean, again boolean, refused string")


@register("with o as (select l_quantity::bigint + 20 g, (l_orderkey * 5 + l_linenumber) % 9 k from lineitem) select count(*) total, count(*) filter (k = 0) off_by_one, least(count(*) filter (k = 1), 5) unit_examples from o")
def b8_error_report(spark, sf):
    path = scratch_path(spark, "report")
    found = errors.classify(questions(spark, sf)).withColumnRenamed("o", "problem_id").withColumn("event_seq", F.monotonically_increasing_id())
    total = found.count()
    summary = sinks.write_error_report(found, total, "lineitem", path)
    again = sinks.read_json(spark, f"{path}/summary.json")
    assert again == summary and again["wrong_but_valid"] == files.read_csv(spark, f"{path}/labeled.csv").count()
    shown = spark.read.schema("label string").json(f"{path}/examples_by_class").where("label = 'unit_error'").count()
    return spark.createDataFrame([(again["total_predictions"], again["counts"]["off_by_one"], shown)], "total long, off_by_one long, unit_examples long")


@register(f"{_EVENT_SQL} select count(*) n from log")
def b9_back_up(spark, sf):
    copy = sinks.back_up(spark, _log_folder(spark, sf))
    return spark.read.json(copy).agg(F.count(F.lit(1)).alias("n"))


@register(f"with {_POINTS}, n as (select metric, count(*) n, round(sum(value), 4) total from p group by 1) select * from n union all select 'param:seed', 42, null union all select 'artifact', length('a note'), null")
def b10_tracking(spark, sf):
    """Metrics with their steps, a parameter and an artifact of a run, appended and read back."""
    path, p = scratch_path(spark, "tracking"), points(spark, sf).select("run", "metric", F.col("line_no").alias("ts"), "value", "step")
    half = F.col("ts") % 2 == 0
    sinks.append_metrics(p.where(half), f"{path}/metrics")
    sinks.append_metrics(p.where(~half), f"{path}/metrics")
    sinks.append_params(spark, "r", {"seed": 42, "note": None}, f"{path}/params")
    note = sinks.read_text(spark, sinks.append_artifact(spark, "r", "note.txt", "a note", path))
    out = spark.read.parquet(f"{path}/metrics").groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    seed = spark.read.parquet(f"{path}/params").where("key = 'seed'").select(F.concat(F.lit("param:"), "key").alias("metric"), F.col("value").cast("long").alias("n"), F.lit(None).cast("double").alias("total"))
    return out.unionByName(seed).unionByName(spark.createDataFrame([("artifact", len(note), None)], "metric string, n long, total double"))


@register("select count(*) filter (n_nationkey % 5 <> 0) train_examples, count(*) filter (n_nationkey % 5 = 0) val_examples, 42::bigint seed from nation")
def b12_training_manifest(spark, sf):
    path, n = f"{scratch_path(spark, 'training')}/training_manifest.json", table(spark, sf, "nation")
    sinks.write_training_manifest(spark, path, n.where("n_nationkey % 5 <> 0"), n.where("n_nationkey % 5 = 0"), {"seed": 42, "model": "m"})
    return files.read_document(spark, path, "train_examples long, val_examples long, seed long", required=("seed",))


@register(_SPLIT)
def g5_cached_split(spark, sf):
    """Made, then loaded under the same identity; another identity is an error."""
    p = docs(spark, sf).select(F.col("text").alias("question"), F.col("doc_id").alias("source_index"))
    path, made = scratch_path(spark, "split"), {"identity": {"source": "documents"}, "problems": p, "spec": SplitSpec(100, 30)}
    splits.cached_split(spark, path, **made)
    try:
        splits.cached_split(spark, path, **(made | {"identity": {"source": "other"}}))
    except ValueError:
        return splits.cached_split(spark, path, **made).withColumn("position", big(F.col("position")))
    raise AssertionError("another identity must be refused")


_DRAWN = random.Random(42).sample(range(25), 8)


@register(f"select draw::bigint draw, n_nationkey from (values {', '.join(f'({i}, {g})' for i, g in enumerate(_DRAWN))}) v(draw, g) join (select n_nationkey, row_number() over (order by n_nationkey) - 1 g from nation) using (g)")
def g6_seeded_sample(spark, sf):
    return splits.seeded_sample(table(spark, sf, "nation").select("n_nationkey"), 8, "n_nationkey")


@register(f"{_EVENT_SQL}, a as (select distinct problem_id from log where event_seq % 2 = 0), b as (select distinct problem_id from log where event_seq % 3 = 0) select (select count(*) from a) n_records_a, (select count(*) from b) n_records_b, count(*) shared_n, count(*) < least((select count(*) from a), (select count(*) from b)) overlap_warning from a join b using (problem_id)")
def k4_overlap(spark, sf):
    e = log(spark, sf)
    return compare.overlap_of(e.where("event_seq % 2 = 0"), e.where("event_seq % 3 = 0"))


@register("select count(*) n from nation")
def l7_row_count(spark, sf):
    """The count that is asked for passes; another is an error."""
    n = table(spark, sf, "nation")
    try:
        files.require_rows(n, 26, "nation")
    except ValueError:
        return files.require_rows(n, 25, "nation").agg(F.count(F.lit(1)).alias("n"))
    raise AssertionError("a wrong count must be refused")


@register("select '<|assistant|>' || chr(10) as template")
def l4_response_template(spark, sf):
    found = chat.response_template("<|user|>\nhow many?\n<|assistant|>\nMARK\n", "MARK")
    return spark.createDataFrame([(found,)], "template string")


@register("select p_partkey, list_transform(string_split(p_name, ' '), lambda w: length(w)::int) ids from part")
def n4_tokenize(spark, sf):
    def encode():
        return lambda t: [len(w) for w in t.split(" ")]

    return chat.tokenize(table(spark, sf, "part"), "p_name", encode).select("p_partkey", "ids")


@register("select substr(sha256('{\"a\": 1, \"b\": \"x\"}'), 1, 10) as hash, true as stage_left_out, true as seed_counts")
def i33_config_hash(spark, sf):
    a, b, c = (RunConfig(**k).config_hash() for k in ({"stage": "a"}, {"stage": "b"}, {"seed": 1}))
    return spark.createDataFrame([(short_hash({"b": "x", "a": 1}), a == b, a != c)], "hash string, stage_left_out boolean, seed_counts boolean")


def _sums(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("source_index"))
    k = F.col("source_index").cast("string")
    return n.select(F.concat(F.lit("p"), k).alias("problem_id"), "source_index", F.concat(F.lit("what is "), k, F.lit(" + "), k, F.lit("?")).alias("question"), (F.col("source_index") * 2).cast("string").alias("gold_answer"))


def _replying():
    """Right at the first attempt, or at the second for every third problem, never for every fifth, an error for one."""

    def reply(text: str, seed: int) -> str:
        i = int(text.split()[-3])
        attempt = seed - 42 - 100 * i
        if i == 9:
            raise RuntimeError("no answer")
        right = i % 5 != 4 and (i % 3 != 0 or attempt > 1)
        return f"<reasoning>Step 1: we take {i} and add it once.\nStep 2: {i} + {i} = {2 * i} is then the whole sum.</reasoning>\n<final_answer>{2 * i + (not right)}</final_answer>"

    return generate.StubBackend(reply)


@register("""with n as (select n_nationkey i from nation) select 'p' || i problem_id, case when i % 5 = 4 then 'rejected' else 'accepted' end status, case when i % 5 = 4 then 3 when i % 3 = 0 then 2 else 1 end::bigint attempts,
 case when i = 9 then 'server_or_client_error' when i % 5 = 4 then 'wrong_answer' else '' end reasons from n""")
def j7_n1_produce_run(spark, sf):
    out = runs.produce_run(_sums(spark, sf), None, _replying, attempts=3)
    return out.select("problem_id", "status", "attempts", F.array_join("validation_errors", "|").alias("reasons"))


@register("with n as (select n_nationkey i from nation) select 'p' || i problem_id, i % 5 <> 4 and i % 3 <> 0 is_correct, case when i = 9 then 'RuntimeError: no answer' end generation_error from n")
def j8_evaluate_run(spark, sf):
    return runs.evaluate_run(_sums(spark, sf), None, _replying).select("problem_id", "is_correct", "generation_error")


@register(f"with {STATE_SQL} select problem_id, event_seq, event_type from state")
def m5_upserted_state(spark, sf):
    """The latest state kept in a table by a stream, read back."""
    path, marks = scratch_path(spark, "state"), scratch_path(spark, "offsets")
    e = event_stream(spark, sf).select(F.col("user_id").alias("problem_id"), F.col("event_id").alias("event_seq"), "event_type")
    streams.upsert_latest(e, path, marks, buckets=8).awaitTermination()
    return streams.read_latest(spark, path).select("problem_id", "event_seq", "event_type")


@register(f"{_EVENT_SQL} select status, count(*) n, true as resumed from (select status from log qualify row_number() over (partition by problem_id order by event_seq desc) = 1) group by 1")
def m3_resumed_state(spark, sf):
    """The latest state from the first half of a log and then the rest is that of the whole log."""
    e = log(spark, sf).select("problem_id", "event_seq", "status")
    first = state.latest_state(e.where("event_seq % 2 = 0")).drop("first_seq")
    whole = state.latest_state(first.unionByName(e.where("event_seq % 2 = 1")))
    return whole.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.lit(True).alias("resumed"))


@register("select 'r' run, 'loss' metric, n_nationkey line_no, n_nationkey / 2.0::double as value, n_nationkey * 10 step from nation union all select 'r', 'score', n_nationkey, n_nationkey / 4.0, n_nationkey * 10 from nation where n_nationkey % 2 = 0")
def n3_trainer_points(spark, sf):
    row = F.struct((F.col("n_nationkey") * 10).alias("step"), F.lit(1.0).alias("epoch"), (F.col("n_nationkey") / 2).alias("loss"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") / 4).alias("score"))
    states = table(spark, sf, "nation").groupBy(F.lit("r").alias("run")).agg(F.array_sort(F.collect_list(row)).alias("log_history"))
    return curves.trainer_points(states)


@register("select case condition when 'before' then 1 when 'after' then 2 else 3 end place, condition as label, v as value, printf('%.1f%%', v * 100) as text from (values ('before', 0.25::double), ('after', 0.5::double), ('teacher', 0.75::double)) t(condition, v) order by 1")
def b11_accuracy_bars(spark, sf):
    s = spark.createDataFrame([("teacher", 0.75), ("before", 0.25), ("after", 0.5), ("else", 0.1), ("before", None)], "condition string, exact_match_accuracy double")
    out = charts.accuracy_bars(s)
    assert charts.draw_bars(out, "accuracy", 1.0).count("<rect") == 3
    return out


@register("select source label, n::double as value, n / sum(n) over () as share from (select source, count(*) n from documents where source is not null group by 1) order by 2 desc, 1")
def b11_horizontal_bars(spark, sf):
    return charts.horizontal_bars(docs(spark, sf).where("source IS NOT NULL").groupBy(F.col("source").alias("label")).agg(F.count(F.lit(1)).alias("n")))


@register("with g as (select event_type, avg(value) mean, max(value) most from events group by 1) select event_type label, 'mean' series, 0 place, round(mean, 6) as value from g union all select event_type, 'most', 1, round(most, 6) from g order by 1, 3")
def b11_grouped_bars(spark, sf):
    g = table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.max("value").alias("most"))
    return charts.grouped_bars(g, "event_type", ("mean", "most")).withColumn("value", F.round("value", 6))


@register(f"""with {_POINTS}, s as (select metric, step, case when metric = 'click_score' then value / 1000 else value end as value from f where metric in ('view_loss', 'click_score'))
select case when metric = 'view_loss' then 'loss' else 'clicks' end panel, 'r/' || metric series, step, value, case when metric = 'click_score' then round(value - sqrt(value * (1 - value) / 50), 9) end low from s""")
def b11_curve_panels(spark, sf):
    p = points(spark, sf).withColumn("value", F.when(F.col("metric") == "click_score", F.col("value") / 1000).otherwise(F.col("value")))
    out = charts.curve_panels(p, {"view_loss": "loss", "click_score": "clicks"}, ("click_score",), 50)
    return out.select("panel", "series", "step", "value", F.round("low", 9).alias("low"))


@register("select 'http' backend, 'm' model, 'refused' other")
def a12_a13_catalogue_check(spark, sf):
    """A backend whose server lists its models: the configured one passes, another is refused."""

    class Listed(generate.HttpBackend):
        def models(self):
            return ["m", "n"]

    generate.check_model(Listed("m", "http://server/v1"))
    try:
        generate.check_model(Listed("x", "http://server/v1"))
        other = "accepted"
    except ValueError:
        other = "refused"
    made = generate.create_backend("http", model="m", base_url="http://server/v1").metadata()
    return spark.createDataFrame([(made["backend"], made["model"], other)], "backend string, model string, other string")

