"""Statistics, state, curves, chat, logs, generation, streaming."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tracequery import cli, scratch
from tracequery.operators import chat, compare, curves, fingerprint, generate, metrics, ordering, splits, state
from tracequery.plans import runs
from tracequery.policies import RunConfig, SplitSpec, slugify
from tracequery.sources import files, logs, sinks
from tracequery.streaming import events as streams

GOLDENS = [
    ((421, 486, 163, 249), 17.53640776699029, 2.8185843826715135e-05),
    ((653, 85, 17, 564), 513.1084337349398, 1.3363261781496787e-113),
    ((396, 496, 282, 145), 43.31615925058548, 4.6572146252274757e-11),
    ((524, 85, 17, 693), 641.7253521126761, 1.4083210114921044e-141),
    ((893, 177, 92, 157), 16.449799196787147, 4.995547314228688e-05),
    ((5, 5, 0, 0), None, 1.0), ((5, 5, 1, 3), None, 0.625), ((5, 5, 0, 5), None, 0.0625), ((0, 0, 12, 12), None, 1.0),
]


def test_mcnemar_goldens(spark):
    rows = [(i, *c) for i, (c, _, _) in enumerate(GOLDENS)]
    df = spark.createDataFrame(rows, "i int, both_correct long, both_wrong long, only_a_correct long, only_b_correct long")
    for r in compare.mcnemar(df).collect():
        _, chi, p = GOLDENS[r.i]
        assert r.statistic == chi and r.p_value == pytest.approx(p, rel=1e-12)
        assert r.method == ("chi_square_continuity" if chi else "exact_binomial")


def test_improvement_and_summary(spark):
    df = spark.createDataFrame([(0.7467778620166793, 0.796057619408643, 0.9226686884003032)], "b double, a double, t double")
    r = df.select(*[c.alias(n) for n, c in compare.improvement(F.col("b"), F.col("a"), F.col("t")).items()]).first()
    assert tuple(r) == pytest.approx((0.04927975739196366, 0.06598984771573611, 0.1266110689916603), rel=1e-12)
    s = compare.summary_rows(spark.createDataFrame([("x", 2094773760)], "condition string, peak_memory_bytes long")).first()
    assert s.peak_cuda_memory_gb == 1.9509100914001465 and len(s) == 18


def test_bootstrap_equals_the_plain_loop(spark):
    y = [i % 3 == 0 for i in range(60)]
    df = spark.createDataFrame(list(enumerate(y)), "source_index long, is_correct boolean")
    rng = random.Random(42)
    means = sorted(sum(y[rng.randrange(60)] for _ in range(60)) / 60 for _ in range(2000))
    assert tuple(compare.bootstrap_interval(df).first()) == (means[50], means[1949])
    low, high = compare.bootstrap_large(df).first()
    assert abs(low - means[50]) < 0.05 and abs(high - means[1949]) < 0.05


def test_percentiles(spark):
    def of(values):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        r = metrics.timing(df, F.col("v"), F.lit(1)).first()
        return r.p95_inference_seconds, r.median_inference_seconds

    assert of([1.0, 2.0, 3.0, 10.0]) == (pytest.approx(8.95), 2.5) and of([]) == (None, None) and of([7.0]) == (7.0, 7.0)


def test_lifetime_and_duplicates(spark):
    cols = "problem_id string, status string, attempts long, elapsed_seconds double, prompt_tokens long, completion_tokens long, total_tokens long"
    prior = spark.createDataFrame([("a", "rejected", 3, 1.5, 10, None, 10), ("b", "accepted", 1, 1.0, 5, 5, 10)], cols)
    now = spark.createDataFrame([("a", "accepted", 1, 0.5, 1, None, 1), ("b", "accepted", 2, 1.0, 1, 1, 2), ("c", "rejected", 1, None, None, None, None)], cols)
    got = {r.problem_id: r for r in state.with_lifetime(now, prior).collect()}
    assert (got["a"].generation_round, got["a"].lifetime_attempts, got["a"].lifetime_elapsed_seconds, got["a"].lifetime_prompt_tokens, got["a"].lifetime_completion_tokens) == (2, 4, 2.0, 11, None)
    assert got["b"].generation_round == 1 and got["b"].lifetime_attempts == 2 and got["c"].lifetime_total_tokens is None
    df = spark.createDataFrame([("train", 1, "h"), ("val", 0, "h"), ("train", 2, "h"), ("val", 1, None)], "subset string, position int, hash string")
    flags = {(r.subset, r.position): r.is_duplicate for r in state.flag_duplicates(df, "hash", "subset", "position").collect()}
    assert flags == {("train", 1): False, ("train", 2): True, ("val", 0): True, ("val", 1): False}


def test_splits(spark):
    df = spark.createDataFrame([(i, f"Question {i // 2}?" + "!" * (i % 2)) for i in range(40)], "source_index long, question string")
    order = list(range(20))
    random.Random(42).shuffle(order)
    got = splits.seeded_split(df, SplitSpec(12, 5))
    rows = {(r.subset, r.position): r.source_index for r in got.collect()}
    assert rows == {("train", i + 1): 2 * g for i, g in enumerate(order[:12])} | {("val", i + 1): 2 * g for i, g in enumerate(order[12:17])}
    splits.assert_safe(got, df)
    with pytest.raises(ValueError):
        splits.seeded_split(df, SplitSpec(20, 5))
    bad = got.unionByName(got.limit(1)).unionByName(got.limit(1).withColumn("source_index", F.lit(99).cast("long")))
    with pytest.raises(ValueError):
        splits.assert_safe(bad, df)


def test_curves(spark):
    pts = [("r", "eval_loss", i, v, s) for i, (s, v) in enumerate([(121, 0.1818), (242, 0.1784), (363, 0.2027), (484, 0.2521), (484, 0.1)])]
    pts += [("r", "score", 1, 0.5, 10), ("r", "score", 2, 0.5, 20), ("r", "loss2", 1, 0.5, 10), ("r", "loss2", 2, 0.5, 20)]
    df = spark.createDataFrame(pts, "run string, metric string, line_no long, value double, step long")
    assert {r.metric: r.best_step for r in curves.best_step(df).collect()} == {"eval_loss": 242, "score": 20, "loss2": 10}
    assert {r.metric: r.value for r in curves.restored(df).collect()}["eval_loss"] == 0.1
    assert {r.metric: r.stop_step for r in curves.early_stop(df).collect()}["eval_loss"] == 484


def test_chat(spark):
    m = [("s", "x"), ("user", "y"), ("assistant", "z")]
    df = spark.createDataFrame([([1, 2, 3], [1, 2, 3, 9, 8], m)], "p array<int>, ids array<int>, messages array<struct<role:string,content:string>>")
    r = df.select(chat.label_mask(F.col("p"), F.col("ids")).alias("x"), chat.prompt_completion(F.col("messages")).alias("c")).first()
    assert r.x.labels == [-100, -100, -100, 9, 8] and r.x.attention_mask == [1] * 5 and len(r.c.prompt) == 2 and r.c.completion[0].content == "z"
    for bad in (chat.label_mask(F.col("ids"), F.col("p")), chat.label_mask(F.col("p"), F.col("ids"), 4)):
        with pytest.raises(Exception):
            df.select(bad).collect()
    rows = spark.createDataFrame([(1, [1] * 3, [1] * 3, [5] * 3), (2, [1] * 9, [1] * 9, [5] * 9)], "i int, input_ids array<int>, attention_mask array<int>, labels array<int>")
    a, b = chat.pad_batches(rows, 2, "i").orderBy("i").collect()
    assert len(a.labels) == len(b.labels) == 16 and a.labels[3:] == [-100] * 13 and sum(a.attention_mask) == 3


SCHEMA = "problem_id string, n long"


@pytest.mark.parametrize("text, rows", [('{"problem_id":"a","n":1}\n\n{"problem_id":"b","n":2}\n', 2), ('{"problem_id":"a","n":1}\n{"problem_id":"b"', 1), ('{"problem_id":"a","n":1}', 1), ('{"problem_id":"a","n":1}\n{"pro\n\n\n', 1), ("", 0), ('{"pro\n{"problem_id":"a","n":1}\n', None)])
def test_tolerant_log(spark, tmp_path, text, rows):
    p = tmp_path / "log.jsonl"
    p.write_text(text)
    if rows is None:
        with pytest.raises(ValueError):
            logs.read_log(spark, str(p), SCHEMA).collect()
        assert logs.read_lenient(spark, str(p), SCHEMA).count() == 1
    else:
        assert logs.read_log(spark, str(p), SCHEMA).count() == rows


def test_missing_log_and_repair(spark, tmp_path):
    assert logs.read_log(spark, str(tmp_path / "none"), SCHEMA).count() == 0
    p = tmp_path / "log.jsonl"
    p.write_text('{"problem_id":"a","n":1}\n{"pro')
    assert sinks.repair_log(spark, str(p), SCHEMA, str(tmp_path / "good")) == 1
    assert logs.read_plain(spark, str(tmp_path / "good"), SCHEMA).count() == 1


def test_documents_and_manifest(spark, tmp_path):
    p = str(tmp_path / "m.json")
    assert sinks.write_or_verify(spark, {"a": 1}, p) and not sinks.write_or_verify(spark, {"a": 1}, p)
    with pytest.raises(ValueError):
        sinks.write_or_verify(spark, {"a": 2}, p)
    with pytest.raises(ValueError):
        files.read_document(spark, p, "exact_match_accuracy double")
    rows = [{"question": "é", "answer": "1"}, {"question": "b", "answer": None}]
    df = spark.createDataFrame([(i, r["question"], r["answer"]) for i, r in enumerate(rows)], "i int, question string, answer string")
    j = fingerprint.python_json(df, ["question", "answer"])
    assert fingerprint.fingerprint(j, F.col("json"), "i").first().fingerprint == fingerprint.of_rows(rows)
    assert RunConfig(stage="a").config_hash() == RunConfig(stage="b").config_hash() != RunConfig(seed=1).config_hash()
    assert slugify("a b//c") == "a_b_c" and slugify("//") == "model"


def test_fingerprint_streams_texts_in_order_and_gathers_none(spark):
    rows = [(i * 7 % 500, "é" * (i % 40) + str(i)) for i in range(500)] + [(3, "b"), (3, "a"), (3, None), (None, "none"), (9, "")]
    df = spark.createDataFrame(rows, "o long, t string").repartition(5)
    out = fingerprint.fingerprint(df, F.col("t"), "o")
    assert "collect_list" not in out._jdf.queryExecution().toString()
    ordered = sorted(((o is not None, o or 0, (t or "").encode()) for o, t in rows))
    assert tuple(out.first()) == (hashlib.sha256(b"".join(t for *_, t in ordered)).hexdigest(), len(rows))
    assert tuple(fingerprint.fingerprint(df.where("o < 0"), F.col("t"), "o").first()) == (fingerprint.of_rows([]), 0)


def test_merged_summaries_keep_the_first_teacher(spark):
    def one(*conditions):
        return spark.createDataFrame([(i, c, "m") for i, c in enumerate(conditions)], "row_no int, condition string, model string")

    out = compare.merge_summaries([("x", one("teacher", "before")), ("y", one("teacher", "after")), ("z", one("teacher"))]).collect()
    assert [(r.source_file, r.condition) for r in out] == [("x", "teacher"), ("x", "before"), ("y", "after")]


def test_runs_resume_and_reject_duplicates(spark):
    problems = spark.createDataFrame([(f"p{i}", i, f"what is {i} + {i}", str(2 * i)) for i in range(6)], "problem_id string, source_index long, question string, gold_answer string")

    calls = spark.sparkContext.accumulator(0)

    def make():
        def reply(text, seed):
            i = int(text.split()[-3])
            told = 1 if i < 2 else i
            calls.add(1)
            return f"<reasoning>Step 1: we take {told} and add it.\nStep 2: {told} + {told} = {2 * told} is then the sum.</reasoning>\n<final_answer>{2 * i}</final_answer>"

        return generate.StubBackend(reply)

    first = runs.produce_run(problems, None, make, attempts=2).withColumn("event_seq", F.col("source_index"))
    got = {r.problem_id: r for r in first.collect()}
    assert got["p0"].status == "accepted" and got["p1"].validation_errors == ["duplicate_reasoning_output"] and (got["p5"].lifetime_attempts, got["p1"].lifetime_attempts) == (1, 2)
    # One call for each of six problems, and one more for the one whose output repeats another's.
    assert calls.value == 7
    again = runs.produce_run(problems, first, make, attempts=1)
    assert [(r.problem_id, r.generation_round) for r in again.collect()] == [("p1", 2)]
    graded = runs.evaluate_run(problems, None, make)
    assert metrics.rates(graded).first().exact_match_accuracy == 1.0
    assert runs.compare_conditions(graded, graded, 1.0).count() == 2


def test_streamed_state_and_totals(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    schema = "problem_id string, event_seq long, n double"
    events = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 2.0), ("a", 3, 3.0)], schema)
    events.write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    streams.upsert_latest(stream, out, ck, buckets=4).awaitTermination()
    spark.createDataFrame([("b", 5, 9.0), ("c", 4, 4.0)], schema).write.mode("append").parquet(src)
    streams.upsert_latest(stream, out, ck, buckets=4).awaitTermination()
    assert {r.problem_id: r.event_seq for r in streams.read_latest(spark, out).collect()} == {"a": 3, "b": 5, "c": 4}
    totals = streams.carried_totals(stream, "problem_id", ("n",))
    totals.writeStream.format("memory").queryName("totals").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    rows = spark.table("totals").collect()
    assert {(r.problem_id, r.generation_round): r.lifetime_n for r in rows} == {("a", 1): 1.0, ("a", 2): 4.0, ("b", 1): 2.0, ("b", 2): 11.0, ("c", 1): 4.0}


def test_sources(spark, tmp_path):
    (tmp_path / "metrics").mkdir()
    (tmp_path / "metrics" / "eval_loss").write_text("1 0.5 10\nbroken\n2 0.4 20\n")
    pts = files.read_metric_files(spark, str(tmp_path / "metrics"), "r").collect()
    assert [(p.metric, p.value, p.step) for p in sorted(pts, key=lambda p: p.step)] == [("eval_loss", 0.5, 10), ("eval_loss", 0.4, 20)]
    for n in ("checkpoint-9", "checkpoint-20", "final"):
        (tmp_path / "c" / n).mkdir(parents=True)
        (tmp_path / "c" / n / "x.bin").write_bytes(b"12")
    listed = files.listing(spark, str(tmp_path / "c"))
    assert [r.step for r in files.checkpoints(listed).collect()] == [9, 20]
    assert files.size_gib(listed).first()[0] == 6 / 1024**3
    sinks.write_csv(spark.createDataFrame([("a", None)], "x string, y string"), str(tmp_path / "t"), ("x", "y", "z"))
    assert files.read_csv(spark, str(tmp_path / "t")).columns == ["x", "y", "z"]
    (tmp_path / "conv.jsonl").write_text(json.dumps({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}) + "\n" + json.dumps({"messages": []}) + "\n")
    with pytest.raises(ValueError, match="line 2"):
        logs.read_conversations(spark, str(tmp_path / "conv.jsonl"), "messages array<struct<role:string,content:string>>")


def test_valid_first_attempts_are_one_call_each(spark):
    problems = spark.createDataFrame([(f"p{i}", i, f"what is {i} + {i}", str(2 * i)) for i in range(10)], "problem_id string, source_index long, question string, gold_answer string")
    calls = spark.sparkContext.accumulator(0)

    def make():
        def reply(text, seed):
            calls.add(1)
            assert text.startswith("Question:\n")
            i = int(text.split()[-1])
            return f"<reasoning>Step 1: we take {i} and add it.\nStep 2: {i} + {i} = {2 * i} is then the sum.</reasoning>\n<final_answer>{2 * i}</final_answer>"

        return generate.StubBackend(reply)

    out = runs.produce_run(problems, None, make)
    assert {(r.status, r.attempts) for r in out.collect()} == {("accepted", 1)} and calls.value == 10
    again = runs.produce_run(problems, out.withColumn("event_seq", F.col("source_index")), make)
    assert again.collect() == [] and calls.value == 10


@pytest.mark.parametrize("parts", [4, 8, 200])
def test_rows_are_numbered_alike_by_any_number_of_parts(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.range(5000).select(F.expr("id * 7919 % 5000").alias("k"), F.expr("CASE WHEN id % 3 = 0 THEN 1 ELSE id END").alias("tied"), F.expr("CASE WHEN id % 10 > 0 THEN id END").alias("gaps")).repartition(7)
        rows = ordering.number_rows(df, "k").collect()
        assert all(r.row_no == r.k for r in rows)
        rows = ordering.number_rows(df, "tied").orderBy("row_no").collect()
        assert [r.row_no for r in rows] == list(range(5000)) and [r.tied for r in rows] == sorted(r.tied for r in rows)
        rows = ordering.number_rows(df, F.desc("gaps")).orderBy("row_no").collect()
        assert [r.gaps for r in rows] == sorted((r.gaps for r in rows if r.gaps is not None), reverse=True) + [None] * 500
        ids = F.sequence(F.lit(1), F.col("k") % 40 + 1)
        out = chat.pad_batches(df.select("k", ids.alias("input_ids"), ids.alias("attention_mask"), ids.alias("labels")), 4, "k").groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k"), F.countDistinct(F.size("labels")).alias("w"), F.max(F.size("labels")).alias("width")).collect()
        assert len(out) == 1250 and all((r.n, r.k, r.w, r.width) == (4, 4 * r.batch, 1, -(-((4 * r.batch + 3) % 40 + 1) // 8) * 8) for r in out)
        assert ordering.number_rows(df.limit(0), "k").collect() == []
        place = ordering.position_within(df.withColumn("g", F.col("k") % 3), "g", "k").collect()
        assert all(r.position == r.k // 3 + 1 for r in place)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_folders_are_swapped_whole(spark, tmp_path):
    p = str(tmp_path / "f")
    for n in (3, 5):
        sinks.replace_folder(spark.range(n), p, "parquet")
        assert spark.read.parquet(p).count() == n
    assert [x.name for x in tmp_path.iterdir()] == ["f"]
    sinks.write_text(spark, "é", f"{p}.txt")
    sinks.write_text(spark, "new", f"{p}.txt")
    assert sinks.read_text(spark, f"{p}.txt") == "new" and sinks.read_text(spark, f"{p}.none") is None
    with pytest.raises(Exception):
        sinks._swap_in(spark, f"{p}.missing", p)
    assert spark.read.parquet(p).count() == 5


def test_scratch_tables_are_recorded_and_removed(spark):
    with scratch.recorded() as made:
        kept = scratch.materialize(spark.range(3), "a")
        other = scratch.materialize(spark.range(4), "b")
    assert len(made) == 2 and kept.count() == 3
    scratch.remove(spark, made[1:])
    with pytest.raises(Exception):
        other.count()
    assert kept.count() == 3


def test_command_line(spark, tmp_path):
    p = tmp_path / "predictions.jsonl"
    rows = [{"problem_id": f"p{i}", "question": "Count 30", "gold_answer": "30", "raw_output": "", "reasoning": "Step 1: a\nStep 2: b\nStep 3: c", "predicted_answer": str(30 + i), "is_correct": i == 0, "is_valid_format": True, "is_truncated": False} for i in range(6)]
    p.write_text("".join(json.dumps(r) + "\n" for r in rows))
    cli.main(["compare", "--predictions-a", str(p), "--predictions-b", str(p), "--output", str(tmp_path / "mcnemar.json")])
    got = json.loads((tmp_path / "mcnemar.json").read_text())
    assert (got["shared_n"], got["both_correct"], got["overlap_warning"], got["p_value"]) == (6, 1, False, 1.0)
    for n, acc in (("before", 0.25), ("after", 0.5)):
        (tmp_path / f"{n}.json").write_text(json.dumps({"model": "m", "exact_match_accuracy": acc}))
    cli.main(["table", "--before-metrics", str(tmp_path / "before.json"), "--after-metrics", str(tmp_path / "after.json"), "--output", str(tmp_path / "summary")])
    assert [r.condition for r in files.read_csv(spark, str(tmp_path / "summary")).collect()] == ["before", "after"]
    cli.main(["plot", "--before-metrics", str(tmp_path / "before.json"), "--after-metrics", str(tmp_path / "after.json"), "--output", str(tmp_path / "bars.svg")])
    assert (tmp_path / "bars.svg").read_text().count("<rect") == 2
    cli.main(["merge", "--summaries", str(tmp_path / "summary"), "--output", str(tmp_path / "merged")])
    assert files.read_csv(spark, str(tmp_path / "merged")).count() == 2
    cli.main(["classify", "--predictions", str(p), "--output", str(tmp_path / "errors")])
    assert json.loads((tmp_path / "errors" / "summary.json").read_text())["counts"]["off_by_one"] == 1
    problems = tmp_path / "problems.jsonl"
    problems.write_text("".join(json.dumps({"problem_id": f"p{i}", "source_index": i, "question": "x" * i, "gold_answer": str(i)}) + "\n" for i in range(4)))
    cli.main(["evaluate", "--problems", str(problems), "--model", "stub", "--output-dir", str(tmp_path / "out")])
    cli.main(["evaluate", "--problems", str(problems), "--model", "stub", "--output-dir", str(tmp_path / "out")])
    documents = list((tmp_path / "out").glob("*_metrics.json"))
    assert len(documents) == 1 and json.loads(documents[0].read_text())["total_examples"] == 4
    rejected = tmp_path / "rejected.jsonl"
    text = "<reasoning>Step 1: we pay $3 * $4 for all of it.\nStep 2: that is $3 * $4 = $12 in all for them.</reasoning>\n<final_answer>12</final_answer>"
    rejected.write_text(json.dumps({"problem_id": "p1", "gold_answer": "12", "raw_output": text, "is_correct": True, "teacher_reasoning": "pay $3 * $4", "validation_errors": ["reasoning_lacks_calculation_detail"]}) + "\n")
    cli.main(["rescue", "--rejected", str(rejected), "--output", str(tmp_path / "rescued"), "--dry-run"])
    assert not (tmp_path / "rescued").exists()
    cli.main(["rescue", "--rejected", str(rejected), "--output", str(tmp_path / "rescued")])
    assert spark.read.json(str(tmp_path / "rescued")).first().status == "accepted"
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "loss").write_text("1 0.5 10\n2 0.4 20\n3 0.6 30\n")
    cli.main(["curves", "--metrics", str(tmp_path / "m"), "--panel", "loss=train", "--output", str(tmp_path / "curves.svg")])
    assert "<polyline" in (tmp_path / "curves.svg").read_text()
