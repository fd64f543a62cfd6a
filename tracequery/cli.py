"""Command line: ``python -m tracequery.cli compare|table|plot|merge|classify|rescue|evaluate|curves ...``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .operators import charts, compare, curves, errors, generate, metrics
from .operators.validation import rescue
from .plans import runs
from .policies import RunConfig
from .sources import files, logs, sinks

_METRICS = "model string, adapter_path string, exact_match_accuracy double, accuracy_ci_lower double, accuracy_ci_upper double, valid_format_rate double, correct_and_valid_rate double, average_inference_seconds double, median_inference_seconds double, p95_inference_seconds double, completion_tokens_per_second double, peak_memory_bytes long"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracequery")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compare", help="paired significance test of two prediction logs")
    c.add_argument("--predictions-a", required=True)
    c.add_argument("--predictions-b", required=True)
    c.add_argument("--label-a", default="condition_a")
    c.add_argument("--label-b", default="condition_b")
    t = sub.add_parser("table", help="summary of two metric documents")
    b = sub.add_parser("plot", help="bars of the accuracy in metric documents, as SVG")
    b.add_argument("--title", default="exact-match accuracy")
    for s in (t, b):
        s.add_argument("--before-metrics", required=True)
        s.add_argument("--after-metrics", required=True)
        s.add_argument("--teacher-metrics")
    m = sub.add_parser("merge", help="merge summary tables")
    m.add_argument("--summaries", nargs="+", required=True)
    k = sub.add_parser("classify", help="classes of wrong but valid predictions")
    k.add_argument("--predictions", required=True)
    k.add_argument("--examples-per-class", type=int, default=5)
    r = sub.add_parser("rescue", help="rejected rows that pass under the looser pattern")
    r.add_argument("--rejected", required=True)
    r.add_argument("--dry-run", action="store_true", help="count only, write nothing")
    v = sub.add_parser("curves", help="training curves of metric files in panels, as SVG")
    v.add_argument("--metrics", required=True)
    v.add_argument("--run", default="run")
    v.add_argument("--panel", action="append", required=True, help="METRIC=PANEL, once a metric")
    v.add_argument("--title", default="training")
    for s in (c, t, b, m, k, r, v):
        s.add_argument("--output", required=True)
    e = sub.add_parser("evaluate", help="grade a model's answers to a file of problems; resumes where a run ended")
    e.add_argument("--problems", required=True)
    e.add_argument("--backend", choices=sorted(generate.BACKENDS), default="stub")
    e.add_argument("--model", default="stub")
    e.add_argument("--stage", default="before_sft")
    e.add_argument("--adapter-path")
    e.add_argument("--base-url")
    e.add_argument("--api-key", default="EMPTY")
    e.add_argument("--timeout-seconds", type=float, default=180.0)
    e.add_argument("--limit", type=int)
    e.add_argument("--max-new-tokens", type=int, default=768)
    e.add_argument("--max-input-tokens", type=int, default=1536)
    e.add_argument("--run-tag")
    e.add_argument("--teacher-accuracy", type=float)
    e.add_argument("--output-dir", required=True)
    return p


def _summary(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    documents = [("before", args.before_metrics), ("after", args.after_metrics)] + ([("teacher", args.teacher_metrics)] if args.teacher_metrics else [])
    rows = {n: files.read_document(spark, p, _METRICS).withColumn("condition", F.lit(n)) for n, p in documents}
    acc = {n: r.first().exact_match_accuracy for n, r in rows.items()}
    gains = compare.improvement(F.lit(acc["before"]), F.lit(acc["after"]), F.lit(acc["teacher"]) if "teacher" in acc else None)
    rows["after"] = rows["after"].withColumns({"absolute_improvement_over_before": gains["absolute_improvement"], "relative_improvement_over_before": gains["relative_improvement"], "gap_to_teacher_accuracy": gains["gap_to_teacher_accuracy"]})
    out = None
    for n in ("teacher", "before", "after"):
        if n in rows:
            part = compare.summary_rows(rows[n])
            out = part if out is None else out.unionByName(part)
    return out


def _evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    config = RunConfig(backend=args.backend, model=args.model, stage=args.stage, adapter_path=args.adapter_path, limit=args.limit, base_url=args.base_url, max_new_tokens=args.max_new_tokens, max_input_tokens=args.max_input_tokens)
    config.validate()
    name = config.slug() + (f"_{args.run_tag}" if args.run_tag else "")
    base = f"{args.output_dir.rstrip('/')}/{name}"
    options = {} if args.backend == "stub" else {"model": args.model, "base_url": args.base_url, "api_key": args.api_key, "timeout_seconds": args.timeout_seconds, "max_new_tokens": args.max_new_tokens}
    if args.backend == "http":
        generate.check_model(generate.create_backend("http", **options))
    todo = spark.read.schema(schemas.PROBLEM).json(args.problems)
    if args.limit is not None:
        todo = todo.orderBy("source_index").limit(args.limit)
    backend = args.backend
    done = logs.read_log(spark, f"{base}_predictions", schemas.PREDICTION).drop("file", "event_seq")
    fresh = runs.evaluate_run(todo, done, lambda: generate.create_backend(backend, **options), config.seed)
    names = [f.split()[0] for f in schemas.PREDICTION.replace("array<string>", "array").split(", ")]
    sinks.append_log(fresh.select(*[n for n in names if n in fresh.columns]), f"{base}_predictions")
    every = logs.read_log(spark, f"{base}_predictions", schemas.PREDICTION)
    # A problem that failed before and was tried again counts by its success.
    last = every.withColumn("__good", F.col("generation_error").isNull())
    last = last.groupBy("problem_id").agg(F.max_by(F.struct(*every.columns), F.struct("__good", "event_seq")).alias("r")).select("r.*")
    document = metrics.metrics_document(last).crossJoin(compare.bootstrap_interval(last).withColumnsRenamed({"ci_lower": "accuracy_ci_lower", "ci_upper": "accuracy_ci_upper"}))
    document = document.withColumns({"model": F.lit(args.model), "stage": F.lit(args.stage), "config": F.lit(config.config_hash())})
    if args.teacher_accuracy is not None:
        document = document.withColumn("gap_to_teacher_accuracy", F.lit(args.teacher_accuracy) - F.col("exact_match_accuracy"))
    sinks.write_document(document, f"{base}_metrics.json")


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "compare":
        schema = "problem_id string, is_correct boolean"
        a, b = (logs.read_log(spark, p, schema) for p in (args.predictions_a, args.predictions_b))
        found = compare.mcnemar(compare.contingency(compare.paired(a, b))).crossJoin(compare.overlap_of(a, b))
        found = found.withColumns({"label_a": F.lit(args.label_a), "label_b": F.lit(args.label_b), "predictions_a": F.lit(args.predictions_a), "predictions_b": F.lit(args.predictions_b)})
        row = json.loads(found.toJSON().first())
        if row["overlap_warning"]:
            print(f"warning: the runs share {row['shared_n']} ids of {row['n_records_a']} and {row['n_records_b']}; only these are compared")
        sinks.write_json(spark, row, args.output)
    elif args.command == "table":
        sinks.write_csv(_summary(spark, args), args.output, schemas.SUMMARY_FIELDS, files=1)
    elif args.command == "plot":
        sinks.write_text(spark, charts.draw_bars(charts.accuracy_bars(_summary(spark, args)), args.title, 1.0), args.output)
    elif args.command == "curves":
        panels = dict(p.split("=", 1) for p in args.panel)
        points = files.read_metric_files(spark, args.metrics, args.run)
        sinks.write_text(spark, charts.draw_curves(charts.curve_panels(points, panels), args.title), args.output)
        print(curves.best_step(points.where(F.col("metric").isin(*panels))).toJSON().collect())
    elif args.command == "merge":
        tables = []
        for p in args.summaries:
            stem = p.rstrip("/").rpartition("/")[2].removesuffix(".csv")
            tables.append((stem, files.read_csv(spark, p).withColumn("row_no", F.monotonically_increasing_id())))
        sinks.write_csv(compare.merge_summaries(tables), args.output, ("source_file", *schemas.SUMMARY_FIELDS), files=1)
    elif args.command == "rescue":
        rejected = logs.read_log(spark, args.rejected, "problem_id string, gold_answer string, raw_output string, is_correct boolean, teacher_reasoning string, validation_errors array<string>")
        found = rescue(rejected).drop("file")
        if args.dry_run:
            print(f"{found.count()} of {rejected.count()} rejected rows would be rescued")
        else:
            sinks.append_log(found, args.output)
    elif args.command == "evaluate":
        _evaluate(spark, args)
    else:
        every = logs.read_log(spark, args.predictions, schemas.PREDICTION)
        rows = errors.classify(errors.wrong_but_valid(every)).persist()
        sinks.write_error_report(rows.drop("file"), every.count(), args.predictions, args.output, examples=args.examples_per_class)
        rows.unpersist()


if __name__ == "__main__":
    main()
