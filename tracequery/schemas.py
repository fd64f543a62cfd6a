"""Schemas of the tables that the engine reads and writes."""

from __future__ import annotations

MESSAGE = "struct<role:string,content:string>"
PROBLEM = "problem_id string, source_index long, question string, gold_answer string"
GENERATION = "text string, finish_reason string, prompt_tokens long, completion_tokens long, total_tokens long, elapsed_seconds double, peak_memory_bytes long, generation_error string"
PREDICTION = (
    PROBLEM
    + ", raw_output string, finish_reason string, generation_error string, prompt_tokens long, completion_tokens long, total_tokens long"
    + ", elapsed_seconds double, peak_memory_bytes long, reasoning string, predicted_answer string, answer_source string"
    + ", answer_extracted boolean, is_correct boolean, is_valid_format boolean, is_correct_and_valid boolean, is_truncated boolean, validation_errors array<string>"
)
EVENT = (
    "problem_id string, event_seq long, subset string, status string, question string, gold_answer string, teacher_reasoning string, teacher_final_answer string"
    + ", student_target string, is_correct boolean, reasoning_hash string, validation_errors array<string>, format_warnings array<string>, attempts long, elapsed_seconds double"
    + ", prompt_tokens long, completion_tokens long, total_tokens long"
)
SFT = f"problem_id string, question string, gold_answer string, teacher_final_answer string, student_target string, messages array<{MESSAGE}>"
METRIC_POINT = "run string, metric string, line_no long, ts long, value double, step long"

#: Columns of a summary row, in the order in which files hold them; fixed values.
SUMMARY_FIELDS = (
    "condition",
    "model",
    "adapter_path",
    "exact_match_accuracy",
    "accuracy_ci_lower",
    "accuracy_ci_upper",
    "valid_format_rate",
    "correct_and_valid_rate",
    "mean_inference_seconds",
    "median_inference_seconds",
    "p95_inference_seconds",
    "completion_tokens_per_second",
    "peak_cuda_memory_gb",
    "model_parameter_count",
    "adapter_storage_gb",
    "absolute_improvement_over_before",
    "relative_improvement_over_before",
    "gap_to_teacher_accuracy",
)
SFT_FIELDS = ("problem_id", "question", "gold_answer", "teacher_final_answer", "student_target", "messages")
