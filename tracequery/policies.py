"""Frozen policies: every threshold, pattern and list that an operator follows is a parameter."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import re
from dataclasses import dataclass

#: Failure reasons in the order in which they are listed; fixed values.
FAILURE_REASONS = (
    "wrong_answer",
    "missing_reasoning_tag",
    "missing_final_answer_tag",
    "malformed_reasoning_tag",
    "empty_reasoning",
    "malformed_final_answer_tag",
    "non_numeric_final_answer",
    "ambiguous_final_answer",
    "no_extractable_answer",
    "truncated_output",
    "generation_error",
)
#: The reasons that make an output's format invalid; fixed values.
FORMAT_FAILURES = (
    "missing_reasoning_tag",
    "missing_final_answer_tag",
    "malformed_reasoning_tag",
    "malformed_final_answer_tag",
    "empty_reasoning",
    "non_numeric_final_answer",
    "ambiguous_final_answer",
    "truncated_output",
)
#: Error classes of wrong but valid outputs; fixed values.
ERROR_CLASSES = (
    "arithmetic_mistake",
    "wrong_operation",
    "dropped_intermediate_step",
    "misunderstood_question",
    "copied_irrelevant_teacher_pattern",
    "premature_answer",
    "correct_reasoning_wrong_extraction",
    "hallucinated_reasoning",
    "off_by_one",
    "unit_error",
    "other",
)
#: Prompts that outputs and training rows must share; fixed values.
SYSTEM_PROMPT = (
    "Solve the mathematical problem using step-by-step reasoning, with at most "
    "one arithmetic operation per step. Return the reasoning inside <reasoning> "
    "tags and the numerical answer inside <final_answer> tags. The "
    "<final_answer> tag must contain only the normalized numerical answer "
    "without units, currency symbols, commas, percent signs, or explanatory "
    "text."
)
ANSWER_ONLY_PROMPT = "Solve the mathematical problem. Return only the numerical answer inside <final_answer> tags."
USER_PREFIX, GENERATOR_PREFIX = "Problem:\n", "Question:\n"
#: What the generator of training rows is told unless a run names a prompt of its own.
GENERATOR_PROMPT = (
    "Write a worked solution for a small model to learn from. One arithmetic operation a step, written with "
    "digits and symbols as an equation, in numbered lines; leave out nothing that is needed. Put the steps "
    "between <reasoning> and </reasoning>, and the bare number between <final_answer> and </final_answer>. "
    "Write nothing else."
)


@dataclass(frozen=True)
class ValidationPolicy:
    """Quality rules for generated answers. ``calculation``, a fixed value, must be found in the reasoning."""

    calculation: str = r"\d\s*[\w/%]*\s*[+\-*/=×÷]\s*[$€]?\s*\d"
    least_characters: int = 20
    least_words: int = 8
    most_characters: int = 4000
    most_lines: int = 60
    most_repeated_lines: int = 3
    most_repeated_sentences: int = 3
    least_sentence: int = 12
    least_steps: int = 2
    most_steps: int = 20
    outside_limit: int = 20
    reject_outside: bool = True
    require_calculation: bool = True


#: The looser pattern under which rejected rows are looked at again; a fixed value.
RESCUE_CALCULATION = r"\d\s*[+\-*/=×÷]\s*\$?\s*\d"
#: The earlier, stricter pattern that the rescue was made for: operator and digits side by side; a fixed value.
STRICT_CALCULATION = r"\d\s*[+\-*/=×÷]\s*\d"


@dataclass(frozen=True)
class SplitSpec:
    """Sizes and seed of a train/validation split."""

    n_train: int = 2000
    n_val: int = 500
    seed: int = 42


@dataclass(frozen=True)
class RunConfig:
    """Settings of an evaluation run. Its hash leaves out what does not change a prediction."""

    backend: str = "stub"
    model: str = "stub"
    stage: str = "baseline"
    adapter_path: str | None = None
    limit: int | None = None
    base_url: str | None = None
    max_new_tokens: int = 768
    max_input_tokens: int = 1536
    load_in_4bit: bool = False
    dtype: str = "auto"
    seed: int = 42
    temperature: float = 0.0
    top_p: float = 1.0
    system_prompt: str = SYSTEM_PROMPT

    def validate(self) -> None:
        """Raise on settings that contradict each other."""
        if self.limit is not None and self.limit <= 0:
            raise ValueError("limit must be positive")
        if self.max_new_tokens <= 0 or self.max_input_tokens <= 0:
            raise ValueError("token limits must be positive")
        if self.backend == "remote" and (self.adapter_path or self.load_in_4bit):
            raise ValueError("a remote backend takes neither an adapter nor quantisation")

    def config_hash(self) -> str:
        fields = {k: v for k, v in dataclasses.asdict(self).items() if k not in ("stage", "limit", "base_url")}
        return short_hash(fields, 8)

    def slug(self) -> str:
        return f"{slugify(self.model)}_{slugify(self.stage)}_{self.config_hash()}"


def short_hash(payload: dict, digits: int = 10) -> str:
    """First hexadecimal digits of the SHA-256 of a payload as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()[:digits]


def slugify(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]+", "_", text).strip("_") or "model"
