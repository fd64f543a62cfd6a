"""Numbers, grading, validation, rescue and error classes by vectors."""

import pytest
from pyspark.sql import functions as F

from tracequery.functions import numeric as N
from tracequery.functions import text as T
from tracequery.operators import errors
from tracequery.operators.grading import grade
from tracequery.operators.validation import rescue, validate
from tracequery.policies import RESCUE_CALCULATION, STRICT_CALCULATION

R = "<reasoning>\nStep 1: 4 * 12 = 48.\nStep 2: 48 - 6 = 42.\n</reasoning>\n"
WA, NN, AM, NO = "wrong_answer", "non_numeric_final_answer", "ambiguous_final_answer", "no_extractable_answer"
MR, MF, BR, BF = "missing_reasoning_tag", "missing_final_answer_tag", "malformed_reasoning_tag", "malformed_final_answer_tag"
#: raw, gold, predicted, source, correct, valid, reasons
GRADES = [
    (R + "<final_answer>42</final_answer>", "42", "42", "final_answer_tag", True, True, []),
    (R + "<final_answer>42.0</final_answer>", "42", "42.0", "final_answer_tag", True, True, []),
    (R + "<final_answer>1,200</final_answer>", "1200", "1200", "final_answer_tag", True, False, [NN]),
    (R + "<final_answer>$42</final_answer>", "42", "42", "final_answer_tag", True, False, [NN]),
    (R + "<final_answer>50%</final_answer>", "50", "50%", "final_answer_tag", False, False, [WA, NN]),
    (R + "<final_answer>1/2</final_answer>", "0.5", "1/2", "final_answer_tag", True, True, []),
    (R + "<final_answer>1 1/2</final_answer>", "1.5", "1 1/2", "final_answer_tag", True, True, []),
    (R + "<final_answer>8 or 10</final_answer>", "8", None, "final_answer_tag", False, False, [NN, AM]),
    (R + "<final_answer>10-12</final_answer>", "10", None, "final_answer_tag", False, False, [NN, AM]),
    ("<reasoning>\n\n</reasoning>\n<final_answer>42</final_answer>", "42", "42", "final_answer_tag", True, False, ["empty_reasoning"]),
    (R + "<final_answer></final_answer>", "42", None, "final_answer_tag", False, False, [NN, NO]),
    ("We get 40 then 42. The answer is 42.", "42", "42.", "fallback", True, False, [MR, MF]),
    ("Answer: 8 or 10", "8", None, "missing", False, False, [MR, MF, AM]),
    ("It is 8 or 10 apples", "10", None, "missing", False, False, [MR, MF, AM]),
    ("First 6, then 42", "42", "42", "fallback", True, False, [MR, MF]),
    ("<final_answer>42</final_answer><reasoning>4*12=48</reasoning>", "42", "42", "final_answer_tag", True, False, [BR, BF]),
    ("<reasoning>x <final_answer>42</final_answer></reasoning>", "42", "42", "final_answer_tag", True, False, [BR, BF]),
    (R + "<final_answer>41</final_answer><final_answer>42</final_answer>", "42", "41", "final_answer_tag", False, False, [WA, BF]),
    ("<reasoning>6*7\n<final_answer>42</final_answer>", "42", "42", "final_answer_tag", True, False, [BR]),
    (R.upper() + "<FINAL_ANSWER>42</FINAL_ANSWER>", "42", "42", "final_answer_tag", True, True, []),
    ("<reasoning>idk</reasoning>", "42", None, "missing", False, False, [MF, NO]),
    ("", "42", None, "missing", False, False, [MR, MF, NO]),
    (None, "42", None, "missing", False, False, [MR, MF, NO]),
]


def test_grading_vectors(spark):
    df = spark.createDataFrame([(i, g[0], g[1]) for i, g in enumerate(GRADES)], "i int, raw_output string, gold_answer string")
    for r in grade(df).collect():
        want = GRADES[r.i]
        assert (r.predicted_answer, r.answer_source, r.is_correct, r.is_valid_format, r.validation_errors) == want[2:], want[0]
        assert r.is_correct_and_valid == (want[4] and want[5]) and r.answer_extracted == (want[2] is not None)


def test_truncation_and_failed_generation(spark):
    df = spark.createDataFrame([(R + "<final_answer>42</final_answer>", "42", True, None), ("", "42", False, "Timeout: x")], "raw_output string, gold_answer string, cut boolean, err string")
    a, b = grade(df, truncated="cut", error="err").collect()
    assert a.validation_errors == ["truncated_output"] and a.is_correct and not a.is_valid_format
    assert b.validation_errors == [MR, MF, NO, "generation_error"]


RATIONALS = {
    "42": "42/1", "42.0": "42/1", "42.": "42/1", "+.5": "1/2", "-1 1/2": "-3/2", "-0 1/2": "1/2", "1 1/2": "3/2", "+1 1/2": None, "3/4": "3/4", "3/-4": None, "5/0": None,
    "50%": "1/2", "1e3": "1000/1", "1.5E-2": "3/200", "abc": None, "NaN": None, "Infinity": None, "1,200": None, "$5": None, "1e999999999": None, None: None,
}


def test_rationals(spark):
    df = spark.createDataFrame([(k,) for k in RATIONALS], "v string")
    assert {r.v: r.x for r in df.select("v", N.rational(F.col("v")).alias("x")).collect()} == RATIONALS
    normal = df.select("v", N.rational(N.normalized(F.col("v"))).alias("x")).collect()
    assert {r.v: r.x for r in normal if r.v in ("1,200", "$5")} == {"1,200": "1200/1", "$5": "5/1"}


def test_same_number(spark):
    pairs = [("1/2", "0.5", True), ("50%", "1/2", True), ("2/4", "1/2", True), ("84/2", "42", True), ("1 1/2", "1.5", True), ("1e3", "1000", True), ("42.", "42", True), ("5/0", "0", False), ("x", "x", False), (None, "1", False), ("1" * 30, "1" * 30, True), ("0.1", "0.10000000000000000001", False)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.x for r in df.select("i", N.same_number(F.col("a"), F.col("b")).alias("x")).collect()}
    assert got == {i: p[2] for i, p in enumerate(pairs)}


NUMBERS = [
    ("42", True, True, "42"), (" 42 ", True, True, "42"), ("$42", True, False, "42"), ("1,200", True, False, "1200"), ("42%", False, False, "42%"), ("1 1/2", True, True, "1 1/2"), ("3 / 4", True, True, "3/4"), ("3/-4", True, True, "3/-4"),
    (".5", True, True, ".5"), ("5.", True, True, "5."), ("1e5", True, True, "1e5"), ("42 apples", False, False, "42"), ("₹5", False, False, "5"), ("\\boxed{42}", True, False, "42"), ("", False, False, None),
]


def test_strict_and_first_number(spark):
    df = spark.createDataFrame([(n[0],) for n in NUMBERS], "v string")
    v = F.col("v")
    got = {r.v: r[1:] for r in df.select("v", N.is_strict(N.normalized(v, N.GENERATOR_SIGNS)), N.is_strict(v), N.first_number(v)).collect()}
    for v, loose, strict, number in NUMBERS:
        assert got[v] == (loose, strict, number), v


B = "Step 1: One box holds 12 pencils.\nStep 2: Four boxes hold 12 * 4 = 48 pencils.\nStep 3: So 48 - 6 = 42 remain."
RULES = [
    (B, "42", "", None, "42", 3, [], []),
    (B, "42", "", "length", "42", 3, ["truncated_output"], []),
    (B, "$42", "", None, "42", 3, [], []),
    (B, "42 pencils", "", None, "42", 3, ["non_numeric_text_inside_final_answer_tag"], []),
    ("", "42", "", None, "42", 0, ["missing_tagged_reasoning"], ["no_numbered_steps_detected"]),
    ("6*7=42", "42", "", None, "42", 0, ["reasoning_too_short"], ["no_numbered_steps_detected"]),
    ("Step 1: We count all the pencils in the boxes.\nStep 2: The answer is 42.", "42", "", None, "42", 2, ["reasoning_lacks_calculation_detail"], []),
    (B + "\nagain we go" * 4, "42", "", None, "42", 3, ["repetitive_reasoning_lines"], []),
    (B + " This is said again." * 4, "42", "", None, "42", 3, ["repetitive_reasoning_sentences"], []),
    (B, "42", "x" * 25, None, "42", 3, ["significant_text_outside_required_tags"], ["text_outside_required_tags"]),
    (B, "42", "short", None, "42", 3, [], ["text_outside_required_tags"]),
    (B, "41", "", None, "41", 3, ["wrong_answer"], []),
    (B, "42%", "", None, "42%", 3, ["non_numeric_text_inside_final_answer_tag", "wrong_answer"], []),
]


def test_validation_vectors(spark):
    rows = [(i, f"<reasoning>{r}</reasoning><final_answer>{a}</final_answer>{o}", "42", f) for i, (r, a, o, f, *_) in enumerate(RULES)]
    df = spark.createDataFrame(rows, "i int, raw_output string, gold_answer string, finish string")
    for r in validate(df, finish="finish").collect():
        *_, answer, steps, wrong, warned = RULES[r.i]
        assert (r.teacher_final_answer, r.numbered_step_count, r.validation_errors, r.format_warnings) == (answer, steps, wrong, warned), RULES[r.i]
        assert r.is_valid == (not wrong)


def test_rescue_takes_the_patterns_as_arguments(spark):
    text = "Step 1: First we pay the sum of $20 + $30 for it.\nStep 2: That makes fifty in all then."
    rows = [(1, f"<reasoning>{text}</reasoning><final_answer>50</final_answer>", "50", text, True, ["reasoning_lacks_calculation_detail"]), (2, f"<reasoning>{text}</reasoning><final_answer>50</final_answer>", "50", text, False, ["wrong_answer"])]
    df = spark.createDataFrame(rows, "problem_id int, raw_output string, gold_answer string, teacher_reasoning string, is_correct boolean, validation_errors array<string>")
    out = rescue(df, STRICT_CALCULATION, RESCUE_CALCULATION).collect()
    assert [r.problem_id for r in out] == [1] and out[0].student_target.endswith("<final_answer>50</final_answer>")


def steps(*s):
    return "\n".join(f"Step {i}: {x}" for i, x in enumerate(s, 1))


CLASSES = [
    ("q 6 7", steps("6 * 7 = 42"), "24", None, "correct_reasoning_wrong_extraction"),
    ("q 6 7", steps("6 * 7"), "43", None, "off_by_one"),
    ("q 6 7", steps("6 * 7"), "420", None, "unit_error"),
    ("q 6 7", steps("6 * 7"), "0", None, "unit_error"),
    ("q 6 7", steps("6 * 7 = 49"), "49", None, "arithmetic_mistake"),
    ("q 6 7", "1. take 6\n2. take 7\n3. done", "30", None, "premature_answer"),
    ("q 61 72", steps("a", "b", "c"), "30", None, "misunderstood_question"),
    ("q 6 7", steps("6", "7", "ok"), "84", None, "wrong_operation"),
    ("q 6 7", steps("6 and 7", "11", "13", "17"), "30", None, "hallucinated_reasoning"),
    ("take 6 then 7 after", steps("6", "7", "ok"), "30", None, "dropped_intermediate_step"),
    ("q 6 7", steps("zzzz 6", "7", "c", "d", "e", "f"), "30", "alpha beta gamma delta", "copied_irrelevant_teacher_pattern"),
    ("q 6 7", steps("6", "7", "c", "d"), "30", None, "other"),
]


def test_error_classes(spark):
    df = spark.createDataFrame([(i, c[0], c[1], "42", c[2], c[3]) for i, c in enumerate(CLASSES)], "i int, question string, reasoning string, gold_answer string, predicted_answer string, target string")
    got = {r.i: r.label for r in errors.classify(df, "target").collect()}
    assert got == {i: c[4] for i, c in enumerate(CLASSES)}
    assert sum(r.n for r in errors.class_counts(errors.classify(df)).collect()) == len(CLASSES)


@pytest.mark.parametrize("items, most, want", [([], 3, False), (["a"] * 3, 3, False), (["a", "b"] * 4, 3, True), (["a"] * 4, 3, True)])
def test_repetition(spark, items, most, want):
    df = spark.createDataFrame([(items,)], "x array<string>")
    assert df.select(T.repeated_more_than(F.col("x"), most)).first()[0] is want
