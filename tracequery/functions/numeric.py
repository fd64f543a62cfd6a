"""Numbers in text: extraction, exact comparison, arithmetic and equations."""

from __future__ import annotations

import re
from decimal import Decimal, InvalidOperation
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import let, present, strip, tag

#: A mixed number, a fraction, or a decimal or scientific number; fixed values.
STRICT = (
    r"[+-]?\d+\s+\d+\s*/\s*\d+"
    r"|[+-]?\d+\s*/\s*[+-]?\d+"
    r"|[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?"
)
CANDIDATE = (
    r"[+-]?\d+\s+\d+\s*/\s*\d+%?"
    r"|[+-]?\d+\s*/\s*[+-]?\d+%?"
    r"|[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?%?"
)
#: An answer phrase, an equation and a number in the error rules; fixed values.
PHRASE = r"(?:final\s+answer|answer)\s*(?:is|:|=)\s*([^\n<]+)"
EQUATION = r"(-?\d[\d,]*(?:\.\d+)?)\s*([+\-*/x×])\s*(-?\d[\d,]*(?:\.\d+)?)\s*=\s*(-?\d[\d,]*(?:\.\d+)?)"
NUMBER = r"-?\d[\d,]*(?:\.\d+)?"
#: Characters dropped from numbers by the generator's and by the evaluator's rules.
GENERATOR_SIGNS, EVALUATOR_SIGNS = ",$€£", ",$€£₹"


def normalized(c: Column, signs: str = EVALUATOR_SIGNS) -> Column:
    """Without thousands separators, currency signs and a box around the number; stripped."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), f"[{signs}]", ""), r"\\boxed\{|\}", ""))


def is_strict(c: Column) -> Column:
    """True if the stripped text is one number and nothing else."""
    return F.coalesce(strip(c).rlike(rf"\A(?:{STRICT})\z"), F.lit(False))


def candidates(c: Column, signs: str = EVALUATOR_SIGNS) -> Column:
    """All numbers in a text, left to right."""
    return F.coalesce(F.regexp_extract_all(normalized(c, signs), F.lit(f"({CANDIDATE})"), F.lit(1)), F.array().cast("array<string>"))


def tidy(c: Column) -> Column:
    """A candidate with single blanks and none around a slash."""
    return F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r"\s*/\s*", "/")


def first_number(c: Column, signs: str = EVALUATOR_SIGNS) -> Column:
    return tidy(F.try_element_at(candidates(c, signs), F.lit(1)))


def last_number(c: Column, signs: str = EVALUATOR_SIGNS) -> Column:
    return tidy(F.try_element_at(candidates(c, signs), F.lit(-1)))


def phrase(c: Column, flags: str = "i") -> Column:
    """What follows an answer phrase on its line; null without one."""
    return F.when(c.rlike(f"(?{flags}){PHRASE}"), F.regexp_extract(c, f"(?{flags}){PHRASE}", 1))


def loose_answer(c: Column) -> Column:
    """The generator's fallback: the number in a tag, else in an answer phrase, else the last one."""
    return F.coalesce(first_number(tag(c, "final_answer"), GENERATOR_SIGNS), first_number(phrase(c), GENERATOR_SIGNS), last_number(c, GENERATOR_SIGNS))


def committed_answer(c: Column) -> Column:
    """The evaluator's fallback as struct (answer, ambiguous): a phrase or a sentence that names two numbers
    does not commit to one."""
    either = c.rlike(rf"(?i)(?:{CANDIDATE})\s+or\s+(?:{CANDIDATE})")

    def judged(found: Column) -> Column:
        several = F.coalesce((F.size(found) > 1) | ((F.size(found) < 1) & either), F.lit(False))
        return F.struct(found.alias("found"), several.alias("ambiguous"))

    def settled(s: Column) -> Column:
        one = F.when(F.size(s["found"]) == 1, tidy(F.try_element_at(s["found"], F.lit(1)))).otherwise(last_number(c))
        return F.struct(F.when(~s["ambiguous"], one).alias("answer"), s["ambiguous"].alias("ambiguous"))

    return let(let(candidates(phrase(c)), judged), settled)


_PLAIN = r"\A[+-]?\d{1,18}(?:\.\d{0,18})?\z"
_FRACTION = r"\A([+-]?\d{1,15})/(\d{1,15})\z"


def parse_rational(value: str | None) -> Fraction | None:
    """The exact value of a number text; null if it is none.

    Percent signs divide by 100; a negative mixed number subtracts its fraction. Not finite numbers and
    exponents beyond 400 are none.
    """
    if value is None:
        return None
    text = value.strip()
    percent = text.endswith("%")
    text = text[:-1] if percent else text
    try:
        mixed = re.fullmatch(r"(-?\d+)\s+(\d+)\s*/\s*(\d+)", text)
        if mixed:
            whole, part = int(mixed[1]), Fraction(int(mixed[2]), int(mixed[3]))
            out = whole - part if whole < 0 else whole + part
        elif "/" in text:
            out = Fraction(text)
        else:
            number = Decimal(text)
            if not number.is_finite() or number and abs(number.adjusted()) > 400:
                return None
            out = Fraction(number)
    except (ValueError, ZeroDivisionError, InvalidOperation):
        return None
    return out / 100 if percent else out


@F.pandas_udf(StringType())
def _rational(values: pd.Series) -> pd.Series:
    def canonical(v):
        f = None if v is None else parse_rational(v)
        return None if f is None else f"{f.numerator}/{f.denominator}"

    return values.map(canonical)


def rational(c: Column) -> Column:
    """Canonical ``n/d`` of a number text; null if it is none. Exact for any size, through Arrow."""
    return _rational(c)


def decimal_value(c: Column) -> Column:
    """The value of a plain decimal number; null for all other texts."""
    t = strip(c)
    return F.when(t.rlike(_PLAIN), t.try_cast("decimal(38,18)"))


def same_number(a: Column, b: Column, arrow: bool = True, stripped: bool = False) -> Column:
    """True if both texts are numbers of exactly equal value. ``stripped`` says that they have no white space
    around them, which spares looking for it.

    Plain decimals, and a fraction of integers against an integer or fraction, are compared in the JVM.
    With ``arrow``, all other forms (percent, mixed, scientific, long) go through :func:`rational`, which
    sees null for the rows that are settled; without it they count as different unless the texts are equal.
    """
    x, y = (a, b) if stripped else (strip(a), strip(b))

    def part(t: Column, group: int, whole: Column) -> Column:
        return F.when(t.rlike(_FRACTION), F.regexp_extract(t, _FRACTION, group).try_cast("decimal(19,0)")).when(t.rlike(r"\A[+-]?\d{1,15}\z"), whole)

    plain = x.rlike(_PLAIN) & y.rlike(_PLAIN)
    equal_plain = x.try_cast("decimal(38,18)") == y.try_cast("decimal(38,18)")
    (n1, d1), (n2, d2) = ((part(t, 1, t.try_cast("decimal(19,0)")), part(t, 2, F.lit(1).cast("decimal(19,0)"))) for t in (x, y))
    parts = n1.isNotNull() & n2.isNotNull()
    equal_parts = (d1 != 0) & (d2 != 0) & (n1 * d2 == n2 * d1)
    settled = F.coalesce(plain | parts, F.lit(False))
    if arrow:
        rest = rational(F.when(~settled, x)) == rational(F.when(~settled, y))
    else:
        rest = (x == y) & x.rlike(r"\d")
    return F.coalesce(F.when(plain, equal_plain).when(parts, equal_parts).otherwise(rest), F.lit(False))


def lenient_float(c: Column) -> Column:
    """A double after dropping commas and dollar signs; null if it is none."""
    return strip(F.regexp_replace(c, "[,$]", "")).try_cast("double")


def close_to(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    return F.coalesce(F.abs(a - b) < tolerance, F.lit(False))


def numbers(c: Column) -> Column:
    """Numbers as written, for the error rules."""
    return F.coalesce(F.regexp_extract_all(c, F.lit(f"({NUMBER})"), F.lit(1)), F.array().cast("array<string>"))


def unused_numbers(question: Column, text: Column, common: tuple[str, ...] = ("1", "2")) -> Column:
    """Distinct numbers of a question, as written, that a text does not have; ``common`` ones do not count."""
    return F.array_except(F.array_except(numbers(question), numbers(text)), F.array(*map(F.lit, common)))


def far_values(values: Column, known: Column, tolerance: float = 1e-6) -> Column:
    """Distinct values that are further than ``tolerance`` from all known ones."""
    return F.array_distinct(F.filter(values, lambda v: F.forall(known, lambda x: F.abs(v - x) > tolerance)))


def equations(c: Column) -> Column:
    """Every ``a op b = c`` as an array of struct (a, op, b, c, value); value is what the left side gives."""
    sides = F.arrays_zip(*[F.regexp_extract_all(c, F.lit(EQUATION), F.lit(g)).alias(n) for g, n in enumerate("aobc", 1)])

    def evaluated(e: Column) -> Column:
        x, y = (F.regexp_replace(e[k], ",", "").cast("double") for k in "ab")
        value = F.when(e["o"] == "+", x + y).when(e["o"] == "-", x - y).when(e["o"].isin("*", "x", "×"), x * y).when(e["o"] == "/", F.try_divide(x, y))
        return F.struct(e["a"].alias("a"), e["o"].alias("op"), e["b"].alias("b"), F.regexp_replace(e["c"], ",", "").cast("double").alias("c"), value.alias("value"))

    return F.transform(F.coalesce(sides, F.array().cast("array<struct<a:string,o:string,b:string,c:string>>")), evaluated)


def wrong_equations(c: Column) -> Column:
    """Equations off by more than 0.001 and by more than one percent of the true value (at least of 1)."""

    def off(e: Column) -> Column:
        gap = F.abs(e["value"] - e["c"])
        return F.coalesce((gap > 1e-3) & (gap / F.greatest(F.abs(e["value"]), F.lit(1.0)) > 0.01), F.lit(False))

    return F.filter(equations(c), off)


def rate(n: Column, total: Column) -> Column:
    """A share; zero of nothing."""
    return F.when(total > 0, n / total).otherwise(F.lit(0.0))
