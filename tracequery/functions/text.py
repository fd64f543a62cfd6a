"""Tags, lines, sentences and other text functions as column expressions.

White space follows Python's notion (Unicode white space and U+001C to U+001F) unless stated otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x1c-\x1f]"
#: White space that ends no line.
SPACE_IN_LINE = r"(?U)[\s\x1f&&[^\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]]"
#: Line ends: CR LF, LF, VT, FF, CR, U+001C to U+001E, NEL, LS and PS.
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"


def staged(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Adds columns that later steps refer to by value.

    The planner merges neighbouring projections and moves filters below them, putting each column's
    expression in every place that uses it; a few steps of rules would grow without bound. A generator of
    one row stands in the way and is part of the generated code.
    """
    own = [c for c in df.columns if c not in cols]
    made = df.select(*own, *[c.alias(f"__s{i}") for i, c in enumerate(cols.values())])  # shares common parts
    return made.select(*own, F.inline(F.array(F.struct(*[F.col(f"__s{i}").alias(n) for i, n in enumerate(cols)]))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one blank."""
    return F.regexp_replace(c, f"{SPACE}+", " ")


def present(c: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(F.length(c) > 0, F.lit(False))


def words(c: Column) -> Column:
    """Words between white space; none for an empty text."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: F.length(w) > 0)


def word_count(c: Column) -> Column:
    return F.size(words(c))


def tag(c: Column, name: str) -> Column:
    """Stripped content of the first complete tag pair, in either case; null without one."""
    return strip(F.try_element_at(F.regexp_extract_all(c, F.lit(rf"(?is)<{name}>(.*?)</{name}>"), F.lit(1)), F.lit(1)))


def tag_structure(c: Column) -> Column:
    """What is wrong with the two tags: struct of missing and malformed flags for either.

    A tag is malformed unless it opens and closes once, in this order; absent is not malformed. If both
    are well formed but cross, nest or stand in the wrong order, both count as malformed.
    """

    marks = {"ro": "<reasoning>", "rc": "</reasoning>", "fo": "<final_answer>", "fc": "</final_answer>"}
    seen = [F.regexp_count(c, F.lit(f"(?i){m}")).alias(f"n_{k}") for k, m in marks.items()]
    seen += [F.regexp_instr(c, F.lit(f"(?i){m}")).alias(f"at_{k}") for k, m in marks.items()]

    def states(m: Column) -> Column:
        def of(x: str) -> list[Column]:
            opens, closes = m[f"n_{x}o"], m[f"n_{x}c"]
            missing = (opens == 0) & (closes == 0)
            bad = ~missing & ((opens != 1) | (closes != 1) | (m[f"at_{x}o"] > m[f"at_{x}c"]))
            return [missing.alias(f"{x}_missing"), bad.alias(f"{x}_bad")]

        # With one pair each, the answer must open after the reasoning has closed.
        return F.struct(*of("r"), *of("f"), (m["at_fo"] < m["at_rc"]).alias("wrong"))

    def flags(s: Column) -> Column:
        crossed = ~s["r_missing"] & ~s["f_missing"] & ~s["r_bad"] & ~s["f_bad"] & s["wrong"]
        return F.struct(
            s["r_missing"].alias("reasoning_missing"),
            s["f_missing"].alias("final_missing"),
            (s["r_bad"] | crossed).alias("reasoning_malformed"),
            (s["f_bad"] | crossed).alias("final_malformed"),
        )

    return let(let(F.struct(*seen), states), flags)


def outside_tags(c: Column) -> Column:
    """What is left of a text without its tag pairs, stripped."""
    for name in ("reasoning", "final_answer"):
        c = F.regexp_replace(c, rf"(?is)<{name}>.*?</{name}>", "")
    return strip(c)


def lines(c: Column) -> Column:
    """Lines that are not blank, in lower case with white space collapsed."""
    # White space other than line ends is collapsed in the whole text at once; blanks are left at the ends of lines.
    return F.filter(F.transform(F.split(F.regexp_replace(F.lower(c), f"{SPACE_IN_LINE}+", " "), LINE_END), F.trim), lambda x: F.length(x) > 0)


def sentences(c: Column, least: int = 12) -> Column:
    """Sentences of ``least`` characters or more, in lower case with white space collapsed."""
    parts = F.split(c, rf"(?<=[.!?]){SPACE}+|\n+")
    return F.transform(F.filter(F.transform(parts, strip), lambda x: F.length(x) >= least), lambda x: collapse(F.lower(x)))


def repeated_more_than(items: Column, most: int) -> Column:
    """True if some item occurs more than ``most`` times.

    Equal items are neighbours once sorted, so one sort and one pass that counts runs settle it however many
    items there are. ``items`` is evaluated once. Null items never repeat; a null array has no items.
    """
    start = F.struct(F.lit(None).cast("string").alias("item"), F.lit(0).alias("run"), F.lit(False).alias("hit"))

    def step(s: Column, item: Column) -> Column:
        same = F.coalesce(s["item"] == item, F.lit(False))
        return F.struct(item.alias("item"), F.when(same, s["run"] + 1).otherwise(1).alias("run"), (s["hit"] | (same & (s["run"] >= most))).alias("hit"))

    return F.coalesce(F.aggregate(F.sort_array(items), start, step, lambda s: s["hit"]), F.lit(False))


def numbered_steps(c: Column) -> Column:
    """Lines that start with a step number."""
    return F.regexp_count(c, F.lit(r"(?im)^\s*(?:step\s*)?\d+\s*[:.)-]"))


def named_steps(c: Column) -> Column:
    """Occurrences of ``Step N:`` in either case."""
    return F.regexp_count(c, F.lit(r"(?i)Step\s+\d+:"))


def reasoning_hash(c: Column) -> Column:
    return F.sha2(collapse(strip(F.lower(c))), 256)


def normalized_question(c: Column) -> Column:
    """Lower case, every run of other than letters, digits and underscore as one blank, stripped."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))


def gold_answer(c: Column) -> Column:
    """What follows the last ``####``, else the last word; without commas."""
    marked = strip(F.element_at(F.split(c, "####"), -1))
    return F.regexp_replace(F.when(F.contains(c, F.lit("####")), marked).otherwise(F.try_element_at(words(c), F.lit(-1))), ",", "")


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), r"\A_+|_+\z", "")
    return F.when(s == "", F.lit("model")).otherwise(s)


def overlap(target: Column, text: Column) -> Column:
    """Share of the target's distinct words of four letters or more that the text has too; null without any."""
    t, s = (F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("([a-z]{4,})"), F.lit(1))) for x in (target, text))
    return F.when(F.size(t) > 0, F.size(F.array_intersect(t, s)) / F.size(t))


def first_present(*cols: Column) -> Column:
    """The first value that is neither null nor empty; else an empty text."""
    return F.coalesce(*[F.when(present(c), c) for c in cols], F.lit(""))


def tags_in_order(flags: list[tuple[str, Column]]) -> Column:
    """Array of the names whose flag is true, in the order given."""
    return F.filter(F.array(*[F.when(F.coalesce(on, F.lit(False)), F.lit(name)) for name, on in flags]), lambda x: x.isNotNull())


def percent(c: Column, digits: int = 1) -> Column:
    """A share as text in percent; a dash for null."""
    return F.coalesce(F.format_string(f"%.{digits}f%%", c * 100), F.lit("—"))
