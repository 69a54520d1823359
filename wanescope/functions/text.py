"""Answer parsing, grading and text features as Column expressions. Digits are written [0-9] so that all regex engines agree."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NUMBER = r"(-?[0-9]+\.?[0-9]*)"


def clean_choice(c: Column) -> Column:
    """A choice without its `A)`-like prefix."""
    return F.trim(F.regexp_replace(c, r"^\s*[A-Da-d][).:]\s*", ""))


def first_letter(s: Column, letters: str = "ABCD") -> Column:
    found = F.regexp_extract(F.upper(F.trim(s)), f"[{letters}]", 0)
    return F.when(found != "", found)


def index_letter(i: Column) -> Column:
    return F.char((i + 65).cast("int"))


def first_digit(s: Column) -> Column:
    found = F.regexp_extract(s, "[0-9]", 0)
    return F.when(found != "", found.cast("int"))


def grade_mc(response: Column, gold: Column) -> Column:
    """1 for the right letter, 0 for another or none, null for no response."""
    return F.when(response.isNull(), F.lit(None)).when(first_letter(response).eqNullSafe(gold), 1).otherwise(0).cast("int")


def _last(found: Column) -> Column:
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def final_answer(s: Column) -> Column:
    """What follows `####`, without commas, else the last number of the text."""
    marked = F.regexp_replace(F.regexp_extract(s, r"####\s*([-0-9,.]+)", 1), ",", "")
    return F.coalesce(F.when(marked != "", marked), _last(F.regexp_extract_all(s, F.lit(NUMBER), F.lit(1))))


def marked_line(s: Column) -> Column:
    """The rest of the line after `####`, trimmed."""
    found = F.trim(F.regexp_extract(s, r"####[ \t]*([^\n]+)", 1))
    return F.when(found != "", found)


def grade_numeric(answer: Column, gold: Column, tolerance: float = 1e-4) -> Column:
    """Numeric equality within a tolerance; what isn't a number is wrong."""
    a, b = answer.try_cast("double"), gold.try_cast("double")
    return F.coalesce(F.when(F.abs(a - b) < tolerance, 1).otherwise(0), F.lit(0))


def boxed(text: str | None) -> str | None:
    """All that follows the last `####`; else the content of the last \\boxed{...} with balanced braces; else the last line of the text."""
    if text is None:
        return None
    if "####" in text:
        return text.rsplit("####", 1)[1].strip()
    at = text.rfind("\\boxed{")
    if at >= 0:
        depth, start = 1, at + 7
        for i in range(start, len(text)):
            depth += {"{": 1, "}": -1}.get(text[i], 0)
            if not depth:
                return text[start:i].strip()
    return text.strip().rsplit("\n", 1)[-1].strip()


@F.pandas_udf(StringType())
def boxed_answer(s: pd.Series) -> pd.Series:
    """`boxed` over a column: matching braces isn't regular."""
    return s.map(boxed, na_action="ignore")


def normalize_answer(s: Column) -> Column:
    """Lower case without `$`, thin spaces and blanks; \\frac{a}{b} as a/b."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(s), r"\$|\\,|\\!|\s+", ""), r"\\left|\\right", "")
    return F.regexp_replace(bare, r"\\d?frac\{([^{}]*)\}\{([^{}]*)\}", r"$1/$2")


def answers_match(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Equal after normalising, or both numbers within the tolerance; a/b counts as a number, commas between digits don't matter."""

    def number(x: Column) -> Column:
        x = F.replace(x, F.lit(","), F.lit(""))
        top, low = F.split_part(x, F.lit("/"), F.lit(1)), F.split_part(x, F.lit("/"), F.lit(2))
        ratio = top.try_cast("double") / F.nullif(low.try_cast("double"), F.lit(0.0))
        return F.when(F.contains(x, F.lit("/")), ratio).otherwise(x.try_cast("double"))

    x, y = normalize_answer(a), normalize_answer(b)
    return F.coalesce((x == y) | (F.abs(number(x) - number(y)) < tolerance), F.lit(False))


def gold_index(labels: Column, key: Column) -> Column:
    """Place of the answer key among the labels, from 0; null if it isn't there."""
    return F.nullif(F.array_position(labels, key), F.lit(0)) - 1


def gold_first(options: Column, i: Column) -> Column:
    return F.concat(F.array(F.get(options, i)), F.filter(options, lambda _, j: j != i))


def op_count(s: Column) -> Column:
    return F.size(F.regexp_extract_all(s, F.lit(r"(<<[^>]*>>)"), F.lit(1)))


def final_integer(s: Column) -> Column:
    """The number after `####` if it is integral."""
    v = F.regexp_extract(s, r"####\s*([-0-9.]+)", 1).try_cast("double")
    return F.when(v == F.floor(v), v.cast("bigint"))


def all_numbers(s: Column) -> Column:
    return F.transform(F.regexp_extract_all(s, F.lit(NUMBER), F.lit(1)), lambda x: x.try_cast("double"))


OPERATION = r"<<\s*(-?[0-9.]+)\s*([-+*/])\s*(-?[0-9.]+)\s*=\s*(-?[0-9.]+)\s*>>"


def operands(s: Column) -> Column:
    """array<struct<a, op, b, c>> of every `<<a op b = c>>`."""
    part = [F.regexp_extract_all(s, F.lit(OPERATION), F.lit(i)) for i in (1, 2, 3, 4)]
    zipped = F.arrays_zip(*[p.alias(n) for p, n in zip(part, "aobc")])
    return F.transform(zipped, lambda x: F.struct(x["a"].try_cast("double").alias("a"), x["o"].alias("op"), x["b"].try_cast("double").alias("b"), x["c"].try_cast("double").alias("c")))


def digit_count(x: Column) -> Column:
    """Digits of an integral value; else of its text without point, sign and leading zeros."""
    text = F.regexp_replace(F.regexp_replace(F.abs(x).cast("string"), r"\.", ""), "^0+", "")
    return F.when(x == F.floor(x), F.length(F.abs(x).cast("bigint").cast("string"))).otherwise(F.length(text))


def digit_sum(n: Column) -> Column:
    return F.aggregate(F.split(F.abs(n).cast("string"), ""), F.lit(0), lambda a, d: a + F.coalesce(d.try_cast("int"), F.lit(0)))


def carry_count(a: Column, b: Column) -> Column:
    """Carries when adding two non-negative integers: each takes 9 from the digit sum."""
    return ((digit_sum(a) + digit_sum(b) - digit_sum(a + b)) / 9).cast("int")


def max_digits(numbers: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(numbers, digit_count)), F.lit(0))


def sum_digits(numbers: Column) -> Column:
    return F.aggregate(F.transform(numbers, digit_count), F.lit(0), lambda a, x: a + x)


def strip_fences(s: Column) -> Column:
    """Code without Markdown fence lines."""
    return F.btrim(F.regexp_replace(s, r"(?m)^```[A-Za-z0-9]*[ \t]*$\n?", ""), F.lit(" \t\r\n"))


def function_name(code: Column) -> Column:
    found = F.regexp_extract(code, r"def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", 1)
    return F.when(found != "", found)


def rename(tests: Column, old: Column, new: Column) -> Column:
    return F.replace(tests, old, new)


def json_object(s: Column) -> Column:
    """From the first brace to the last one."""
    found = F.regexp_extract(s, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def repair_quotes(s: Column) -> Column:
    return F.replace(s, F.lit("'"), F.lit('"'))


def mc_prompt(question: Column, choices: Column, tail: str = "Answer with one letter.") -> Column:
    lines = F.transform(choices, lambda c, i: F.concat(F.char((i + 65).cast("int")), F.lit(") "), c))
    return F.concat_ws("\n", question, F.array_join(lines, "\n"), F.lit(tail))


def short_name(model: Column, replacements: dict[str, str]) -> Column:
    for old, new in replacements.items():
        model = F.replace(model, F.lit(old), F.lit(new))
    return model


def shade(points: Column) -> Column:
    return F.when(points >= 8, "dark").when(points >= 3, "medium").when(points >= 0, "light").otherwise("negative")


def month_start(s: Column) -> Column:
    """`yyyy-MM` as a date."""
    return F.to_date(F.concat(s, F.lit("-01")))


def arithmetic_features(answer: Column) -> dict[str, Column]:
    """Counts of operations, digits and carries of a worked answer."""
    ops = operands(answer)
    whole = F.filter(ops, lambda x: x["op"].isin("+", "-") & (x["a"] >= 0) & (x["b"] >= 0) & (x["a"] == F.floor(x["a"])) & (x["b"] == F.floor(x["b"])))
    carries = F.aggregate(F.transform(whole, lambda x: carry_count(x["a"].cast("bigint"), x["b"].cast("bigint"))), F.lit(0), lambda a, x: a + x)
    sides = F.flatten(F.transform(ops, lambda x: F.array(x["a"], x["b"])))
    results = F.transform(ops, lambda x: x["c"])
    return {"n_ops": op_count(answer), "max_operand_digits": max_digits(sides), "sum_operand_digits": sum_digits(sides), "max_result_digits": max_digits(results), "carries": carries, "n_numbers": F.size(all_numbers(answer))}


REASONS = ["kept", "op_count", "final_type", "same_final", "same_text", "few_correct"]


def subset_reason(orig_answer: Column, pert_answer: Column, orig_text: Column, pert_text: Column, n_correct: Column, min_correct: int = 6) -> Column:
    """The first rule of the verified subset that an item fails, else `kept`."""
    a, b = final_integer(orig_answer), final_integer(pert_answer)
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    return F.when(bad((op_count(orig_answer) == op_count(pert_answer)) & (op_count(orig_answer) >= 1)), "op_count").when(bad((a > 0) & (b > 0)), "final_type").when(bad(a != b), "same_final").when(bad(F.trim(orig_text) != F.trim(pert_text)), "same_text").when(bad(n_correct >= min_correct), "few_correct").otherwise("kept")
