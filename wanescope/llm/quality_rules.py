"""Quality rules as a short-circuit cascade, with DataFrame functions only.

The contract's base counts are computed for every text. The further rules are ordered by a plan: on a hash sample of the rows each
rule's selectivity (rows it rejects, among those the rules before it leave) and its cost (characters that it reads in those rows) are
summed up. The rule with the most rejections per cost goes next. The chosen order becomes one CASE chain, so a row stops at its first failing rule. Which rows are kept doesn't depend on the order, so not on
the sample; only the named reason does.

Nulls: a null text has no words; it fails the base rule. Empty, blank and very long texts are whole texts like any other. Repeated
rows come back as often as they came; other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wanescope.llm.common import BLANK_RUN, BLANKS, let

#: The symbols that count as such.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SAMPLE_OF = 64


def removed(text: Column, pattern: str) -> Column:
    """How many characters of a text a pattern of one character class matches."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def base_counts(text: Column) -> list[dict[str, Column]]:
    """Column expressions over `text`, in steps: each may use the columns of the steps before it."""
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    core = F.btrim(full, F.lit(BLANKS.decode()))
    return [
        {"_words": F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, BLANK_RUN)), "_lines": lines, "n_symbols": removed(full, f"[{SYMBOLS}]+").cast("long")},
        {"_windows": window_keys(F.col("_words")), "n_words": F.size("_words").cast("long"), "word_chars": F.length(F.array_join("_words", "")).cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "n_lines": F.size("_lines").cast("long")},
        {"_places": repeated_places(F.col("_windows"))},
        {"n_repeat_words": covered(F.col("_places"))},
    ]


WINDOW = 3


def window_keys(words: Column, n: int = WINDOW) -> Column:
    """The hashes of all n-word windows with their places, sorted; windows are told apart by a 64-bit hash of their words."""
    key = lambda w: lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(n)]).alias("h"), i.alias("i"))
    keys = lambda w: F.when(F.size(w) > n, F.transform(F.sequence(F.lit(0), F.size(w) - n), key(w))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    return F.sort_array(let(words, keys))


def repeated_places(keys: Column) -> Column:
    """Where windows begin that equal a neighbour in the sorted keys, in text order."""
    twice = let(keys, lambda s: F.filter(s, lambda x, k: x["h"].eqNullSafe(F.get(s, k + 1)["h"]) | x["h"].eqNullSafe(F.get(s, k - 1)["h"])))
    return F.sort_array(F.transform(twice, lambda x: x["i"]))


def covered(places: Column, n: int = WINDOW) -> Column:
    """Words that the windows at these places cover: what each adds before the next one."""
    each = let(places, lambda p: F.transform(p, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(p, k + 1) - x, F.lit(n)))))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)


@dataclass(frozen=True)
class Rule:
    """fails: over the columns of `base_counts` and the text; reads: how many characters the expression looks at in a row, 1 for counts."""

    name: str
    fails: Column
    reads: Column


def default_rules(text: str = "text") -> list[Rule]:
    """Fixed thresholds after published web-corpus filters (mean word length, symbols, repeated lines and windows, letters, stop bullets)."""
    full, words = F.coalesce(F.col(text), F.lit("")), F.col("n_words")
    one, all_chars, line_starts = F.lit(1), F.length(full), 8 * F.size("_lines")
    others = removed(full, "[^\\p{L}\\x20\\x09-\\x0D]+")
    return [
        Rule("too_many_words", words > 100_000, one),
        Rule("mean_word_length", (F.col("word_chars") < 3 * words) | (F.col("word_chars") > 10 * words), one),
        Rule("symbol_share", 10 * F.col("n_symbols") > words, one),
        Rule("duplicate_lines", 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"), one),
        Rule("repeated_windows", 10 * F.col("n_repeat_words") > 3 * words, one),
        Rule("few_letters", 10 * others > 3 * F.col("word_chars"), all_chars),
        Rule("shouting", 2 * removed(full, "\\p{Lu}+") > F.col("word_chars"), all_chars),
        Rule("bullet_lines", 10 * F.size(F.filter("_lines", lambda x: x.rlike("^[\\x20\\t]*[-*\\u2022]"))) > 9 * F.col("n_lines"), line_starts),
        Rule("ellipsis_lines", 10 * F.size(F.filter("_lines", lambda x: x.rlike("(\\.\\.\\.|\\u2026)[\\x20\\t]*$"))) > 3 * F.col("n_lines"), all_chars),
    ]


def with_base(docs: DataFrame, text_col: str = "text") -> DataFrame:
    out = docs
    for step in base_counts(F.col(text_col)):
        out = out.withColumns(step)
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def planned(docs: DataFrame, rules: list[Rule], text_col: str = "text", sample_of: int = SAMPLE_OF) -> list[Rule]:
    """The rules by rejections per cost, both summed up on a sample: what each rejects of the rows that those before it leave, and the
    characters that it reads there. The sample (one row of `sample_of` by a hash of the text) sets the order alone; its patterns of failing
    rules, not its rows, come to the driver: at most 2 to the number of rules."""
    sample = with_base(docs.where(F.pmod(F.xxhash64(text_col), F.lit(sample_of)) == 0).select(F.col(text_col)), text_col)
    bits = F.lit(0)
    for i, r in enumerate(rules):
        bits = bits + F.when(F.coalesce(r.fails, F.lit(False)), 1 << i).otherwise(0)
    costs = [F.sum(F.col(f"reads_{i}")).alias(f"reads_{i}") for i in range(len(rules))]
    marked = sample.select(F.when(~F.col("base_failed"), bits).alias("bits"), *[r.reads.cast("double").alias(f"reads_{i}") for i, r in enumerate(rules)])
    seen = {r["bits"]: r for r in marked.where("bits is not null").groupBy("bits").agg(F.count("*").alias("n"), *costs).collect()}
    order, left = [], list(range(len(rules)))
    while left:
        cost = {i: max(1.0, sum(r[f"reads_{i}"] or 0 for r in seen.values())) for i in left}
        gain = {i: sum(r["n"] for b, r in seen.items() if b >> i & 1) / cost[i] for i in left}
        best = max(left, key=lambda i: (gain[i], -cost[i], -i))
        order.append(rules[best])
        left.remove(best)
        seen = {b: r for b, r in seen.items() if not b >> best & 1}
    return order


def cascade(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """docs' rows with the base counts, base_failed, kept, and reason: the first rule that a row fails in the planned order."""
    clash = [c for c in docs.columns if c in {"_words", "_lines", "_windows", "_places", "n_lines", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reason"} and c != text_col]
    docs = docs.drop(*clash)  # columns of ours replace any of the same name
    order = planned(docs, rules or default_rules(text_col), text_col)
    reason = F.when(F.col("base_failed"), F.lit("base"))
    for r in order:
        reason = reason.when(r.fails, F.lit(r.name))
    return with_base(docs, text_col).withColumn("reason", reason).withColumn("kept", F.col("reason").isNull()).drop("_words", "_lines", "_windows", "_places")
