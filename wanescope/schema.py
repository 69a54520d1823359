"""Canonical frames as Spark types, and probing of column names."""

from __future__ import annotations

from pyspark.sql import DataFrame

SCORES = "benchmark string, model string, score double, eval_date timestamp"
HISTORY = "benchmark string, model string, score double, release_date date, source string"
RESPONSES = "benchmark string, model string, item bigint, version string, correct int"
ITEM_PARAMS = "benchmark string, epoch string, item bigint, a double, b double"
MODEL_DIM = "model string, ord int, t_year double, vendor string, cutoff string, release string"

#: Names under which a date or a score may come, in order of preference.
DATE_NAMES = ("eval_date", "date", "release_date", "submission_date")
SCORE_NAMES = ("score", "accuracy", "acc", "value")


def detect_columns(df: DataFrame, date_col: str | None = None, score_col: str | None = None) -> tuple[str, str]:
    """The date and score columns of a frame; names given win over probed ones."""
    have = set(df.columns)
    date = date_col or next((c for c in DATE_NAMES if c in have), None)
    score = score_col or next((c for c in SCORE_NAMES if c in have), None)
    if date not in have or score not in have:
        raise ValueError(f"no date column of {DATE_NAMES} or no score column of {SCORE_NAMES} among {sorted(have)}")
    return date, score
