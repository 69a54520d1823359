"""Solvers and perturbers: whatever answers or rewrites items, plugged in behind small protocols.

A cluster run deals items out as partitions and calls the plug-in in each; `parallelism` bounds concurrent calls. Shipped are only
deterministic offline stand-ins: no network client, and no execution of generated code (pass or fail is taken in as a column).
"""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Solver(Protocol):
    name: str

    def __call__(self, prompt: str) -> str | None: ...


class Perturber(Protocol):
    def __call__(self, text: str) -> str | None: ...


@dataclass(frozen=True)
class Retry:
    """Exponential backoff with jitter; what still fails after `tries` is no answer."""

    tries: int = 5
    first_wait: float = 1.0
    factor: float = 2.0
    jitter: float = 0.5
    sleep: Callable[[float], None] = time.sleep

    def __call__(self, call: Callable[[], str | None]) -> str | None:
        for i in range(self.tries):
            try:
                return call()
            except Exception:  # noqa: BLE001  any failure of a remote call counts as one
                if i + 1 < self.tries:
                    self.sleep(self.first_wait * self.factor**i * (1 + self.jitter * random.random()))
        return None


class FirstLetter:
    """Offline stand-in that always answers A."""

    name = "first-letter"

    def __call__(self, prompt: str) -> str:
        return "A"


class ShiftNumbers:
    """Offline stand-in that adds one to every integer of a text."""

    def __call__(self, text: str) -> str:
        return re.sub(r"\d+", lambda m: str(int(m.group()) + 1), text)


def _mapped(items: DataFrame, column: str, out: str, call: Callable[[str], str | None], parallelism: int, retry: Retry) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{out: [None if x is None else retry(lambda x=x: call(x)) for x in pdf[column]]})

    return items.repartition(parallelism).mapInPandas(run, f"{items._jdf.schema().toDDL()}, {out} string")


def solve(items: DataFrame, solver: Solver, prompt: str = "prompt", parallelism: int = 16, retry: Retry = Retry()) -> DataFrame:
    """items with `response` and `model`; a failure is null, as not evaluated."""
    return _mapped(items, prompt, "response", solver, parallelism, retry).withColumn("model", F.lit(solver.name))


def perturb(items: DataFrame, perturber: Perturber, column: str = "text", parallelism: int = 16, retry: Retry = Retry()) -> DataFrame:
    return _mapped(items, column, f"pert_{column}", perturber, parallelism, retry)


def agreed(items: DataFrame, one: str, two: str) -> DataFrame:
    """Items on whose answer two solvers agree."""
    from wanescope.functions.text import answers_match

    return items.where(answers_match(F.col(one), F.col(two)))


def hub_scores(raw: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A pulled table with its columns renamed to ours and incomplete rows dropped; the pull itself is the caller's."""
    return raw.select(*[F.col(old).alias(new) for old, new in columns.items()]).dropna()
