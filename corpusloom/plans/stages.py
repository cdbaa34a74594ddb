"""Stages: functions of a table to a table, chained; a pandas function of a batch can be one."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial, reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Stage(Protocol):
    """What every stage is: it declares a plan and runs nothing."""

    def __call__(self, df: DataFrame) -> DataFrame: ...


def stage(function: Callable[..., DataFrame], **options) -> Stage:
    """A stage from an operator and its options."""
    return partial(function, **options)


def pandas_stage(function: Callable[[pd.DataFrame], pd.DataFrame], schema: str | None = None) -> Stage:
    """The way out for what expressions cannot say: a function of one batch of rows, shipped by Arrow. The schema stays unless given."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return map(function, frames)

    return lambda df: df.mapInPandas(batches, schema or df.schema)


def chain(stages: Iterable[Stage]) -> Stage:
    """One stage of many, in order."""
    held = tuple(stages)
    return lambda df: reduce(lambda out, s: s(out), held, df)
