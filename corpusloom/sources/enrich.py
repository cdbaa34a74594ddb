"""Attributes from a service, one call a name: resumable, and no call's failure stops the rest."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from corpusloom.sources.commits import without_done


def enrich(names: DataFrame, fetch: Callable[[str], dict], schema: str, done: DataFrame | None = None, key: str = "name", pause: float = 0.0) -> DataFrame:
    """key and the columns of ``schema`` for the names that ``done`` does not hold yet; nulls where the call fails.

    Each task pauses between its calls, for services that limit their rate; write the result with ``append_rows`` and
    pass what is written as ``done`` to go on after a stop.
    """
    columns = [c.split(" ")[0] for c in schema.split(", ")]
    left = (names if done is None else without_done(names, done, key)).select(key)

    def called(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name in batch[key]:
                try:
                    found = fetch(name)
                except Exception:  # noqa: BLE001  whatever the service's client raises
                    found = {}
                rows.append([name, *(found.get(c) for c in columns)])
                time.sleep(pause)
            yield pd.DataFrame(rows, columns=[key, *columns], dtype=object)

    return left.mapInPandas(called, f"{key} string, {schema}")
