"""All registered queries of the engine, side by side with their oracles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "e1_clusters"
Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    run: Query
    oracle: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with its DuckDB oracle, if SQL can say it."""

    def add(run: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"registered twice: {name}")
        ENTRIES[name] = Entry(run, oracle)
        return run

    return add


def _load() -> None:
    from . import q_aggregates, q_clusters, q_dataset, q_dayloop, q_features, q_joins, q_labels, q_models, q_more, q_portfolio, q_rows, q_streams, q_windows  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return {k: e.run for k, e in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: e.oracle for k, e in ENTRIES.items() if e.oracle}
