"""Registered queries: name -> (function of session and folder, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def all_entries() -> dict[str, tuple[Query, str | None]]:
    from . import documents, evaluation, fitting, joins, more, statistics, vectors, windows

    out: dict[str, tuple[Query, str | None]] = {}
    for module in (vectors, statistics, windows, joins, documents, evaluation, fitting, more):
        clash = out.keys() & module.ENTRIES.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= module.ENTRIES
    return out
