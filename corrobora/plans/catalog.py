"""Registry of queries: one entry per operator, with its SQL twin where SQL can state it."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from corrobora.plans import views
from corrobora.session import ship


@dataclass(frozen=True)
class Entry:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    reason: str | None     # why there is no SQL twin


ENTRIES: dict[str, Entry] = {}


def query(name: str, oracle: str | None = None, reason: str | None = None):
    """Register ``fn(tables)`` under ``name``. ``oracle`` is the body; view CTEs are prepended."""
    if oracle is None and reason is None:
        raise ValueError(f"{name}: state an oracle or a reason for having none")

    def register(fn):
        if name in ENTRIES:
            raise ValueError(f"duplicate query {name}")
        def run(spark, sf_dir):
            ship(spark)
            return fn(views.Tables(spark, sf_dir))
        ENTRIES[name] = Entry(name, run, views.with_views(oracle) if oracle else None, reason)
        return fn
    return register


def load_all() -> dict[str, Entry]:
    from corrobora.plans import (  # noqa: F401
        scans, expressions, retrieval, linking, entities, evidence, accounting, ranking, quality,
        streams)
    return ENTRIES
