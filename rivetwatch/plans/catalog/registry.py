"""Query registration and the shared SQL views."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from .. import sensor_view as v

_TOPICS = ("cleaning", "tables", "statistics", "quality", "models", "fleet", "live", "runs")
_QUERIES: dict[str, "Query"] = {}


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


# Views shared by the SQL side, each with the views it builds on.
_CORE = ("temperature", "vibration", "pressure", "rpm")
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "readings": ((), v.READINGS_SQL),
    "gaps": (("readings",), v.GAPS_SQL),
    "life": (("readings",), v.LIFE_SQL),
    "text_cells": (("readings",), v.TEXT_SQL),
    "maintenance": ((), v.MAINTENANCE_SQL),
    "costs": ((), v.COSTS_SQL),
    "engine": (("readings",), v.ENGINE_SQL),
    "scored": (("readings",), v.SCORED_SQL),
    "preds": (("readings",), v.PREDICTIONS_SQL),
    "filled": (("gaps",), "SELECT * REPLACE (" + ", ".join(
        f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in _CORE
    ) + ') FROM gaps WINDOW w AS (PARTITION BY machine_id ORDER BY "timestamp", event_id ROWS UNBOUNDED PRECEDING)'),
    "redlines": (("readings",), v.redline_sql("readings", v.DEFAULT_RULES)),
    "physics": (("redlines",), v.physics_summary_sql("redlines")),
    "health": (("readings", "preds"), v.health_sql("readings", v.PLANT_SENSORS)),
    "ranked": (("scored", "preds"), v.RANKED_SQL),
    "drivers": (("readings", "preds"), v.DRIVERS_SQL),
    "items": (("preds", "physics", "health", "drivers"), v.ITEMS_SQL),
    "assets": (("readings", "items", "health", "physics", "preds"), v.ASSETS_SQL),
    "slow": (("throughput",), v.SLOW_SQL),
    "throughput": (("readings",), v.THROUGHPUT_SQL),
}


def sql(views: str, body: str, **more: str) -> str:
    """``body`` behind a WITH list of the named shared views (and what they need) and of ``more``."""
    ordered: list[str] = []

    def add(name: str) -> None:
        needs, _ = VIEWS[name]
        for n in needs:
            add(n)
        if name not in ordered:
            ordered.append(name)

    for name in views.split():
        add(name)
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in ordered] + [f"{n} AS ({b})" for n, b in more.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def query(name: str, oracle: str | None = None):
    def keep(run):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = Query(run, oracle)
        return run

    return keep


def all_queries() -> dict[str, Query]:
    for topic in _TOPICS:
        importlib.import_module(f"{__package__}.{topic}")
    return dict(_QUERIES)
