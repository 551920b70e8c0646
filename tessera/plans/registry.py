"""Query registry: name -> (Spark plan builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    fn: QueryFn
    oracle: str | None
    ids: str


_REGISTRY: dict[str, Entry] = {}


def query(name: str, oracle: str | None = None, ids: str = "") -> Callable[[QueryFn], QueryFn]:
    """Register ``fn(spark, sf_dir) -> DataFrame`` with its oracle SQL."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = Entry(name, fn, oracle, ids)
        return fn

    return deco


PLAN_MODULES = ("nlq", "catalog_q", "text_q", "chat_q", "vector_q", "answer_q", "assistant_q",
                "graph_q", "feedback_q", "match_q", "keywords_q")


def _load_all() -> None:
    # importing the plan modules fills the registry
    import importlib

    for m in PLAN_MODULES:
        importlib.import_module(f"tessera.plans.{m}")


def entries() -> dict[str, Entry]:
    _load_all()
    return dict(_REGISTRY)
