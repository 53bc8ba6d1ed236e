"""All registered queries: a runnable over the supplied tables and, where SQL can say it, the equivalent SQL."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

import corpusloom.plans as plans


@dataclass(frozen=True)
class Item:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def items() -> dict[str, Item]:
    found: dict[str, Item] = {}
    for module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__) if m.name.startswith("queries_")):
        found.update(importlib.import_module(f"corpusloom.plans.{module}").ITEMS)
    return found
