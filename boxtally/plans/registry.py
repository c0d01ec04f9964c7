"""Registry of named queries, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxtally.sources.derived import Tables, duck_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "gt det cases"):
    """Register ``fn(tables) -> DataFrame`` under ``name``.

    ``sql`` continues a WITH clause that defines ``views``: it is either a SELECT or further
    common table expressions followed by one.
    """

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            starts_select = body[:6].upper() == "SELECT"
            if views:
                ORACLES[name] = f"WITH RECURSIVE {duck_views(*views.split())}{'' if starts_select else ','} {body}"
            else:
                ORACLES[name] = body if starts_select else f"WITH RECURSIVE {body}"
        return fn

    return register


def r6(c: Column | str, alias: str | None = None) -> Column:
    """Round to six digits, the precision at which results are compared."""
    name = alias or (c if isinstance(c, str) else None)
    out = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return out.alias(name) if name else out


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")
