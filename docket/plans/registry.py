"""Registered queries: name -> Spark builder (spark, sf_dir) and oracle SQL.

Every builder reads the provided tables (through :mod:`docket.plans.views`)
and runs one operator family over the whole tables.  ``finish`` gives all
results the same canonical types as the SQL side: integers as BIGINT and
doubles rounded to 6 decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docket import config as C
from docket.plans import sql as S
from docket.plans import views as V

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}
ROUND = 6


def finish(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), ROUND)
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = lambda spark, sf_dir, _fn=fn: finish(_fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def r(x: str) -> str:
    """SQL rounding twin of ``finish`` for doubles."""
    return f"round(CAST({x} AS DOUBLE), {ROUND})"


# Importing the query modules fills QUERIES / ORACLES.
MODULES = ["q_dataset", "q_report", "q_metrics", "q_quality", "q_ingest", "q_interact", "q_similar", "q_model"]


def load() -> tuple[dict[str, Builder], dict[str, str]]:
    import importlib

    for m in MODULES:
        importlib.import_module(f"docket.plans.{m}")
    return QUERIES, ORACLES


__all__ = ["QUERIES", "ORACLES", "register", "finish", "r", "load", "S", "V", "C", "F"]
