"""Registers queries with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shoebox.plans.views import oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Adds a function of the tables that its parameters name: f(source_rows, labels) gets these."""

    def add(f):
        names = f.__code__.co_varnames[: f.__code__.co_argcount]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(view(spark, sf_dir, n) for n in names))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = oracle(sql)
        return f

    return add


def text_time(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def at(seconds: int) -> Column:
    """So many seconds after 2024-01-01."""
    return F.expr(f"TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, {seconds})")
