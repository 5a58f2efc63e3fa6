"""Registered queries: a Spark builder and, where SQL can say it, the same in SQL.

A query states its output columns as ``name:type`` words (``i`` integer, ``d`` double,
``s`` text, ``t`` time).  Both sides are brought to those types the same way: doubles
are rounded to 6 places, times become text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.session import prepare

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    columns: str
    build: Build
    sql: str | None = None

    @property
    def spec(self) -> list[tuple[str, str]]:
        return [tuple(w.split(":")) for w in self.columns.split()]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(prepare(spark), sf_dir)
        return df.select(*[_present(c, k).alias(c) for c, k in self.spec])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cols = ", ".join(f"{_present_sql(c, k)} AS {c}" for c, k in self.spec)
        return f"SELECT {cols} FROM ({self.sql}) AS q"


def _present(c: str, kind: str) -> Column:
    x = F.col(c)
    if kind == "i":
        return x.cast("bigint")
    if kind == "d":
        # The tiny shift sends values midway between two roundings the same way in
        # both engines; adding zero removes a negative zero.
        return F.round(x.cast("double") + 1e-9, 6) + F.lit(0.0)
    if kind == "t":
        return F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    return x.cast("string")


def _present_sql(c: str, kind: str) -> str:
    if kind == "i":
        return f"CAST({c} AS BIGINT)"
    if kind == "d":
        return f"round(CAST({c} AS DOUBLE) + 1e-9, 6) + 0.0"
    if kind == "t":
        return f"strftime(CAST({c} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"
    return f"CAST({c} AS VARCHAR)"


class Registry(dict):
    def add(self, name: str, columns: str, sql: str | None = None):
        def wrap(build: Build) -> Build:
            if name in self:
                raise ValueError(f"query {name} registered twice")
            self[name] = Query(name, columns, build, sql)
            return build

        return wrap


REGISTRY = Registry()
query = REGISTRY.add
