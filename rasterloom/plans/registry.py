"""All queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 6) -> Callable[[Query], Query]:
    """Registers a query; its double columns are rounded, with -0.0 as 0.0, and so are the columns that the SQL names with
    a trailing ``{r}`` marker."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.withColumns({c: F.round(df[c], digits) + F.lit(0.0) for c, t in df.dtypes if t == "double"})

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            names = re.findall(r"(\w+)\{r\}", sql)
            body = re.sub(r"\{r\}", "", sql)
            replace = ", ".join(f"round(CAST({n} AS DOUBLE), {digits}) + 0.0 AS {n}" for n in names)
            ORACLE[name] = f"SELECT * REPLACE ({replace}) FROM (\n{body}\n) rounded" if names else body
        return fn

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["q_pipeline_morphology"](spark, sf_dir)


from . import queries_graph, queries_model, queries_raster  # noqa: E402, F401
