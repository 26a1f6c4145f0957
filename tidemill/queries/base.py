"""Registration and the small derivations that several queries share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemill.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NOW = datetime(2024, 1, 31)
NOW_SQL = "timestamp '2024-01-31 00:00:00'"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, one per run."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def rd(expression: str, places: int) -> str:
    """SQL for the report rounding: half up on the decimal form."""
    return f"round(cast(({expression}) as decimal(38,{places + 6})), {places})::double"


def pct(part: str, whole: str) -> str:
    return rd(f"({part})::double / nullif(({whole})::double, 0) * 100", 2)


# No test table has a missing value, so these derive some, alike on both sides.

ORDERS_GAPS = """(select o_orderkey, o_custkey, o_orderstatus,
  case when o_orderkey % 7 = 0 then null else o_totalprice end as o_totalprice, o_orderdate,
  case when o_orderkey % 11 = 0 then null else o_orderpriority end as o_orderpriority from orders)"""


def orders_gaps(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.withColumns(
        {
            "o_totalprice": F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")),
            "o_orderpriority": F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")),
        }
    )


LINES_GAPS = """(select l_quantity, l_extendedprice, nullif(l_discount, 0.0) as l_discount,
  nullif(l_tax, 0.0) as l_tax, l_returnflag, l_linestatus from lineitem)"""


def lines_gaps(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    return li.select(
        "l_quantity",
        "l_extendedprice",
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
        "l_returnflag",
        "l_linestatus",
    )


def text_time(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


def text_time_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f') as {column}"
