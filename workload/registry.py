"""Names a query, its Spark callable and, where SQL can express it, its check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.sources.star import Star
from workload.prelude import PRELUDE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def comparable(df: DataFrame) -> DataFrame:
    """Decimals as double and dates as text, so that two engines print them alike."""

    def plain(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            return c.cast("double").alias(field.name)
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return c.cast("bigint").alias(field.name)
        if isinstance(field.dataType, (T.DateType, T.TimestampType)):
            return c.cast("string").alias(field.name)
        if isinstance(field.dataType, T.ArrayType):
            return F.concat_ws(",", c.cast("array<string>")).alias(field.name)
        return c

    return df.select(*[plain(f) for f in df.schema.fields])


def query(name: str, sql: str | None = None):
    """Register ``fn(star) -> DataFrame``. SQL starting with a comma adds tables to the prelude."""

    def register(fn: Callable[[Star], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: comparable(fn(Star(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = PRELUDE + sql
        return fn

    return register
