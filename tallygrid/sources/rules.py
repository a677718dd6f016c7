"""Small rule tables typed in by people: bands, rates, holidays, targets."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def rows(spark: SparkSession, schema: str, values: Sequence[tuple]) -> DataFrame:
    """A rule table from literal rows.

    Arrow input becomes a local relation, so Spark knows its exact size, broadcasts it only when that is small,
    and starts no Python worker for it.
    """
    struct = T.StructType.fromDDL(schema)
    names = struct.fieldNames()
    table = pa.Table.from_pylist([dict(zip(names, v)) for v in values], schema=to_arrow_schema(struct))
    return spark.createDataFrame(table, schema=struct)
