"""Named views and CSV export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def view_publish(df: DataFrame, name: str, as_table: bool = False) -> DataFrame:
    """(Re)create a reporting view, or a stored table, and return it as read back by name."""
    if as_table:
        df.write.mode("overwrite").saveAsTable(name)
    else:
        df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def sink_csv_export(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Quoted CSV of the chosen columns with a header; quotes inside values are doubled."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
