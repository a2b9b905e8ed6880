"""Writing results out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def guard(df: DataFrame) -> DataFrame:
    """Text that a spreadsheet would take for a formula gets a leading apostrophe; other types stay as they are."""
    risky = {f.name: F.when(F.col(f.name).rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), f.name)).otherwise(F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.withColumns(risky) if risky else df


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The columns in their fixed order, quotes doubled, formulas guarded."""
    guard(df.select(*columns)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_decisions(df: DataFrame, path: str) -> None:
    """Adds decisions to the log; readers let the latest win."""
    df.write.mode("append").parquet(path)
