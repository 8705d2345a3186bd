"""Current rows of delivered tables, and small shared pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NARRATOR, UNKNOWN = "Narrator", "Unknown"


def latest(df: DataFrame, *keys: str) -> DataFrame:
    """The last delivery of each key: by loaded_at, then row_id. One shuffle on the key; WindowGroupLimit prunes before it."""
    w = Window.partitionBy(*keys).orderBy(F.col("loaded_at").desc(), F.col("row_id").desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def is_speech(c: Column) -> Column:
    """Dialogue or thought."""
    return c.isin("dialogue", "internal_thought")


def named(c: Column) -> Column:
    return c.isNotNull() & ~c.isin(NARRATOR, UNKNOWN)
