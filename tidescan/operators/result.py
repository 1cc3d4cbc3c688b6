"""What can be done with a scan's result: merge, length, long form, text, split and sort of single columns."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidescan.errors import EngineError
from tidescan.functions.scalar import value_display


def merge(*results: DataFrame) -> DataFrame:
    """All rows of all results; a column that one of them lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)


def result_len(df: DataFrame, sparse: list[str] | None = None) -> DataFrame:
    """Row count; with only sparse columns, of the rows in which one of them is present."""
    if sparse:
        df = df.where(reduce(Column.__or__, (F.col(c).isNotNull() for c in sparse)))
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def triples(df: DataFrame, key: str, ids: dict[str, int], types: dict[str, str]) -> DataFrame:
    """Long form: a row for each key and column, with the column's id, type and value as text (null if absent)."""
    cells = [F.struct(F.lit(ids[c]).cast("long").alias("column_id"), F.lit(types[c]).alias("column_type"), F.col(c).cast("string").alias("data")) for c in df.columns if c != key and c in ids]
    return df.select(F.col(key), F.explode(F.array(*cells)).alias("cell")).select(key, "cell.column_id", "cell.column_type", "cell.data")


def fragment_iter(df: DataFrame, row: str, column: str) -> DataFrame:
    """Row id and value of the rows in which the column is present."""
    return df.where(F.col(column).isNotNull()).select(row, column)


def fragment_sort(df: DataFrame, row: str, column: str) -> DataFrame:
    """fragment_iter() by ascending value, each value keeping its row id."""
    return fragment_iter(df, row, column).orderBy(column, row)


def split_at(df: DataFrame, row: str, mid: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose position by ascending `row` is below mid, and the others counted from 0. For single fragments: it numbers all rows."""
    numbered = df.withColumn("position", F.row_number().over(Window.orderBy(row)).cast("long") - 1)
    return numbered.where(F.col("position") < mid), numbered.where(F.col("position") >= mid).withColumn("position", F.col("position") - mid)


def split_at_idx(df: DataFrame, row: str, column: str, idx: int, sparse: bool = True) -> tuple[DataFrame, DataFrame]:
    """Present values with a row id below idx, and the others with idx subtracted."""
    if not sparse:
        raise EngineError("split_at_idx needs a sparse column")
    rows = fragment_iter(df, row, column)
    return rows.where(F.col(row) < idx), rows.where(F.col(row) >= idx).withColumn(row, F.col(row) - idx)


def max_index(df: DataFrame, row: str, column: str) -> DataFrame:
    return df.agg(F.max(F.when(F.col(column).isNotNull(), F.col(row))).alias("max_index"))


def to_text(df: DataFrame) -> DataFrame:
    """Every value as text, null as the empty string."""
    return df.select(*(value_display(F.col(f"`{c}`")).alias(c) for c in df.columns))
