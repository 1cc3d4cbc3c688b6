"""Append batches: validation, and sparse (values, row indices) pairs as null-filled columns."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidescan.errors import AppendError
from tidescan.functions.scalar import chunk_capacity
from tidescan.sources.schema import SOURCE, TS, Schema


@dataclass(frozen=True)
class Append:
    """Rows of one source. data: values by column id; a sparse column gives (values, row indices)."""

    ts: list[int]
    source_id: int
    data: dict[int, list | tuple[list, list[int]]] = field(default_factory=dict)

    def __len__(self) -> int:
        return len(self.ts)

    def is_empty(self) -> bool:
        return not self.ts


def validate(batch: Append, schema: Schema) -> None:
    if batch.is_empty():
        raise AppendError("an append needs timestamps")
    n = len(batch)
    for i, values in batch.data.items():
        if i not in schema.columns or i < 2:
            raise AppendError(f"column {i} not found")
        if schema.columns[i].type.sparse:
            if not isinstance(values, tuple) or len(values) != 2 or len(values[0]) != len(values[1]):
                raise AppendError(f"sparse column {i} needs as many row indices as values")
            if len(values[0]) > n or any(not 0 <= k < n for k in values[1]) or len(set(values[1])) != len(values[1]):
                raise AppendError(f"row indices of column {i} must be distinct and below {n}")
        elif isinstance(values, tuple) or len(values) != n:
            raise AppendError(f"dense column {i} has not {n} values")


def to_frame(spark: SparkSession, batch: Append, schema: Schema) -> DataFrame:
    """The batch as rows with the catalog's columns; those that it lacks are null."""
    validate(batch, schema)
    columns = [list(batch.ts), [batch.source_id] * len(batch)]
    for c in sorted(schema.columns.values(), key=lambda c: c.id)[2:]:
        values = batch.data.get(c.id)
        row: list = [None] * len(batch)
        if c.type.sparse and values is not None:
            for v, k in zip(*values, strict=True):
                row[k] = c.type.encode(v)
        elif values is not None:
            row = [c.type.encode(v) for v in values]
        if isinstance(c.type.data_type, T.DecimalType):
            from decimal import Decimal

            row = [None if v is None else Decimal(v) for v in row]
        columns.append(row)
    return spark.createDataFrame(list(zip(*columns, strict=True)), schema.struct())


#: Rows of a task that cuts chunks: a task and a file for each chunk would take far longer than the rows.
TASK_ROWS = 1 << 18


def tasks_of(rows: int, capacity: int) -> int:
    """Tasks that cut `rows` rows into chunks; a chunk over `TASK_ROWS` has a task of its own."""
    return max(1, -(-rows // max(capacity, TASK_ROWS)))


def ids_of(rows: int, capacity: int) -> int:
    """Chunk ids to reserve: each task has as many as all rows could take, as its rows aren't known beforehand."""
    return tasks_of(rows, capacity) * max(1, -(-rows // capacity))


def with_chunks(df: DataFrame, first: int, rows: int, capacity: int) -> DataFrame:
    """chunk_id from `first` on, in the order of ts, with `capacity` rows each; the last one of a task may have fewer.

    Tasks take ranges of ts by sampled bounds, so none sees all rows of a large frame.
    """
    n = tasks_of(rows, capacity)
    dealt = (df.repartitionByRange(n, F.col(TS)) if n > 1 else df.coalesce(1)).sortWithinPartitions(TS)
    # The low 33 bits number a task's rows in their order.
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.withColumn("chunk_id", F.lit(first).cast("long") + F.spark_partition_id() * F.lit(ids_of(rows, capacity) // n).cast("long") + F.floor(row / capacity))


def capacity_of(schema: Schema, names: list[str]) -> int:
    return chunk_capacity([schema.by_name(n).type.bytes_per_row for n in names if n not in (TS, SOURCE)])
