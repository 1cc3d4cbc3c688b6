"""Scan: an immutable query description, and the plan that turns it into a DataFrame."""
from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidescan.errors import ScanError
from tidescan.operators.predicates import Op, dnf


@dataclass(frozen=True)
class TsRange:
    """start is inclusive, end exclusive; None leaves that side open."""

    start: object = None
    end: object = None

    def rows(self, ts: Column) -> Column | None:
        """Rows within the range."""
        parts = [x for x in (ts >= F.lit(self.start) if self.start is not None else None, ts < F.lit(self.end) if self.end is not None else None) if x is not None]
        return None if not parts else parts[0] if len(parts) == 1 else parts[0] & parts[1]

    def overlaps(self, low: Column, high: Column) -> Column:
        """Chunks with some row that could be within the range, by their least and greatest ts."""
        out = F.lit(True)
        if self.start is not None:
            out = out & (high >= F.lit(self.start))
        return out & (low < F.lit(self.end)) if self.end is not None else out

    def holds(self, low, high) -> bool:
        """overlaps() for plain values."""
        return (self.start is None or self.start <= high) and (self.end is None or low < self.end)


FULL = TsRange()


@dataclass(frozen=True)
class StreamConfig:
    """A page holds about row_limit rows: chunks are added while their sum stays within threshold of it."""

    row_limit: int
    threshold: int
    state: tuple | None = None

    def __post_init__(self):
        if self.row_limit < 1 or self.threshold < 0:
            raise ScanError("row_limit must be at least 1 and threshold at least 0")


@dataclass(frozen=True)
class Scan:
    """granularity 'exact' keeps rows of the range, 'chunk' whole chunks that overlap it. lenient: unknown columns of the projection come back as null."""

    filters: list[list[Op]] | None = None
    projection: list[str] | None = None
    groups: list[int] | None = None
    partitions: list | None = None
    ts_range: TsRange = FULL
    stream: StreamConfig | None = None
    granularity: str = "exact"
    ordered: bool = False
    lenient: bool = False
    columns: dict[str, str] = field(default_factory=lambda: {"ts": "ts", "source": "source_id", "chunk": "chunk_id"})

    def replace(self, **changes) -> Scan:
        return replace(self, **changes)


def select_rows(scan: Scan, df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """df restricted to the scan's sources, chunks, time range and filters, with all its columns."""
    ts, source, chunk = (scan.columns[k] for k in ("ts", "source", "chunk"))
    if scan.groups is not None:
        df = df.where(F.col(source).isin(scan.groups) if scan.groups else F.lit(False))
    if scan.partitions:
        df = df.where(F.col(chunk).isin(list(scan.partitions)))
    if scan.granularity == "exact":
        if (bound := scan.ts_range.rows(F.col(ts))) is not None:
            df = df.where(bound)
    elif scan.ts_range != FULL:
        # Stats have one short row a chunk; Spark broadcasts them below its threshold and joins by shuffle beyond.
        stats = chunk_stats(df, scan.columns) if stats is None else stats
        df = df.join(stats.where(scan.ts_range.overlaps(F.col("ts_min"), F.col("ts_max"))).select(source, chunk), [source, chunk], "left_semi")
    condition = dnf(scan.filters, df.schema)
    return df if condition is None else df.where(condition)


def project(scan: Scan, df: DataFrame) -> DataFrame:
    if scan.projection is None:
        return df
    out = []
    for name in scan.projection:
        if name in df.columns:
            out.append(F.col(f"`{name}`"))
        elif scan.lenient:
            out.append(F.lit(None).cast(T.LongType()).alias(name))
        else:
            raise ScanError(f"projection of unknown column {name}")
    return df.select(*out)


def plan(scan: Scan, df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """The scan's result, lazily: filters are pushed to the files, only the columns that it names are read."""
    rows = select_rows(scan, df, stats)
    if scan.ordered:
        rows = rows.orderBy(*(scan.columns[k] for k in ("source", "chunk", "ts") if scan.columns[k] in rows.columns))
    return project(scan, rows)


def chunk_stats(df: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """One row a chunk: source, chunk, ts_min, ts_max, n_rows."""
    c = columns or {"ts": "ts", "source": "source_id", "chunk": "chunk_id"}
    return df.groupBy(c["source"], c["chunk"]).agg(F.min(c["ts"]).alias("ts_min"), F.max(c["ts"]).alias("ts_max"), F.count(F.lit(1)).alias("n_rows"))
