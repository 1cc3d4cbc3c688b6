"""Request layer: requests and replies as dataclasses, and the dispatcher."""
from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import functions as F

from tidescan.errors import ApiError, CatalogApiError, ColumnNameAlreadyExists, ColumnNameCannotBeEmpty, EngineError, InconsistentData, InvalidScanRequest, NoData
from tidescan.functions.types import parse_type
from tidescan.operators.predicates import Op
from tidescan.operators.scan import Scan, StreamConfig, TsRange
from tidescan.sources.catalog import Catalog
from tidescan.sources.ingest import Append
from tidescan.sources.schema import TS, Column


@dataclass(frozen=True)
class ListColumns:
    pass


@dataclass(frozen=True)
class Insert:
    """columns: values by column id, a sparse column as (values, row indices)."""

    timestamps: list[int]
    source: int
    columns: list[dict[int, object]] = field(default_factory=list)


@dataclass(frozen=True)
class ScanFilter:
    column: int
    op: str
    value: object


@dataclass(frozen=True)
class ScanRequest:
    min_ts: int
    max_ts: int
    projection: list[int]
    filters: list[list[ScanFilter]] | None = None
    partition_ids: list[int] = field(default_factory=list)
    stream: StreamConfig | None = None


@dataclass(frozen=True)
class RefreshCatalog:
    pass


@dataclass(frozen=True)
class AddColumn:
    name: str
    type: str


@dataclass(frozen=True)
class AddColumnIndex:
    column_id: int
    kind: str = "bloom"


@dataclass(frozen=True)
class Flush:
    pass


@dataclass(frozen=True)
class DataCompaction:
    pass


@dataclass(frozen=True)
class DataTriple:
    column_id: int
    column_type: str
    data: pa.ChunkedArray | None


@dataclass(frozen=True)
class Reply:
    kind: str
    ok: object = None
    error: ApiError | None = None


def _insert(r: Insert, c: Catalog) -> int:
    if not r.timestamps or not r.columns:
        raise NoData("an insert needs timestamps and columns")
    merged: dict[int, object] = {}
    for part in r.columns:
        for i, values in part.items():
            if i in merged:
                raise InconsistentData(f"column {i} is repeated")
            kind = c.schema.columns[i].type if i in c.schema.columns else None
            n = len(values[0]) if isinstance(values, tuple) else len(values)
            if n > len(r.timestamps) or n != len(r.timestamps) and not (kind and kind.sparse):
                raise InconsistentData(f"column {i} has {n} values for {len(r.timestamps)} rows")
            merged[i] = values
    return c.append(Append(r.timestamps, r.source, merged))


def to_scan(r: ScanRequest, c: Catalog) -> Scan:
    """The engine's scan; text operators want text, and text wants text operators or membership."""
    if r.min_ts > r.max_ts:
        raise InvalidScanRequest("min_ts is above max_ts")
    if not r.projection:
        raise InvalidScanRequest("the projection is empty")
    clauses = []
    for clause in r.filters or []:
        ops = []
        for f in clause:
            if f.column not in c.schema.columns:
                raise InvalidScanRequest(f"column {f.column} not found")
            text, textual = isinstance(f.value, str) or f.op == "in" and any(isinstance(v, str) for v in f.value), f.op in ("starts_with", "ends_with", "contains", "matches")
            if text and not textual and f.op != "in":
                raise InvalidScanRequest(f"{f.op} takes numbers, not text")
            if textual and not text:
                raise InvalidScanRequest(f"{f.op} takes text, not numbers")
            ops.append(Op(c.schema.columns[f.column].name, f.op, tuple(f.value) if f.op == "in" else f.value))
        clauses.append(ops)
    names = [c.schema.columns[i].name for i in r.projection if i in c.schema.columns]
    return Scan(filters=clauses or None, projection=names, partitions=list(r.partition_ids) or None, ts_range=TsRange(r.min_ts, r.max_ts), stream=r.stream)


def _scan(r: ScanRequest, c: Catalog) -> tuple[list[DataTriple], tuple | None]:
    """Column by column, for a client; use Catalog.scan() for results that stay distributed."""
    scan = to_scan(r, c)
    page = c.page(scan) if r.stream else None
    table = (page.rows if page else c.scan(scan)).toArrow()
    out = [DataTriple(i, c.schema.columns[i].type.name, table.column(c.schema.columns[i].name)) for i in r.projection if i in c.schema.columns]
    return out, page.state if page else None


def _refresh(c: Catalog) -> dict:
    stats = c.stats().orderBy("source_id", "chunk_id")
    return {"columns": [(x.type.name, x.id, x.name) for x in c.columns().values()], "partitions": stats}


def _add_column(r: AddColumn, c: Catalog) -> int:
    if not r.name:
        raise ColumnNameCannotBeEmpty("a column needs a name")
    if any(x.name == r.name for x in c.columns().values()):
        raise ColumnNameAlreadyExists(r.name)
    new = Column(c.next_id(), r.name, parse_type(r.type))
    c.add_columns([new])
    return new.id


def _add_index(r: AddColumnIndex, c: Catalog) -> int:
    c.add_indexes({r.column_id: r.kind})
    return r.column_id


def run_request(request, catalog: Catalog) -> Reply:
    """Reply of a request; errors come back in it, none is raised."""
    handlers = {
        ListColumns: lambda r: [(x.type.name, x.id, x.name) for x in catalog.columns().values()],
        Insert: lambda r: _insert(r, catalog), ScanRequest: lambda r: _scan(r, catalog), RefreshCatalog: lambda r: _refresh(catalog),
        AddColumn: lambda r: _add_column(r, catalog), AddColumnIndex: lambda r: _add_index(r, catalog),
        Flush: lambda r: catalog.flush(), DataCompaction: lambda r: catalog.compact(),
    }
    kind = type(request).__name__
    if type(request) not in handlers:
        return Reply("Other")
    try:
        return Reply(kind, handlers[type(request)](request))
    except ApiError as e:
        return Reply(kind, error=e)
    except EngineError as e:
        return Reply(kind, error=CatalogApiError(str(e)))


def count_rows(catalog: Catalog, scan: Scan) -> int:
    """Matching rows, reading only the filters' columns."""
    return catalog.scan(scan.replace(projection=[TS])).agg(F.count(F.lit(1))).first()[0]
