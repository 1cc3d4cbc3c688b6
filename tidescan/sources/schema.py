"""Schema of a catalog: columns by id, indexes, and their JSON document."""
from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import types as T

from tidescan.errors import SchemaError
from tidescan.functions.types import ColumnType, parse_type

TS, SOURCE = "timestamp", "source_id"


@dataclass(frozen=True)
class Column:
    id: int
    name: str
    type: ColumnType


@dataclass(frozen=True)
class Schema:
    """Immutable; add_columns and add_indexes return a new one or raise without effect."""

    columns: dict[int, Column] = field(default_factory=dict)
    indexes: dict[int, str] = field(default_factory=dict)

    @staticmethod
    def default() -> Schema:
        return Schema({0: Column(0, TS, parse_type("U64Dense")), 1: Column(1, SOURCE, parse_type("I32Dense"))})

    def next_id(self) -> int:
        return max(self.columns, default=-1) + 1

    def by_name(self, name: str) -> Column:
        found = next((c for c in self.columns.values() if c.name == name), None)
        if found is None:
            raise SchemaError(f"column {name} not found")
        return found

    def add_columns(self, new: list[Column]) -> Schema:
        out, names = dict(self.columns), {c.name for c in self.columns.values()}
        for c in new:
            if c.id in out:
                raise SchemaError(f"column id {c.id} already exists")
            if c.name in names:
                raise SchemaError(f"column {c.name} already exists")
            out[c.id] = c
            names.add(c.name)
        return Schema(out, self.indexes)

    def add_indexes(self, new: dict[int, str]) -> Schema:
        for i, kind in new.items():
            if i not in self.columns:
                raise SchemaError(f"column {i} not found")
            if i in self.indexes:
                raise SchemaError(f"column {i} has an index already")
            if kind != "bloom" or not self.columns[i].type.is_string:
                raise SchemaError(f"no index of kind {kind} for {self.columns[i].type.name}")
        return Schema(self.columns, self.indexes | new)

    def struct(self) -> T.StructType:
        """ts is kept as BIGINT microseconds, so that years past 9999 survive; every user column may be null on read."""
        out = T.StructType()
        for c in sorted(self.columns.values(), key=lambda c: c.id):
            kind = T.LongType() if c.id == 0 else T.LongType() if c.id == 1 else c.type.data_type
            out.add(T.StructField(c.name, kind, c.id > 1, {"column_id": c.id, "type": c.type.name}))
        return out

    def to_json(self) -> str:
        return json.dumps({"columns": [{"id": c.id, "name": c.name, "type": c.type.name, "encoding": c.type.encoding} for c in sorted(self.columns.values(), key=lambda c: c.id)], "indexes": {str(k): v for k, v in self.indexes.items()}}, indent=1)

    @staticmethod
    def from_json(text: str) -> Schema:
        d = json.loads(text)
        return Schema({c["id"]: Column(c["id"], c["name"], parse_type(c["type"], c["encoding"])) for c in d["columns"]}, {int(k): v for k, v in d["indexes"].items()})
