"""Filters: eleven comparisons with a literal, combined in disjunctive normal form.

A DNF is a list of clauses, a clause a list of Op; all of a clause and any of the clauses must hold. A column that a
clause does not name is not restricted by it, so an empty clause is true and no clauses at all means no filter. A null
satisfies no comparison, not even `noteq`.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F, types as T

from tidescan.errors import ScanError
from tidescan.functions.scalar import is_literal, java_pattern

_ORDER = {"lt": Column.__lt__, "lteq": Column.__le__, "eq": Column.__eq__, "gteq": Column.__ge__, "gt": Column.__gt__, "noteq": Column.__ne__}
_TEXT = {"starts_with": Column.startswith, "ends_with": Column.endswith, "contains": Column.contains, "matches": Column.rlike}
KINDS = (*_ORDER, "in", *_TEXT)


@dataclass(frozen=True)
class Op:
    column: str
    kind: str
    value: object

    def column_expr(self, schema: T.StructType) -> Column:
        """The comparison as a Spark column; ScanError if the literal's type doesn't fit the column's."""
        if self.column not in schema.names:
            raise ScanError(f"filter on unknown column {self.column}")
        target, kind = F.col(f"`{self.column}`"), schema[self.column].dataType
        if self.kind in _TEXT:
            text = self.value if isinstance(self.value, str) else str(self.value)
            if self.kind == "matches":
                text = java_pattern(text)
            return _TEXT[self.kind](target if isinstance(kind, T.StringType) else target.cast("string"), text)
        values = list(self.value) if self.kind == "in" else [self.value]
        for v in values:
            self._fits(v, kind)
        if self.kind == "in":
            return target.isin([_literal(v, kind) for v in values]) if values else F.lit(False)
        return _ORDER[self.kind](target, _literal(self.value, kind))

    def _fits(self, value: object, kind: T.DataType) -> None:
        text = isinstance(kind, T.StringType)
        if value is None or isinstance(value, bool) or text != isinstance(value, str) and not isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            raise ScanError(f"{self.kind} on {self.column}: {value!r} is no {kind.simpleString()}")

    def needle(self) -> str | None:
        """Text that every matching string must contain; None if the index can't help."""
        if not isinstance(self.value, str):
            return None
        if self.kind in ("eq", "starts_with", "ends_with", "contains") or self.kind == "matches" and is_literal(self.value):
            return self.value
        return None


def _literal(value: object, kind: T.DataType) -> Column:
    return F.lit(str(value)).cast(T.DecimalType(38, 0)) if isinstance(value, int) and abs(value) >= 2**63 else F.lit(value)


def _make(kind: str):
    def build(column: str, value) -> Op:
        return Op(column, kind, tuple(value) if kind == "in" else value)

    build.__name__ = kind
    return build


lt, lteq, eq, gteq, gt, noteq, is_in, starts_with, ends_with, contains, matches = map(_make, ("lt", "lteq", "eq", "gteq", "gt", "noteq", "in", "starts_with", "ends_with", "contains", "matches"))


def dnf(clauses: list[list[Op]] | None, schema: T.StructType) -> Column | None:
    """One boolean column, or None if nothing is filtered."""
    if not clauses or any(not c for c in clauses):
        for op in (op for c in clauses or [] for op in c):
            op.column_expr(schema)
        return None
    return reduce(or_, (reduce(and_, (op.column_expr(schema) for op in c)) for c in clauses))


def count_or_clauses(clauses: list[list[Op]] | None) -> int:
    return len(clauses or [])
