"""Column types: integers of 8 to 128 bits, signed or not, dense (NOT NULL) or sparse (nullable), and dense strings."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

from tidescan.errors import SchemaError

_SPARK = {
    ("I", 8): T.ByteType(), ("I", 16): T.ShortType(), ("I", 32): T.IntegerType(), ("I", 64): T.LongType(),
    ("U", 8): T.ShortType(), ("U", 16): T.IntegerType(), ("U", 32): T.LongType(), ("U", 64): T.DecimalType(20, 0),
}
ENCODINGS = ("decimal", "binary")


@dataclass(frozen=True)
class ColumnType:
    """kind: I, U or S (string); bits: 0 for strings; encoding: how 128-bit values are kept."""

    kind: str
    bits: int
    sparse: bool
    encoding: str = "decimal"

    @property
    def name(self) -> str:
        return ("String" if self.kind == "S" else f"{self.kind}{self.bits}") + ("Sparse" if self.sparse else "Dense")

    @property
    def is_string(self) -> bool:
        return self.kind == "S"

    @property
    def bytes_per_row(self) -> int:
        """16 for a string's slice."""
        return 16 if self.is_string else self.bits // 8

    @property
    def data_type(self) -> T.DataType:
        if self.is_string:
            return T.StringType()
        if self.bits == 128:
            return T.BinaryType() if self.encoding == "binary" else T.DecimalType(38, 0)
        return _SPARK[self.kind, self.bits]

    @property
    def limits(self) -> tuple[int, int]:
        """Smallest and largest value that may be stored."""
        low, high = (0, 2**self.bits - 1) if self.kind == "U" else (-(2 ** (self.bits - 1)), 2 ** (self.bits - 1) - 1)
        if self.bits == 128 and self.encoding == "decimal":
            return max(low, -(10**38) + 1), min(high, 10**38 - 1)
        return low, high

    def encode(self, value: int | str | None):
        """A Python value as it is stored; out of range raises SchemaError."""
        if value is None or self.is_string:
            return value
        low, high = self.limits
        if not low <= value <= high:
            raise SchemaError(f"{value} is out of range for {self.name}")
        if self.bits == 128 and self.encoding == "binary":
            return (value + (2**127 if self.kind == "I" else 0)).to_bytes(16, "big")
        return value

    def decode(self, stored):
        if stored is None or self.bits != 128 or self.encoding != "binary":
            return int(stored) if stored is not None and not self.is_string else stored
        return int.from_bytes(bytes(stored), "big") - (2**127 if self.kind == "I" else 0)

    def check(self, column: Column) -> Column:
        """True where a stored value is in range and not a forbidden null."""
        fits = F.lit(True)
        if not self.is_string and not (self.bits == 128 and self.encoding == "binary"):
            low, high = (F.lit(str(x)).cast(T.DecimalType(38, 0)) for x in self.limits)
            fits = F.coalesce(column.cast(T.DecimalType(38, 0)).between(low, high), F.lit(True))
        return fits if self.sparse else fits & column.isNotNull()


def parse_type(name: str, encoding: str = "decimal") -> ColumnType:
    """ColumnType of a name such as U64Sparse."""
    base = name.removesuffix("Sparse").removesuffix("Dense")
    if encoding not in ENCODINGS or base == name:
        raise SchemaError(f"unknown column type {name}")
    sparse = name.endswith("Sparse")
    if base == "String" and not sparse:
        return ColumnType("S", 0, False)
    if base[:1] in ("I", "U") and base[1:] in ("8", "16", "32", "64", "128"):
        return ColumnType(base[0], int(base[1:]), sparse, encoding)
    raise SchemaError(f"unknown column type {name}")


ALL_TYPES = tuple(parse_type(f"{k}{b}{s}") for k in "IU" for b in (8, 16, 32, 64, 128) for s in ("Dense", "Sparse")) + (parse_type("StringDense"),)
