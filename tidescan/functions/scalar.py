"""Scalar functions of the scan engine."""
from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, functions as F

from tidescan.errors import ScanError

#: Fixed values of the storage format.
BLOCK_SIZE = 1048576
TIMESTAMP_MIN = 1
TIMESTAMP_MAX = 8210298326400000000

#: Parts of a pattern: an escape, a character class as a whole, or one character.
_PARTS = re.compile(r"\\.|\[\^?\]?(?:\[:\w+:\]|\\.|[^\]\\])*\]|.", re.S)
_NOT_LINEAR = re.compile(r"\(\?(?:=|!|<=|<!|>)")


def ts_micros(column: Column) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ, TIMESTAMP or DATE, read as UTC."""
    return F.unix_micros(column.cast("timestamp"))


def ts_from_micros(column: Column) -> Column:
    return F.timestamp_micros(column).cast("timestamp_ntz")


def split_micros(column: Column) -> tuple[Column, Column]:
    """Whole seconds and the microseconds below them."""
    return F.floor(column / F.lit(1000000)).cast("long"), F.pmod(column, F.lit(1000000)).cast("long")


def value_display(column: Column) -> Column:
    """Text of a value; the empty string for null."""
    return F.coalesce(column.cast("string"), F.lit(""))


def is_literal(pattern: str) -> bool:
    """Whether a regular expression matches only itself, so that its trigrams can be looked up."""
    return not re.search(r"[\\.+*?()|\[\]{}^$#&\-~]", pattern)


def check_pattern(pattern: str) -> str:
    """The pattern, if a linear-time matcher could run it: no look-around, back-references or possessive repeats."""
    parts = _PARTS.findall(pattern)
    bare = "".join("x" if len(p) > 1 else p for p in parts)  # escapes and classes can't be repeats or groups
    if _NOT_LINEAR.search(bare) or re.search(r"[*+?}]\+", bare) or any(re.fullmatch(r"\\[1-9k]", p) for p in parts):
        raise ScanError(f"pattern needs backtracking: {pattern}")
    return pattern


def java_pattern(pattern: str) -> str:
    """The pattern for Java's matcher: `$` is the end of the text alone, only a line feed ends a line, and \\w, \\d, \\s, \\b know all scripts."""
    parts = _PARTS.findall(check_pattern(pattern))
    lines = re.search(r"\(\?[a-zA-Z]*m", pattern) is not None
    out = "".join("\\z" if p == "$" and not lines else p for p in parts)
    flags = ("d" if "." in parts or lines else "") + ("U" if re.search(r"\\[wWdDsSbB]|\[:", pattern) else "")
    return f"(?{flags}){out}" if flags else out


def chunk_capacity(bytes_per_row: list[int]) -> int:
    """Rows that fit in one chunk: the widest column fills its block first. ts takes 8 bytes."""
    return BLOCK_SIZE // max([8, *bytes_per_row])


def new_id() -> str:
    return str(uuid.uuid4())
