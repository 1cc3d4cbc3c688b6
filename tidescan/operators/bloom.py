"""Trigram bloom index of text columns: a side table with one 256-bit filter a chunk, as four BIGINT words.

It only ever skips chunks that cannot hold a match; the exact predicate always runs after it.
"""
from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from tidescan.operators.predicates import Op

WORDS, SEEDS = 4, (17, 91)


def trigrams(text: Column) -> Column:
    """Byte trigrams of a string; none below three bytes."""
    raw = F.encode(text, "utf-8")
    n = F.octet_length(raw)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(raw, i, F.lit(3)))).otherwise(F.array().cast("array<binary>"))


def bit_positions(trigram: Column) -> Column:
    return F.array(*(F.pmod(F.xxhash64(trigram, F.lit(s)), F.lit(64 * WORDS)).cast("int") for s in SEEDS))


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(position, F.lit(64)).cast("int"))


def _word(bits: Column, w: int) -> Column:
    return F.aggregate(F.filter(bits, lambda b: F.floor(b / 64) == w), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(_bit(b)))


def encode(text: Column) -> Column:
    """The filter of one string: an array of four words."""
    bits = F.array_distinct(F.flatten(F.transform(trigrams(text), bit_positions)))
    return F.array(*(_word(bits, w) for w in range(WORDS)))


def covers(bloom: Column, needle: Column) -> Column:
    """Whether the filter may contain the needle."""
    return reduce(and_, (bloom[w].bitwiseAND(needle[w]) == needle[w] for w in range(WORDS)))


def build(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """One filter for each key: the OR of its rows' filters, of which those of a task are put together before the shuffle.

    A row for each place of a text, as steps over rows are compiled and steps within arrays are not. Texts below three bytes have none.
    """
    raw, at = F.encode(F.col(column), "utf-8"), F.explode(F.when(F.col("n") >= 3, F.sequence(F.lit(1), F.greatest(F.col("n") - 2, F.lit(1))))).alias("at")
    places = df.select(*keys, raw.alias("raw")).withColumn("n", F.octet_length("raw")).select(*keys, "raw", at)
    two = places.select(*keys, F.substring("raw", F.col("at"), F.lit(3)).alias("trigram")).select(*keys, *(F.pmod(F.xxhash64("trigram", F.lit(s)), F.lit(64 * WORDS)).cast("int").alias(f"bit{s}") for s in SEEDS))
    masks = [reduce(lambda x, y: x.bitwiseOR(y), (F.when(F.shiftright(f"bit{s}", 6) == w, _bit(F.col(f"bit{s}"))).otherwise(F.lit(0).cast("long")) for s in SEEDS)) for w in range(WORDS)]
    words = [F.bit_or(m).alias(f"w{w}") for w, m in enumerate(masks)]
    return two.groupBy(*keys).agg(*words).select(*keys, F.array(*(f"w{w}" for w in range(WORDS))).alias("bloom"))


def chunk_filter(clauses: list[list[Op]] | None, indexed: set[str]) -> dict[str, Column] | Column | None:
    """Condition on the columns bloom_<name> of the chunks that may match; None unless every clause has a needle in an indexed column."""
    parts = []
    for clause in clauses or []:
        needles = [(op.column, n) for op in clause if op.column in indexed and (n := op.needle()) is not None]
        if not needles:
            return None
        # A chunk without a filter has no trigram at all: it may still hold needles below three bytes.
        parts.append(reduce(and_, (F.when(F.col(f"bloom_{c}").isNull(), F.lit(len(n.encode()) < 3)).otherwise(covers(F.col(f"bloom_{c}"), encode(F.lit(n)))) for c, n in needles)))
    return reduce(or_, parts) if parts else None
