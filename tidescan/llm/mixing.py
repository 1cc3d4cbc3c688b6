"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is to be taken target / source_size times: the whole part always, the rest with that probability.
Pivotal steps pair two fractional documents and move mass (words) from one to the other, to either side with the odds that
keep both expectations, until one of them is taken or left; their common mass never changes. Documents are dealt by a hash of
their id to cells of about `cell_rows` rows; a cell leaves at most one fractional document a source, and these combine in a
tree, `fan_in` cells at a time, until one a source remains, which is drawn. So a source's words differ from its target by less
than one document. Pairs go by falling size, so that what remains fractional is small. All draws are hashes of ids.

A hot source is spread over all cells. Only source totals come to the driver: one row for each source that gets a weight.

Edges: a null text has size 0 and is taken 0 words; null sources form one source, last in order; null ids are allowed; rows that
agree in id, source and size are interchangeable; no rows give no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidescan.llm.common import NULL_ID, keep, mix, own_names

WORD = r"[^\x20\x09-\x0D]+"
_EPS = 1e-9
_COLS = [("row", pa.int64()), ("source", pa.string()), ("size", pa.int64()), ("cell", pa.int64()), ("copies", pa.int64()), ("part", pa.float64()), ("leaf", pa.int64())]
_SCHEMA = "row long, source string, size long, cell long, copies long, part double, leaf long"


def targets(sizes: list[int], share: float = 1.5, weights: tuple = (5, 2, 1), most: float = 2.0) -> list[float]:
    """Words for each source, in order: `share` of all words by weight, at most `most` times its own, the excess reshared."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(weights[i % len(weights)] for i in open_)
        full = [i for i in open_ if left * weights[i % len(weights)] > most * sizes[i] * total]
        if not full:
            for i in open_:
                out[i] = left * weights[i % len(weights)] / total
            break
        for i in full:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return out


def pivot(sizes: np.ndarray, parts: np.ndarray, draws: np.ndarray) -> int | None:
    """Makes all parts but one 0 or 1, in place, by steps in the given order; the index of that one, or None."""
    s, p, u = sizes.tolist(), parts.tolist(), draws.tolist()
    now = None
    for j in range(len(s)):
        if not _EPS < p[j] < 1 - _EPS:
            p[j] = round(p[j])
            continue
        if now is None:
            now = j
            continue
        a, b = s[now], s[j]
        x, y = p[now] * a, p[j] * b
        give, take = min(x, b - y), min(y, a - x)
        if u[j] * (give + take) < take:
            x, y = x - give, y + give
        else:
            x, y = x + take, y - take
        p[now], p[j] = x / a, y / b
        done = [not _EPS < p[k] < 1 - _EPS for k in (now, j)]
        for k, d in zip((now, j), done, strict=True):
            if d:
                p[k] = round(p[k])
        now = j if done[0] and not done[1] else None if all(done) else now
    parts[:] = p
    return now


def _combine(seed: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        row, size, cell, copies, part, leaf = (np.array(table.column(c).to_numpy(), copy=True) for c in ("row", "size", "cell", "copies", "part", "leaf"))
        source = table.column("source").to_pylist()
        name = np.unique(np.array(["" if s is None else "s" + s for s in source], dtype=object), return_inverse=True)[1] if source else np.empty(0, int)
        draw = mix(row.view(np.uint64) ^ mix(np.array([seed + 1], np.uint64)) ^ leaf.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.lexsort((row, draw, -size, name))
        for rows in np.split(order, np.flatnonzero(np.diff(name[order])) + 1) if len(order) else []:
            rows = rows[(size[rows] > 0) & (part[rows] > 0)]
            p = part[rows]
            u = draw[rows].astype(np.float64) / 2.0**64
            rest = pivot(size[rows], p, u)
            if rest is not None and last:
                p[rest] = float(mix(draw[rows[rest : rest + 1]])[0]) / 2.0**64 < p[rest]
            part[rows] = p
        part[size == 0] = 0
        whole = (part == 0) | (part == 1)
        copies[whole] += part[whole].astype(np.int64)
        part[whole] = 0
        data = [row, source, size, cell, copies, part, leaf]
        return pa.Table.from_arrays([pa.array(d, t) for d, (_, t) in zip(data, _COLS, strict=True)], names=[n for n, _ in _COLS])

    return run


def mixing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, weights: tuple = (5, 2, 1), most: float = 2.0, cell_rows: int = 4096, fan_in: int = 16) -> DataFrame:
    """Per document: its id, source, size, source_size, target (of its source) and copies."""
    base = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("row"), F.col(f"`{source_col}`").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    base = keep(base)
    totals = sorted(base.groupBy("source").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    aims = targets([r["s"] for r in totals], share, weights, most)
    cells = max(1, -(-sum(r["n"] for r in totals) // cell_rows))
    rates = docs.sparkSession.createDataFrame([(r["source"], r["s"], a, a / r["s"] if r["s"] else 0.0) for r, a in zip(totals, aims, strict=True)], "of string, source_size long, target double, rate double")
    rates = F.broadcast(rates) if len(totals) <= 100_000 else rates
    ready = base.join(rates, F.col("source").eqNullSafe(F.col("of")), "left")
    leaf = F.pmod(F.xxhash64("row"), F.lit(cells)).cast("long")
    first = ready.select("row", "source", "size", leaf.alias("cell"), F.floor("rate").cast("long").alias("copies"), (F.col("rate") - F.floor("rate")).alias("part"), leaf.alias("leaf"))
    leaves = keep(first.groupBy("cell").applyInArrow(_combine(0, cells == 1), _SCHEMA))
    open_, level, decided = leaves.where("part > 0"), 0, []
    while cells > 1:
        cells, level = -(-cells // fan_in), level + 1
        done = keep(open_.withColumn("cell", F.floor(F.col("cell") / fan_in).cast("long")).groupBy("cell").applyInArrow(_combine(level, cells == 1), _SCHEMA))
        decided.append(done.where("part = 0"))
        open_ = done.where("part > 0")
    out = leaves
    if decided:
        late = decided[0]
        for d in decided[1:]:
            late = late.unionByName(d)
        late = late.select(F.col("source").alias("s2"), F.col("leaf").alias("l2"), F.col("copies").alias("late"))
        out = leaves.join(late, leaves.source.eqNullSafe(late.s2) & (leaves.leaf == late.l2) & (leaves.part > 0), "left").withColumn("copies", F.coalesce("late", "copies"))
    out = out.join(rates, F.col("source").eqNullSafe(F.col("of")), "left")
    return out.select(F.when(F.col("row") != NULL_ID, F.col("row")).alias(id_col), "source", "size", "source_size", "target", "copies")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    i, of, size, n, copy = own_names(docs, "_id", "_source", "_size", "_n", "_copy")
    words = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    left = docs.withColumns({i: F.col(f"`{id_col}`").cast("long"), of: F.col(f"`{source_col}`").cast("string"), size: words})
    left = left.withColumn(n, F.row_number().over(Window.partitionBy(i).orderBy(of, size)))
    right = mixing(docs, id_col, text_col, source_col, **params).select(F.col(id_col).alias("row"), "source", "size", "copies")
    right = right.withColumn("nth", F.row_number().over(Window.partitionBy("row").orderBy("source", "size"))).select("row", "nth", "copies")
    right = right.where("copies > 0").select(F.col("row").alias(f"{i}2"), F.col("nth").alias(f"{n}2"), F.sequence(F.lit(1).cast("long"), "copies").alias(f"{copy}2"))
    both = left.join(right, F.col(i).eqNullSafe(F.col(f"{i}2")) & (F.col(n) == F.col(f"{n}2")))
    return both.withColumn(copy, F.explode(f"{copy}2")).select(*(left[c] for c in left.columns[: len(docs.columns)]))


def query(spark, sf_dir: str) -> DataFrame:
    out = mixing(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
