"""Embedding near-dedup: sign hashes of random hyperplanes in several tables, exact cosines, connected components.

Equal vectors of a label fold into one with a count, before anything else. Each vector has a signature in every table; vectors of
a label that agree in one table's signature are compared exactly, in blocks of products in double precision. A pair counts in the
first table in which it meets. From each block come only numbers of links and a spanning forest, never the pairs; a bucket with
more vectors than `block` is cut into a grid of pairs of blocks, so nothing is capped.

Bits grow with the logarithm of the input, and tables so that a pair at the threshold is missed with a probability of at most `miss`.

Edges: vectors that are null, zero, hold null or non-finite components, or have a null label, link with nothing and are kept; vectors
of different lengths aren't linked; null ids are allowed, as the smallest id; repeated rows are each returned; no rows give no rows.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidescan.llm.common import NULL_ID, connected_components, keep

BLOCK = 1024
SMALL_ROWS = 1_000_000


def plan_tables(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits of a signature and number of tables for n vectors."""
    bits = min(30, max(10, math.ceil(math.log2(max(n, 1) / 64 + 1))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-agree))


def _planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng(20240501 + dim).standard_normal((dim, bits * tables))


def signatures(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Rows by tables."""
    signs = (x @ _planes(x.shape[1], bits, tables) >= 0).reshape(len(x), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _valid(kind: str):
    """Usable vectors as bytes."""

    def run(batches):
        for b in batches:
            out = []
            for i, v, label in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                raw = None
                if v is not None and label is not None and len(v) and None not in v:
                    x = np.array(v, np.float64)
                    if np.isfinite(x).all() and 0 < (x * x).sum() < np.inf:
                        raw = x.astype(kind).tobytes()
                out.append((NULL_ID if i is None else i, label if raw is not None else None, raw))
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary())], names=["id", "label", "vec"])

    return run


def _sign(kind: str, bits: int, tables: int):
    def run(batches):
        for b in batches:
            raw = b.column(2).to_pylist()
            sig: list = [None] * len(raw)
            for size in {len(r) for r in raw}:
                at = [k for k, r in enumerate(raw) if len(r) == size]
                x = np.frombuffer(b"".join(raw[k] for k in at), kind).reshape(len(at), -1).astype(np.float64)
                for k, s in zip(at, signatures(x, bits, tables).tolist(), strict=True):
                    sig[k] = s
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(sig, pa.list_(pa.int64()))], names=["id", "label", "vec", "copies", "sig"])

    return run


def _forest(near: np.ndarray) -> np.ndarray:
    """The first row of each row's component of a symmetric boolean matrix."""
    n = len(near)
    root = np.full(n, -1)
    for s in range(n):
        if root[s] < 0:
            root[s] = s
            todo = np.array([s])
            while len(todo):
                todo = np.flatnonzero(near[todo].any(axis=0) & (root < 0))
                root[todo] = s
    return root


def _compare(kind: str, bits: int, tables: int, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        key = np.column_stack([table.column(c).to_numpy() for c in ("where", "cell")])
        t, ids, copies, side = (table.column(c).to_numpy() for c in ("t", "id", "copies", "side"))
        across = table.column("across").to_pylist()
        vec, label = table.column("vec"), table.column("label").to_pylist()
        sig = table.column("s").to_numpy()
        name = np.unique(np.array(label, dtype=object), return_inverse=True)[1] if len(label) else np.empty(0, int)
        size = np.array([len(v.as_py()) for v in vec])
        order = np.lexsort((ids, size, sig, t, name, key[:, 1], key[:, 0]))
        parts = np.column_stack([key[order], name[order], t[order], sig[order], size[order]])
        new = np.flatnonzero(np.r_[True, (parts[1:] != parts[:-1]).any(axis=1)]) if len(order) else []
        a, b, n = [], [], []
        for lo, hi in zip(new, [*new[1:], len(order)], strict=True) if len(order) else ():
            if hi - lo < 2:
                continue
            rows = order[lo:hi]
            x = np.frombuffer(b"".join(vec[int(r)].as_py() for r in rows), kind).reshape(len(rows), -1).astype(np.float64)
            norm = np.sqrt((x * x).sum(axis=1))
            near = (x @ x.T) / norm[:, None] / norm[None, :] >= threshold
            near |= near.T
            np.fill_diagonal(near, False)
            if across[rows[0]]:
                near &= side[rows][:, None] != side[rows][None, :]
            if not near.any():
                continue
            own, first = int(t[rows[0]]), near
            if own:
                early = signatures(x, bits, tables)[:, :own]
                i, j = np.nonzero(near)
                seen = np.zeros(len(i), bool)
                for k in range(own):
                    seen |= early[i, k] == early[j, k]
                first = near.copy()
                first[i[seen], j[seen]] = False
            more, root = first @ copies[rows], _forest(near)
            for k in np.flatnonzero((more > 0) | (root != np.arange(len(rows)))):
                a.append(int(ids[rows[k]]))
                b.append(int(ids[rows[root[k]]]))
                n.append(int(more[k]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def embedding_dedup(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, miss: float = 1e-5) -> DataFrame:
    """Per row: its id, n_links, component_id and kept."""
    element = df.schema[vec_col].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    rows = keep(df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("vec"), F.col(label_col).cast("string").alias("label")).mapInArrow(_valid(kind), "id long, label string, vec binary"))
    usable = rows.where(F.col("vec").isNotNull())
    folded = keep(usable.groupBy("label", "vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).select("id", "label", "vec", "copies"))
    n = folded.count()
    bits, tables = plan_tables(n, threshold, miss)
    signed = folded.mapInArrow(_sign(kind, bits, tables), "id long, label string, vec binary, copies long, sig array<long>")
    posts = signed.select("id", "label", "vec", "copies", F.posexplode("sig").alias("t", "s")).withColumn("where", F.xxhash64("label", "t", "s"))
    hot = keep(signed.select("label", F.posexplode("sig").alias("t", "s")).groupBy(F.xxhash64("label", "t", "s").alias("w")).agg(F.count(F.lit(1)).alias("n")))
    hot = hot.where(F.col("n") > BLOCK)
    few = hot.count()
    posts = posts.join(F.broadcast(hot) if few <= SMALL_ROWS else hot, F.col("where") == F.col("w"), "left").withColumn("blocks", F.ceil(F.coalesce("n", F.lit(1)) / BLOCK))
    own = F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks"))
    # Cell (i, j) compares block i with block j; where they are the same, all its vectors among themselves.
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct((F.least(own, j) * F.col("blocks") + F.greatest(own, j)).alias("cell"), (j != own).alias("across")))
    posts = posts.select("id", "label", "vec", "copies", "t", "s", "where", own.alias("side"), F.explode(cells).alias("c")).select("id", "label", "vec", "copies", "t", "s", "where", "side", "c.*")
    slots = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * tables // 50_000))
    found = keep(posts.withColumn("slot", F.pmod(F.xxhash64("where", "cell"), F.lit(slots))).groupBy("slot").applyInArrow(_compare(kind, bits, tables, threshold), "a long, b long, n long"))
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("more"))
    parts = connected_components(found.select("a", "b")).select(F.col("node").alias("rep"), "component")
    reps = folded.select(F.col("id").alias("rep"), F.col("label").alias("l"), F.col("vec").alias("v"), "copies").join(links, "rep", "left").join(parts, "rep", "left")
    out = rows.join(reps, (F.col("label") == F.col("l")) & (F.col("vec") == F.col("v")), "left")
    component = F.coalesce("component", "rep", "id")
    null = lambda c: F.when(c != NULL_ID, c)
    return out.select(null(F.col("id")).alias(id_col), (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), null(component).alias("component_id"), (F.col("id") == component).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
