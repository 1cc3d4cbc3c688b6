"""Hashed character n-grams, document frequencies over whole corpora, and bounded samples of labelled rows."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_MUL = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)


def grams(text: str, orders: tuple, bits: int) -> np.ndarray:
    """Bucket of every n-gram of the text between two spaces, repeats included."""
    c = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), "<u4")
    out = []
    for n in orders:
        m = len(c) - n + 1
        if m > 0:
            h = np.full(m, n * 0x51ED270B & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                h = (h ^ c[k : k + m]) * np.uint32(_MUL[k])
                h ^= h >> np.uint32(15)
            out.append(h >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def counts(text: str, orders: tuple, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and how often each occurs."""
    dense = np.bincount(grams(text, orders, bits), minlength=1 << bits)
    at = np.flatnonzero(dense)
    return at, dense[at]


def weights(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of length 1."""
    v = np.log1p(n) * idf[at]
    norm = np.sqrt((v * v).sum())
    return v / norm if norm else v


def document_frequencies(texts: DataFrame, orders: tuple, bits: int, lower: bool) -> tuple[np.ndarray, int]:
    """How many of all the rows (one column, text) hold each bucket, and the number of rows. A task sends one row a bucket."""

    def run(batches):
        held, n = np.zeros(1 << bits, np.int64), 0
        for b in batches:
            for t in b.column(0):
                t = t.as_py() or ""
                held[np.unique(grams(t.lower() if lower else t, orders, bits))] += 1
                n += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at], pa.int32()), pa.array(np.r_[n, held[at]], pa.int64())], names=["bucket", "n"])

    rows = texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df, total = np.zeros(1 << bits), int(rows.n[rows.bucket == -1].sum())
    rows = rows[rows.bucket >= 0]
    df[rows.bucket.to_numpy()] = rows.n.to_numpy()
    return df, total


def idf_of(df: np.ndarray, total: int) -> np.ndarray:
    return np.log((1 + total) / (1 + df)) + 0.1


def sample(rows: DataFrame, label: str, most: int, keys: list[str]) -> DataFrame:
    """About `most` rows of each label, chosen by a hash of the keys; at most twice that many of all labels together."""
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
    share = F.lit(0.0)
    for r in n:
        share = F.when(F.col(label) == F.lit(r[label]), F.lit(most / r["n"])).otherwise(share)
    draw = F.pmod(F.xxhash64(*keys, F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    return rows.withColumn("_draw", draw).where(F.col("_draw") < share).orderBy("_draw", *keys).limit(2 * most * max(1, len(n))).drop("_draw")


def crc(id_col: str):
    """crc32 of an id written as text."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))
