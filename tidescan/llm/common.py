"""What several operators share: words, hashes, packed arrays, bucket counts, checkpoints, connected components."""
from __future__ import annotations

import atexit
import gc
import math
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Stands for a null id inside the operators.
NULL_ID = -(2**63)
#: Input bytes, as Spark's statistics have them, for each bucket of a shuffle of packed arrays.
BUCKET_BYTES = 8 << 20
#: Text bytes that a task gathers before it hashes and deals them out.
CHUNK_BYTES = 12 << 20
#: Narrow rows that may be broadcast once they are counted.
SMALL_ROWS = 500_000
#: Bytes of counted rows that may be broadcast: the driver holds them several times over.
SMALL_BYTES = 16 << 20
#: Bytes of a Parquet row group of what is kept for a while; tasks hold one for each file that they write at once.
GROUP_BYTES = 8 << 20
_M = np.uint64


def words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space; bytes.split() cuts at exactly those six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """One-to-one scrambling, so that any bits of the result may be used alone."""
    x = x ^ (x >> _M(31))
    x = x * _M(0x9E3779B97F4A7C15)
    x = x ^ (x >> _M(29))
    x = x * _M(0xBF58476D1CE4E5B9)
    return x ^ (x >> _M(32))


_BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = []


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every run of `width` word hashes, modulo 2**64, from prefix sums; scrambled."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if not _powers or len(_powers[0]) < len(h):
        size = max(1 << 20, 1 << int(len(h)).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.r_[_M(1), np.full(size - 1, b, np.uint64)]) for b in (_BASE, inverse)]
    prefix = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers[0][: len(h)], out=prefix[1:])
    return mix((prefix[width:] - prefix[:-width]) * _powers[1][:n])


def pack(x: np.ndarray, delta: bool = False) -> bytes:
    """An integer array in bytes: differences if asked, then byte planes, then zstd."""
    x = np.ascontiguousarray(x)
    if delta and len(x):
        x = np.diff(x, prepend=x.dtype.type(0))
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes, dtype, delta: bool = False) -> np.ndarray:
    dtype = np.dtype(dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    x = np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype) if len(raw) else np.empty(0, dtype)
    return np.cumsum(x, dtype=dtype) if delta else x


def bucket_count(df: DataFrame) -> int:
    """Grows with the input; at least Spark's own number of shuffle partitions."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(math.ceil(size / BUCKET_BYTES), 1 << 20))


def id_bucket(ids: np.ndarray, n: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % _M(n)).astype(np.int32)


def shared_folder(spark: SparkSession) -> str:
    """Where all executors can write and read: what the cluster names, else the session's checkpoint folder.

    A temporary folder, removed at exit, is made on a local master alone; elsewhere the executors couldn't see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir isn't set: it has to name a folder that all executors share")
    own = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(own)
    return own


def keep(df: DataFrame) -> DataFrame:
    """df computed once and kept where all executors see it; its lineage ends there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def _options() -> dict:
    return {"compression": "zstd", "parquet.block.size": str(GROUP_BYTES)}


@contextmanager
def appended(frames):
    """Frames of the same columns, each computed once, one after the other, and read together as by written(); gone at the end."""
    path, fs, schema = None, None, None
    try:
        for df in frames:
            if path is None:
                spark, schema = df.sparkSession, df.schema
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/kept-{uuid.uuid4()}")
                fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
            df.write.mode("append").options(**_options()).parquet(path.toString())
            del df
            tidy(spark)
        yield spark.read.schema(schema).parquet(path.toString())
    finally:
        if path is not None:
            fs.delete(path, True)


@contextmanager
def written(df: DataFrame):
    """df computed once and read from the shared folder, as Parquet, in a fraction of the space of a checkpoint; gone at the end."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/kept-{uuid.uuid4()}")
    try:
        df.write.options(**_options()).parquet(path.toString())
        yield spark.read.schema(df.schema).parquet(path.toString())
    finally:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def dealt(df, by: str, n: int):
    """The rows of df with 0, 1 .. n - 1 in the column `by`, as frames in turn, from the shared folder; each goes as the next is asked for.

    df may be several frames of the same columns, which are written one after the other.
    """
    frames = iter([df] if isinstance(df, DataFrame) else df)
    first = next(frames)
    spark, conf, schema = first.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", first.drop(by).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/kept-{uuid.uuid4()}")
    fs, before = path.getFileSystem(spark._jsc.hadoopConfiguration()), spark.conf.get(conf, None)

    def parts():
        for k in range(n):
            part = spark._jvm.org.apache.hadoop.fs.Path(path, f"{by}={k}")
            yield spark.read.schema(schema).parquet(part.toString()) if fs.exists(part) else spark.createDataFrame([], schema)
            fs.delete(part, True)

    try:
        # Files of all n at once in a task, as rows would else be sorted for it.
        spark.conf.set(conf, n)
        try:
            while first is not None:
                first.write.mode("append").options(**_options()).partitionBy(by).parquet(path.toString())
                tidy(spark)
                first = next(frames, None)
        finally:
            spark.conf.unset(conf) if before is None else spark.conf.set(conf, before)
        yield parts()
    finally:
        fs.delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Has the driver drop what nothing refers to any more, in Python too; Spark then deletes the shuffle files of steps that are kept."""
    gc.collect()
    spark._jvm.System.gc()


def bytes_of(df: DataFrame) -> int:
    """About what the rows of df take in a hash table, counted and not estimated: Spark takes an array for one element."""
    def width(kind) -> int:
        return 16 + sum(width(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else 16

    arrays = [f for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    n, *sizes = df.agg(F.count(F.lit(1)), *(F.coalesce(F.sum(F.greatest(F.size(f.name), F.lit(0))), F.lit(0)) for f in arrays)).first()
    return n * (32 + sum(width(f.dataType) for f in df.schema.fields)) + sum(k * width(f.dataType.elementType) for k, f in zip(sizes, arrays, strict=True))


def within_rows(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", most: int = SMALL_ROWS) -> DataFrame:
    """A join whose small side is broadcast if its counted rows and bytes allow it; else both are sorted, and Spark's estimate isn't asked."""
    fits = small.count() <= most and bytes_of(small) <= SMALL_BYTES
    return big.join(F.broadcast(small) if fits else small.hint("merge"), on, how)


def own_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many more underscores in front as it takes to differ from all columns of df."""
    taken = {c.lower() for c in df.columns}
    return [next(x for k in range(len(taken) + 1) if (x := "_" * k + name).lower() not in taken) for name in names]


def chunks(batches, size: int = CHUNK_BYTES):
    """Lists of (id, text) of about `size` bytes of text from Arrow batches of an id and a text column."""
    rows, total = [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            t = t.as_py()
            rows.append((NULL_ID if i is None else i, t))
            total += len(t or "") + 64
            if total >= size:
                yield rows
                rows, total = [], 0
    if rows:
        yield rows


def columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id, as long, and the text."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the edges (a, b): the smallest node that it reaches.

    Alternating large-star and small-star steps: each links nodes to the smallest neighbour that they know, until
    every component is one star. Edges are grouped by partial minima and joined, so a hub is split by skew handling.
    Raises if edges still change in the last round.
    """
    e = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lows, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        e = keep(small)
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("a").cast("decimal(38,0)") - F.col("b"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not complete after {rounds} rounds")
    return e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()).groupBy("node").agg(F.min("component").alias("component"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
