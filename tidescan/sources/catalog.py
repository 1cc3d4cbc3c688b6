"""Catalog: a schema document and a Parquet table under one root, which may be any path that Spark's readers open."""
from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidescan.errors import AppendError, EngineError, SchemaError
from tidescan.functions.scalar import new_id
from tidescan.operators import bloom
from tidescan.operators.scan import Scan, StreamConfig, chunk_stats, plan
from tidescan.sources.ingest import Append, capacity_of, ids_of, to_frame, with_chunks
from tidescan.sources.schema import SOURCE, TS, Column, Schema
from tidescan.streaming.paging import Page, next_page, pages

def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one, removed at exit, on a local master alone."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise EngineError("spark.checkpoint.dir isn't set: it has to name a folder that all executors share")
    own = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, own, True)
    return own


_NAMES = {"ts": TS, "source": SOURCE, "chunk": "chunk_id"}


class Catalog:
    """Schema changes and appends are single-writer; readers always see whole committed files.

    A numbered document names the schema, the generation of folders that hold the data, and the next chunk's id. A change writes the
    next document under another name and renames it, which commits it; the one before stays for readers that have just found it.
    Chunk ids are reserved before rows are written, so that a failed append leaves a gap and no chunk twice.
    """

    def __init__(self, spark: SparkSession, root: str, schema: Schema):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.version, self.generation, self.next_chunk = 0, "", 0

    # files, through Hadoop's own file systems
    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, *parts: str) -> bool:
        path, fs = self._path(*parts)
        return fs.exists(path)

    def _versions(self) -> list[int]:
        path, fs = self._path()
        found = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(m[1]) for name in found if (m := re.fullmatch(r"schema-(\d+)\.json", name)))

    def _save(self) -> None:
        """Commits the next document."""
        (new, fs), (to, _) = self._path(f"schema-{new_id()}.tmp"), self._path(f"schema-{self.version + 1:09d}.json")
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps(json.loads(self.schema.to_json()) | {"generation": self.generation, "next_chunk": self.next_chunk}, indent=1).encode()))
        stream.close()
        if fs.exists(to) or not fs.rename(new, to):
            raise EngineError(f"can't write {to}")
        self.version += 1
        for old in self._versions():
            if old < self.version - 1:
                fs.delete(self._path(f"schema-{old:09d}.json")[0], False)

    @classmethod
    def create(cls, spark: SparkSession, root: str) -> Catalog:
        out = cls(spark, root, Schema.default())
        if out._versions():
            raise EngineError(f"there is a catalog at {root} already")
        out._save()
        return out

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Catalog:
        out = cls(spark, root, Schema.default())
        if not (versions := out._versions()):
            raise EngineError(f"no catalog at {root}")
        path, fs = out._path(f"schema-{versions[-1]:09d}.json")
        stream = fs.open(path)
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        stored = json.loads(text)
        out.schema, out.version, out.generation, out.next_chunk = Schema.from_json(text), versions[-1], stored["generation"], stored["next_chunk"]
        return out

    @classmethod
    def open_or_create(cls, spark: SparkSession, root: str) -> Catalog:
        return cls.open(spark, root) if cls(spark, root, Schema.default())._versions() else cls.create(spark, root)

    # schema
    def columns(self) -> dict[int, Column]:
        return dict(self.schema.columns)

    def list_columns(self) -> DataFrame:
        return self.spark.createDataFrame([(c.id, c.name, c.type.name) for c in self.schema.columns.values()], "column_id long, name string, type string")

    def next_id(self) -> int:
        return self.schema.next_id()

    def add_columns(self, new: list[Column]) -> None:
        self.schema = self.schema.add_columns(new)
        self._save()

    def add_indexes(self, new: dict[int, str]) -> None:
        """Builds each index from the data that is there."""
        self.schema = self.schema.add_indexes(new)
        self._save()
        for i in new:
            self._index(i, self.data())

    def add_partition_group(self, source_id: int) -> None:
        """Sources need no preparation: the first append makes their directory."""

    def flush(self) -> None:
        """Appends and schema changes are durable when they return."""

    def space_for(self, names: list[str]) -> int:
        return capacity_of(self.schema, names)

    # data
    def data(self) -> DataFrame:
        """All rows, with a null in columns that are younger than a row."""
        struct = self.schema.struct().add("chunk_id", "long")
        if not self._exists(f"data{self.generation}"):
            return self.spark.createDataFrame([], struct)
        return self.spark.read.schema(struct).parquet(f"{self.root}/data{self.generation}")

    def append(self, batch: Append) -> int:
        """Rows written."""
        return self.append_frame(to_frame(self.spark, batch, self.schema), len(batch))

    def append_frame(self, df: DataFrame, rows: int | None = None) -> int:
        """Any number of rows of any sources; columns of the schema that df lacks become null, others raise."""
        if unknown := set(df.columns) - {c.name for c in self.schema.columns.values()}:
            raise SchemaError(f"columns {sorted(unknown)} not found")
        if rows is None:
            rows = self._checked(df)
        if not rows:
            return 0
        names, struct = set(df.columns), self.schema.struct()
        ready = df.select(*(F.col(f"`{f.name}`").cast(f.dataType) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in struct.fields))
        first, capacity = self.next_chunk, capacity_of(self.schema, list(names))
        self.next_chunk = first + ids_of(rows, capacity)
        self._save()
        with_chunks(ready, first, rows, capacity).write.mode("append").partitionBy(SOURCE).parquet(f"{self.root}/data{self.generation}")
        self._describe(F.col("chunk_id") >= first)
        return rows

    def _checked(self, df: DataFrame) -> int:
        """The number of rows, if every value fits its column: one pass, that raises with the number of rows that don't."""
        by_name = {c.name: c for c in self.schema.columns.values()}
        if missing := {TS, SOURCE} - set(df.columns):
            raise SchemaError(f"columns {sorted(missing)} are missing")
        wrong = [F.count_if(~by_name[n].type.check(F.col(f"`{n}`"))).alias(n) for n in df.columns]
        found = df.agg(F.count(F.lit(1)).alias("rows of the frame"), *wrong).first()
        if bad := {n: found[n] for n in df.columns if found[n]}:
            raise AppendError(f"rows with a null or a value out of range, by column: {bad}")
        return found[0]

    def _describe(self, which) -> None:
        """Stores the statistics and the index entries of chunks that were written just now."""
        data = self.data().where(which)
        chunk_stats(data, _NAMES).write.mode("append").parquet(f"{self.root}/chunks{self.generation}")
        for i in self.schema.indexes:
            self._index(i, data)

    def compact(self, capacity: int | None = None) -> None:
        """Rewrites all chunks to about `capacity` rows each, in folders of a new generation; the document that names them commits it.

        Ids go on, so cursors of running pages end.
        """
        old, data = self.generation, self.data()
        rows = data.count()
        if not rows:
            return
        capacity, first = capacity or capacity_of(self.schema, [c.name for c in self.schema.columns.values()]), 0
        self.generation = f"-{new_id()}"
        try:
            with_chunks(data, first, rows, capacity).write.partitionBy(SOURCE).parquet(f"{self.root}/data{self.generation}")
            self._describe(F.lit(True))
            self.next_chunk = ids_of(rows, capacity)
            self._save()
        except Exception:
            self.generation = old
            raise
        for name in (f"data{old}", f"chunks{old}", *(f"index{old}-{i}" for i in self.schema.indexes)):
            path, fs = self._path(name)
            fs.delete(path, True)

    def stats(self) -> DataFrame:
        """One row a chunk, as stored by the appends."""
        if not self._exists(f"chunks{self.generation}"):
            return chunk_stats(self.data(), _NAMES)
        # A chunk's rows of one source may have come in several appends only if ids were reserved twice; then they add up.
        stored = self.spark.read.parquet(f"{self.root}/chunks{self.generation}")
        return stored.groupBy(SOURCE, "chunk_id").agg(F.min("ts_min").alias("ts_min"), F.max("ts_max").alias("ts_max"), F.sum("n_rows").alias("n_rows"))

    def ts_minmax(self) -> DataFrame:
        return self.stats().agg(F.min("ts_min").alias("ts_min"), F.max("ts_max").alias("ts_max"))

    # index
    def _index(self, column_id: int, df: DataFrame) -> None:
        name = self.schema.columns[column_id].name
        bloom.build(df.where(F.col(name).isNotNull()), name, [SOURCE, "chunk_id"]).write.mode("append").parquet(f"{self.root}/index{self.generation}-{column_id}")

    def _skip_chunks(self, scan: Scan, df: DataFrame) -> DataFrame:
        """Only chunks whose filters cover the scan's needles. The side tables have one short row a chunk."""
        indexed = {self.schema.columns[i].name: i for i in self.schema.indexes}
        condition = bloom.chunk_filter(scan.filters, set(indexed))
        if condition is None:
            return df
        chunks = self.stats().select(SOURCE, "chunk_id")
        for name in {op.column for clause in scan.filters for op in clause if op.column in indexed}:
            if not self._exists(f"index{self.generation}-{indexed[name]}"):
                return df
            chunks = chunks.join(self.spark.read.parquet(f"{self.root}/index{self.generation}-{indexed[name]}").withColumnRenamed("bloom", f"bloom_{name}"), [SOURCE, "chunk_id"], "left")
        return df.join(chunks.where(condition).select(SOURCE, "chunk_id"), [SOURCE, "chunk_id"], "left_semi")

    # scans
    def _ready(self, scan: Scan) -> tuple[Scan, DataFrame]:
        projection = [c.name for c in self.schema.columns.values()] if scan.projection is None else scan.projection
        scan = replace(scan, columns=_NAMES, projection=projection)
        return scan, self._skip_chunks(scan, self.data())

    def scan(self, scan: Scan) -> DataFrame:
        scan, df = self._ready(scan)
        return plan(scan, df, self.stats() if scan.granularity == "chunk" else None)

    def page(self, scan: Scan) -> Page:
        scan, df = self._ready(scan)
        return next_page(scan, df, self.stats() if scan.granularity == "chunk" else None, self.stats())

    def pages(self, scan: Scan):
        scan, df = self._ready(scan)
        return pages(scan, df, self.stats() if scan.granularity == "chunk" else None, self.stats())

    def stream_ingest(self, stream: DataFrame, checkpoint: str):
        """Appends every micro-batch of a streaming DataFrame that has the catalog's columns."""
        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: self.append_frame(df) and None).start()


__all__ = ["Catalog", "StreamConfig"]
