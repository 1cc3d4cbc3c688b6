"""One query for each operator, over the test tables, and its SQL."""
from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidescan.functions.scalar import new_id, ts_from_micros, ts_micros, value_display
from tidescan.functions.types import parse_type
from tidescan.operators import bloom, result
from tidescan.operators.predicates import Op, contains, ends_with, eq, gt, gteq, is_in, lt, lteq, matches, noteq, starts_with
from tidescan.operators.scan import Scan, StreamConfig, TsRange, chunk_stats, plan
from tidescan.sources.catalog import Catalog, scratch
from tidescan.sources.schema import Column
from tidescan.streaming.paging import next_page, pages

QUERIES: dict = {}
SQL: dict[str, str] = {}
FROM, TO = dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 5)
_E = "(SELECT *, CAST(user_id % 3 AS INTEGER) AS source_id, CAST(ts AS DATE) AS chunk_id, user_id AS dense1, event_type AS string1, CASE WHEN event_type = 'error' THEN user_id END AS sparse1, CASE WHEN event_id % 4 = 0 THEN event_id END AS sparse2 FROM events)"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with the engine's columns: a source, a day chunk, dense and sparse ones."""
    e = read(spark, sf_dir, "events")
    return e.select("*", (F.col("user_id") % 3).cast("int").alias("source_id"), F.to_date("ts").alias("chunk_id"), F.col("user_id").alias("dense1"), F.col("event_type").alias("string1"), F.when(F.col("event_type") == "error", F.col("user_id")).alias("sparse1"), F.when(F.col("event_id") % 4 == 0, F.col("event_id")).alias("sparse2"))


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def scan_query(name: str, scan: Scan, where: str, select: str | None = None, table: str = "events") -> None:
    select = select or ", ".join(scan.projection)
    source = _E if table == "events" else table
    load = events if table == "events" else functools.partial(lambda s, d, t: read(s, d, t), t=table)
    query(name, f"SELECT {select} FROM {source} t WHERE {where}")(lambda spark, sf_dir: plan(scan, load(spark, sf_dir)))


_ID = ["event_id", "dense1"]
for _n, _f, _s in (("lt", lt, "<"), ("lteq", lteq, "<="), ("eq", eq, "="), ("gteq", gteq, ">="), ("gt", gt, ">"), ("noteq", noteq, "<>")):
    scan_query(f"filter_{_n}", Scan([[_f("dense1", 50)]], _ID), f"dense1 {_s} 50")
    scan_query(f"str_{_n}", Scan([[_f("string1", "error")]], ["event_id", "string1"]), f"string1 {_s} 'error'")
scan_query("filter_in", Scan([[is_in("dense1", (2, 5, 10))]], _ID), "dense1 IN (2, 5, 10)")
scan_query("filter_in_empty", Scan([[is_in("dense1", ())]], _ID), "FALSE")
scan_query("str_in", Scan([[is_in("string1", ("error", "click", "absent"))]], ["event_id", "string1"]), "string1 IN ('error', 'click', 'absent')")
scan_query("num_startswith", Scan([[starts_with("dense1", "12")]], _ID), "starts_with(CAST(dense1 AS VARCHAR), '12')")
scan_query("num_endswith", Scan([[ends_with("dense1", "7")]], _ID), "suffix(CAST(dense1 AS VARCHAR), '7')")
scan_query("num_contains", Scan([[contains("dense1", "3")]], _ID), "contains(CAST(dense1 AS VARCHAR), '3')")
scan_query("num_matches", Scan([[matches("dense1", "^1[0-3]$")]], _ID), "regexp_matches(CAST(dense1 AS VARCHAR), '^1[0-3]$')")
scan_query("str_startswith", Scan([[starts_with("text", "T")]], ["doc_id"]), "starts_with(text, 'T')", table="documents")
scan_query("str_endswith", Scan([[ends_with("text", ".")]], ["doc_id"]), "suffix(text, '.')", table="documents")
scan_query("str_contains", Scan([[contains("text", "se")]], ["doc_id"]), "contains(text, 'se')", table="documents")
scan_query("str_matches", Scan([[matches("text", "[ie]t")]], ["doc_id"]), "regexp_matches(text, '[ie]t')", table="documents")
scan_query("and_single_column", Scan([[gt("dense1", 10), lt("dense1", 20)]], _ID), "dense1 > 10 AND dense1 < 20")
scan_query("and_two_columns", Scan([[gt("dense1", 10), lt("dense1", 20), eq("string1", "click")]], _ID), "dense1 > 10 AND dense1 < 20 AND string1 = 'click'")
scan_query("or_single_column", Scan([[gt("dense1", 10), lt("dense1", 20)], [lt("dense1", 5)]], _ID), "(dense1 > 10 AND dense1 < 20) OR dense1 < 5")
scan_query("or_multi_column", Scan([[gt("dense1", 10), lt("dense1", 20), eq("string1", "click")], [lt("dense1", 7), noteq("string1", "click")]], _ID), "(dense1 > 10 AND dense1 < 20 AND string1 = 'click') OR (dense1 < 7 AND string1 <> 'click')")
scan_query("or_implied_true", Scan([[gt("dense1", 10), lt("dense1", 20), eq("string1", "click")], [lt("dense1", 7)]], _ID), "(dense1 > 10 AND dense1 < 20 AND string1 = 'click') OR dense1 < 7")
scan_query("empty_clause_true", Scan([[]], _ID), "TRUE")
scan_query("sparse_filter", Scan([[gteq("sparse1", 4)]], ["event_id", "sparse1"]), "sparse1 >= 4")
scan_query("sparse_noteq", Scan([[noteq("sparse1", 5)]], ["event_id", "sparse1"]), "sparse1 <> 5")
scan_query("sparse_dense_and", Scan([[gteq("sparse1", 4), lt("dense1", 12)]], ["event_id", "sparse1"]), "sparse1 >= 4 AND dense1 < 12")
scan_query("sparse_two_columns", Scan([[lt("sparse1", 9), gt("sparse2", 15)]], ["event_id", "sparse1", "sparse2"]), "sparse1 < 9 AND sparse2 > 15")
scan_query("sparse_materialize", Scan([[lt("dense1", 10)]], ["event_id", "sparse1", "sparse2"]), "dense1 < 10")
_ALL = "event_id, ts, user_id, event_type, value, props, source_id, dense1, string1, sparse1, sparse2"
scan_query("scan_full", Scan(projection=_ALL.split(", ")), "TRUE")
scan_query("ts_full", Scan(projection=["event_id", "ts"], ts_range=TsRange()), "TRUE")
scan_query("ts_from", Scan(projection=["event_id", "ts"], ts_range=TsRange(FROM)), "ts >= TIMESTAMP '2024-01-03'")
scan_query("ts_to", Scan(projection=["event_id", "ts"], ts_range=TsRange(None, TO)), "ts < TIMESTAMP '2024-01-05'")
scan_query("ts_bounded", Scan(projection=["event_id", "ts"], ts_range=TsRange(FROM, TO)), "ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-05'")
_A, _B = dt.datetime(2024, 1, 3, 12), dt.datetime(2024, 1, 5, 12)
query("ts_bounded_chunk", f"SELECT event_id, ts FROM {_E} t JOIN (SELECT source_id AS s, chunk_id AS c, min(ts) AS lo, max(ts) AS hi FROM {_E} u GROUP BY 1, 2) k ON source_id = s AND chunk_id = c WHERE hi >= TIMESTAMP '2024-01-03 12:00:00' AND lo < TIMESTAMP '2024-01-05 12:00:00'")(lambda spark, d: plan(Scan(projection=["event_id", "ts"], ts_range=TsRange(_A, _B), granularity="chunk"), events(spark, d)))
scan_query("scan_groups", Scan(projection=["event_id", "source_id"], groups=[0, 2, 77]), "source_id IN (0, 2)")
scan_query("scan_partitions", Scan(projection=["event_id", "ts"], partitions=[dt.date(2024, 1, 4), dt.date(2024, 1, 9)]), "chunk_id IN (DATE '2024-01-04', DATE '2024-01-09')")
scan_query("project_selected", Scan([[lt("dense1", 4)]], ["event_id", "dense1", "sparse2"]), "dense1 < 4")
scan_query("project_no_queried", Scan([[lt("dense1", 4)]], ["event_id", "sparse2"]), "dense1 < 4")
scan_query("project_missing", Scan([[lt("dense1", 4)]], ["event_id", "absent"], lenient=True), "dense1 < 4", "event_id, CAST(NULL AS BIGINT) AS absent")
scan_query("scan_empty", Scan([[gt("dense1", 100000), lt("dense1", 100001)]], ["event_id", "sparse1"]), "FALSE")
query("filter_only_count", "SELECT count(*) AS n_rows FROM lineitem WHERE l_partkey > 10 AND l_partkey <= 1000")(lambda spark, d: result.result_len(plan(Scan([[gt("l_partkey", 10), lteq("l_partkey", 1000)]], []), read(spark, d, "lineitem"))))


@query("absent_column_filter", f"SELECT event_id, dense1 FROM {_E} t WHERE FALSE")
def absent_column_filter(spark, d):
    young = events(spark, d).withColumn("young", F.lit(None).cast("long"))
    return plan(Scan([[gt("young", 1)]], _ID), young)


_TEXTS = ((1, "☀☀☀"), (2, "🌊🌧🌊"), (3, "⏳☀☀"), (4, "sun☀rise"), (5, "tide⏳☀tide"))


@query("str_matches_utf8", f"SELECT id FROM (VALUES {', '.join(f'({k}, {t!r})' for k, t in _TEXTS)}) t(id, s) WHERE regexp_matches(s, '(☀{{3,}}|⏳☀[^☀])')")
def str_matches_utf8(spark, d):
    return plan(Scan([[matches("s", "(☀{3,}|⏳☀[^☀])")]], ["id"]), spark.createDataFrame(_TEXTS, "id int, s string"))


@query("str_matches_class", f"SELECT event_id FROM {_E} t WHERE regexp_matches(string1, '[*+cl]i')")
def str_matches_class(spark, d):
    return plan(Scan([[matches("string1", "[*+cl]i")]], ["event_id"]), events(spark, d))


@query("str_matches_end", f"SELECT event_id FROM {_E} t WHERE regexp_matches(string1, '(k|r)\\z')")
def str_matches_end(spark, d):
    """Texts with a line feed after them don't match."""
    rows = events(spark, d).select("event_id", F.explode(F.array("string1", F.concat("string1", F.lit("\n")))).alias("string1"))
    return plan(Scan([[matches("string1", "(k|r)$")]], ["event_id"]), rows)


@query("flagship", f"SELECT event_id, ts, sparse1 FROM {_E} t WHERE dense1 >= 5 AND dense1 <= 12 AND sparse1 IN (7, 9, 11) AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20'")
def flagship(spark, d):
    return plan(Scan([[gteq("dense1", 5), lteq("dense1", 12), is_in("sparse1", (7, 9, 11))]], ["event_id", "ts", "sparse1"], ts_range=TsRange(FROM, dt.datetime(2024, 1, 20))), events(spark, d))


query("ts_minmax", "SELECT min(ts) AS ts_min, max(ts) AS ts_max FROM events")(lambda spark, d: events(spark, d).agg(F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max")))
query("chunk_stats", f"SELECT source_id, CAST(chunk_id AS VARCHAR) AS chunk_id, min(ts) AS ts_min, max(ts) AS ts_max, count(*) AS n_rows FROM {_E} t GROUP BY 1, 2")(lambda spark, d: chunk_stats(events(spark, d)).withColumn("chunk_id", F.col("chunk_id").cast("string")))
query("result_len", f"SELECT count(*) AS n_rows FROM {_E} t WHERE dense1 < 20")(lambda spark, d: result.result_len(plan(Scan([[lt("dense1", 20)]], ["dense1"]), events(spark, d))))
query("result_len_sparse", f"SELECT count(*) AS n_rows FROM {_E} t WHERE sparse1 IS NOT NULL OR sparse2 IS NOT NULL")(lambda spark, d: result.result_len(plan(Scan(projection=["sparse1", "sparse2"]), events(spark, d)), ["sparse1", "sparse2"]))
query("append_count", f"SELECT source_id, count(*) AS n_rows FROM {_E} t GROUP BY 1")(lambda spark, d: events(spark, d).groupBy("source_id").agg(F.count(F.lit(1)).alias("n_rows")))


@query("merge_union", f"SELECT event_id, dense1, CAST(NULL AS BIGINT) AS sparse1 FROM {_E} t WHERE source_id = 0 UNION ALL SELECT event_id, CAST(NULL AS BIGINT), sparse1 FROM {_E} u WHERE source_id = 1")
def merge_union(spark, d):
    e = events(spark, d)
    return result.merge(plan(Scan(projection=["event_id", "dense1"], groups=[0]), e), plan(Scan(projection=["event_id", "sparse1"], groups=[1]), e))


query("rows_with_nulls", f"SELECT event_id, sparse1, sparse2 FROM {_E} t WHERE dense1 IN (1, 2, 3)")(lambda spark, d: plan(Scan([[is_in("dense1", (1, 2, 3))]], ["event_id", "sparse1", "sparse2"]), events(spark, d)))
query("fragment_iter", f"SELECT event_id, sparse2 FROM {_E} t WHERE sparse2 IS NOT NULL")(lambda spark, d: result.fragment_iter(events(spark, d), "event_id", "sparse2"))
query("fragment_sort", f"SELECT event_id, sparse1 FROM {_E} t WHERE sparse1 IS NOT NULL ORDER BY sparse1, event_id")(lambda spark, d: result.fragment_sort(events(spark, d), "event_id", "sparse1"))
query("fragment_max_index", f"SELECT max(event_id) AS max_index FROM {_E} t WHERE sparse1 IS NOT NULL")(lambda spark, d: result.max_index(events(spark, d), "event_id", "sparse1"))
query("fragment_split_idx", f"SELECT event_id - 500 AS event_id, sparse1 FROM {_E} t WHERE sparse1 IS NOT NULL AND event_id >= 500")(lambda spark, d: result.split_at_idx(events(spark, d), "event_id", "sparse1", 500)[1])

_PAGE = Scan([[lt("dense1", 100)]], ["event_id", "source_id"], stream=StreamConfig(400, 150))


@query("stream_page_1", f"WITH RECURSIVE c AS (SELECT source_id AS s, chunk_id AS k, count(*) AS n FROM {_E} t WHERE dense1 < 100 GROUP BY 1, 2), r AS (SELECT s, k, sum(n) OVER (ORDER BY s, k) AS total, coalesce(sum(n) OVER (ORDER BY s, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c) SELECT event_id, source_id FROM {_E} u JOIN r ON source_id = s AND chunk_id = k WHERE dense1 < 100 AND total <= 550 AND before < 250")
def stream_page_1(spark, d):
    return next_page(_PAGE, events(spark, d)).rows


@query("stream_all_pages", f"SELECT event_id, source_id FROM {_E} t WHERE dense1 < 100")
def stream_all_pages(spark, d):
    n = read(spark, d, "events").count()
    scan = _PAGE.replace(stream=StreamConfig(max(400, n // 6), max(150, n // 30)))
    return result.merge(*(p.rows for p in pages(scan, events(spark, d))))


@query("bloom_contains", "SELECT doc_id FROM documents WHERE contains(text, 'worthless')")
def bloom_contains(spark, d):
    docs = read(spark, d, "documents").withColumn("chunk_id", F.floor(F.col("doc_id") / 64))
    clauses = [[contains("text", "worthless")]]
    index = bloom.build(docs, "text", ["chunk_id"]).withColumnRenamed("bloom", "bloom_text")
    may = docs.select("chunk_id").distinct().join(index, "chunk_id", "left").where(bloom.chunk_filter(clauses, {"text"})).select("chunk_id")
    return plan(Scan(clauses, ["doc_id"]), docs.join(may, "chunk_id", "left_semi"))


query("ts_micros", "SELECT event_id, epoch_us(ts) AS micros FROM events")(lambda spark, d: read(spark, d, "events").select("event_id", ts_micros(F.col("ts")).alias("micros")))
query("ts_round_trip", "SELECT event_id, ts FROM events")(lambda spark, d: read(spark, d, "events").select("event_id", ts_from_micros(ts_micros(F.col("ts"))).alias("ts")))
query("value_display", f"SELECT event_id, coalesce(CAST(sparse1 AS VARCHAR), '') AS shown FROM {_E} t")(lambda spark, d: events(spark, d).select("event_id", value_display(F.col("sparse1")).alias("shown")))
query("numeric_bench_dense", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey > 10 AND l_partkey <= 1000")(lambda spark, d: plan(Scan([[gt("l_partkey", 10), lteq("l_partkey", 1000)]], ["l_orderkey", "l_partkey"]), read(spark, d, "lineitem")))
query("numeric_bench_sparse", "SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN l_partkey END AS sparse1 FROM lineitem WHERE l_orderkey % 2 = 0 AND l_partkey > 10 AND l_partkey <= 1000")(lambda spark, d: plan(Scan([[gt("sparse1", 10), lteq("sparse1", 1000)]], ["l_orderkey", "sparse1"]), read(spark, d, "lineitem").withColumn("sparse1", F.when(F.col("l_orderkey") % 2 == 0, F.col("l_partkey")))))
query("string_bench_regex", "SELECT doc_id FROM documents WHERE regexp_matches(text, 'worthless')")(lambda spark, d: plan(Scan([[matches("text", "worthless")]], ["doc_id"]), read(spark, d, "documents")))


def _catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """events in a catalog of its own in the shared folder, appended source by source, with an index on string1."""
    catalog = Catalog.create(spark, f"{scratch(spark)}/catalog-{new_id()}")
    e = read(spark, sf_dir, "events").select(ts_micros(F.col("ts")).alias("timestamp"), (F.col("user_id") % 3).alias("source_id"), "event_id", F.col("event_type").alias("string1"), F.when(F.col("event_id") % 4 == 0, F.col("event_id")).alias("sparse2"))
    catalog.add_columns([Column(2, "event_id", parse_type("I64Dense")), Column(3, "string1", parse_type("StringDense")), Column(4, "sparse2", parse_type("I64Sparse"))])
    catalog.append_frame(e.where("source_id = 0"))
    catalog.add_indexes({3: "bloom"})
    catalog.append_frame(e.where("source_id > 0"))
    return catalog


query("append_scan", "SELECT event_id, epoch_us(ts) AS timestamp, CASE WHEN event_id % 4 = 0 THEN event_id END AS sparse2 FROM events WHERE event_id > 20")(lambda spark, d: _catalog(spark, d).scan(Scan([[gt("event_id", 20)]], ["event_id", "timestamp", "sparse2"])))
query("indexed_contains", "SELECT event_id FROM events WHERE contains(event_type, 'lick') OR event_type = 'error'")(lambda spark, d: _catalog(spark, d).scan(Scan([[contains("string1", "lick")], [eq("string1", "error")]], ["event_id"])))
query("catalog_ts_minmax", "SELECT epoch_us(min(ts)) AS ts_min, epoch_us(max(ts)) AS ts_max FROM events")(lambda spark, d: _catalog(spark, d).ts_minmax())


@query("catalog_pages", "SELECT event_id FROM events WHERE event_id % 4 = 0 AND event_id > 8")
def catalog_pages(spark, d):
    catalog = _catalog(spark, d)
    catalog.compact(700)
    return result.merge(*(p.rows for p in catalog.pages(Scan([[gt("sparse2", 8)]], ["event_id"], stream=StreamConfig(20_000, 8_000)))))


query("list_columns", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'timestamp', 'U64Dense'), (CAST(1 AS BIGINT), 'source_id', 'I32Dense'), (CAST(2 AS BIGINT), 'event_id', 'I64Dense'), (CAST(3 AS BIGINT), 'string1', 'StringDense'), (CAST(4 AS BIGINT), 'sparse2', 'I64Sparse')) t(column_id, name, type)")(lambda spark, d: _catalog(spark, d).list_columns())
_T = {"dense1": (2, "I64Dense"), "sparse1": (3, "I64Sparse"), "string1": (4, "StringDense")}
query("scan_result_triples", " UNION ALL ".join(f"SELECT event_id, CAST({i} AS BIGINT) AS column_id, '{t}' AS column_type, CAST({c} AS VARCHAR) AS data FROM {_E} t WHERE dense1 < 20" for c, (i, t) in _T.items()))(lambda spark, d: result.triples(plan(Scan([[lt("dense1", 20)]], ["event_id", *_T]), events(spark, d)), "event_id", {c: i for c, (i, _) in _T.items()}, {c: t for c, (_, t) in _T.items()}))


@query("u64_compare", "SELECT event_id FROM events WHERE CAST(event_id AS DECIMAL(20, 0)) + CAST('18446744073709551000' AS DECIMAL(20, 0)) >= CAST('18446744073709551100' AS DECIMAL(20, 0))")
def u64_compare(spark, d):
    wide = read(spark, d, "events").withColumn("wide", (F.col("event_id").cast(T.DecimalType(20, 0)) + F.lit("18446744073709551000").cast(T.DecimalType(20, 0))).cast(T.DecimalType(20, 0)))
    return plan(Scan([[Op("wide", "gteq", 18446744073709551100)]], ["event_id"]), wide)
