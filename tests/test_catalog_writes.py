"""Writes that must not lose or let in anything, the regular expressions' dialect, and pages that read a page."""
import pytest
from pyspark.sql import functions as F

from tidescan.errors import AppendError, EngineError, ScanError
from tidescan.functions.scalar import check_pattern, java_pattern, split_micros
from tidescan.functions.types import parse_type
from tidescan.operators.predicates import count_or_clauses, gt
from tidescan.operators.scan import Scan, StreamConfig
from tidescan.sources.catalog import Catalog
from tidescan.sources.schema import Column
from tidescan.streaming import paging


def catalog(spark, root):
    c = Catalog.create(spark, str(root))
    c.add_columns([Column(2, "n", parse_type("U8Dense")), Column(3, "s", parse_type("StringDense")), Column(4, "x", parse_type("I64Sparse"))])
    return c


@pytest.mark.parametrize("row", [(1, 0, 300, "a", None), (1, 0, -7, "a", None), (1, 0, None, "a", None), (1, 0, 5, None, None), (None, 0, 5, "a", None), (1, None, 5, "a", None)])
def test_frames_are_checked(spark, tmp_path, row):
    c = catalog(spark, tmp_path / "c")
    frame = lambda rows: spark.createDataFrame(rows, "timestamp long, source_id long, n int, s string, x long")
    with pytest.raises(AppendError):
        c.append_frame(frame([(1, 0, 5, "a", None), row]))
    assert c.data().isEmpty() and c.append_frame(frame([(1, 0, 255, "", None), (2, 1, 0, "b", 9)])) == 2


def test_compaction_commits_by_its_document(spark, tmp_path, monkeypatch):
    c = catalog(spark, tmp_path / "c")
    rows = spark.range(1000).select(F.col("id").alias("timestamp"), (F.col("id") % 2).alias("source_id"), (F.col("id") % 200).cast("int").alias("n"), F.lit("abc").alias("s"))
    c.append_frame(rows)
    c.add_indexes({3: "bloom"})
    before = c.next_chunk
    with monkeypatch.context() as m:
        m.setattr(Catalog, "_save", lambda self: (_ for _ in ()).throw(EngineError("stopped")))
        with pytest.raises(EngineError):
            c.compact(100)
    again = Catalog.open(spark, str(tmp_path / "c"))
    assert again.data().count() == 1000 and again.next_chunk == before and c.data().count() == 1000
    again.compact(100)
    late = Catalog.open(spark, str(tmp_path / "c"))
    assert late.data().count() == 1000 == late.stats().agg(F.sum("n_rows")).first()[0] and late.next_chunk == 10
    late.append_frame(rows.limit(5))
    assert late.data().agg(F.max("chunk_id")).first()[0] == 10 and late.ts_minmax().first() == (0, 999)
    with pytest.raises(EngineError):
        Catalog.create(spark, str(tmp_path / "c"))


def test_dialect(spark):
    for ok in ("[*+]", "a[?+]b", "[]+]+", r"\++", "(ab)+c*"):
        assert check_pattern(ok) == ok
    for bad in ("(?=a)", r"(a)\1", "a++", "a*+", "(?<!b)a", "[ab]++"):
        with pytest.raises(ScanError):
            check_pattern(bad)
    texts = spark.createDataFrame([("a",), ("a\n",), ("$",), ("é1",), ("a\rb",)], "s string")
    found = lambda p: {r.s for r in texts.where(F.col("s").rlike(java_pattern(p))).collect()}
    assert found("a$") == {"a"} and found("[$]") == {"$"} and found(r"\$") == {"$"} and found(r"^\w\d$") == {"é1"} and found("a.b") == {"a\rb"}


def test_a_page_reads_a_page(spark, tmp_path, monkeypatch):
    c = catalog(spark, tmp_path / "c")
    c.append_frame(spark.range(4000).select(F.col("id").alias("timestamp"), F.lit(0).cast("long").alias("source_id"), (F.col("id") % 100).cast("int").alias("n"), F.lit("t").alias("s")))
    c.compact(100)
    asked = []
    between = paging.between
    monkeypatch.setattr(paging, "between", lambda scan, rows, first, last: asked.append((first, last)) or between(scan, rows, first, last))
    scan = Scan([[gt("n", -1)]], ["timestamp"], stream=StreamConfig(300, 50))
    page = c.page(scan)
    assert page.rows.count() == len(page.chunks) * 100 == 300 and max(last[1] - first[1] for first, last in asked) <= 3
    every = [r.timestamp for p in c.pages(scan) for r in p.rows.collect()]
    assert sorted(every) == list(range(4000))
    rare = c.pages(Scan([[gt("n", 98)]], ["timestamp"], stream=StreamConfig(7, 2)))
    assert sorted(r.timestamp for p in rare for r in p.rows.collect()) == list(range(99, 4000, 100))


def test_small_helpers(spark):
    assert count_or_clauses(None) == 0 and count_or_clauses([[gt("n", 1)], []]) == 2
    assert tuple(spark.range(1).select(*split_micros(F.lit(-1_500_000))).first()) == (-2, 500_000)
