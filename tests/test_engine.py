import random
import re

import pytest

from tidescan import Catalog, Scan, TsRange, contains, ends_with, eq, gt, gteq, is_in, lt, lteq, matches, noteq, starts_with
from tidescan.errors import AppendError, EngineError, PagingError, ScanError, SchemaError
from tidescan.functions.scalar import chunk_capacity, is_literal
from tidescan.functions.types import ALL_TYPES, parse_type
from tidescan.operators import bloom, result
from tidescan.operators.scan import StreamConfig, plan
from tidescan.sources import api
from tidescan.sources.ingest import Append
from tidescan.sources.schema import Column
from tidescan.streaming.paging import take_while

WORDS = ["Lorem", "ipsum", "dolor", "sit", "amet,", "consectetur", "adipiscing", "elit,", "sed", "do"]


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    c = Catalog.create(spark, str(tmp_path_factory.mktemp("catalog")))
    c.add_columns([Column(2, "dense1", parse_type("U32Dense")), Column(3, "sparse1", parse_type("U8Sparse")), Column(4, "dense2", parse_type("U16Dense")), Column(5, "sparse2", parse_type("U16Sparse")), Column(6, "word", parse_type("StringDense"))])
    c.append(Append(list(range(1, 11)), 1, {2: [5, 6, 7, 2, 3, 4, 1, 2, 3, 4], 3: ([1, 2, 3, 4], [1, 3, 5, 8]), 4: [10, 20, 30, 40, 50, 50, 40, 30, 20, 10], 5: ([10, 20, 30, 7, 8], [0, 1, 5, 8, 9]), 6: WORDS}))
    return c


def ts(df):
    return sorted(r["timestamp"] for r in df.collect())


@pytest.mark.parametrize("clauses, want", [
    (None, range(1, 11)), ([], range(1, 11)), ([[]], range(1, 11)), ([[lt("dense1", 3), gt("dense2", 30)]], [4, 7]), ([[lt("sparse1", 4), gt("sparse2", 15)]], [2, 6]),
    ([[gt("dense1", 4), lt("sparse2", 15)]], [1]), ([[gteq("sparse1", 4)]], [9]), ([[noteq("sparse1", 4)]], [2, 4, 6]), ([[is_in("timestamp", (2, 5, 10))]], [2, 5, 10]), ([[is_in("dense1", ())]], []),
    ([[lt("timestamp", 4), gt("timestamp", 1), lt("sparse1", 2)], [gt("timestamp", 5), gt("sparse1", 3), lteq("sparse1", 4)]], [2, 9]),
    ([[lt("word", "ipsum")]], [1, 3, 5, 6, 7, 8, 10]), ([[lteq("word", "ipsum")]], [1, 2, 3, 5, 6, 7, 8, 10]), ([[is_in("word", ("ipsum", "elit,", "sed", "not_present"))]], [2, 8, 9]), ([[starts_with("word", "s")]], [4, 9]),
    ([[ends_with("word", "it")]], [4]), ([[contains("word", "se")]], [6, 9]), ([[matches("word", "[ie]t")]], [4, 5, 6, 8]), ([[starts_with("dense2", "5")]], [5, 6]), ([[eq("source_id", 1)]], range(1, 11)),
])
def test_scans(catalog, clauses, want):
    assert ts(catalog.scan(Scan(clauses))) == list(want)


def test_projection_and_ranges(catalog):
    assert catalog.scan(Scan([[lt("timestamp", 4)]], ["sparse2", "word"])).columns == ["sparse2", "word"]
    with pytest.raises(ScanError):
        catalog.scan(Scan(projection=["nope"]))
    assert [r["nope"] for r in catalog.scan(Scan([[lt("timestamp", 2)]], ["nope"], lenient=True)).collect()] == [None]
    assert ts(catalog.scan(Scan(ts_range=TsRange(3, 5)))) == [3, 4]
    assert ts(catalog.scan(Scan(ts_range=TsRange(3, 5), granularity="chunk"))) == list(range(1, 11))
    assert ts(catalog.scan(Scan(groups=[2]))) == ts(catalog.scan(Scan(groups=[]))) == []
    with pytest.raises(ScanError):
        catalog.scan(Scan([[eq("word", 3)]]))
    with pytest.raises(ScanError):
        catalog.scan(Scan([[matches("word", "(?=x)")]]))


@pytest.mark.parametrize("start, end, want", [(17, 19, True), (8, 10, False), (17, None, True), (18, None, False), (None, 10, False), (None, 11, True), (None, None, True)])
def test_overlap(start, end, want):
    assert TsRange(start, end).holds(10, 17) is want


def test_random_dnf(spark):
    r = random.Random(4)
    rows = [(k, r.choice([None, *range(8)]), r.randrange(8), r.choice(WORDS)) for k in range(300)]
    df = spark.createDataFrame(rows, "k long, a long, b long, w string")
    py = {"lt": lambda x, v: x < v, "gteq": lambda x, v: x >= v, "noteq": lambda x, v: x != v, "contains": lambda x, v: v in str(x), "in": lambda x, v: x in v}
    make = {"lt": lt, "gteq": gteq, "noteq": noteq, "contains": contains, "in": is_in}
    for _ in range(12):
        clauses = []
        for _ in range(r.randint(1, 3)):
            ops = []
            for _ in range(r.randint(1, 3)):
                kind, c = r.choice(list(py)), r.choice("ab")
                ops.append(make[kind](c, (1, 5) if kind == "in" else "3" if kind == "contains" else r.randrange(8)))
            clauses.append(ops)
        want = [row[0] for row in rows if any(all(row["kab".index(o.column)] is not None and py[o.kind](row["kab".index(o.column)], o.value) for o in c) for c in clauses)]
        assert sorted(x.k for x in plan(Scan(clauses, ["k"]), df).collect()) == want


def test_types():
    assert len(ALL_TYPES) == 21
    u64, wide = parse_type("U64Dense"), parse_type("I128Sparse", "binary")
    assert u64.encode(2**64 - 1) == 2**64 - 1
    with pytest.raises(SchemaError):
        u64.encode(2**64)
    values = [-(2**127), -1, 0, 5, 2**127 - 1]
    assert [wide.decode(wide.encode(v)) for v in values] == values == [wide.decode(b) for b in sorted(map(wide.encode, values))]
    assert chunk_capacity([8]) == 131072 and chunk_capacity([16]) == 65536
    with pytest.raises(SchemaError):
        parse_type("StringSparse")


def test_evolution_append_reopen(spark, tmp_path):
    c = Catalog.open_or_create(spark, str(tmp_path / "c"))
    with pytest.raises(EngineError):
        Catalog.create(spark, str(tmp_path / "c"))
    assert c.append(Append([1, 2], 5)) == 2
    c.add_columns([Column(c.next_id(), "n", parse_type("I64Sparse")), Column(9, "text", parse_type("StringDense"))])
    for bad in ([Column(9, "x", parse_type("I8Dense"))], [Column(20, "n", parse_type("I8Dense"))]):
        with pytest.raises(SchemaError):
            c.add_columns(bad)
    c.append(Append([3, 4, 5], 7, {2: ([70], [1]), 9: ["alpha beta", "gamma", "x"]}))
    again = Catalog.open(spark, str(tmp_path / "c"))
    assert [(r.timestamp, r.source_id, r.n, r.text) for r in sorted(again.data().collect())] == [(1, 5, None, None), (2, 5, None, None), (3, 7, None, "alpha beta"), (4, 7, 70, "gamma"), (5, 7, None, "x")]
    for batch in (Append([], 1), Append([1], 1, {33: [1]}), Append([1], 1, {9: ["a", "b"]}), Append([1], 1, {2: ([1], [4])})):
        with pytest.raises(AppendError):
            again.append(batch)
    again.add_indexes({9: "bloom"})
    with pytest.raises(SchemaError):
        again.add_indexes({9: "bloom"})
    for needle in ("alpha", "ta", "gamm", "absent"):
        assert ts(again.scan(Scan([[contains("text", needle)]]))) == [t for t, w in ((3, "alpha beta"), (4, "gamma"), (5, "x")) if needle in w]
    before = ts(again.data())
    again.compact()
    assert ts(again.data()) == before and again.stats().count() == 2


def test_paging(spark):
    rows = [(k, s, k // 40, k % 4) for s in (1, 2) for k in range(400)]
    df = spark.createDataFrame(rows, "ts long, source_id long, chunk_id long, cycle long")
    from tidescan.streaming.paging import pages

    scan = Scan([[eq("cycle", 3)]], stream=StreamConfig(35, 6))
    got = list(pages(scan, df))
    assert len(got) > 3
    every = [(r.source_id, r.ts) for p in got for r in p.rows.collect()]
    assert len(every) == len(set(every)) and set(every) == {(s, k) for k, s, _, c in rows if c == 3}
    with pytest.raises(PagingError):
        next(pages(scan.replace(stream=StreamConfig(3, 2)), df))
    with pytest.raises(ScanError):
        StreamConfig(0, 1)
    assert take_while([10, 10, 10], 20, 1) == 2 and take_while([10, 15], 20, 4) == 1 and take_while([1, 1], 20, 4) == 2


def test_bloom(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(*(bloom.covers(bloom.encode(F.lit("a quick brown fox")), bloom.encode(F.lit(w))).alias(w) for w in ("quick", "wn fox", "a quick", "fast", "wn tox", "aquick"))).first()
    assert list(row) == [True, True, True, False, False, False]
    assert [len(x) for x in spark.range(1).select(*(bloom.trigrams(F.lit(w)) for w in ("", "ab", "abc de", "❤❤❤"))).first()] == [0, 0, 4, 7]
    assert bloom.chunk_filter([[contains("text", "abc")], [gt("n", 3)]], {"text"}) is None
    assert is_literal("abc") and not is_literal("a.c")


def test_requests(spark, tmp_path):
    c = Catalog.create(spark, str(tmp_path / "r"))
    run = lambda r: api.run_request(r, c)
    assert len(run(api.ListColumns()).ok) == 2
    assert run(api.AddColumn("", "I64Dense")).error.code == "ColumnNameCannotBeEmpty"
    assert run(api.AddColumn("n", "I64Dense")).ok == 2 and run(api.AddColumn("n", "I64Dense")).error.code == "ColumnNameAlreadyExists"
    assert run(api.AddColumn("w", "StringDense")).ok == 3
    assert run(api.Insert([], 1, [{2: []}])).error.code == "NoData" and run(api.Insert([1], 1, [])).error.code == "NoData"
    assert run(api.Insert([1, 2], 1, [{2: [1]}])).error.code == "InconsistentData" and run(api.Insert([1], 1, [{2: [1]}, {2: [1]}])).error.code == "InconsistentData"
    assert run(api.Insert([1, 2, 3], 1, [{2: [4, 5, 6]}, {3: ["ab", "bc", "cd"]}])).ok == 3
    assert run(api.ScanRequest(5, 1, [0])).error.code == "InvalidScanRequest" and run(api.ScanRequest(0, 9, [])).error.code == "InvalidScanRequest"
    assert run(api.ScanRequest(0, 9, [0], [[api.ScanFilter(3, "lt", "x")]])).error.code == "InvalidScanRequest"
    assert run(api.ScanRequest(0, 9, [0], [[api.ScanFilter(2, "contains", 3)]])).error.code == "InvalidScanRequest"
    triples, state = run(api.ScanRequest(0, 9, [0, 2], [[api.ScanFilter(2, "in", (4, 6))], [api.ScanFilter(3, "contains", "bc")]])).ok
    assert sorted(triples[0].data.to_pylist()) == [1, 2, 3] and state is None and triples[1].column_type == "I64Dense"
    assert run(api.AddColumnIndex(3)).ok == 3 and run(api.AddColumnIndex(3)).error.code == "CatalogError"
    assert run(api.RefreshCatalog()).ok["partitions"].count() == 1 and run(api.Flush()).error is None and run(object()).kind == "Other"


def test_fragments(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([None, 9, None, 4, 4])], "row long, v long")
    assert [tuple(r) for r in result.fragment_sort(df, "row", "v").collect()] == [(3, 4), (4, 4), (1, 9)]
    a, b = result.split_at_idx(df, "row", "v", 3)
    assert [tuple(r) for r in a.collect()] == [(1, 9)] and sorted(tuple(r) for r in b.collect()) == [(0, 4), (1, 4)]
    with pytest.raises(EngineError):
        result.split_at_idx(df, "row", "v", 3, sparse=False)
    assert result.max_index(df, "row", "v").first()[0] == 4 and result.result_len(df, ["v"]).first()[0] == 3
    assert [tuple(r) for r in result.to_text(df).limit(1).collect()] == [("0", "")]


def test_queries_match_sql(spark):
    import duckdb

    from tidescan.plans.queries import QUERIES, SQL

    sf, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("events", "lineitem", "documents"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    text = lambda v: re.sub(r"\.0$", "", str(v))
    for name, q in QUERIES.items():
        df, rel = q(spark, sf), db.sql(SQL[name])
        order = sorted(df.columns)
        assert order == sorted(rel.columns), name
        ours = sorted([text(r[c]) for c in order] for r in df.collect())
        theirs = sorted([text(r[rel.columns.index(c)]) for c in order] for r in rel.fetchall())
        assert ours == theirs, name
