from pyspark.sql import functions as F

from tidescan.operators import bloom
from tidescan.sources import ingest


def test_index_is_built_in_compiled_steps(spark):
    """Trigrams were made by steps within arrays, which aren't compiled."""
    texts = [(1, "a quick brown fox"), (1, "❤❤"), (2, "ab"), (2, None), (3, "abc")]
    df = spark.createDataFrame(texts, "k int, text string")
    out = bloom.build(df, "text", ["k"])
    want = {}
    for k, bits in df.where(F.octet_length("text") >= 3).select("k", bloom.encode(F.col("text"))).collect():
        want[k] = [x | y for x, y in zip(want.get(k, [0] * 4), bits, strict=True)]
    assert {r.k: r.bloom for r in out.collect()} == want and set(want) == {1, 3}
    assert "transform" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_task_cuts_many_chunks(spark, monkeypatch):
    """There was a task, and a file for each source, for every chunk."""
    df = spark.range(1000).select(F.col("id").alias(ingest.TS), (F.col("id") % 3).alias(ingest.SOURCE))
    for rows, tasks in ((1 << 18, 1), (400, 3)):
        monkeypatch.setattr(ingest, "TASK_ROWS", rows)
        out = ingest.with_chunks(df, 5, 1000, 10)
        assert out.rdd.getNumPartitions() == tasks
        chunks = sorted(out.groupBy("chunk_id").agg(F.min(ingest.TS), F.max(ingest.TS), F.count("*")).collect())
        assert len(chunks) <= 100 + tasks and max(c[3] for c in chunks) == 10 and sum(c[3] for c in chunks) == 1000
        assert all(x[2] < y[1] for x, y in zip(chunks, chunks[1:], strict=False)) and 5 <= chunks[0][0] and chunks[-1][0] < 5 + ingest.ids_of(1000, 10)
