import numpy as np
import pytest
from pyspark.sql import functions as F

from tidescan.llm import line_dedup
from tidescan.llm.common import shared_folder, written


def near_pairs(spark):
    """50 pairs of near lines; all 100 lines are posted under one stretch, and the two of a pair share no other."""
    r = np.random.default_rng(21)
    word = lambda: "".join(r.choice(list("abcdefghijklmnop"), 5))
    some = [f"{word()} {word()} {word()}" for _ in range(3000)]
    # The smallest hash of many: one of the ten of each line.
    hashed = spark.createDataFrame([(x,) for x in some], "x string").select("x", F.xxhash64(F.substring("x", 1, 14)).alias("h"))
    common = hashed.orderBy("h").first().x.split(" ")
    rows = []
    for k in range(50):
        w = [word() for _ in range(33)]
        w[15:18] = common
        other = [x if i % 2 or i == 16 else "z" + x[1:] for i, x in enumerate(w)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    return rows


def test_near_lines_with_nothing_but_a_common_stretch_in_common(spark):
    docs = spark.createDataFrame(near_pairs(spark), "doc_id long, text string")
    seen = line_dedup.signatures(docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), "text"))
    keys = {x.id: {k >> line_dedup.PLACE for k in x["keys"]} for x in seen.collect()}
    assert all(len(keys[i] & keys[i + 1]) == 1 for i in range(0, 100, 2)) and len(set.intersection(*keys.values())) == 1 and line_dedup.FEW < 100
    got = {x.doc_id: x.n_removed for x in line_dedup.line_dedup(docs).collect()}
    assert got == {i: i % 2 for i in range(100)}


def test_pipeline_links_them_too(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, t, len(t)) for i, t in near_pairs(spark)], "doc_id long, text string, n_chars long")
    got = {x.doc_id: x.n_chars == 0 for x in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert got == {i: i % 2 == 1 for i in range(100)}


def test_lengths_within_the_share_are_in_adjoining_spans(spark):
    spans = [x.s for x in spark.range(1, 3000).select(F.col("id").alias("len")).select(line_dedup.span(0.1).alias("s")).collect()]
    for n in range(1, 3000):
        assert 0 <= spans[n - 1] - spans[n - n // 10 - 1] <= 1


def test_written_is_gone_at_the_end(spark):
    from pathlib import Path

    folder = lambda: set(Path(shared_folder(spark).removeprefix("file:")).glob("kept-*"))
    before = folder()
    with pytest.raises(ZeroDivisionError), written(spark.range(5)) as df:
        assert df.count() == 5 and len(folder() - before) == 1
        raise ZeroDivisionError
    assert folder() == before
