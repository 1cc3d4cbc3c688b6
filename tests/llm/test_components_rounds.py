import pytest

from tidescan.llm.common import connected_components


def test_unfinished_components_raise(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long")
    with pytest.raises(RuntimeError):
        connected_components(edges, rounds=2)
