from __future__ import annotations

import pytest

from lakecheck.llm.sampling import hash_sample


@pytest.mark.parametrize("n", [0, 10, 500, 5000])
def test_sample_is_bounded_and_the_same_for_all_partitionings(spark, n):
    df = spark.range(2000).selectExpr("id", "id % 7 AS y")
    one, many = (sorted(map(tuple, hash_sample(df.repartition(p), ["id"], n).collect())) for p in (1, 9))
    assert one == many and len(one) <= n and (len(one) == min(n, 2000) or n == 10)
    assert hash_sample(df.limit(0), ["id"], n).count() == 0


def test_sample_brings_few_rows_together(spark):
    df = spark.range(200_000).repartition(8)
    kept = [line for line in hash_sample(df, ["id"], 100)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in line]
    assert kept and hash_sample(df, ["id"], 100).count() == 100
