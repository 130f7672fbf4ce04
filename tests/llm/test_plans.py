"""Tables that grow with the input aren't broadcast, however small their estimates are."""

import numpy as np

from gridlake.llm import ann, minhash, simhash


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fingerprints_are_joined_by_shuffle(spark, sf):
    made = simhash.links(spark.range(50).selectExpr("xxhash64(id) as fp"))
    grouped = simhash.group(spark.read.parquet(f"{sf}/documents.parquet"))
    for df in (made, grouped):
        assert "SortMergeJoin" in plan(df) and "Broadcast" not in plan(df)


def test_probes_and_index_are_joined_by_shuffle(spark):
    rows = spark.range(40).selectExpr("id as h", "id as g", "array(double(id), 1d, 2d, 3d) as v")
    index = ann.learn(np.random.default_rng(1).standard_normal((40, 4)), 40)
    made = ann.fetched(rows, rows.where("h < 3"), index, 4)
    assert "SortMergeJoin" in plan(made) and "Broadcast" not in plan(made)


def test_near_copies_are_joined_by_shuffle(spark, sf):
    made = minhash.links(spark.read.parquet(f"{sf}/documents.parquet"))
    assert "SortMergeJoin" in plan(made) and "Broadcast" not in plan(made)
