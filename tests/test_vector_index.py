"""The inverted file: recall against the exact search, all rows filed, only probed cells read."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeweave.operators import retrieval, vector_index


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 12)) * 2
    rows = [(i, (centres[i % 20] + rng.normal(size=12)).tolist()) for i in range(1500)]
    rows += [(i, [1.0] * 12) for i in range(1500, 2300)]  # one hot group of equal vectors
    return spark.createDataFrame(rows + [(2300, None), (2301, [0.0] * 12)], "vec_id long, embedding array<double>")


@pytest.fixture(scope="module")
def index(items):
    return vector_index.build(items)


def queries(items):
    return items.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def test_recall_and_scores(items, index):
    assert index.blocks.agg(F.sum("n")).first()[0] == 2 * 2301
    assert index.blocks.agg(F.max("n")).first()[0] <= vector_index.BLOCK
    assert index.probes < len(index.centroids)
    true = retrieval.nearest(items, queries(items), 10)
    found = vector_index.search(index, queries(items), 10)
    by_score = true.select("query_id", "rank", F.col("score").alias("true")).join(found, ["query_id", "rank"])
    assert by_score.agg(F.avg((F.abs(F.col("true") - F.col("score")) < 1e-9).cast("int"))).first()[0] >= 0.95
    assert vector_index.recall(found, true).agg(F.avg("recall")).first()[0] >= 0.95


def test_all_cells_give_the_exact_search(items, index):
    want = retrieval.nearest(items, queries(items), 10)
    got = vector_index.search(index, queries(items), 10, probes=len(index.centroids)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_passes_keep_every_query(items, index, monkeypatch):
    want = sorted(map(tuple, vector_index.search(index, queries(items), 5).collect()))
    monkeypatch.setattr(vector_index, "PASS_ROWS", 7)
    assert sorted(map(tuple, vector_index.search(index, queries(items), 5).collect())) == want
    sizes = {0: 3, 1: 20, 2: 4, 3: 4}
    assert vector_index._passes(sizes) == [([1], 0, 3), ([1], 1, 3), ([1], 2, 3), ([0, 2], 0, 1), ([3], 0, 1)]


def test_only_probed_cells_are_scanned(index):
    plan = index.blocks.where(F.col("cell").isin([1, 3]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "IN (1,3)" in plan


def test_empty_tables(spark, items, index):
    none = items.limit(0)
    assert vector_index.search(index, none.withColumnRenamed("vec_id", "query_id"), 3).count() == 0
