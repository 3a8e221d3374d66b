"""The best-k merge of the exact vector search: against brute force with ties, and what it holds at once."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from lakeweave.operators import retrieval


def test_merged_best_equal_brute_force():
    rng = np.random.default_rng(1)
    for n, k in ((1, 3), (5, 9), (40, 4), (61, 10)):
        x, ids = retrieval._unit(rng.integers(-1, 2, (n, 3)).astype(float)), rng.permutation(n)
        wanted, own = ids[: n // 2 + 1], x[: n // 2 + 1]
        best_id, best = np.zeros((len(wanted), k), np.int64), np.full((len(wanted), k), -np.inf)
        for at in range(0, n, 7):
            retrieval._keep_best(best_id, best, own, wanted, ids[at : at + 7], x[at : at + 7])
        for row, i in enumerate(wanted):
            scores = np.round(x @ own[row], 9)
            true = sorted((-scores[m], ids[m]) for m in range(n) if ids[m] != i)[:k]
            assert [i for _, i in true] == best_id[row][best[row] > -np.inf].tolist()


def test_a_block_of_queries_holds_a_bounded_piece_at_once():
    rng = np.random.default_rng(2)
    x, ids = retrieval._unit(rng.normal(size=(retrieval.STRIPE, 64))), np.arange(retrieval.STRIPE)
    best_id, best = np.zeros((retrieval.ASKED, 100), np.int64), np.full((retrieval.ASKED, 100), -np.inf)
    tracemalloc.start()
    retrieval._keep_best(best_id, best, x[: retrieval.ASKED], ids[: retrieval.ASKED], ids, x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20


def test_vectors_of_unequal_length_are_refused():
    import pyarrow as pa

    with pytest.raises(ValueError, match="components"):
        retrieval._matrix(pa.array([[1.0, 2.0], [1.0]]))


def test_hop_metrics_use_all_dimensions(spark, tmp_path):
    """The first 16 dimensions are equal: the rest alone tells the twelve vectors near the query from those before them."""
    from lakeweave.plans import registry

    near, far = [1.0] * 64, [1.0] * 16 + [-1.0] * 48
    rows = [(k, near if k == 0 or k > 15 else far, "b" if 0 < k < 16 else "a") for k in range(28)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["graph_hop_metrics"](spark, str(tmp_path)).collect()
    assert [(r["query_id"], r["recall"], r["hit"], r["mrr"], r["mean_hops"], r["least_hops"]) for r in got] == [(0, 1.0, 1, 1.0, 2.0, 1)]
