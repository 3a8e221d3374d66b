"""Queries over whole tables: against their SQL on tables with wider keys than the test tables."""

from __future__ import annotations

import duckdb
import pytest

from lakeweave.plans import registry

from .compare import TABLES, connection, same

QUERIES, SQL = registry.queries(), registry.oracle_sql()
WHOLE = "clock_compare clock_merge context_texts khop lineage_hash_verify lineage_step_hashes lineage_upstream link_score network_value presence_list sage_layer similar_pairs_jaccard".split()


@pytest.fixture(scope="module")
def wide(sf_dir, tmp_path_factory):
    """The test tables with wider keys: orders past 3,000, parts past 200, vectors past 499, users past 29."""
    folder, con = tmp_path_factory.mktemp("wide"), duckdb.connect()
    for name in TABLES:
        rows = f"SELECT * FROM '{sf_dir}/{name}.parquet'"
        if name == "lineitem":
            rows = f"SELECT * REPLACE (l_orderkey * 7 AS l_orderkey, l_partkey * 5 AS l_partkey) FROM '{sf_dir}/{name}.parquet'"
        elif name == "embeddings":
            rows = f"{rows} UNION ALL SELECT * REPLACE (vec_id + (SELECT count(*) FROM '{sf_dir}/{name}.parquet') AS vec_id) FROM '{sf_dir}/{name}.parquet'"
        elif name == "events":
            rows = f"SELECT * REPLACE (user_id + 20 AS user_id) FROM '{sf_dir}/{name}.parquet'"
        con.sql(f"COPY ({rows}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_whole_table(spark, wide, name):
    same(QUERIES[name](spark, wide), connection(wide).sql(SQL[name]))


def test_query_terms_read_the_whole_text(spark, tmp_path):
    spark.createDataFrame([(1, "- " * 40 + "late words"), (2, "short")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r["item_id"]: r["terms"] for r in QUERIES["query_terms"](spark, str(tmp_path)).collect()} == {1: "late,words", 2: "short"}


def test_a_pair_that_shares_one_trigram_is_reported(spark, tmp_path):
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(8, "one two three"), (9, "four five six")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in QUERIES["similar_pairs_jaccard"](spark, str(tmp_path)).collect()] == [(8, 1, 1.0)]
