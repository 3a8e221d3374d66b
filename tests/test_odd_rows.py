"""Queries on odd rows, against their SQL or plain models: first ids, zeros, rows in many batches."""

from __future__ import annotations

import datetime

from lakeweave.plans import registry

from .compare import same

QUERIES, SQL = registry.queries(), registry.oracle_sql()
START = datetime.datetime(2024, 1, 1)


def events(spark, folder, rows, files: int = 1):
    """``rows`` of (event_id, seconds, user_id, event_type) as an events table, and a DuckDB connection to it."""
    import duckdb

    full = [(i, START + datetime.timedelta(seconds=s), u, t, 1.0, "{}") for i, s, u, t in rows]
    df = spark.createDataFrame(full, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.repartition(files, "event_id").write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'; SET threads = 1")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet' ORDER BY event_id")
    return con


def test_the_first_event_conflicts_too(spark, tmp_path):
    con = events(spark, tmp_path, [(0, 0, 1, "view"), (1, 5, 21, "view"), (2, 9, 1, "view"), (3, 9, None, "view")])
    same(QUERIES["edit_conflicts"](spark, str(tmp_path)), con.sql(SQL["edit_conflicts"]))


def test_titles_keep_their_zeros(spark, tmp_path):
    texts = ["\n  0 to 100  \nx", "　  wide 　\nx", "ends in 90", "\n\n", "# head"]
    import duckdb

    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(QUERIES["markdown_detect"](spark, str(tmp_path)), con.sql(SQL["markdown_detect"]))


def test_mean_risks_do_not_depend_on_partitions(spark, tmp_path):
    kinds = ["purchase", "error", "view", "purchase", "purchase", "signup", "error", "click"]
    rows = [(u * 100 + k, 3 * 3600 * k + u, u, kinds[(u * k + k // 3 + u) % len(kinds)]) for u in range(400) for k in range(3 + u % 17)]
    con = events(spark, tmp_path, rows, 13)
    same(QUERIES["risk_histogram"](spark, str(tmp_path)), con.sql(SQL["risk_histogram"]))


def test_token_bucket_takes_rows_of_many_files_and_frames_in_order(spark, tmp_path):
    rows = [(k, 9973 * (k * 37 % 600), k % 2, "view") for k in range(600)]
    con = events(spark, tmp_path, rows, 130)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        same(QUERIES["stream_token_bucket"](spark, str(tmp_path)), con.sql(SQL["stream_token_bucket"]))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_chunks_are_passed_on_in_pieces():
    import pyarrow as pa

    from lakeweave.operators import chunking

    held = chunking._Held()
    held.add(1, 0, "ab", 0, 2, "")
    held.add(0, 0, "c", 0, 1, "h")
    assert held.size == 3
    assert held.taken(pa.array(["x", "y"])).to_pylist()[0] == {"key": "y", "chunk_index": 0, "content": "ab", "start": 0, "stop": 2, "section": ""}
    assert not held.rows and held.size == 0


def test_conflicts_of_all_clocks(spark):
    """Clocks of one actor and others, zero counts, bounds of bins and of the time limit: as each pair compared."""
    import itertools
    import random

    from lakeweave.operators import collaboration

    rng = random.Random(3)
    clocks = [{"a": 1}, {"a": 2}, {"b": 1}, {"b": 0}, {"c": -1}, {"a": 1, "b": 1}, {"a": 2, "c": 1}, {}]
    rows = [(i, i % 3, rng.choice((0, 1, 9, 10, 11, 19, 20, 21, 30, 41)) + 50 * (i % 2), rng.choice(clocks)) for i in range(120)]
    at_most = lambda a, b: all(v <= b.get(k, 0) for k, v in a.items())

    def found(rows):
        df = spark.createDataFrame([(i, r, START + datetime.timedelta(seconds=s), c) for i, r, s, c in rows], "id long, resource long, at timestamp_ntz, clock map<string, long>")
        return collaboration.conflicts(df, "resource", "id", "at", 20)

    for some in (rows, [r for r in rows if len(r[3]) == 1]):
        want = [(a[1], a[0], b[0]) for a, b in itertools.combinations(some, 2) if a[1] == b[1] and abs(a[2] - b[2]) <= 20 and at_most(a[3], b[3]) == at_most(b[3], a[3])]
        assert sorted(map(tuple, found(some).collect())) == sorted(want)
    plan = found([r for r in rows if len(r[3]) == 1])._jdf.queryExecution().optimizedPlan().toString()
    assert "forall" not in plan  # no maps are compared by pair
