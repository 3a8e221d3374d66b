"""Policies on SQL: what may run, and that small groups can't be made to look large."""

from __future__ import annotations

import pytest

from lakeweave.operators import governed_sql as g
from lakeweave.operators.governance import AccessDenied


@pytest.fixture(scope="module")
def relations(spark):
    people = spark.createDataFrame([(i, "big" if i < 40 else f"small{i % 3}", float(i), "a" if i % 2 else "b") for i in range(46)], "id long, team string, pay double, asset string")
    visits = spark.createDataFrame([(k, k % 4, k % 3) for k in range(60)], "visit long, person long, kind long")
    return {"people": g.Relation(people, ("id",)), "visits": g.Relation(visits, ("visit",))}


def rows(spark, relations, query, policy="analytics", **how):
    return sorted((tuple(r) for r in g.governed_sql(spark, query, policy, relations, **how).collect()), key=repr)


def test_small_groups_are_left_out(spark, relations):
    assert rows(spark, relations, "SELECT team, count(*) AS n, avg(pay) AS pay FROM people GROUP BY team") == [("big", 40, 19.5)]
    assert rows(spark, relations, "SELECT count(*) AS n FROM people") == [(46,)]
    assert rows(spark, relations, "SELECT count(*) AS n FROM people WHERE id = 7") == []
    assert rows(spark, relations, "SELECT team FROM people GROUP BY team HAVING count(*) > 0 ORDER BY team LIMIT 3") == [("big",)]
    assert rows(spark, relations, "SELECT DISTINCT round(p) AS p FROM (SELECT team, avg(pay) AS p FROM people GROUP BY team)") == [(20.0,)]


@pytest.mark.parametrize(
    "query",
    [
        "SELECT team, count(*) AS n FROM people, VALUES (1), (2), (3), (4), (5) GROUP BY team",
        "SELECT team, count(*) AS n FROM people LATERAL VIEW explode(sequence(1, 50)) x AS y GROUP BY team",
        "SELECT a.team, count(*) AS n FROM people a JOIN people b ON a.team = b.team OR b.id < 40 GROUP BY a.team",
        "WITH x AS (SELECT a.team FROM people a CROSS JOIN people b) SELECT team, count(*) AS n FROM x GROUP BY team",
        "SELECT team, count(*) AS n FROM (SELECT p.*, v.y FROM people p LATERAL VIEW explode(array(1, 2, 3, 4, 5, 6)) v AS y) GROUP BY team",
    ],
)
def test_inflated_groups_stay_small(spark, relations, query):
    assert [r[0] for r in rows(spark, relations, query)] == ["big"]


def test_every_relation_needs_its_records(spark, relations):
    # persons 0 to 3 have 15 visits each: each group rests on one person
    assert rows(spark, relations, "SELECT p.id, count(*) AS n FROM people p JOIN visits v ON p.id = v.person GROUP BY p.id") == []
    assert rows(spark, relations, "SELECT kind, count(*) AS n FROM visits GROUP BY kind") == [(0, 20), (1, 20), (2, 20)]
    # an aggregate of an aggregate counts groups: three kinds are less than five
    assert rows(spark, relations, "SELECT avg(n) AS n FROM (SELECT kind, count(*) AS n FROM visits GROUP BY kind)") == []
    assert rows(spark, relations, "SELECT count(*) AS n FROM (SELECT person, kind, count(*) AS n FROM visits GROUP BY person, kind)") == [(12,)]
    assert rows(spark, relations, "SELECT count(*) AS n FROM (SELECT team FROM people WHERE id >= 43 GROUP BY team)") == []


def test_tables_of_any_origin_are_data(spark):
    for rows_ in (spark.range(9), spark.sql("SELECT * FROM VALUES (1), (2) AS t(id)")):
        with pytest.raises(AccessDenied):
            rows(spark, {"t": g.Relation(rows_, ("id",))}, "SELECT id FROM t")
        assert rows(spark, {"t": g.Relation(rows_, ("id",))}, "SELECT id FROM t GROUP BY id") == []


@pytest.mark.parametrize(
    "query",
    [
        "SELECT * FROM people",
        "SELECT 'sum(' AS x FROM people",
        "SELECT id, (SELECT count(*) FROM people) AS n FROM people",
        "SELECT (SELECT max(pay) FROM people WHERE id = 3) AS x",
        "SELECT team, count(*) AS n FROM people GROUP BY team UNION ALL SELECT team, 1 FROM people",
        "SELECT p.id FROM people p JOIN (SELECT team, count(*) AS n FROM people GROUP BY team) t ON p.team = t.team",
        "SELECT count(*) AS n FROM people GROUP BY team HAVING (SELECT max(pay) FROM people) > 1",
        "SELECT sum(pay) OVER () AS x FROM people",
        "SELECT count(*) AS n FROM (SELECT team FROM people UNION ALL SELECT team FROM people)",
        "SELECT team, count(*) AS n FROM (SELECT DISTINCT team FROM people) GROUP BY team",
        "SELECT count(*) AS n FROM parquet.`/root/testdata/sf0.001/customer.parquet`",
        "SELECT count(*) AS n FROM elsewhere",
        "SELECT team FROM people WHERE id IN (SELECT nosuch FROM people)",
        "DROP VIEW people",
        "INSERT INTO people SELECT * FROM people",
        "EXPLAIN SELECT 1",
        "not a statement",
    ],
)
def test_what_is_refused(spark, relations, query):
    with pytest.raises(AccessDenied):
        rows(spark, relations, query)


def test_unions_literals_and_subqueries_below(spark, relations):
    q = "SELECT team, count(*) AS n FROM people GROUP BY team UNION ALL SELECT asset, count(*) FROM people GROUP BY asset"
    assert rows(spark, relations, q) == [("a", 23), ("b", 23), ("big", 40)]
    assert rows(spark, relations, "SELECT 1 AS one") == [(1,)]
    assert rows(spark, relations, "SELECT count(*) AS n FROM people WHERE id IN (SELECT person FROM visits) OR id > 30") == [(19,)]


def test_policies_cap_rows_and_writes(spark, relations):
    assert len(rows(spark, relations, "SELECT id, pay FROM people", "read_only")) == 46
    assert len(rows(spark, relations, "SELECT a.id, b.id AS other FROM people a CROSS JOIN people b", "read_only")) == 100
    assert g.check_operation(spark, "INSERT INTO t VALUES (1)", "full_access") == "INSERT"
    assert g.check_operation(spark, "WITH x AS (SELECT 1) SELECT * FROM x", "read_only") == "SELECT"
    for query, policy in (("DELETE FROM t", "read_only"), ("MERGE INTO t USING s ON t.a = s.a WHEN MATCHED THEN DELETE", "full_access"), ("CREATE TABLE t (a INT)", "exclusive"), ("SET x = 1", "exclusive")):
        with pytest.raises(AccessDenied):
            g.check_operation(spark, query, policy)


def test_grants_name_relations_or_choose_rows(spark, relations):
    grants = spark.sql(
        "SELECT asset, 1L AS buyer, status, TIMESTAMP_NTZ'2020-01-01' AS valid_from, TIMESTAMP_NTZ'2030-01-01' AS valid_until FROM VALUES ('people', 'active'), ('visits', 'revoked'), ('a', 'active'), ('b', 'expired') AS t(asset, status)"
    )
    how = {"grants": grants, "buyer": 1, "as_of": "2025-01-01 00:00:00"}
    assert rows(spark, relations, "SELECT count(*) AS n FROM people", **how) == [(46,)]
    for query in ("SELECT count(*) AS n FROM visits", "SELECT count(*) AS n FROM people WHERE id IN (SELECT person FROM visits)"):
        with pytest.raises(AccessDenied):
            rows(spark, relations, query, **how)
    with pytest.raises(AccessDenied):
        rows(spark, relations, "SELECT count(*) AS n FROM people", **(how | {"buyer": 2}))
    by_row = {"people": g.Relation(relations["people"].rows, ("id",), "asset")}
    assert rows(spark, by_row, "SELECT asset, count(*) AS n FROM people GROUP BY asset", **how) == [("a", 23)]
    assert rows(spark, by_row, "SELECT asset, count(*) AS n FROM people GROUP BY asset", **(how | {"as_of": "2031-01-01 00:00:00"})) == []
