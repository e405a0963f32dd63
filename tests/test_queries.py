"""Every registered query of the engine against its SQL statement."""

from __future__ import annotations

import pytest

from tests.conftest import check, plain
from tidewater.operators import relational
from tidewater.plans import catalog


@pytest.mark.parametrize("key", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, duck, key):
    check(catalog.QUERIES[key](spark, sf_dir), duck, catalog.ORACLES[key])


def test_full_join_takes_whole_tables(spark, sf_dir):
    rows = catalog.QUERIES["join_full"](spark, sf_dir).collect()
    for column, table in (("c_custkey", "customer"), ("o_orderkey", "orders")):
        keys = {r[0] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(column).collect()}
        assert {r[column] for r in rows} == keys | {None}


@pytest.mark.parametrize(("key", "table"), [("order_by", "customer"), ("order_nulls", "nation"), ("orderby_subquery", "nation")])
def test_whole_table_in_order(spark, sf_dir, duck, key, table):
    rows = catalog.QUERIES[key](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    assert [[plain(v) for v in r] for r in rows] == [[plain(v) for v in r] for r in duck.execute(catalog.ORACLES[key]).fetchall()]


def row_numbers(df) -> list[str]:
    """The windows of a plan that number rows."""
    return [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number() windowspecdefinition(" in x]


@pytest.mark.parametrize("key", ["join_lateral", "scalar_limit1"])
def test_correlated_limit_is_ordered(spark, sf_dir, key):
    """Rows are numbered by the keys, not in the order in which a shuffle or a spilled sort brings them."""
    found = row_numbers(catalog.QUERIES[key](spark, sf_dir))
    assert found and all("DESC NULLS FIRST" in x and "ASC NULLS LAST" in x for x in found)


@pytest.mark.parametrize(
    "select",
    [
        "o_orderkey FROM {} ORDER BY o_totalprice DESC, o_orderkey LIMIT 3", "o_orderkey FROM {} ORDER BY o_totalprice DESC, o_orderkey OFFSET 2",
        "o_orderkey AS k, -o_totalprice v FROM {} ORDER BY abs(v) + 1, k LIMIT 3", "o.o_orderkey FROM {} ORDER BY o.o_totalprice, o.o_orderkey FETCH FIRST 1 ROW ONLY",
        "o_orderpriority AS p FROM {} GROUP BY o_orderpriority ORDER BY sum(o_totalprice) DESC, p LIMIT 2",
        "EXTRACT(YEAR FROM o_orderdate) AS year FROM {} ORDER BY EXTRACT(YEAR FROM o_orderdate), o_totalprice, o_orderkey LIMIT 2",
        "sum(v) AS s FROM (SELECT o_totalprice AS v FROM {} ORDER BY o_orderdate DESC, o_orderkey LIMIT 3) AS t",
    ],
)
def test_forms_of_correlated_limits(spark, sf_dir, duck, select):
    inner = select.format("orders o WHERE o_custkey = c.c_custkey")
    sql = f"SELECT c.c_custkey, t.* FROM customer c JOIN LATERAL (SELECT {inner}) t ON TRUE"
    df = catalog.run_statement(spark, sf_dir, sql)
    found = row_numbers(df)
    assert found and all(" ASC NULLS " in x or " DESC NULLS " in x for x in found)
    check(df, duck, sql)


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["all_quantifier", "any_quantifier", "any_null"])
def test_quantifier_joins_no_pairs(spark, sf_dir, key):
    assert "NestedLoop" not in physical(catalog.QUERIES[key](spark, sf_dir))


@pytest.mark.parametrize("quantifier", ["ANY", "ALL"])
@pytest.mark.parametrize("op", ["=", "<>", "<", "<=", ">", ">="])
def test_quantifiers_of_whole_subqueries(spark, sf_dir, duck, op, quantifier):
    """Text, numbers of two types, no rows, NULLs on both sides."""
    for left, right in (
        ("n_name", "SELECT s FROM (VALUES ('FRANCE'), ('CHINA')) AS t(s)"), ("n_name", "SELECT nullif(n_name, 'CHINA') FROM nation WHERE n_regionkey = 2"),
        ("nullif(n_regionkey, 2)", "SELECT r_regionkey * 1.5 FROM region WHERE r_regionkey BETWEEN 1 AND 2"), ("nullif(n_regionkey, 2)", "SELECT r_regionkey FROM region WHERE r_regionkey > 99"),
    ):
        sql = f"SELECT n_nationkey, {left} {op} {quantifier} ({right}) AS r FROM nation"
        df = catalog.run_statement(spark, sf_dir, sql)
        assert "NestedLoop" not in physical(df)
        check(df, duck, sql)


def test_quantifier_compares_in_the_common_type(spark, sf_dir):
    """Text against a number compares as numbers, whose least is not the least text."""
    sql = "SELECT 10 > ANY (SELECT s FROM (VALUES ('9'), ('100')) AS t(s)) AS a, 10 <= ALL (SELECT s FROM (VALUES ('9'), ('100')) AS t(s)) AS b FROM region"
    assert {tuple(r) for r in catalog.run_statement(spark, sf_dir, sql).collect()} == {(True, False)}
    sql = "SELECT n_name > ANY (SELECT r_regionkey FROM region WHERE r_regionkey > 99) AS a, n_name <= ALL (SELECT r_regionkey FROM region WHERE r_regionkey > 99) AS b FROM nation"
    assert {tuple(r) for r in catalog.run_statement(spark, sf_dir, sql).collect()} == {(False, True)}


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT n_nationkey, n_nationkey <= ALL (SELECT r_regionkey FROM region WHERE r_regionkey > n_regionkey) AS r FROM nation",
        "WITH region AS (SELECT n_name AS r_regionkey FROM nation WHERE n_nationkey > 5) SELECT n_name FROM nation WHERE n_name < ANY (SELECT r_regionkey FROM region)",
        "WITH a AS (SELECT r_regionkey AS k FROM region), b AS (SELECT n_nationkey FROM nation WHERE n_nationkey > ALL (SELECT k FROM a)) SELECT n_nationkey FROM b WHERE n_nationkey < ANY (SELECT max(n_nationkey) FROM b)",
        "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) >= ALL (SELECT avg(o_totalprice) * 12 FROM orders)",
        "SELECT n.n_nationkey, r.r_name FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey AND n.n_nationkey > ANY (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)",
        "SELECT n_nationkey FROM nation WHERE n_nationkey > ANY (SELECT r_regionkey FROM region WHERE r_regionkey >= ALL (SELECT n_regionkey FROM nation WHERE n_nationkey < 9))",
    ],
)
def test_places_of_quantifiers(spark, sf_dir, duck, sql):
    check(catalog.run_statement(spark, sf_dir, sql), duck, sql)


@pytest.mark.parametrize(("broken", "column"), [("lineitem", "share"), ("(SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem)", "inside")])
def test_sample_cases_find_broken_samplers(spark, sf_dir, broken, column):
    sql = relational.SAMPLE_CASES.replace("lineitem TABLESAMPLE BERNOULLI (10)", broken)
    found = {r.percent: r[column] for r in catalog.run_statement(spark, sf_dir, sql).collect()}
    assert found == {0: True, 10: False, 100: True}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
