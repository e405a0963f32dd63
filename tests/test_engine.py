"""Statements, refusals, views, datasets, catalog, settings and grants."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException

from tests.conftest import same_rows
from tidewater.engine import Engine
from tidewater.errors import EngineError, UnknownName, UnsupportedSql


@pytest.fixture
def engine(spark, sf_dir, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    e.catalog.add("files", "parquet", {"path": sf_dir}, ["region", "nation", "orders", "events", "customer"])
    return e


@pytest.mark.parametrize(
    "sql",
    [
        "INSERT INTO region VALUES (9, 'x')", "UPDATE region SET r_name = 'x'", "DELETE FROM region", "CREATE TABLE t (a INT)", "CREATE TABLE t AS SELECT 1",
        "DROP TABLE region", "TRUNCATE TABLE region", "MERGE INTO region USING nation ON true WHEN MATCHED THEN DELETE", "",
        "SELECT * FROM nation LATERAL VIEW explode(array(1)) t AS x", "SELECT n_name FROM nation SORT BY n_name", "SELECT n_name FROM nation DISTRIBUTE BY n_name",
        "SELECT TRY_CAST('x' AS INT)", "SELECT 1 FROM nation WHERE n_nationkey BETWEEN SYMMETRIC 3 AND 1", "SELECT n_name FROM nation FETCH FIRST 2 ROWS WITH TIES",
        "SELECT TOP 3 n_name FROM nation", "SELECT n_name INTO x FROM nation", "SELECT 1 WHERE true", "SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation",
        "SELECT n_name, rank() OVER (ORDER BY n_name) AS r FROM nation QUALIFY rank() OVER (ORDER BY n_name) = 1", "SELECT DISTINCT n_regionkey FROM nation GROUP BY n_regionkey",
        "WITH RECURSIVE t AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM t) SELECT * FROM t", "SELECT 1; SELECT 2", "SELECT n_name FROM nation LIMIT n_nationkey",
        "EXPLAIN DROP TABLE region", "FUNNEL ('a') ON ev WINDOW 1 DAY", "FUNNEL ('a', 'b') ON ev WINDOW 0 DAYS", "FUNNEL ('a', 'b') ON ev WINDOW 1 DAY MODE ANY_ORDER",
        "PATHS ON ev DEPTH 1", "RETENTION ON ev BIRTH 'a' RETURN 'b' PERIOD DAY PERIODS 2 AT 3", "SEGMENT COUNT ON ev BUCKET DAY FROM '2024-02-01' TO '2024-01-01'",
    ],
)
def test_refused(engine, sql):
    with pytest.raises(EngineError):
        engine.sql(sql)


@pytest.mark.parametrize(
    "sql", ["SELECT nope FROM nation", "SELECT n_name, count(*) FROM nation GROUP BY n_regionkey", "SELECT * FROM nowhere", "SELECT r_name FROM region r JOIN region s ON true", "SELECT n_name FROM nation WHERE rank() OVER (ORDER BY n_name) = 1"]
)
def test_invalid_raises(engine, sql):
    with pytest.raises((EngineError, PySparkException)):
        engine.sql(sql).collect()


def test_scalar_subquery_with_rows_raises(engine):
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        engine.sql("SELECT (SELECT r_name FROM region) AS x").collect()


@pytest.mark.parametrize("op", ["=", "<>", "<", "<=", ">", ">="])
@pytest.mark.parametrize("quantifier", ["ANY", "ALL"])
@pytest.mark.parametrize("values", ["(1), (2)", "(1), (NULL)", "(NULL)"])
def test_quantifiers_are_three_valued(engine, op, quantifier, values):
    rows = engine.sql(f"SELECT x, x {op} {quantifier} (SELECT v FROM (VALUES {values}) AS t(v)) AS r FROM (VALUES (1), (2), (NULL)) AS u(x)").collect()
    data = [None if v == "NULL" else int(v) for v in values.replace("(", "").replace(")", "").split(", ")]
    import operator

    apply = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[op]
    for x, got in rows:
        parts = [None if x is None or v is None else apply(x, v) for v in data]
        decisive = quantifier == "ANY"
        want = decisive if decisive in parts else None if None in parts else not decisive
        assert got is want


def test_ternary_partition(engine):
    """Q = Q where p, plus Q where not p, plus Q where p is null."""
    p = "nullif(n_regionkey, 2) > 1"
    whole = engine.sql("SELECT n_nationkey FROM nation").count()
    assert whole == sum(engine.sql(f"SELECT n_nationkey FROM nation WHERE {c}").count() for c in (p, f"NOT ({p})", f"({p}) IS NULL"))


def test_order_of_nulls(engine):
    rows = engine.sql("SELECT x FROM (VALUES (2), (NULL), (1)) AS t(x) ORDER BY x").collect()
    assert [r[0] for r in rows] == [1, 2, None]
    rows = engine.sql("SELECT x FROM (VALUES (2), (NULL), (1)) AS t(x) ORDER BY x DESC").collect()
    assert [r[0] for r in rows] == [None, 2, 1]


def test_comments_strings_and_quoted_names(engine):
    row = engine.sql("SELECT 'a -- ~ ; (' AS \"x y\" /* QUALIFY ( */ FROM nation -- FETCH\nLIMIT 1").collect()[0]
    assert row["x y"] == "a -- ~ ; ("


def test_views(engine, spark, tmp_path):
    folder = tmp_path / "src"
    spark.range(5).selectExpr("id AS k", "id * 2 AS v").write.parquet(f"file://{folder}/t.parquet")
    engine.catalog.add("own", "parquet", {"path": f"file://{folder}"})
    engine.sql("CREATE MATERIALIZED VIEW plain AS SELECT k, v FROM t")
    engine.sql("CREATE MATERIALIZED VIEW grown WITH (watermark = 'k') AS SELECT k, v FROM t")
    engine.sql("CREATE MATERIALIZED VIEW keyed WITH (key = 'k') AS SELECT k, v FROM t")
    assert engine.sql("REFRESH MATERIALIZED VIEW plain").first()[0] == "skipped"
    spark.range(3, 8).selectExpr("id AS k", "id * 3 AS v").write.mode("overwrite").parquet(f"file://{folder}/t.parquet")
    spark.read.parquet(f"file://{folder}/t.parquet").createOrReplaceTempView("t")
    assert engine.sql("REFRESH MATERIALIZED VIEW plain").first()[0] == "whole"
    assert engine.sql("REFRESH MATERIALIZED VIEW grown").first()[0] == "appended"
    assert engine.sql("REFRESH MATERIALIZED VIEW keyed").first()[0] == "merged"
    assert sorted(map(tuple, engine.views.read("keyed").collect())) == [(k, 3 * k) for k in range(3, 8)]
    assert sorted(map(tuple, engine.views.read("grown").collect())) == [(k, 2 * k) for k in range(5)] + [(k, 3 * k) for k in range(5, 8)]
    assert [r[0] for r in engine.sql("SHOW MATERIALIZED VIEWS").collect()] == ["grown", "keyed", "plain"]
    with pytest.raises(UnsupportedSql):
        engine.sql("CREATE MATERIALIZED VIEW bad WITH (key = 'k') AS SELECT k, sum(v) AS v FROM t GROUP BY k")
    engine.sql("DROP MATERIALIZED VIEW plain")
    with pytest.raises(UnknownName):
        engine.sql("REFRESH MATERIALIZED VIEW plain")


def test_event_dataset(engine):
    engine.sql("CREATE EVENT DATASET ev FROM files.main.events ACTOR user_id TIME ts EVENT event_type TIEBREAK event_id PROPERTIES (value) WITH (refresh_key = 'event_id', shards = '3')")
    assert engine.sql("SHOW EVENT DATASETS").first()["name"] == "ev"
    assert engine.sql("SHOW EVENTS FROM ev").count() == 5
    assert engine.sql("REFRESH EVENT DATASET ev").first()[0] == "skipped"
    assert engine.sql("FUNNEL ('view', 'purchase') ON ev WINDOW 2 DAYS").count() == 2
    with pytest.raises(UnknownName, match="purchase"):
        engine.sql("FUNNEL ('view', 'purchases') ON ev WINDOW 2 DAYS")
    with pytest.raises(UnknownName):
        engine.sql("SEGMENT COUNT ON ev BUCKET DAY WHERE nope = 1")
    with pytest.raises(UnsupportedSql):
        engine.sql("SEGMENT COUNT ON ev BUCKET DAY WHERE value = 'x'")
    engine.sql("SET events.allow_unknown_names = true")
    rows = engine.sql("FUNNEL ('nothing', 'purchase') ON ev WINDOW 2 DAYS").collect()
    assert [(r.step_index, r.entered) for r in rows] == [(1, 0), (2, 0)]
    engine.sql("RESET ALL")
    engine.sql("REBUILD EVENT DATASET ev")
    engine.sql("DROP EVENT DATASET ev")
    with pytest.raises(UnknownName):
        engine.sql("SHOW EVENTS FROM ev")


def test_funnel_witness_and_ties(spark):
    """Sub-second ties decide by tiebreak; the earliest of the deepest anchors counts."""
    from datetime import datetime

    from tidewater.events import analysis, spec

    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    rows = [(1, at(0), 1, "a"), (1, at(1), 3, "b"), (1, at(1), 2, "a"), (1, at(30), 4, "c"), (2, at(5), 2, "a"), (2, at(5), 1, "b"), (3, at(0), 1, "a"), (3, at(9), 2, "a"), (3, at(9), 3, "b")]
    events = spark.createDataFrame(rows, "actor int, ts timestamp_ntz, tb bigint, name string")
    found = analysis.funnel(events, spec.parse("FUNNEL ('a', 'b', 'c') ON x WINDOW 1 MINUTE")).collect()
    assert [r.entered for r in found] == [3, 2, 1]
    assert found[1].median_seconds_from_previous == pytest.approx((1 + 9) / 2)
    assert found[2].median_seconds_from_previous == pytest.approx(29)


def test_predicate_is_two_valued(spark):
    from tidewater.events import analysis, spec

    events = spark.createDataFrame([(1, 5), (2, None)], "actor int, v bigint")
    where = lambda text: spec.parse(f"SEGMENT COUNT ON x BUCKET DAY WHERE {text}").common.where
    keep = lambda text: sorted(r.actor for r in events.where(analysis.condition(events, where(text))).collect())
    assert keep("v = 5") == [1]
    assert keep("NOT v = 5") == [2]
    assert keep("v <> 4") == [1]
    assert keep("NOT (v IN (4) OR v IS NULL)") == [1]


def test_settings_and_grants(engine):
    assert engine.sql("SHOW views.substitution").first()[0] == "True"
    with pytest.raises(UnknownName, match="nearest"):
        engine.sql("SET views.substitutin = false")
    engine.sql("CREATE USER kim")
    engine.user = "kim"
    with pytest.raises(EngineError):
        engine.sql("SELECT * FROM region")
    engine.user = "admin"
    engine.sql("GRANT SELECT ON files.main.region TO kim")
    engine.user = "kim"
    assert engine.sql("SELECT * FROM region").count() == 5
    with pytest.raises(EngineError):
        engine.sql("SELECT * FROM nation")


def test_catalog_statements(engine):
    assert ("files", "region") in [tuple(r) for r in engine.sql("SHOW TABLES").collect()]
    assert [r.column_name for r in engine.sql("DESCRIBE files.main.region").collect()] == ["r_regionkey", "r_name"]
    assert "Scan" in engine.sql("EXPLAIN SELECT * FROM region").first()[0]
    engine.sql("DROP DATASOURCE files")
    with pytest.raises(UnknownName):
        engine.sql("DROP DATASOURCE files")


def test_duckdb_source(engine, tmp_path):
    import duckdb

    with duckdb.connect(str(tmp_path / "d.db")) as c:
        c.execute("CREATE TABLE small AS SELECT 1 AS a, 'x' AS b UNION ALL SELECT 2, NULL")
    engine.catalog.add("d", "duckdb", {"path": str(tmp_path / "d.db")})
    rows = engine.sql("SELECT a, b FROM small").collect()
    same_rows([tuple(r) for r in rows], [(1, "x"), (2, None)], ["a", "b"], ["a", "b"])


def test_recursive_distinct(spark, tmp_path):
    from tidewater.operators.relational import recursive_distinct

    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "a int, b int")
    n = iter(range(100))

    def store(df):
        path = f"file://{tmp_path}/{next(n)}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    seed = spark.createDataFrame([(1,)], "x int")
    found = recursive_distinct(seed, lambda d: d.join(edges, d.x == edges.a).select(edges.b.alias("x")), store)
    assert sorted(r[0] for r in found.collect()) == [1, 2, 3]


def test_grants_cannot_be_walked_round(engine):
    """Views, event datasets, EXPLAIN, DESCRIBE and grants to oneself."""
    engine.sql("CREATE MATERIALIZED VIEW hidden_nations AS SELECT n_name FROM nation")
    engine.sql("CREATE EVENT DATASET hidden_ev FROM files.main.events ACTOR user_id TIME ts EVENT event_type TIEBREAK event_id")
    engine.sql("CREATE USER bob")
    engine.user = "bob"
    try:
        for text in (
            "SELECT * FROM hidden_nations", "EXPLAIN SELECT * FROM nation", "DESCRIBE nation", "SHOW EVENTS FROM hidden_ev", "SEGMENT COUNT OF 'signup' ON hidden_ev DAILY",
            "GRANT SELECT ON files TO bob", "CREATE MATERIALIZED VIEW mine AS SELECT * FROM nation", "DROP MATERIALIZED VIEW hidden_nations",
        ):
            with pytest.raises(EngineError, match="may not"):
                engine.sql(text)
    finally:
        engine.user = "admin"
    engine.sql("GRANT SELECT ON files.main.nation TO bob")
    engine.user = "bob"
    try:
        assert engine.sql("SELECT * FROM hidden_nations").count() == 25 and engine.sql("DESCRIBE nation").count() == 3
    finally:
        engine.user = "admin"
        engine.sql("DROP USER bob")
        engine.sql("DROP MATERIALIZED VIEW hidden_nations")
        engine.sql("DROP EVENT DATASET hidden_ev")


def test_qualified_names(engine, spark, tmp_path):
    """Two sources with a table of the same name: only qualified names reach them, also for grants and views."""
    spark.createDataFrame([(0, "ELSEWHERE")], "r_regionkey int, r_name string").write.parquet(f"file://{tmp_path}/other/region.parquet")
    assert engine.sql("SELECT region.r_name FROM files.main.region WHERE region.r_regionkey = 0").first()[0] == "AFRICA"
    engine.catalog.add("other", "parquet", {"path": f"file://{tmp_path}/other"})
    rows = engine.sql("SELECT a.r_name, b.r_name AS there FROM files.main.region a JOIN other.region b ON a.r_regionkey = b.r_regionkey").collect()
    assert [tuple(r) for r in rows] == [("AFRICA", "ELSEWHERE")]
    for text in ("SELECT * FROM region", "SELECT * FROM nation JOIN region ON true", "DESCRIBE region"):
        with pytest.raises(EngineError, match="several sources"):
            engine.sql(text)
    assert engine.sql("WITH region AS (SELECT 1 AS x) SELECT x FROM region").first()[0] == 1
    with pytest.raises(UnknownName):
        engine.sql("SELECT * FROM other.main.nation")
    engine.sql("CREATE MATERIALIZED VIEW away AS SELECT r_name FROM other.main.region")
    assert engine.sql("REFRESH MATERIALIZED VIEW away").first()[0] == "skipped"
    engine.sql("CREATE USER ann")
    engine.sql("GRANT SELECT ON files.main.region TO ann")
    engine.user = "ann"
    try:
        assert engine.sql("SELECT * FROM files.main.region").count() == 5
        for text in ("SELECT * FROM other.region", "SELECT * FROM away", "DESCRIBE other.main.region", "EXPLAIN SELECT * FROM other.region"):
            with pytest.raises(EngineError, match="may not"):
                engine.sql(text)
    finally:
        engine.user = "admin"
        engine.sql("DROP USER ann")
        engine.sql("DROP MATERIALIZED VIEW away")
    engine.sql("DROP DATASOURCE other")
    assert engine.sql("SELECT * FROM region").count() == 5


def test_recursive_union(engine):
    rows = engine.sql("WITH RECURSIVE e(a, b) AS (SELECT * FROM (VALUES (1, 2), (2, 3), (3, 1), (4, NULL)) AS v(a, b)), r(x) AS (SELECT 1 UNION SELECT 4 UNION SELECT e.b FROM r JOIN e ON e.a = r.x) SELECT x FROM r")
    assert sorted((r[0] for r in rows.collect()), key=str) == [1, 2, 3, 4, None]
    with pytest.raises(UnsupportedSql):
        engine.sql("WITH RECURSIVE r(x) AS (SELECT 1 UNION ALL SELECT 2 UNION SELECT x + 1 FROM r WHERE x < 5) SELECT x FROM r")


def test_excluded_rows(engine):
    value = "FROM (SELECT * FROM (VALUES (1, 10), (2, 20), (2, NULL), (3, 40)) AS u(k, v)) AS t ORDER BY k, v"
    one = lambda call: [r[0] for r in engine.sql(f"SELECT {call} AS s {value}").collect()]
    assert one("avg(v) OVER (ORDER BY k, v ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW)") == [20.0, 10.0, 30.0, None]
    assert one("sum(v) OVER (ORDER BY k GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW EXCLUDE TIES)") == [10, 30, 10, 60]
    assert one("min(v) OVER (ORDER BY k GROUPS BETWEEN CURRENT ROW AND 1 FOLLOWING EXCLUDE GROUP)") == [20, 40, 40, None]
    assert one("count(*) OVER (ORDER BY k ROWS CURRENT ROW EXCLUDE CURRENT ROW)") == [0, 0, 0, 0]
    for bad in ("sum(v) OVER (ORDER BY k ROWS BETWEEN 1 PRECEDING AND CURRENT ROW EXCLUDE TIES)", "sum(DISTINCT v) OVER (ORDER BY k ROWS CURRENT ROW EXCLUDE CURRENT ROW)"):
        with pytest.raises(UnsupportedSql):
            one(bad)
