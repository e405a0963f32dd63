"""Operators that Spark has no single call for, as DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.errors import UnsupportedSql


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in the order given."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def grouped_limit(df: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """At most ``limit`` rows per key in the order given."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__nth", nth).where(F.col("__nth") <= limit).drop("__nth")


def single_row(df: DataFrame, keys: list[str]) -> DataFrame:
    """The input, if no key (or, without keys, no input) has a second row; else an error when it runs."""
    if keys:
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1)))
        guard = F.when(nth > 1, F.raise_error(F.lit("more than one row for a scalar subquery")).cast("int")).otherwise(F.lit(1))
        return df.withColumn("__one", guard).where("__one = 1").drop("__one")
    two = df.limit(2)
    total = two.agg(F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("more than one row for a scalar subquery")).cast("int")).otherwise(F.lit(1)).alias("__one"))
    return two.join(F.broadcast(total.where("__one = 1")), F.lit(True)).drop("__one")


def groups_frame(df: DataFrame, keys: list[str], order: Column, value: Column, before: int, after: int, out: str) -> DataFrame:
    """``value`` aggregated over peer groups: a RANGE frame over the dense rank."""
    ranked = df.withColumn("__rank", F.dense_rank().over(Window.partitionBy(*keys).orderBy(order)))
    frame = Window.partitionBy(*keys).orderBy("__rank").rangeBetween(-before, after)
    return ranked.withColumn(out, value.over(frame)).drop("__rank")


def excluding_current(df: DataFrame, frame, column: str, kind: str, out: str) -> DataFrame:
    """SUM or COUNT over a frame without the current row: the row's own share is taken off."""
    own = F.col(column)
    n = F.count(own).over(frame) - own.isNotNull().cast("bigint")
    if kind == "count":
        return df.withColumn(out, n)
    if kind != "sum":
        raise UnsupportedSql("EXCLUDE CURRENT ROW is known for SUM and COUNT")
    return df.withColumn(out, F.when(n > 0, F.sum(own).over(frame) - F.coalesce(own, F.lit(0))))


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Rows with ``low <= point < high``, by an equi-join on bins of ``width`` instead of a nested loop."""
    bins = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    spread = right.withColumn("__bin", F.explode(F.when(F.col(high) > F.col(low), bins)))
    binned = left.withColumn("__bin", F.floor(F.col(point) / width))
    return binned.join(spread, "__bin").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__bin")


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, columns: list[str]) -> DataFrame:
    """For each left row the latest right row of its keys that is not later.

    Both sides go through one sort per key; nothing is multiplied.
    """
    carried = F.struct(F.col(right_at).alias("at"), *columns)
    ours = left.withColumn("__side", F.lit(1)).withColumn("__at", F.col(at))
    theirs = right.select(*keys, F.lit(0).alias("__side"), F.col(right_at).alias("__at"), carried.alias("__right"))
    both = ours.unionByName(theirs, allowMissingColumns=True)
    last = F.last("__right", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("__right", last).where("__side = 1")
    return found.select(*left.columns, F.col("__right.at").alias(right_at), *[F.col(f"__right.{c}").alias(c) for c in columns])


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int, how: str = "inner") -> DataFrame:
    """An equi-join whose hot keys are spread over ``salts`` partitions: the right side is repeated per salt."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise UnsupportedSql(f"a salted join keeps the left side's rows; {how} does not")
    own = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
    other = right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return own.join(other, [key, "__salt"], how).drop("__salt")


def broadcast_if_small(df: DataFrame, limit_bytes: int) -> DataFrame:
    """Hint a broadcast only if the optimizer's size estimate is within the limit."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit_bytes else df


def recursive_distinct(seed: DataFrame, step: Callable[[DataFrame], DataFrame], store: Callable[[DataFrame], DataFrame], rounds: int = 1000) -> DataFrame:
    """WITH RECURSIVE ... UNION: rounds of new rows until there are none; NULLs are equal.

    ``store`` cuts the lineage of a round, e.g. by writing it to shared storage.
    """
    found = store(seed.distinct())
    fresh = found
    for n in range(rounds):
        fresh = store(step(fresh).subtract(found))
        if not fresh.take(1):
            return found
        found = found.unionByName(fresh)
        if n % 16 == 15:  # a plan of few scans
            found = store(found)
    raise UnsupportedSql(f"no fixpoint after {rounds} rounds")


def _read(spark: SparkSession, sf_dir: str, t: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{t}.parquet")


def _win_exclude_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = Window.partitionBy("p_brand").orderBy("p_size", "p_partkey").rowsBetween(-2, 2)
    df = excluding_current(_read(spark, sf_dir, "part"), frame, "p_size", "sum", "s")
    return excluding_current(df, frame, "p_size", "count", "n").select("p_partkey", F.col("s").cast("bigint").alias("s"), "n")


def _range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = _read(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 2).alias("lo"), (F.col("n_nationkey") * 2 + 3).alias("hi"))
    met = range_join(_read(spark, sf_dir, "part").select("p_partkey", "p_size"), bands, "p_size", "lo", "hi", 4.0)
    return met.select("p_partkey", "n_nationkey")


def _as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("user_id", "event_id", "ts")
    views = events.where("event_type = 'view'").groupBy("user_id", F.col("ts").alias("view_ts")).agg(F.max("event_id").alias("view_id"))
    return as_of_join(clicks, views, ["user_id"], "ts", "view_ts", ["view_id"]).select("event_id", "view_id")


def _salted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    return salted_join(customers, _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name"), "k", 4).select("c_custkey", "n_name")


def _single_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single_row(_read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), ["o_custkey"])


def _grouped_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_limit(_read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], [F.desc("o_orderkey")], 2)


#: Whether a sample of a percentage has about that share of the rows, and no row that the table hasn't or oftener than it has.
SAMPLE_CASES = " UNION ALL ".join(
    f"SELECT {p} AS percent, (SELECT count(*) FROM lineitem TABLESAMPLE BERNOULLI ({p})) BETWEEN n * {low} AND n * {high} AS share, "
    f"(SELECT count(*) FROM (SELECT * FROM lineitem TABLESAMPLE BERNOULLI ({p}) EXCEPT ALL SELECT * FROM lineitem) AS strays) = 0 AS inside "
    "FROM (SELECT count(*) AS n FROM lineitem) AS whole"
    for p, low, high in ((0, 0, 0), (10, 0.05, 0.15), (100, 1, 1))
)


def _table_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.plans.catalog import run_statement

    return run_statement(spark, sf_dir, SAMPLE_CASES)


QUERIES = {
    "win_exclude_current": _win_exclude_current,
    "range_join": _range_join,
    "as_of_join": _as_of_join,
    "salted_join": _salted_join,
    "single_row_guard": _single_row,
    "grouped_limit": _grouped_limit,
    "table_sample": _table_sample,
}
ORACLES = {
    "win_exclude_current": """
SELECT p_partkey, CAST(sum(p_size) OVER w AS BIGINT) AS s, count(p_size) OVER w AS n FROM part
WINDOW w AS (PARTITION BY p_brand ORDER BY p_size, p_partkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW)""",
    "range_join": "SELECT p_partkey, n_nationkey FROM part JOIN nation ON p_size >= n_nationkey * 2 AND p_size < n_nationkey * 2 + 3",
    "as_of_join": """
WITH v AS (SELECT user_id, ts AS view_ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT c.event_id, v.view_id FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.ts >= v.view_ts""",
    "salted_join": "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "single_row_guard": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey",
    "grouped_limit": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 2",
    "table_sample": "SELECT * FROM (VALUES (0, true, true), (10, true, true), (100, true, true)) AS t(percent, share, inside)",
}
