"""Functions, operators, streaming helpers, the tokenizer and the command line."""

from __future__ import annotations

import io

import pytest
from pyspark.sql import functions as F

from tidewater.functions import scalar
from tidewater.operators import relational
from tidewater.plans.tokens import text_of, tree
from tidewater.streaming import incremental


@pytest.mark.parametrize(("start", "length", "want"), [(1, 3, "abc"), (0, 3, "ab"), (-1, 3, "a"), (-9, 3, ""), (4, 9, "def"), (9, 2, ""), (3, None, "cdef"), (0, None, "abcdef")])
def test_substring(spark, start, length, want):
    assert spark.range(1).select(scalar.substring(F.lit("abcdef"), start, length)).first()[0] == want


def test_concat_and_days(spark):
    row = spark.sql("SELECT timestamp_ntz'2024-03-03 00:00:01.5' AS t, CAST(NULL AS STRING) AS n").select(
        scalar.concat(F.lit("a"), F.col("n"), F.lit(1)), scalar.epoch(F.col("t")), scalar.day_of_week(F.col("t")), scalar.iso_day_of_week(F.col("t"))
    ).first()
    assert tuple(row) == ("a1", 1709424001.5, 0, 7)


def test_single_row(spark):
    df = spark.range(3).withColumn("k", F.lit(1))
    with pytest.raises(Exception, match="more than one row"):
        relational.single_row(df, ["k"]).collect()
    with pytest.raises(Exception, match="more than one row"):
        relational.single_row(df, []).collect()
    assert relational.single_row(df.limit(1), []).count() == 1
    assert relational.single_row(df.limit(0), []).count() == 0


def test_broadcast_only_below_the_limit(spark):
    df = spark.range(1000)
    assert "BroadcastHint" not in df.join(relational.broadcast_if_small(df, 10), "id")._jdf.queryExecution().logical().toString()
    hinted = spark.range(10).join(relational.broadcast_if_small(df, 10**9), "id")
    assert "broadcast" in hinted._jdf.queryExecution().logical().toString().lower()


def test_streaming_appends_once(spark, tmp_path):
    folder, target, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    spark.range(5).write.parquet(folder)
    schema = spark.read.parquet(folder).schema
    assert incremental.append_new_files(spark, folder, schema, target, state) == 5
    assert incremental.append_new_files(spark, folder, schema, target, state) == 0
    spark.range(5, 8).write.mode("append").parquet(folder)
    assert incremental.append_new_files(spark, folder, schema, target, state) == 3
    assert sorted(r[0] for r in spark.read.parquet(target).collect()) == list(range(8))


def test_stream_buckets(spark, tmp_path):
    folder = f"file://{tmp_path}/ev"
    spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id AS INT)) AS ts FROM range(180)").write.parquet(folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    query = incremental.bucket_counts(stream, "ts", "1 hour", "10 minutes").writeStream.format("memory").queryName("b").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.value for r in spark.table("b").collect()) == [60, 60, 60]


def test_sessions(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, timestamp_ntz'2024-01-01 00:00:00'), (1, timestamp_ntz'2024-01-01 00:05:00'), (1, timestamp_ntz'2024-01-01 01:00:00') AS t(a, ts)")
    assert sorted(r.events for r in incremental.sessions(rows, "a", "ts", "30 minutes").collect()) == [1, 2]


@pytest.mark.parametrize("sql", ["SELECT a.b, 'it''s', \"x\"\"y\" FROM t WHERE (a + 1) * 2 >= .5e3 AND c::INT <> 1", "SELECT f(a, g(b)) FROM (SELECT 1) AS t(x)"])
def test_tokens_round_trip(sql):
    once = text_of(tree(sql))
    assert text_of(tree(once)) == once
    assert ("it''s" in sql) == ("'it''s'" in once)


def test_command_line_formats():
    from tidewater.__main__ import write

    for style, want in (("csv", "a,b\r\n1,\r\n"), ("json", '{"a": 1, "b": null}\n'), ("table", "a | b\n--+-----\n1 | NULL\n")):
        out = io.StringIO()
        write([(1, None)], ["a", "b"], style, out)
        assert out.getvalue() == want
