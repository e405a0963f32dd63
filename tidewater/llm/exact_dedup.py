"""Exact deduplication by a tree merge of sorted digest runs.

The digests of all rows are written once, each row in one of ``2 ** rounds``
virtual partitions, at random. A partition's run has one entry per digest, in
digest order: (digest, largest id, count). In each binomial round a partition
pairs with the one whose number differs in one more bit: it keeps the entries
whose digest has the same bit as its own number and hands the others to its
partner, and the two sorted runs that it then holds are merged. After the last
round partition p has exactly the digests that belong to p, each once. The
outcome travels back along the first runs (one entry per partition and digest),
so a text that a third of all rows share never meets in one task.

A merge goes through the entries in the order of (partition, digest, id): a
window over sorted rows, which the optimizer cannot turn into hashing. At every
level an entry is verified: entries with one SHA-256 must agree in byte length
and in an independent 64-bit hash, otherwise the job raises.

Defined cases: null text counts as empty, and all empty texts are one group; a
null ``doc_id`` is smaller than any id; of rows that repeat the surviving id
exactly one is kept, by a hash of its text; a very long text is hashed whole and
only its digest moves; an empty table gives an empty result; other columns of
the input, whatever their names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.base import boxed, lower_ascii, marked_by_ids, materialise, one_of_each, read, shuffle_parts, unboxed


def _rounds(spark: SparkSession) -> int:
    """Rounds needed so that there are at least as many partitions as the cluster shuffles into."""
    return max(1, math.ceil(math.log2(max(2, shuffle_parts(spark))) - 1e-9))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(lower_ascii(F.coalesce(text, F.lit(""))), 256))


def _mark(text: Column) -> Column:
    """Tells apart texts that differ in case only."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _merge(entries: DataFrame, owner: Column, tasks: int) -> DataFrame:
    """One round: hand every entry to its owner, go through its runs in digest order, merge equal digests."""
    dealt = entries.withColumn("owner", owner).repartition(tasks, "owner")
    same = Window.partitionBy("owner", "digest").orderBy(F.col("top_id").desc_nulls_last(), F.col("top_mark").desc(), F.col("top_row").desc())
    group = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = dealt.withColumns(
        {
            "__nth": F.row_number().over(same),
            "__members": F.sum("members").over(group),
            "__sound": (F.min("n_bytes").over(group) == F.max("n_bytes").over(group)) & (F.min("check").over(group) == F.max("check").over(group)),
        }
    ).where("__nth = 1")
    verified = F.when(F.col("__sound"), F.col("__members")).otherwise(F.raise_error(F.lit("different texts share a SHA-256 digest")).cast("bigint"))
    return merged.withColumn("members", verified).drop("__nth", "__members", "__sound")


def _rows(docs: DataFrame, parts: int) -> DataFrame:
    """Each row's digest, written once; ``row`` numbers the rows."""
    text = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select("doc_id", _mark(F.col("text")).alias("mark"), text.alias("__t"), F.monotonically_increasing_id().alias("row")).select(
        "doc_id",
        "mark",
        "row",
        F.unhex(F.sha2("__t", 256)).alias("digest"),
        F.octet_length("__t").cast("bigint").alias("n_bytes"),
        F.xxhash64("__t").alias("check"),
        F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("pid"),
    )
    return materialise(rows, "exact-rows")


def merged_runs(runs: DataFrame, rounds: int, tasks: int) -> DataFrame:
    """``digest, top_id, top_mark, top_row, members``, each digest once, after all binomial rounds over runs ``owner, digest, ...``."""
    level = runs
    for k in range(rounds):
        bit = lambda c: F.call_function("shiftright", F.col(c), F.lit(k)).bitwiseAND(F.lit(1))  # noqa: B023, E731
        level = _merge(level, (F.col("owner") + (bit("home") - bit("owner")) * F.lit(1 << k)).cast("int"), tasks)
    return level


def _told(docs: DataFrame, rounds: int | None = None) -> DataFrame:
    """Each row's ``doc_id, mark, digest, keep_id, group_size, kept``."""
    spark = docs.sparkSession
    rounds = rounds or _rounds(spark)
    parts = 1 << rounds
    tasks = max(2, min(parts, shuffle_parts(spark)))
    rows = _rows(docs, parts)
    top = F.max(F.struct("doc_id", "mark", "row"))
    runs = rows.groupBy("pid", "digest").agg(
        top.alias("__top"),
        F.count(F.lit(1)).alias("members"),
        F.min("n_bytes").alias("n_bytes"),
        F.max("n_bytes").alias("__hi_bytes"),
        F.min("check").alias("check"),
        F.max("check").alias("__hi_check"),
    )
    sound = (F.col("n_bytes") == F.col("__hi_bytes")) & (F.col("check") == F.col("__hi_check"))
    # The digest's own partition number, from its leading bytes.
    home = F.pmod(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("bigint"), F.lit(parts)).cast("int")
    runs = runs.select(
        F.col("pid").alias("owner"),
        "digest",
        F.col("__top.doc_id").alias("top_id"),
        F.col("__top.mark").alias("top_mark"),
        F.col("__top.row").alias("top_row"),
        F.when(sound, F.col("members")).otherwise(F.raise_error(F.lit("different texts share a SHA-256 digest")).cast("bigint")).alias("members"),
        "n_bytes",
        "check",
        home.alias("home"),
    )
    runs = materialise(runs, "exact-runs")
    final = merged_runs(runs, rounds, tasks).select(F.col("digest").alias("__d"), F.col("top_id").alias("keep_id"), "top_row", F.col("members").alias("group_size"))
    back = runs.select("owner", "digest").join(final, F.col("digest") == F.col("__d")).select(
        F.col("owner").alias("__p"), F.col("digest").alias("__d"), "keep_id", F.col("top_row").alias("__row"), "group_size"
    )
    told = rows.join(back, (F.col("pid") == F.col("__p")) & (F.col("digest") == F.col("__d")))
    return told.select("doc_id", "mark", "digest", "keep_id", F.col("group_size").cast("bigint").alias("group_size"), (F.col("row") == F.col("__row")).alias("kept"))


def exact_groups(docs: DataFrame, rounds: int | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    return _told(docs, rounds).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The documents that :func:`exact_groups` keeps, with their columns.

    Rows that repeat both id and text give one row: that whose columns, written
    as JSON, come first. Only rows whose id is that of a dropped or repeated row
    are looked at again; no other text moves.
    """
    told = _told(docs).groupBy("doc_id", "digest", "mark").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("times"))
    judged = told.where("NOT kept OR times > 1").select(F.col("doc_id").alias("__tw_id"), F.col("digest").alias("__tw_digest"), F.col("mark").alias("__tw_mark"), F.col("kept").alias("__tw_kept"))
    judged = materialise(judged, "exact-judged")
    marked = marked_by_ids(boxed(docs, "doc_id", "text"), "doc_id", judged, "__tw_id")
    asked = marked.where("__tw_hit").withColumns({"__tw_own_digest": _digest(F.col("text")), "__tw_own_mark": _mark(F.col("text"))})
    same = F.col("doc_id").eqNullSafe(F.col("__tw_id")) & (F.col("__tw_own_digest") == F.col("__tw_digest")) & (F.col("__tw_own_mark") == F.col("__tw_mark"))
    met = asked.join(judged, same, "left")
    left = marked.where("NOT __tw_hit").select("__tw_doc").unionByName(met.where("__tw_kept IS NULL").select("__tw_doc"))
    if judged.where("__tw_kept").take(1):
        repeated = one_of_each(met.where("__tw_kept"), ["doc_id", "__tw_own_digest", "__tw_own_mark"])
        left = left.unionByName(repeated.select("__tw_doc"))
    return unboxed(left)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


OP7_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM t
"""
