"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: White space as every operator here understands it: U+0020 and U+0009..U+000D.
SPACE_CHARS = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body) -> Column:
    """Bind ``value`` once and evaluate ``body`` on it.

    A lambda variable is computed a single time per row, so ``body`` may use it
    inside further lambdas without Catalyst copying the expression into them.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; every other code point stays as it is."""
    return F.translate(text, UPPER, LOWER)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver found it.

    The package goes through Spark's own file service, once per application.
    Documents are long rows, so Arrow batches are held to ``BATCH_ROWS`` of them.
    """
    context = spark.sparkContext
    if int(spark.conf.get(BATCH_SETTING)) > BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    if getattr(context, "_tidewater_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="tidewater-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as packed:
        for source in sorted(package.rglob("*.py")):
            packed.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))
    context._tidewater_shipped = True


def release(collect: bool = True) -> None:
    """Hand memory that is free again back to the system: a Python worker outlives its task."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a session without
    that setting (tests on one machine) gets a temporary folder of its own.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tidewater.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        own = tempfile.TemporaryDirectory(prefix="tidewater-", ignore_cleanup_errors=True)
        atexit.register(own.cleanup)
        found = f"file://{own.name}"
        spark.conf.set("tidewater.shared.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tidewater/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, tasks: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with replicated storage instead of executor-local blocks,
    so a lost executor costs a re-read and not a recomputation. ``tasks`` write
    it at most: every file costs a task, its commit, and on local file systems
    two processes forked by the executor to set permissions.
    """
    path = fresh_path(df.sparkSession, label)
    (df.coalesce(tasks) if tasks else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(spark: SparkSession, rows: int, each: int) -> int:
    """Tasks for ``rows`` rows at ``each``, and never less than there are cores; grows with the rows."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salt(column: Column, buckets: int) -> Column:
    """A bucket that depends on the row's content only, so that retries agree."""
    return F.pmod(F.xxhash64(column, F.lit(0x5EED)), F.lit(buckets)).cast("int")


def spread_prefix(df: DataFrame, keys: list[str], bucket: str, order: list[Column], weight: str, out: str, kind: str = "bigint") -> DataFrame:
    """Exclusive running sum of ``weight`` per ``keys`` in (bucket, order).

    A plain window would put all rows of a hot key into one task. Here each
    (keys, bucket) cell is summed first, the few cell totals get their own
    running sum, and rows are only ordered inside their cell.
    """
    cells = df.groupBy(*keys, bucket).agg(F.sum(weight).cast(kind).alias("__tw_cell"))
    over = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        *[F.col(k).alias(f"__tw_k{i}") for i, k in enumerate(keys)],
        F.col(bucket).alias("__tw_b"),
        F.coalesce(F.sum("__tw_cell").over(over), F.lit(0)).cast(kind).alias("__tw_before"),
    )
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = df.withColumn("__tw_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)).cast(kind))
    same = F.col(bucket).eqNullSafe(F.col("__tw_b"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__tw_k{i}"))
    return (
        ranked.join(cells, same)
        .withColumn(out, F.col("__tw_before") + F.col("__tw_inside"))
        .drop("__tw_b", "__tw_before", "__tw_inside", *[f"__tw_k{i}" for i in range(len(keys))])
    )


def marked_by_ids(df: DataFrame, column: str, ids: DataFrame, id_column: str, least_words: int = 1 << 16, most_words: int = 1 << 20) -> DataFrame:
    """``df`` with a column ``__tw_hit``: false only where no id equals ``column``; no row moves.

    The ids set bits in a table of at most ``most_words`` 64-bit words (16 MB,
    whatever the input's size), which is broadcast. With more ids than bits the
    table marks more rows that match nothing; what follows must be exact.
    """
    words = least_words
    n = ids.count()
    while words < most_words and words * 16 < n:
        words *= 2
    mixed = lambda c: F.xxhash64(F.col(c), F.lit(0xB1F))
    word = lambda c: F.pmod(mixed(c), F.lit(words)).cast("int")
    bit = lambda c: F.pmod(F.shiftright(mixed(c), 24), F.lit(64)).cast("int")
    bits = ids.groupBy(word(id_column).alias("__tw_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(id_column))).alias("__tw_bits"))
    hit = F.call_function("shiftright", F.col("__tw_bits"), bit(column)).bitwiseAND(F.lit(1).cast("bigint")) == 1
    met = df.join(F.broadcast(bits), word(column) == F.col("__tw_word"), "left")
    return met.withColumn("__tw_hit", F.coalesce(hit, F.lit(False))).drop("__tw_word", "__tw_bits")


def rows_with_ids(df: DataFrame, column: str, ids: DataFrame, id_column: str) -> DataFrame:
    """``df`` left semi ``ids``; only rows that hit a bit of the ids go on to the exact join."""
    near = marked_by_ids(df, column, ids, id_column).where("__tw_hit").drop("__tw_hit")
    return near.join(ids.select(F.col(id_column).alias("__tw_id")), F.col(column) == F.col("__tw_id"), "left_semi")


def boxed(df: DataFrame, *names: str) -> DataFrame:
    """All columns as one struct ``__tw_doc``, beside copies of those named: no column can clash with an operator's own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__tw_doc"), *[F.col(f"`{n}`") for n in names])


def unboxed(df: DataFrame) -> DataFrame:
    return df.select("__tw_doc.*")


def one_of_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of the boxed rows with equal keys the one whose columns, written as JSON, come first; with the keys."""
    return df.groupBy(*keys).agg(F.min_by("__tw_doc", F.to_json("__tw_doc")).alias("__tw_doc"))


def schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)
