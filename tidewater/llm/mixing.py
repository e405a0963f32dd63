"""Mixing sources to target weights by a low-discrepancy schedule.

1. Every source's words form a line: its documents in a hash order, cut into
   blocks of ``block`` words. Running sums are taken per (source, salt) cell,
   so a source with a third of all rows is spread over many tasks.
2. Slot t of the schedule has the point ``frac(t * golden ratio)``. The points
   are mapped through the cumulative target shares to a source; slots are
   ranked per source, again in cells. Rank k takes block ``k mod n`` of the
   source, in pass ``k div n`` over its shuffled line.
3. Slots and blocks meet by an equi-join on (source, block). A source's last
   slot is cut where its target ends; slots beyond the target are idle, and
   missing ones (the discrepancy is a few slots) follow at the end. A document
   is taken as often as slots cover its words.

Targets are water-filled: sources in code point order, null last, weigh
3, 1, 2, 3, 1, 2, ... and share 150% of all sizes; no target exceeds twice its
source's size, and what exceeds it is shared again by weight.

Defined cases: null text has size 0; a null source is a source of its own; a
document of size 0 is never taken; sources without words have target 0;
repeated rows are separate documents; an empty table gives an empty result;
columns other than ``doc_id``, ``text`` and ``source`` are ignored. The result
depends on the rows only, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.base import WORD, materialise, read, salt, spread_prefix

BLOCK_WORDS = 256
CELLS = 128
WEIGHTS = (3, 1, 2)
SHARE = 1.5
PASSES = 2
#: The schedule's points are multiples of 2**-31; GOLDEN / 2**31 is the golden ratio's fraction.
MODULUS = 2**31
GOLDEN = 1327217885
BINS = 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """``source, source_size, target``: a few rows, one per source.

    In the order of (cap / weight), the sources that end at their cap come
    first; for each prefix the level of the rest follows from running sums, and
    the true level is the smallest, which water-filling never undercuts.
    """
    sums = sized.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    by_name = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sums.withColumn("weight", F.element_at(table, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
    ranked = ranked.withColumn("cap", F.lit(passes) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").cast("binary").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    filled = ranked.select(
        "*",
        (F.lit(share) * F.sum("source_size").over(everything)).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weight_left"),
    ).withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
    # A source is capped when its ratio is at most the level that holds if all before it are capped.
    open_level = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(everything)["level"]
    return filled.withColumn("open", open_level).select(
        "source",
        "source_size",
        F.when(F.col("open").isNull() | (F.col("ratio") <= F.col("open")), F.col("cap").cast("double"))
        .otherwise(F.col("open") * F.col("weight"))
        .alias("target"),
    )


def _schedule(targets: DataFrame, block: int, n_slots: int) -> DataFrame:
    """``source, block_no, from_word, to_word``: the words of the source's line that each active slot takes."""
    over = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    shares = targets.where("target > 0").select(
        "source",
        "source_size",
        F.floor(F.col("target") + 0.5).cast("bigint").alias("quota"),
        (F.sum("target").over(over.rowsBetween(Window.unboundedPreceding, -1)) / F.sum("target").over(Window.partitionBy())).alias("lo"),
        (F.sum("target").over(over.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("target").over(Window.partitionBy())).alias("hi"),
        F.row_number().over(over.orderBy(F.col("source").cast("binary").desc_nulls_first())).alias("from_end"),
    )
    shares = shares.withColumn("lo", F.coalesce("lo", F.lit(0.0))).withColumn("hi", F.when(F.col("from_end") == 1, F.lit(2.0)).otherwise(F.col("hi")))
    # Each source's interval is laid over bins, so that points and intervals meet by an equi-join.
    first, last = F.floor(F.col("lo") * BINS), F.least(F.floor(F.col("hi") * BINS), F.lit(BINS - 1))
    binned = shares.select("source", "lo", "hi", F.explode(F.sequence(F.least(first, F.lit(BINS - 1)).cast("int"), last.cast("int"))).alias("bin"))
    spark = targets.sparkSession
    point = F.pmod(F.pmod(F.col("id"), F.lit(MODULUS)) * GOLDEN, F.lit(MODULUS)) / float(MODULUS)
    slots = spark.range(n_slots).select(F.col("id").alias("t"), point.alias("u")).withColumn("bin", F.floor(F.col("u") * BINS).cast("int"))
    chunk = max(1, -(-n_slots // CELLS))
    chosen = (
        slots.join(binned, "bin")
        .where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
        .select("source", "t", F.floor(F.col("t") / chunk).cast("int").alias("chunk"), F.lit(1).alias("one"))
    )
    ranked = spread_prefix(chosen, ["source"], "chunk", [F.col("t")], "one", "rank").select("source", "rank")
    had = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("had")).withColumnRenamed("source", "__s")
    # Whole passes end with a short block; the last pass ends within the quota.
    whole = F.floor(F.col("quota") / F.col("source_size"))
    needed = (whole * F.ceil(F.col("source_size") / block) + F.ceil((F.col("quota") - whole * F.col("source_size")) / block)).cast("bigint")
    late = (
        shares.join(had, F.col("source").eqNullSafe(F.col("__s")), "left")
        .withColumn("had", F.coalesce("had", F.lit(0).cast("bigint")))
        .where(needed > F.col("had"))
        .select("source", F.explode(F.sequence(F.col("had"), needed - 1)).alias("rank"))
    )
    facts = shares.select(F.col("source").alias("__s"), "source_size", "quota")
    blocks = F.ceil(F.col("source_size") / block).cast("bigint")
    placed = ranked.unionByName(late).join(facts, F.col("source").eqNullSafe(F.col("__s"))).withColumn("blocks", blocks)
    placed = placed.withColumn("pass", F.floor(F.col("rank") / F.col("blocks"))).withColumn("block_no", F.pmod(F.col("rank"), F.col("blocks")))
    start = F.col("block_no") * block
    end = F.least(start + block, F.col("source_size"), F.col("quota") - F.col("pass") * F.col("source_size"))
    return placed.select("source", "block_no", start.alias("from_word"), end.alias("to_word")).where("to_word > from_word")


def mix_sources(docs: DataFrame, block: int = BLOCK_WORDS, cells: int = CELLS) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, taken``."""
    spark = docs.sparkSession
    sized = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    targets = materialise(source_targets(sized), "mix-targets")
    total = targets.agg(F.sum("target")).first()[0] or 0
    n_slots = int(total // block) + 1

    line = sized.withColumn("cell", salt(F.coalesce(F.col("doc_id"), F.lit(-1)), cells))
    shuffled = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit(1))
    # The place in its cell tells rows apart that agree in everything.
    line = line.withColumn("nth", F.row_number().over(Window.partitionBy("source", "cell").orderBy(shuffled, "doc_id", "size")))
    line = spread_prefix(line, ["source"], "cell", [F.col("nth")], "size", "begin")
    end = F.col("begin") + F.col("size")
    first, last = F.floor(F.col("begin") / block), F.floor((F.greatest(end, F.col("begin") + 1) - 1) / block)
    parts = line.select("source", "doc_id", "size", "begin", "cell", "nth", F.explode(F.sequence(first, last)).alias("block_no"))
    slots = _schedule(targets, block, n_slots)
    slots = slots.select(F.col("source").alias("__s"), F.col("block_no").alias("__b"), "from_word", "to_word")
    same = F.col("source").eqNullSafe(F.col("__s")) & (F.col("block_no") == F.col("__b"))
    covered = F.least("to_word", F.col("begin") + F.col("size")) - F.greatest("from_word", F.col("begin"))
    met = parts.join(slots, same, "left").withColumn(
        "words", F.when(F.col("from_word").isNull(), F.lit(0)).otherwise(F.greatest(covered, F.lit(0)))
    )
    taken = met.groupBy("source", "cell", "nth", "doc_id", "size").agg(F.sum("words").cast("bigint").alias("taken"))
    facts = targets.select(F.col("source").alias("__s"), "source_size", "target")
    return taken.join(facts, F.col("source").eqNullSafe(F.col("__s"))).select("doc_id", "source", "size", "source_size", "target", "taken")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
