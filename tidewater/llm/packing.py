"""Best-fit packing with large-item matching, planned on length counts.

Pieces are at most ``capacity`` tokens long, so a table of how many pieces have
each length has a fixed size whatever the input's. The plan is made on that
table, for runs of equal bins at once:

* pieces above a third of the capacity fit at most twice into a bin; from the
  longest down each is matched greedily with the longest other that still fits;
* smaller pieces, longest first, go to the tightest remaining gap (best fit),
  and new bins are opened only when no gap is left that takes them.

A plan row says: the pieces of this length with ranks lo..hi-1 go, ``copies`` to
a bin, to the bins from ``bin`` on, at ``offset``. Pieces are ranked within
their length over salted cells, so a frequent length is not one task, and meet
the plan by an equi-join on the length. The plan has a few rows per length
(at most about 20 000 of them), so it is always small enough to broadcast.

Defined cases: null text counts as empty, and an empty document still has its
end id; repeated rows are separate documents; a null doc_id is packed like any
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.base import materialise, read, release, schema, ship, spread_prefix
from tidewater.llm.tokens import encoder, slices, with_endings

CAPACITY = 4096
END_ID = 1
CELLS = 64
#: Bytes of texts that are encoded at a time (one text at least).
SLICE_BYTES = 1 << 20
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLAN = "length bigint, lo bigint, hi bigint, copies bigint, bin bigint, offset bigint"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut_pieces(parts, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID):
    """Batches of the columns ``PIECES`` for Arrow batches of ``doc_id, text``."""
    import numpy as np
    import pyarrow as pa

    for batch in parts:
        ids, texts = batch.column(0), batch.column(1)
        for a, b in slices(texts, SLICE_BYTES):
            found, bounds = with_endings(*encoder(vocabulary, False).encode(texts.slice(a, b - a)), end_id)
            sizes = np.diff(bounds)
            pieces = -(-sizes // capacity)
            owner = np.repeat(np.arange(b - a), pieces)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, sizes[owner] - start)
            at = bounds[:-1][owner] + start
            raw = memoryview(found.tobytes())
            checks = [zlib.crc32(raw[4 * x : 4 * (x + n)]) for x, n in zip(at.tolist(), length.tolist(), strict=True)]
            columns = [ids.take(pa.array(owner + a)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(checks, pa.int64())]
            del found, raw
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])
        # What a batch frees lies between remembered pieces, and would add up to some 100 MB in a worker.
        release(collect=False)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document: whole if it fits, else cut every ``capacity`` tokens."""
    ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInArrow(lambda parts: cut_pieces(parts, vocabulary, capacity, end_id), schema(PIECES))


class _Bins:
    """Runs of equal bins by their gap."""

    def __init__(self):
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.gaps: list[int] = []

    def add(self, gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in self.runs:
                bisect.insort(self.gaps, gap)
                self.runs[gap] = []
            self.runs[gap].append((first, n))

    def tightest(self, size: int) -> tuple[int, int, int] | None:
        """Take out a run with the smallest gap that holds ``size``."""
        at = bisect.bisect_left(self.gaps, size)
        if at == len(self.gaps):
            return None
        gap = self.gaps[at]
        first, n = self.runs[gap].pop()
        if not self.runs[gap]:
            del self.runs[gap]
            self.gaps.pop(at)
        return gap, first, n


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """The plan rows ``(length, lo, hi, copies, bin, offset)`` for pieces counted by length."""
    left = {k: n for k, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    plan: list[tuple[int, int, int, int, int, int]] = []
    bins, opened = _Bins(), 0

    def put(length: int, n: int, copies: int, first: int, offset: int) -> None:
        plan.append((length, used[length], used[length] + n, copies, first, offset))
        used[length] += n
        left[length] -= n

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        at = bisect.bisect_right(large, capacity - a) - 1
        while at >= 0 and not left[large[at]]:
            del large[at]
            at -= 1
        b = large[at] if at >= 0 else None
        if b is None:
            n = left[a]
            put(a, n, 1, opened, 0)
            bins.add(capacity - a, opened, n)
        elif b == a:
            n = left[a] // 2
            if n:
                put(a, 2 * n, 2, opened, 0)
                bins.add(capacity - 2 * a, opened, n)
            else:  # one is left: its partner is the next shorter one
                at -= 1
                while at >= 0 and not left[large[at]]:
                    at -= 1
                n = 1
                put(a, 1, 1, opened, 0)
                if at >= 0:
                    put(large[at], 1, 1, opened, a)
                bins.add(capacity - a - (large[at] if at >= 0 else 0), opened, 1)
        else:
            n = min(left[a], left[b])
            put(a, n, 1, opened, 0)
            put(b, n, 1, opened, a)
            bins.add(capacity - a - b, opened, n)
        opened += n

    for size in sorted((k for k in left if left[k]), reverse=True):
        while left[size]:
            run = bins.tightest(size)
            if run is None:
                n = -(-left[size] // (capacity // size))
                gap, first = capacity, opened
                opened += n
            else:
                gap, first, n = run
            copies = min(gap // size, left[size])
            filled = min(n, left[size] // copies)
            put(size, filled * copies, copies, first, capacity - gap)
            bins.add(gap - copies * size, first, filled)
            if run is not None or left[size] == 0:
                bins.add(gap, first + filled, n - filled)
            elif n > filled:  # the last new bin takes what is left
                rest = left[size]
                put(size, rest, rest, first + filled, 0)
                bins.add(capacity - rest * size, first + filled, 1)
    return plan


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, cells: int = CELLS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``doc_id, piece, length, ids_crc32``."""
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan = pack_lengths(counts, capacity)
    table = spark.createDataFrame(plan, schema(PLAN)).withColumnRenamed("length", "__length").withColumnRenamed("offset", "__offset")
    mixed = F.xxhash64("doc_id", "piece", "ids_crc32")
    cell = F.pmod(mixed, F.lit(cells)).cast("int")
    ranked = pieces.withColumn("cell", cell)
    nth = F.row_number().over(Window.partitionBy("length", "cell").orderBy(mixed, "doc_id", "piece", "ids_crc32"))
    ranked = spread_prefix(ranked.withColumn("nth", nth).withColumn("one", F.lit(1)), ["length"], "cell", [F.col("nth")], "one", "rank")
    same = (F.col("length") == F.col("__length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    met = ranked.join(F.broadcast(table), same)
    place = F.col("rank") - F.col("lo")
    return met.select(
        *pieces.columns,
        (F.col("bin") + F.floor(place / F.col("copies"))).cast("bigint").alias("sequence_id"),
        (F.col("__offset") + F.pmod(place, F.col("copies")) * F.col("length")).cast("bigint").alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: one row per piece."""
    pieces = materialise(token_pieces(docs, vocabulary or default_vocabulary(), capacity), "pack-pieces")
    return pack_pieces(pieces, capacity)


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
