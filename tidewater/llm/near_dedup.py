"""Near-duplicate groups from SetSketch registers.

1. Each document's set of distinct 4-word shingles is sketched into registers:
   exponentially spaced truncated minima, mergeable by maximum. Equal sets
   collapse into one class, represented by its smallest doc_id.
2. Bands of register values meet by an equi-join. In each bucket the member
   with the most band neighbours is the centre, and the others are paired with
   it. A pair's similarity is estimated jointly by likelihood from all registers
   and the two set sizes; pairs well below the threshold go, the others are
   confirmed on their full shingle sets. The links make parts.
3. Two members of a bucket may be similar though neither is to the centre. Where
   a bucket's members are in several parts and the largest has more than ``FEW``
   members, that part meets everything else that shares a bucket with it, in
   blocks of ``BLOCK`` documents on each side, and leaves the bucket. Of what
   is left, members outside the largest part, if they are ``FEW`` at most, are
   paired with all members of other parts. A bucket with more of them is dealt
   anew by ``MORE`` further registers in ``TRIES`` ways, up to ``DEPTH`` times. What
   is torn by so many even then is compared in full, in blocks. Estimate and
   confirmation are always the same.

Pairs grow with a bucket, not with its square, and no bucket is capped; blocks
grow with the product of a part's size and of what shares its buckets unlinked.
A pair at the threshold shares no bucket with probability below 1e-6 and has too
low an estimate with about 1e-6 (4.7 standard errors). Only where all buckets that it
shares (12 on average) are dealt anew ``DEPTH`` times, all of them may lose it,
with probability 2e-4.

Defined cases: null or blank text has an empty set, component = its own id, and
is linked with nothing; a null doc_id is linked with nothing and kept; rows that
share an id count as one document, linked with whatever any of their texts is
linked with; a very long text is hashed whole, in a slice of its own; an empty
table gives an empty result; other columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.base import boxed, marked_by_ids, materialise, one_of_each, read, rows_with_ids, schema, ship, tasks_for, unboxed
from tidewater.llm.components import connected
from tidewater.llm.shingles import BANDS, REGISTERS, ROWS, estimate, jaccard_reaches, registers, shingle_sets
from tidewater.llm.tokens import slices

PERCENT = 80
#: Estimates below are no candidates: 4.7 standard errors under the threshold.
CANDIDATE = 0.66
#: Members outside a bucket's largest part that are paired with all others.
FEW = 16
#: A bucket with more is dealt anew by so many further registers, in so many ways, so often.
MORE, TRIES, DEPTH = 2, 2, 3
BLOCK = 128
#: So many new links are worth finding the parts anew.
RECOUNT = 1000
SLICE_BYTES = 1 << 20
#: Documents for each task that writes a table about them.
DOCS_A_TASK = 10_000


def _asked(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, n, digest, regs`` of every row."""
    ship(docs.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in parts:
            for a, b in slices(batch.column(1), SLICE_BYTES):
                sets = shingle_sets(batch.column(1).slice(a, b - a))
                digests = [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets]
                regs = [registers(s) if len(s) else None for s in sets]
                columns = [batch.column(0).slice(a, b - a), pa.array(map(len, sets), pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "digest", "regs"])

    return _asked(docs).mapInArrow(run, schema("doc_id bigint, n bigint, digest binary, regs binary"))


def shingles_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``rep, shingles`` for the documents listed in ``ids.rep``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for a, b in slices(batch.column(1), SLICE_BYTES):
                sets = [s.tobytes() for s in shingle_sets(batch.column(1).slice(a, b - a))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], ["rep", "shingles"])

    own = rows_with_ids(docs.select("doc_id", "text"), "doc_id", ids, "rep")
    return _asked(own).mapInArrow(run, schema("rep bigint, shingles binary"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(len(column), REGISTERS)


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, b`` of pairs whose estimate is at least ``CANDIDATE``."""
    side = lambda c, k: classes.select(F.col("rep").alias(c), F.col("n").alias(f"n{k}"), F.col("regs").alias(f"regs{k}"))
    near = (100 * F.least("n1", "n2")) >= PERCENT * F.greatest("n1", "n2")
    met = pairs.join(side("a", 1), "a").join(side("b", 2), "b").where(near)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            if len(frame):
                est = estimate(_matrix(frame["regs1"]), _matrix(frame["regs2"]), frame["n1"].to_numpy(float), frame["n2"].to_numpy(float))
                yield frame.loc[est >= CANDIDATE, ["a", "b"]]

    return met.mapInPandas(run, schema("a bigint, b bigint"))


def _confirmed(pairs: DataFrame, docs: DataFrame, label: str, tasks: int) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets reach the threshold."""
    ends = materialise(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), f"{label}-ends", tasks)
    sets = materialise(shingles_of(docs, ends), f"{label}-sets", tasks)
    side = lambda c, k: sets.select(F.col("rep").alias(c), F.col("shingles").alias(f"s{k}"))
    met = pairs.join(side("a", 1), "a").join(side("b", 2), "b").coalesce(tasks)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            x, y = batch.column("s1"), batch.column("s2")
            holds = [jaccard_reaches(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64), PERCENT) for i in range(len(batch))]
            yield batch.select(["a", "b"]).filter(pa.array(holds, pa.bool_()))

    return materialise(met.mapInArrow(run, schema("a bigint, b bigint")).distinct(), f"{label}-links", tasks)


def _torn(parted: DataFrame, tasks: int) -> DataFrame:
    """``key, main, n_main, n_rest`` of the buckets in ``key, rep, part`` that hold several parts."""
    sizes = parted.groupBy("key", "part").agg(F.count(F.lit(1)).alias("size"))
    keys = sizes.groupBy("key").agg(F.max(F.struct("size", "part")).alias("top"), F.sum("size").alias("n_all"), F.count(F.lit(1)).alias("n_parts"))
    torn = keys.where("n_parts > 1").select("key", F.col("top.part").alias("main"), F.col("top.size").alias("n_main"), (F.col("n_all") - F.col("top.size")).alias("n_rest"))
    return materialise(torn, "near-torn", tasks)


def _few_with_all(parted: DataFrame, torn: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of each member outside the largest part with every member of another part, in buckets with few on both sides."""
    few = torn.where(F.col("n_rest") <= FEW).select("key", "main")
    inside = parted.join(few, "key")
    rest = inside.where("part <> main").groupBy("key").agg(F.collect_list(F.struct(F.col("rep").alias("a"), F.col("part").alias("pa"))).alias("rest"))
    met = inside.join(rest, "key").select("rep", "part", F.explode("rest").alias("r")).where("part <> r.pa")
    return met.select(F.least("rep", "r.a").alias("a"), F.greatest("rep", "r.a").alias("b"))


def _with_main(parted: DataFrame, torn: DataFrame, classes: DataFrame, docs: DataFrame, tasks: int) -> DataFrame:
    """Confirmed links ``a, b`` between large parts and what shares a bucket with them.

    A part meets all the others' members at once, however many buckets they
    share, in blocks of ``BLOCK`` on each side; one link to the part is enough.
    """
    large = torn.where(F.col("n_main") > FEW).select("key", "main")
    sides = parted.join(large, "key").select(F.col("main").alias("area"), "rep", (F.col("part") == F.col("main")).alias("in_main")).distinct()
    sides = materialise(sides, "near-sides", tasks)
    blocks = lambda c: F.ceil(F.sum(c.cast("int")) / BLOCK).cast("int")
    sizes = materialise(sides.groupBy("area").agg(blocks(F.col("in_main")).alias("mains"), blocks(~F.col("in_main")).alias("rests")), "near-sizes", tasks)
    sets = materialise(shingles_of(docs, sides.select("rep").distinct()), "near-sides-sets", tasks)
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("rests"))).cast("int")
    other = F.sequence(F.lit(0), F.when(F.col("in_main"), F.col("rests")).otherwise(F.col("mains")) - 1)
    dealt = sides.join(sizes, "area").select("area", "rep", "in_main", own.alias("own"), F.explode(other).alias("other"))
    i, j = F.when(F.col("in_main"), F.col("own")).otherwise(F.col("other")), F.when(F.col("in_main"), F.col("other")).otherwise(F.col("own"))
    full = dealt.select("area", "rep", "in_main", i.alias("i"), j.alias("j")).join(classes.select("rep", "n", "regs"), "rep").join(sets, "rep")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rep", kind="stable").reset_index(drop=True)
        inside = frame["in_main"].to_numpy(bool)
        mains = np.flatnonzero(inside)
        regs, n, reps = _matrix(frame["regs"]), frame["n"].to_numpy(float), frame["rep"].to_numpy()
        sets_ = [np.frombuffer(x, np.uint64) for x in frame["shingles"]]
        found = []
        for x in np.flatnonzero(~inside).tolist():
            ys = mains[100 * np.minimum(n[mains], n[x]) >= PERCENT * np.maximum(n[mains], n[x])]
            ys = ys[(regs[ys] == regs[x]).mean(1) >= CANDIDATE - 0.2] if len(ys) else ys
            if not len(ys):
                continue
            est = estimate(regs[ys], np.broadcast_to(regs[x], (len(ys), REGISTERS)), n[ys], np.full(len(ys), n[x]))
            for y in ys[np.argsort(-est, kind="stable")][: int((est >= CANDIDATE).sum())].tolist():
                if jaccard_reaches(sets_[x], sets_[y], PERCENT):
                    found.append((int(reps[x]), int(reps[y])))
                    break
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return materialise(full.groupBy("area", "i", "j").applyInPandas(compare, schema("a bigint, b bigint")), "near-main-links", tasks)


def _dealt_anew(parted: DataFrame, torn: DataFrame, classes: DataFrame, round_: int, tasks: int) -> DataFrame:
    """``key, rep`` of the members of buckets with many outside their largest part, by further registers."""
    many = torn.where(F.col("n_rest") > FEW).select("key")
    inside = parted.join(many, "key").join(classes.select("rep", "regs"), "rep")
    groups = REGISTERS // MORE
    # Which registers they are depends on the bucket, so the buckets that a pair shares fail independently.
    group = lambda e: F.pmod(F.xxhash64("key", F.lit(round_)) + F.lit(e * (groups // TRIES)), F.lit(groups)).cast("int")
    further = lambda e: F.xxhash64("key", F.lit(e), F.substring("regs", 2 * MORE * group(e) + 1, F.lit(2 * MORE)))
    keys = inside.select("rep", F.explode(F.array(*[further(e) for e in range(TRIES)])).alias("key"))
    shared = materialise(keys.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key"), "near-further", tasks)
    return keys.join(shared, "key").select("key", "rep")


def _in_blocks(parted: DataFrame, torn: DataFrame, classes: DataFrame, tasks: int) -> DataFrame:
    """Pairs ``a, b`` with a sufficient estimate between the parts of buckets that stay torn by many."""
    many = torn.where(F.col("n_rest") > FEW)
    sizes = parted.join(many, "key").groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = parted.join(materialise(sizes, "near-blocks", tasks), "key")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    cell = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    cells = dealt.select("key", "rep", "part", own.alias("own"), F.explode(cell).alias("cell")).select("key", "rep", "part", "own", "cell.i", "cell.j")
    full = cells.join(classes.select("rep", "n", "regs"), "rep")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
        frame = frame.sort_values("rep", kind="stable").reset_index(drop=True)
        own, reps, part = frame["own"].to_numpy(), frame["rep"].to_numpy(), frame["part"].to_numpy()
        regs, n = _matrix(frame["regs"]), frame["n"].to_numpy(float)
        right = np.flatnonzero(own == j)
        found = [np.zeros((0, 2), np.int64)]
        for x in np.flatnonzero(own == i).tolist():
            ys = right[part[right] != part[x]]
            if i == j:
                ys = ys[ys > x]
            ys = ys[100 * np.minimum(n[ys], n[x]) >= PERCENT * np.maximum(n[ys], n[x])]
            if len(ys):
                est = estimate(regs[ys], np.broadcast_to(regs[x], (len(ys), REGISTERS)), n[ys], np.full(len(ys), n[x]))
                ys = ys[est >= CANDIDATE]
                found.append(np.stack([np.minimum(reps[ys], reps[x]), np.maximum(reps[ys], reps[x])], 1))
        return pd.DataFrame(np.concatenate(found), columns=["a", "b"])

    return full.groupBy("key", "i", "j").applyInPandas(compare, schema("a bigint, b bigint"))


def _parts(links: DataFrame, label: str, tasks: int) -> DataFrame:
    """``rep, part`` of every document with a link."""
    roots = connected(links.select(F.lit(0).alias("kind"), "a", "b"), label, tasks)
    return roots.select(F.col("node").alias("rep"), F.col("root").alias("part"))


def near_links(docs: DataFrame, classes: DataFrame, tasks: int) -> DataFrame:
    """Confirmed links ``a, b`` between classes: all components follow from them. ``tasks`` write each table on the way."""
    band = lambda j: F.xxhash64(F.lit(j), F.substring("regs", 2 * ROWS * j + 1, 2 * ROWS))
    keys = classes.select("rep", F.explode(F.array(*[band(j) for j in range(BANDS)])).alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    members = materialise(keys.join(shared, "key"), "near-members", tasks)
    degrees = materialise(members.groupBy("rep").agg(F.sum("k").alias("degree")), "near-degrees", tasks)
    known = members.join(degrees, "rep")
    centres = materialise(known.groupBy("key").agg((-F.max(F.struct("degree", (-F.col("rep")).alias("r")))["r"]).alias("centre")), "near-centres", tasks)
    stars = members.join(centres, "key").where("rep <> centre").select(F.least("centre", "rep").alias("a"), F.greatest("centre", "rep").alias("b")).distinct()
    active = materialise(rows_with_ids(classes, "rep", degrees, "rep"), "near-active", tasks)
    stars = materialise(_estimated(stars, active), "near-stars", tasks)
    links = _confirmed(stars, docs, "near", tasks)

    # Buckets of two are settled by their star.
    own = members.where("k > 2").select("key", "rep")
    pairs, parts = [], materialise(_parts(links, "near-parts", tasks), "near-part", tasks)
    for round_ in range(DEPTH + 1):
        parted, torn, links, parts = _without_large(own, links, parts, active, docs, tasks)
        pairs.append(_few_with_all(parted, torn).coalesce(tasks))
        if not torn.where(F.col("n_rest") > FEW).take(1):
            break
        if round_ == DEPTH:
            pairs.append(_in_blocks(parted, torn, active, tasks).coalesce(tasks))
        else:
            own = _dealt_anew(parted, torn, active, round_, tasks)
    every = pairs[0]
    for more in pairs[1:]:
        every = every.unionByName(more)
    every = materialise(_estimated(every.distinct(), active), "near-more", tasks)
    return links.unionByName(_confirmed(every, docs, "near-more", tasks))


def _without_large(own: DataFrame, links: DataFrame, parts: DataFrame, classes: DataFrame, docs: DataFrame, tasks: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Compare large parts with the rest of their buckets ``key, rep``, and take them out, until none is left.

    Returns the members left with their parts, the torn buckets among them, all
    links, and the parts. Parts that a few new links would join stay apart:
    their members are then compared again, which changes no result.
    """
    while True:
        parted = materialise(own.join(parts, "rep", "left").select("key", "rep", F.coalesce("part", "rep").alias("part")), "near-parted", tasks)
        torn = _torn(parted, tasks)
        if not torn.where(F.col("n_main") > FEW).take(1):
            return parted, torn, links, parts
        found = _with_main(parted, torn, classes, docs, tasks)
        links = links.unionByName(found)
        # What was compared with its bucket's largest part only meets the others from now on.
        left = parted.join(torn.select("key", F.when(F.col("n_main") > FEW, F.col("main")).alias("main")), "key")
        own = left.where("main IS NULL OR part <> main").select("key", "rep")
        if len(found.take(RECOUNT)) == RECOUNT:
            parts = materialise(_parts(links, "near-parts", tasks), "near-part", tasks)


def _same_ids(table: DataFrame, classes: DataFrame, tasks: int) -> DataFrame:
    """Links ``a, b`` between the classes that rows of one id are in."""
    found = table.where("n > 0 AND doc_id IS NOT NULL")
    several = found.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    several = materialise(several, "near-several", tasks)
    own = rows_with_ids(found, "doc_id", several, "doc_id").select("doc_id", F.col("digest").alias("__d")).distinct()
    reps = own.join(classes.select("digest", "rep"), F.col("__d") == F.col("digest")).select("doc_id", "rep")
    least = materialise(reps.groupBy("doc_id").agg(F.min("rep").alias("a")), "near-least", tasks)
    return reps.join(least, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b")).distinct()


def near_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row per input row."""
    table = materialise(sketches(docs), "near-sketches")
    tasks = tasks_for(docs.sparkSession, table.count(), DOCS_A_TASK)
    classes = (
        table.where("n > 0 AND doc_id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    )
    classes = materialise(classes, "near-classes", tasks)
    links = near_links(docs, classes, tasks).unionByName(_same_ids(table, classes, tasks))
    nodes = materialise(_parts(links, "near-roots", tasks), "near-nodes", tasks)
    final = classes.select("digest", "rep").join(nodes, "rep", "left")
    final = final.select(F.col("digest").alias("__d"), F.coalesce("part", "rep").alias("root"))
    told = table.select("doc_id", "n", "digest").join(final, F.col("digest") == F.col("__d"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return told.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    ).coalesce(tasks)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates, with its columns.

    Rows that repeat an id and its text give one: that whose columns, written as
    JSON, come first. Another text under the same id is a document of its own.
    Rows without an id all stay.
    """
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    texts = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__tw_id"))
    texts = texts.agg(F.min(digest).alias("__tw_first"), F.max(digest).alias("__tw_last"), F.count(F.lit(1)).alias("__tw_times"))
    several = materialise(texts.where("__tw_times > 1"), "near-several")
    repeated = bool(several.take(1))
    named = boxed(docs, "doc_id", "text").withColumn("__tw_own", F.col("doc_id"))
    if repeated:
        # An id's other texts get ids from 2^62 on: a hash, so unlike others' but for about one in 2^62 pairs.
        other = F.xxhash64("doc_id", digest).bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
        own = F.when(F.col("__tw_first").isNull() | (digest == F.col("__tw_first")), F.col("doc_id")).otherwise(other)
        named = named.drop("__tw_own").join(several, F.col("doc_id") == F.col("__tw_id"), "left").select("__tw_doc", own.alias("__tw_own"))
        once = one_of_each(named.where("__tw_own IS NOT NULL"), ["__tw_own"]).unionByName(named.where("__tw_own IS NULL"), allowMissingColumns=False)
        named = materialise(once.select("__tw_doc", "__tw_own", "__tw_doc.doc_id", "__tw_doc.text"), "near-named")
    found = near_components(named.select(F.col("__tw_own").alias("doc_id"), "text")).where("doc_id IS NOT NULL AND n_shingles > 0")
    if repeated:
        ids = named.select("__tw_own", F.col("doc_id").alias("__tw_id"))
        found = found.join(ids, F.col("doc_id") == F.col("__tw_own")).select("doc_id", "component_id", "__tw_id")
    else:
        found = found.select("doc_id", "component_id", F.col("doc_id").alias("__tw_id"))
    found = materialise(found, "near-found")
    kept = found.groupBy("component_id").agg(F.min(F.struct("__tw_id", "doc_id"))["doc_id"].alias("__tw_kept"))
    gone = materialise(found.select("doc_id").join(kept, F.col("doc_id") == F.col("__tw_kept"), "left_anti").select(F.col("doc_id").alias("__tw_gone")), "near-gone")
    # Only rows that hit a bit of the dropped ids move.
    marked = marked_by_ids(named, "__tw_own", gone, "__tw_gone")
    left = marked.where("__tw_hit").join(gone, F.col("__tw_own") == F.col("__tw_gone"), "left_anti")
    return unboxed(marked.where("NOT __tw_hit").select("__tw_doc").unionByName(left.select("__tw_doc")))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(read(spark, sf_dir, "documents"))
