"""FUNNEL, RETENTION, SEGMENT and PATHS over an event dataset.

A dataset has the columns ``actor, ts, tb, name`` and one per property. Events
of an actor are ordered by (ts, tb). Each analysis shuffles once by actor, does
its per-actor work with windows over that partitioning, and aggregates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewater.errors import UnsupportedSql, unknown
from tidewater.events import spec as S

ROLES = ("actor", "ts", "tb", "name")


def properties_of(events: DataFrame) -> list[str]:
    return [c for c in events.columns if c not in ROLES]


def _property(events: DataFrame, name: str) -> T.DataType:
    for f in events.schema.fields:
        if f.name not in ROLES and f.name.lower() == name.lower():
            return f.dataType
    raise unknown("property", name, properties_of(events))


def condition(events: DataFrame, p) -> Column:
    """A property condition, two-valued: a null property fails every comparison, and NOT flips that."""
    if isinstance(p, S.Both):
        return reduce((lambda a, b: a | b) if p.op == "OR" else (lambda a, b: a & b), [condition(events, x) for x in p.parts])
    if isinstance(p, S.Not):
        return ~condition(events, p.inner)
    kind = _property(events, p.column)
    column = F.col(p.column)
    if isinstance(p, S.IsNull):
        return column.isNotNull() if p.negated else column.isNull()
    for v in p.values if isinstance(p, S.Member) else (p.value,):
        fits = isinstance(v, str) if isinstance(kind, T.StringType) else isinstance(v, bool) if isinstance(kind, T.BooleanType) else isinstance(v, (int, float)) and not isinstance(v, bool)
        if not fits:
            raise UnsupportedSql(f"literal {v!r} does not fit property {p.column} of type {kind.simpleString()}")
    if isinstance(p, S.Member):
        test = column.isin(list(p.values))
    else:
        value = F.lit(p.value)
        test = {"=": column == value, "<>": column != value, "!=": column != value, "<": column < value, "<=": column <= value, ">": column > value, ">=": column >= value}[p.op]
    return F.coalesce(test, F.lit(False))


def _in_range(c: S.Common) -> Column:
    keep = F.lit(True)
    if c.since is not None:
        keep = keep & (F.col("ts") >= F.lit(c.since).cast("timestamp_ntz"))
    if c.until is not None:
        keep = keep & (F.col("ts") < F.lit(c.until).cast("timestamp_ntz"))
    return keep


def _visible(events: DataFrame, c: S.Common) -> Column:
    return _in_range(c) & (condition(events, c.where) if c.where is not None else F.lit(True))


def _known(names: set[str] | None, *asked: str | None) -> None:
    if names is not None:
        for n in asked:
            if n is not None and n not in names:
                raise unknown("event name", n, names)


def _broken_down(events: DataFrame, c: S.Common) -> Column | None:
    if c.breakdown is None:
        return None
    _property(events, c.breakdown)
    return F.col(c.breakdown).cast("string")


def funnel(events: DataFrame, f: S.Funnel, names: set[str] | None = None) -> DataFrame:
    """Step by step conversion.

    Going backwards in time, every row learns the first later row of each step,
    together with what that row knows of the following steps. An anchor's greedy
    chain is then a column of its own row, and one pass per step suffices.
    """
    _known(names, *f.steps)
    c, k = f.common, len(f.steps)
    by = _broken_down(events, c)
    rows = events.where(_visible(events, c) & F.col("name").isin(list(set(f.steps)))).select(
        "actor", "ts", "tb", "name", (by if by is not None else F.lit(None).cast("string")).alias("breakdown")
    )
    backwards = Window.partitionBy("actor").orderBy(F.desc("ts"), F.desc("tb")).rowsBetween(Window.unboundedPreceding, -1)
    chain = None
    for j in range(k - 1, 0, -1):
        here = F.struct("ts") if chain is None else F.struct("ts", chain)
        rows = rows.withColumn(f"next{j}", F.last(F.when(F.col("name") == f.steps[j], here), ignorenulls=True).over(backwards))
        chain = f"next{j}"
    limit = F.col("ts") + F.expr(f"INTERVAL '{f.window_seconds}' SECOND")
    times, path = [F.col("ts")], None
    for j in range(1, k):
        path = F.col(f"next{j}") if path is None else path[f"next{j}"]
        times.append(path["ts"])
    reached = [F.lit(True)]
    for j in range(1, k):
        reached.append(reached[-1] & F.coalesce(times[j] <= limit, F.lit(False)))
    depth = reduce(lambda a, b: a + b, [r.cast("int") for r in reached])
    anchors = rows.where(F.col("name") == f.steps[0]).select("actor", "ts", "tb", "breakdown", depth.alias("depth"), *[t.alias(f"t{j}") for j, t in enumerate(times)])
    best = F.min(F.struct((-F.col("depth")).alias("d"), "ts", "tb", "breakdown", *[f"t{j}" for j in range(k)]))
    witness = anchors.groupBy("actor").agg(best.alias("w")).select("w.*")
    gap = lambda j: (F.unix_micros(F.col(f"t{j}").cast("timestamp")) - F.unix_micros(F.col(f"t{j - 1}").cast("timestamp"))) / F.lit(1e6)
    sums = []
    for j in range(k):
        inside = -F.col("d") >= j + 1
        sums.append(F.count(F.when(inside, 1)).alias(f"n{j}"))
        if j:
            sums += [F.percentile(F.when(inside, gap(j)), F.lit(q)).alias(f"q{j}_{i}") for i, q in enumerate((0.5, 0.9))]
    grouped = witness.groupBy("breakdown").agg(*sums) if c.breakdown else witness.agg(*sums)
    ratio = lambda a, b: F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.col(a) / F.nullif(F.col(b), F.lit(0)))
    steps = F.array(
        *[
            F.struct(
                F.lit(j + 1).alias("step_index"),
                F.lit(f.steps[j]).alias("step_name"),
                F.col(f"n{j}").alias("entered"),
                ratio(f"n{j}", f"n{max(j - 1, 0)}").alias("conversion_from_previous"),
                ratio(f"n{j}", "n0").alias("conversion_from_start"),
                (F.col(f"q{j}_0") if j else F.lit(None).cast("double")).alias("median_seconds_from_previous"),
                (F.col(f"q{j}_1") if j else F.lit(None).cast("double")).alias("p90_seconds_from_previous"),
            )
            for j in range(k)
        ]
    )
    flat = grouped.select(*(["breakdown"] if c.breakdown else []), F.explode(steps).alias("s")).select(*(["breakdown"] if c.breakdown else []), "s.*")
    return flat.orderBy(*([F.asc_nulls_last("breakdown")] if c.breakdown else []), "step_index")


def _index(period: str, ts: Column) -> Column:
    """A whole number per calendar period."""
    if period == "MONTH":
        return (F.year(ts) * 12 + F.month(ts) - 1).cast("bigint")
    days = F.unix_date(ts.cast("date")).cast("bigint")
    return days if period == "DAY" else F.floor((days + 3) / 7)


def _start(period: str, index: Column) -> Column:
    if period == "MONTH":
        return F.make_date(F.floor(index / 12).cast("int"), F.pmod(index, F.lit(12)).cast("int") + 1, F.lit(1)).cast("timestamp_ntz")
    days = index if period == "DAY" else index * 7 - 3
    return F.date_from_unix_date(days.cast("int")).cast("timestamp_ntz")


def retention(events: DataFrame, r: S.Retention, names: set[str] | None = None, bounds: tuple | None = None) -> DataFrame:
    """Cohorts by first matching event and who of them came back, on a dense grid.

    ``bounds``: the dataset's first and last timestamp, where the range leaves them open.
    """
    _known(names, r.birth, r.back)
    c = r.common
    by = _broken_down(events, c)
    rows = events.where(_visible(events, c)).select("actor", "ts", "tb", "name", (by if by is not None else F.lit(None).cast("string")).alias("breakdown"))
    is_birth = F.lit(True) if r.birth is None else F.col("name") == r.birth
    is_back = F.lit(True) if r.back is None else F.col("name") == r.back
    rows = rows.where(is_birth | is_back)
    own = Window.partitionBy("actor")
    born = rows.withColumn("birth", F.min(F.when(is_birth, F.struct("ts", "tb", "breakdown"))).over(own)).where("birth IS NOT NULL")
    cohort = _index(r.period, F.col("birth.ts"))
    later = is_back & ((F.col("ts") > F.col("birth.ts")) | ((F.col("ts") == F.col("birth.ts")) & (F.col("tb") > F.col("birth.tb"))))
    offset = F.when(later, _index(r.period, F.col("ts")) - cohort)
    actors = born.select("actor", cohort.alias("cohort"), F.col("birth.breakdown").alias("breakdown"), offset.alias("off"))
    sizes = actors.groupBy("breakdown", "cohort").agg(F.countDistinct("actor").alias("cohort_size"))
    first, last = (F.lit(x).cast("timestamp_ntz") for x in (bounds or (None, None)))
    if c.since is not None:
        first = F.lit(c.since).cast("timestamp_ntz")
    if c.until is not None:
        last = F.lit(c.until).cast("timestamp_ntz") - F.expr("INTERVAL '0.000001' SECOND")
    spark = events.sparkSession
    span = spark.range(1).select(_index(r.period, first).alias("lo"), _index(r.period, last).alias("hi")).where("lo <= hi")
    top = F.lit(r.periods).cast("bigint") if r.periods is not None else F.col("hi") - F.col("cohort")
    grid = span.select("hi", F.explode(F.sequence("lo", "hi")).alias("cohort")).withColumn("top", F.greatest(top, F.lit(0)))
    cells = grid.select("cohort", "top", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("top"))).alias("off"))
    if r.at is not None:
        cells = cells.where(F.col("off") == r.at)
    groups = sizes.select("breakdown").distinct()
    if not c.breakdown:
        groups = spark.range(1).select(F.lit(None).cast("string").alias("breakdown"))
    # A handful of cohorts by a handful of breakdown values.
    cells = cells.crossJoin(F.broadcast(groups))
    if r.mode == "BOUNDED":
        hits = actors.where("off IS NOT NULL").groupBy("breakdown", "cohort", "off").agg(F.countDistinct("actor").alias("retained"))
    else:
        longest = actors.where("off IS NOT NULL").groupBy("breakdown", "cohort", "actor").agg(F.max("off").alias("longest"))
        counted = longest.groupBy("breakdown", "cohort", "longest").agg(F.count(F.lit(1)).alias("n"))
        counted = counted.select(F.col("breakdown").alias("b2"), F.col("cohort").alias("c2"), "longest", "n")
        every = cells.select("breakdown", "cohort", "off", "top")
        # Offsets past the last reported one count for all reported ones.
        same = F.col("breakdown").eqNullSafe(F.col("b2")) & (F.col("cohort") == F.col("c2")) & (F.least("longest", "top") >= F.col("off"))
        hits = every.join(counted, same).groupBy("breakdown", "cohort", "off").agg(F.sum("n").alias("retained"))
    sizes = sizes.select(F.col("breakdown").alias("b3"), F.col("cohort").alias("c3"), "cohort_size")
    hits = hits.select(F.col("breakdown").alias("b4"), F.col("cohort").alias("c4"), F.col("off").alias("o4"), "retained")
    full = cells.join(sizes, F.col("breakdown").eqNullSafe(F.col("b3")) & (F.col("cohort") == F.col("c3")), "left")
    full = full.join(hits, F.col("breakdown").eqNullSafe(F.col("b4")) & (F.col("cohort") == F.col("c4")) & (F.col("off") == F.col("o4")), "left")
    size, kept = F.coalesce("cohort_size", F.lit(0)).cast("bigint"), F.coalesce("retained", F.lit(0)).cast("bigint")
    out = full.select(
        *(["breakdown"] if c.breakdown else []),
        _start(r.period, F.col("cohort")).alias("cohort_start"),
        size.alias("cohort_size"),
        F.col("off").cast("int").alias("period_offset"),
        kept.alias("retained"),
        F.when(size > 0, kept / F.nullif(size, F.lit(0))).alias("retention_rate"),
    )
    return out.orderBy(*([F.asc_nulls_last("breakdown")] if c.breakdown else []), "cohort_start", "period_offset")


def segment(events: DataFrame, s: S.Segment, names: set[str] | None = None) -> DataFrame:
    """A measure per calendar bucket; buckets without an event aren't listed."""
    _known(names, s.event)
    c = s.common
    by = _broken_down(events, c)
    rows = events.where(_visible(events, c) & (F.col("name") == s.event if s.event is not None else F.lit(True)))
    bucket = F.date_trunc(s.bucket.lower(), F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    keys = [bucket.alias("bucket")] + ([by.alias("breakdown")] if by is not None else [])
    value = {
        "COUNT": F.count(F.lit(1)),
        "UNIQUES": F.countDistinct("actor"),
        "COUNT_PER_UNIQUE": F.count(F.lit(1)) / F.countDistinct("actor"),
    }[s.measure]
    out = rows.groupBy(*keys).agg(value.alias("value"))
    return out.orderBy(*([F.asc_nulls_last("breakdown")] if by is not None else []), "bucket")


def paths(events: DataFrame, p: S.Paths, names: set[str] | None = None) -> DataFrame:
    """The most frequent event sequences; range and WHERE test the anchor only."""
    _known(names, p.start, p.end)
    c = p.common
    rows = events.select("actor", "ts", "tb", "name", _visible(events, c).alias("seen"))
    order = Window.partitionBy("actor").orderBy("ts", "tb")
    before = F.lag("ts").over(order)
    torn = before.isNull() if p.gap_seconds is None else before.isNull() | (F.col("ts") > before + F.expr(f"INTERVAL '{p.gap_seconds}' SECOND"))
    rows = rows.withColumn("torn", F.coalesce(torn, F.lit(False))).withColumn("repeat", F.coalesce(F.lag("name").over(order) == F.col("name"), F.lit(False)))
    rows = rows.withColumn("fragment", F.sum(F.col("torn").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where("torn OR NOT repeat")
    inside = Window.partitionBy("actor", "fragment").orderBy("ts", "tb")
    look = F.lag if p.end is not None else F.lead
    around = [F.col("name")] + [look("name", i).over(inside) for i in range(1, p.depth)]
    seq = F.array_compact(F.array(*(reversed(around) if p.end is not None else around)))
    found = rows.withColumn("path", seq).where("seen")
    anchor = p.start or p.end
    found = found.where((F.col("name") == anchor) & (F.size("path") >= 2)) if anchor is not None else found.where(F.size("path") == p.depth)
    counted = found.groupBy("path").agg(F.count(F.lit(1)).alias("occurrences"))
    # All counts meet in two numbers: the total, and the top few by a bounded heap.
    total = counted.agg(F.sum("occurrences").alias("total"))
    best = counted.orderBy(F.desc("occurrences"), F.asc("path")).limit(p.top)
    ranked = best.withColumn("path_id", F.row_number().over(Window.orderBy(F.desc("occurrences"), F.asc("path"))))
    ranked = ranked.crossJoin(F.broadcast(total)).withColumn("share", F.col("occurrences") / F.col("total"))
    return ranked.select("path_id", F.posexplode("path").alias("pos", "event"), "occurrences", "share").select(
        "path_id", (F.col("pos") + 1).alias("seq"), "event", "occurrences", "share"
    ).orderBy("path_id", "seq")
