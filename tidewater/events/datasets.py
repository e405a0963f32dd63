"""Event datasets: built once from a source, then analysed without it.

A dataset is a Parquet folder partitioned over files by a hash of the actor and
sorted by (actor, ts, tb), so that per-actor work reads ordered runs and row
group statistics prune by actor and time. Append-only refreshes add files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.errors import EngineError, UnsupportedSql, unknown
from tidewater.events import analysis
from tidewater.events import spec as S

ACTORS = (T.IntegerType, T.LongType, T.StringType, T.BinaryType)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def shaped(source: DataFrame, d: S.CreateDataset) -> DataFrame:
    """The source's rows in the dataset's columns; wrong types and null roles raise."""
    kinds = {f.name.lower(): f for f in source.schema.fields}

    def field(name: str):
        if name.lower() not in kinds:
            raise unknown("column", name, [f.name for f in source.schema.fields])
        return kinds[name.lower()]

    if not isinstance(field(d.actor).dataType, ACTORS):
        raise UnsupportedSql(f"actor {d.actor} must be an integer, a text or binary")
    if not isinstance(field(d.event).dataType, T.StringType):
        raise UnsupportedSql(f"event name {d.event} must be a text")
    kind = field(d.time).dataType
    if isinstance(kind, T.LongType):
        unit = {"s": 1_000_000, "ms": 1000, "us": 1}.get(d.options.get("time_unit", ""))
        if unit is None:
            raise UnsupportedSql("an integer time column needs WITH (time_unit = 's', 'ms' or 'us')")
        ts = F.timestamp_micros(F.col(d.time) * unit).cast("timestamp_ntz")
    elif isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        ts = F.col(d.time).cast("timestamp_ntz")
    else:
        raise UnsupportedSql(f"time {d.time} must be a timestamp or an integer")
    if d.tiebreak and not isinstance(field(d.tiebreak).dataType, WHOLE):
        raise UnsupportedSql(f"tiebreak {d.tiebreak} must be an integer")
    roles = {x.lower() for x in (d.actor, d.time, d.event, d.tiebreak) if x}
    wanted = d.properties if d.properties is not None else [f.name for f in source.schema.fields if f.name.lower() not in roles]
    props = []
    for name in wanted:
        p = field(name).dataType
        if isinstance(p, WHOLE):
            props.append(F.col(name).cast("bigint").alias(name))
        elif isinstance(p, (T.FloatType, T.DoubleType)):
            props.append(F.col(name).cast("double").alias(name))
        elif isinstance(p, (T.StringType, T.BooleanType)):
            props.append(F.col(name))
        elif d.properties is not None:
            raise UnsupportedSql(f"property {name} of type {p.simpleString()} is not supported")
    need = lambda c, name: F.when(c.isNull(), F.raise_error(F.lit(f"null in {name}"))).otherwise(c)
    tb = F.col(d.tiebreak).cast("bigint") if d.tiebreak else F.monotonically_increasing_id()
    key = d.options.get("refresh_key")
    extra = []
    if key:
        if field(key).name not in [d.actor, d.time, d.event, d.tiebreak, *wanted]:
            raise UnsupportedSql(f"refresh key {key} must be an ingested column")
        extra = [F.col(key).alias("__key")]
    return source.select(need(F.col(d.actor), d.actor).alias("actor"), need(ts, d.time).alias("ts"), tb.alias("tb"), need(F.col(d.event), d.event).alias("name"), *props, *extra)


class Datasets:
    def __init__(self, spark, registry, catalog, rewriter, allow_unknown):
        self.spark, self.registry, self.catalog, self.rewriter, self.allow_unknown = spark, registry, catalog, rewriter, allow_unknown

    def _source(self, d: S.CreateDataset) -> DataFrame:
        return self.spark.sql(self.rewriter.rewrite(d.source)) if d.is_query else self.catalog.resolve(d.source)

    def _write(self, rows: DataFrame, name: str, shards: int | None) -> tuple[str, dict]:
        path = self.registry.new_path(name)
        dealt = rows.repartition(shards, "actor") if shards else rows.repartition("actor")
        dealt.sortWithinPartitions("actor", "ts", "tb").write.parquet(path)
        stored = self.spark.read.parquet(path)
        high = F.max("__key").cast("string") if "__key" in stored.columns else F.lit(None)
        row = stored.agg(F.min("ts").cast("string").alias("lo"), F.max("ts").cast("string").alias("hi"), F.count(F.lit(1)).alias("n"), F.collect_set("name").alias("names"), high.alias("high")).first()
        return path, row.asDict()

    def create(self, d: S.CreateDataset, replace: bool = False) -> None:
        if not replace and self.registry.get(d.name):
            raise EngineError(f"event dataset {d.name!r} exists")
        path, facts = self._write(shaped(self._source(d), d), d.name, int(d.options["shards"]) if "shards" in d.options else None)
        token = None if d.is_query else self.catalog.token(self.registry, d.source)
        self.registry.put(d.name, {"paths": [path], "spec": vars(d), "token": token, **facts})

    def entry(self, name: str) -> dict:
        found = self.registry.get(name)
        if not found:
            raise unknown("event dataset", name, self.registry.names())
        return found

    def spec(self, name: str) -> S.CreateDataset:
        s = dict(self.entry(name)["spec"])
        s["properties"] = tuple(s["properties"]) if s["properties"] is not None else None
        return S.CreateDataset(**s)

    def refresh(self, name: str) -> str:
        """Append rows past the refresh key's high mark; an unchanged source is skipped."""
        entry, d = self.entry(name), self.spec(name)
        if d.is_query:
            raise UnsupportedSql("REFRESH needs a dataset over a table; use REBUILD")
        if "refresh_key" not in d.options:
            raise UnsupportedSql("REFRESH needs a refresh_key; use REBUILD")
        token = self.catalog.token(self.registry, d.source)
        if token is not None and token == entry["token"]:
            return "skipped"
        rows = shaped(self._source(d), d)
        if entry["high"] is not None:
            rows = rows.where(F.col("__key") > F.lit(entry["high"]).cast(rows.schema["__key"].dataType))
        path, facts = self._write(rows, d.name, None)
        merged = {
            "lo": min(filter(None, [entry["lo"], facts["lo"]]), default=None),
            "hi": max(filter(None, [entry["hi"], facts["hi"]]), default=None),
            "n": entry["n"] + facts["n"],
            "names": sorted({*entry["names"], *facts["names"]}),
            "high": facts["high"] if facts["high"] is not None else entry["high"],
        }
        self.registry.put(name, {**entry, **merged, "paths": [*entry["paths"], path], "token": token})
        return "appended"

    def rebuild(self, name: str) -> None:
        self.create(self.spec(name), replace=True)

    def drop(self, name: str) -> None:
        self.entry(name)
        self.registry.drop(name)

    def events(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(*self.entry(name)["paths"])
        return df.drop("__key")

    def run(self, s) -> DataFrame:
        entry = self.entry(s.common.dataset)
        events = self.events(s.common.dataset)
        names = None if self.allow_unknown() else set(entry["names"])
        if isinstance(s, S.Funnel):
            return analysis.funnel(events, s, names)
        if isinstance(s, S.Retention):
            return analysis.retention(events, s, names, (entry["lo"], entry["hi"]))
        if isinstance(s, S.Segment):
            return analysis.segment(events, s, names)
        return analysis.paths(events, s, names)
