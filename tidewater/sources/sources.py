"""Data sources: what they are called, how their tables are read."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tidewater.errors import EngineError, unknown


@dataclass
class Source:
    name: str
    options: dict = field(default_factory=dict)

    def tables(self, spark: SparkSession) -> list[str]:
        raise NotImplementedError

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        raise NotImplementedError

    def path(self, table: str) -> str | None:
        """The files behind a table, for sources that have files."""
        return None


class ParquetSource(Source):
    """A folder in which ``<table>.parquet`` is a file or a folder of files."""

    @property
    def folder(self) -> str:
        return self.options["path"].rstrip("/")

    def tables(self, spark: SparkSession) -> list[str]:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.folder)
        found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
        return sorted(n[: -len(".parquet")] for n in (f.getPath().getName() for f in found) if n.endswith(".parquet"))

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}.parquet"

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.parquet(self.path(table))


class DuckDbSource(Source):
    """A local DuckDB file, opened read-only; rows come over as Arrow batches.

    The file is on the driver, so this is for small dimension tables.
    """

    def _connect(self):
        import duckdb

        return duckdb.connect(self.options["path"], read_only=True)

    def tables(self, spark: SparkSession) -> list[str]:
        with self._connect() as c:
            return sorted(r[0] for r in c.execute("SELECT table_name FROM information_schema.tables WHERE table_schema = 'main'").fetchall())

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        with self._connect() as c:
            quoted = table.replace('"', '""')
            return spark.createDataFrame(c.execute(f'SELECT * FROM "{quoted}"').to_arrow_table())


class JdbcSource(Source):
    """PostgreSQL, MySQL or ClickHouse over JDBC, with everything Spark can push down.

    ``partition_column``, ``lower``, ``upper`` and ``partitions`` split a read
    over that many connections.
    """

    PREFIX = {"postgres": "jdbc:postgresql:", "mysql": "jdbc:mysql:", "clickhouse": "jdbc:clickhouse:"}

    def _reader(self, spark: SparkSession):
        reader = spark.read.format("jdbc").option("url", self.options["url"])
        for k in ("user", "password", "driver", "fetchsize"):
            if k in self.options:
                reader = reader.option(k, self.options[k])
        for k in ("pushDownPredicate", "pushDownAggregate", "pushDownLimit", "pushDownOffset"):
            reader = reader.option(k, "true")
        return reader

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        reader = self._reader(spark).option("dbtable", table)
        if "partition_column" in self.options:
            for theirs, ours in (("partitionColumn", "partition_column"), ("lowerBound", "lower"), ("upperBound", "upper"), ("numPartitions", "partitions")):
                reader = reader.option(theirs, self.options[ours])
        return reader.load()

    def query(self, spark: SparkSession, text: str) -> DataFrame:
        """A whole query that the server runs."""
        return self._reader(spark).option("query", text).load()

    def tables(self, spark: SparkSession) -> list[str]:
        rows = self.query(spark, "SELECT table_name FROM information_schema.tables").collect()
        return sorted(r[0] for r in rows)


KINDS = {"parquet": ParquetSource, "duckdb": DuckDbSource, "postgres": JdbcSource, "mysql": JdbcSource, "clickhouse": JdbcSource}
#: Column types that a source may not have.
REFUSED_TYPES = ("array", "struct", "map", "binary", "variant")


class Catalog:
    """Named sources; each table is a temporary view of its source, and one under its bare name while no other source has that name."""

    def __init__(self, spark: SparkSession):
        self.spark, self.sources = spark, {}
        #: Lower-case view name to (source, table).
        self.views: dict[str, tuple[str, str]] = {}
        #: Lower-case table names that several sources have, with those sources.
        self.shared: dict[str, list[str]] = {}

    @staticmethod
    def own_name(source: str, table: str) -> str:
        return f"__of_{source}__{table}".lower()

    def add(self, name: str, kind: str, options: dict, tables: list[str] | None = None) -> Source:
        if kind.lower() not in KINDS:
            raise unknown("source kind", kind, KINDS)
        if name.lower() in self.sources:
            raise EngineError(f"data source {name!r} exists")
        source = KINDS[kind.lower()](name, options)
        for t in tables if tables is not None else source.tables(self.spark):
            self.register(source, t)
        self.sources[name.lower()] = source
        return source

    def register(self, source: Source, table: str, strict: bool = False) -> None:
        df = source.read(self.spark, table)
        bad = [f.name for f in df.schema.fields if f.dataType.typeName() in REFUSED_TYPES]
        if bad and strict:
            raise EngineError(f"table {table}: unsupported type of column {bad[0]}")
        own = self.own_name(source.name, table)
        df.createOrReplaceTempView(own)
        self.views[own] = (source.name, table)
        self._publish(table)

    def owners(self, table: str) -> list[tuple[str, str]]:
        return [v for k, v in self.views.items() if k == self.own_name(*v) and v[1].lower() == table.lower()]

    def _publish(self, table: str) -> None:
        """Give the bare name to the only source that has the table, or to none."""
        name, owners = table.lower(), self.owners(table)
        self.shared.pop(name, None)
        if len(owners) == 1:
            self.spark.table(self.own_name(*owners[0])).createOrReplaceTempView(table)
            self.views[name] = owners[0]
            return
        if self.views.pop(name, None):
            self.spark.catalog.dropTempView(table)
        if owners:
            self.shared[name] = [source for source, _ in owners]

    def drop(self, name: str) -> None:
        if name.lower() not in self.sources:
            raise unknown("data source", name, self.sources)
        source = self.sources.pop(name.lower())
        gone = [(view, table) for view, (owner, table) in self.views.items() if owner == source.name and view == self.own_name(owner, table)]
        for view, table in gone:
            self.spark.catalog.dropTempView(view)
            del self.views[view]
        for _, table in gone:
            self._publish(table)

    def view_of(self, parts: list[str]) -> str | None:
        """The view of ``source.table`` or ``source.schema.table``; None for a name that is no source's. A bare name of several sources raises."""
        if len(parts) == 1 and parts[0].lower() in self.shared:
            raise EngineError(f"table {parts[0]!r} is in several sources: {', '.join(self.shared[parts[0].lower()])}; name one")
        if len(parts) not in (2, 3) or parts[0].lower() not in self.sources:
            return None
        own = self.own_name(parts[0], parts[-1])
        if own not in self.views:
            raise unknown("table", parts[-1], [t for s, t in self.views.values() if s.lower() == parts[0].lower()])
        return own

    def named(self, text: str) -> list[str]:
        """Views of the catalog's tables that a statement names, one per table."""
        found = {w.lower() for w in re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text)} & set(self.views)
        return sorted({self.views[v]: v for v in sorted(found)}.values())

    def resolve(self, path: str) -> DataFrame:
        """``table``, ``source.table`` or ``source.schema.table``."""
        parts = path.split(".")
        if len(parts) == 1:
            self.view_of(parts)
            if parts[0].lower() not in self.views:
                raise unknown("table", path, self.views)
            return self.spark.table(parts[0])
        if parts[0].lower() not in self.sources:
            raise unknown("data source", parts[0], self.sources)
        return self.sources[parts[0].lower()].read(self.spark, parts[-1])

    def token(self, registry, path: str) -> str | None:
        parts = path.split(".")
        view = (len(parts) > 1 and self.view_of(parts)) or parts[-1].lower()
        name, table = self.views.get(view, (None, None))
        files = self.sources[name.lower()].path(table) if name and name.lower() in self.sources else None
        return registry.token(files) if files else None
