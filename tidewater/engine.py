"""The engine: one entry point for SQL, analyses, views, catalog and settings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidewater.errors import EngineError, UnsupportedSql, unknown
from tidewater.events import spec as event_spec
from tidewater.events.datasets import Datasets
from tidewater.plans.rewrite import Rewriter, is_query
from tidewater.plans.tokens import split_on, text_of, tree, words
from tidewater.session import prepare
from tidewater.settings import KNOWN, Settings
from tidewater.sources.sources import Catalog
from tidewater.store import Registry
from tidewater.views import Views


class Engine:
    """``sql(text)`` answers one statement; whatever it cannot answer raises.

    ``home``: folder for datasets and views, on a file system that all executors reach.
    """

    def __init__(self, spark: SparkSession, home: str | None = None):
        self.spark = prepare(spark)
        self.home = home or f"{spark.conf.get('spark.sql.warehouse.dir')}/tidewater"
        self.catalog = Catalog(spark)
        self.settings = Settings(spark)
        self.rewriter = Rewriter(spark, self.catalog.view_of)
        self.views = Views(spark, Registry(spark, f"{self.home}/views"), self.catalog, self.rewriter)
        self.datasets = Datasets(
            spark, Registry(spark, f"{self.home}/events"), self.catalog, self.rewriter, lambda: self.settings.get("events.allow_unknown_names")
        )
        self.user = "admin"
        #: user to the sources and tables they may read; the admin may read all.
        self.grants: dict[str, set[str]] = {}

    # -- statements ----------------------------------------------------------

    def sql(self, text: str) -> DataFrame:
        items = tree(text)
        if not items:
            raise UnsupportedSql("empty statement")
        if is_query(items):
            return self.query(text)
        first = items[0].upper
        if first in ("FUNNEL", "RETENTION", "SEGMENT", "PATHS"):
            self._allowed(text)
            return self.datasets.run(event_spec.parse(text))
        if first in ("CREATE", "DROP", "REFRESH", "REBUILD", "GRANT", "REVOKE") and self.user != "admin":
            raise EngineError(f"user {self.user!r} may not {first.lower()}")
        if first in ("EXPLAIN", "DESCRIBE", "SHOW"):
            self._allowed(text)
        handler = {
            "EXPLAIN": self._explain, "SHOW": self._show, "DESCRIBE": self._describe, "SET": self._set, "RESET": self._reset,
            "CREATE": self._create, "DROP": self._drop, "REFRESH": self._refresh, "REBUILD": self._rebuild, "GRANT": self._grant, "REVOKE": self._grant,
        }.get(first)
        if handler is None:
            raise UnsupportedSql(f"unsupported SQL: query `{first.lower()}`")
        return handler(text, items)

    def query(self, text: str) -> DataFrame:
        rewritten = self.rewriter.rewrite(text)
        self._allowed(rewritten, resolved=True)
        return self.views.substitute(self.spark.sql(rewritten), bool(self.settings.get("views.substitution")))

    def _reads(self, text: str, resolved: bool = False) -> set[str]:
        """Catalog views that a statement reads, by name or through views and event datasets.

        A name that several sources have stands for the tables of all of them,
        unless the statement's names are ``resolved`` to views.
        """
        found, seen, waiting = set(), set(), [text]
        while waiting:
            names = {w.lower() for w in re.findall(r"[A-Za-z_][A-Za-z_0-9]*", waiting.pop())} - seen
            seen |= names
            found |= names & set(self.catalog.views)
            if not resolved:
                found |= {self.catalog.own_name(*owner) for n in names & set(self.catalog.shared) for owner in self.catalog.owners(n)}
            else:  # what follows is text of views and datasets
                resolved, seen = False, seen - set(self.catalog.shared)
            waiting += [self.views.entry(n)["sql"] for n in self.views.registry.names() if n in names]
            waiting += [self.datasets.spec(n).source for n in self.datasets.registry.names() if n in names]
        return found

    def _allowed(self, sql: str, resolved: bool = False) -> None:
        if self.user == "admin":
            return
        mine = self.grants.get(self.user, set())
        for view in sorted(self._reads(sql, resolved)):
            source, table = (x.lower() for x in self.catalog.views[view])
            bare = set() if table in self.catalog.shared else {table}
            if not mine & (bare | {source, f"{source}.{table}"}):
                raise EngineError(f"user {self.user!r} may not read {table}")

    def _rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def _said(self, text: str) -> DataFrame:
        return self._rows([(text,)], "status string")

    def _explain(self, text: str, items: list) -> DataFrame:
        rest, style = items[1:], "formatted"
        if rest and rest[0].kind == "group":
            style, rest = ("json" if "JSON" in [x.upper for x in rest[0].items] else "formatted"), rest[1:]
        if not is_query(rest):
            raise UnsupportedSql("EXPLAIN takes a query")
        df = self.spark.sql(self.rewriter.rewrite(text_of(rest)))
        if style == "json":
            return self._rows([(df._jdf.queryExecution().optimizedPlan().toJSON(),)], "plan string")
        return self._rows([(df._jdf.queryExecution().explainString(self.spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")),)], "plan string")

    def _show(self, text: str, items: list) -> DataFrame:
        rest = items[1:]
        if words(rest, "EVENT", "DATASETS"):
            names = self.datasets.registry.names()
            return self._rows([(n, int(self.datasets.entry(n)["n"]), self.datasets.entry(n)["lo"], self.datasets.entry(n)["hi"]) for n in names], "name string, events bigint, first string, last string")
        if words(rest, "EVENTS") and len(rest) == 3 and rest[1].upper in ("FROM", "IN"):
            return self.datasets.events(rest[2].text).groupBy("name").count().withColumnRenamed("count", "events").orderBy("name")
        if words(rest, "MATERIALIZED", "VIEWS"):
            return self._rows([(n, self.views.entry(n)["sql"]) for n in self.views.registry.names()], "name string, query string")
        if words(rest, "DATASOURCES"):
            return self._rows([(s.name, type(s).__name__.removesuffix("Source").lower()) for s in self.catalog.sources.values()], "name string, kind string")
        if words(rest, "TABLES"):
            return self._rows([(source, table) for source, table in sorted(set(self.catalog.views.values()))], "datasource string, table_name string")
        if words(rest, "GRANTS"):
            return self._rows(sorted((u, o) for u, objects in self.grants.items() for o in objects), "user string, object string")
        if words(rest, "ALL") and len(rest) == 1:
            return self._rows([(n, str(self.settings.get(n)), said) for n, (_, _, said, _) in KNOWN.items()], "name string, value string, description string")
        if rest:
            return self._rows([(str(self.settings.get(text_of(rest).replace(" ", ""))),)], "value string")
        raise UnsupportedSql("SHOW what?")

    def _describe(self, text: str, items: list) -> DataFrame:
        df = self.catalog.resolve(text_of(items[1:]).replace(" ", "").replace("`", ""))
        return self._rows([(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields], "column_name string, type string, nullable boolean")

    def _set(self, text: str, items: list) -> DataFrame:
        m = re.fullmatch(r"(?is)\s*SET\s+([\w.]+)\s*(?:=|\bTO\b)\s*'?([^';]+?)'?\s*;?\s*", text)
        if not m:
            raise UnsupportedSql("SET name = value")
        self.settings.set(m[1], m[2])
        return self._said("set")

    def _reset(self, text: str, items: list) -> DataFrame:
        self.settings.reset(None if words(items[1:], "ALL") else text_of(items[1:]).replace(" ", ""))
        return self._said("reset")

    def _create(self, text: str, items: list) -> DataFrame:
        rest = items[1:]
        if words(rest, "EVENT", "DATASET"):
            self.datasets.create(event_spec.parse(text))
            return self._said("created")
        if words(rest, "MATERIALIZED", "VIEW") and len(rest) > 2:
            name, rest = rest[2].text.strip('"`'), rest[3:]
            options = {}
            if words(rest, "WITH") and rest[1].kind == "group":
                for part in split_on(rest[1].items, ","):
                    if len(part) != 3 or part[0].text.lower() not in ("key", "watermark"):
                        raise UnsupportedSql(f"unknown option: {text_of(part)}")
                    options[part[0].text.lower()] = part[2].text.strip("'")
                rest = rest[2:]
            if not words(rest, "AS") or not is_query(rest[1:]):
                raise UnsupportedSql("CREATE MATERIALIZED VIEW name [WITH (key | watermark = 'column')] AS query")
            self.views.create(name, text_of(rest[1:]), options)
            return self._said("created")
        if words(rest, "DATASOURCE") and len(rest) >= 4 and words(rest[2:], "TYPE"):
            options = {}
            if words(rest[4:], "OPTIONS") and len(rest) == 6:
                for part in split_on(rest[5].items, ","):
                    options[part[0].text.lower()] = part[-1].text.strip("'")
            self.catalog.add(rest[1].text, rest[3].text, options)
            return self._said("created")
        if words(rest, "USER") and len(rest) == 2:
            self.grants.setdefault(rest[1].text, set())
            return self._said("created")
        raise UnsupportedSql(f"unsupported SQL: query `create {rest[0].text.lower() if rest else ''}`")

    def _drop(self, text: str, items: list) -> DataFrame:
        rest = items[1:]
        if words(rest, "EVENT", "DATASET") and len(rest) == 3:
            self.datasets.drop(rest[2].text)
        elif words(rest, "MATERIALIZED", "VIEW") and len(rest) == 3:
            self.views.drop(rest[2].text)
        elif words(rest, "DATASOURCE") and len(rest) == 2:
            self.catalog.drop(rest[1].text)
        elif words(rest, "USER") and len(rest) == 2:
            if rest[1].text not in self.grants:
                raise unknown("user", rest[1].text, self.grants)
            del self.grants[rest[1].text]
        else:
            raise UnsupportedSql(f"unsupported SQL: query `drop {rest[0].text.lower() if rest else ''}`")
        return self._said("dropped")

    def _refresh(self, text: str, items: list) -> DataFrame:
        rest = items[1:]
        if words(rest, "EVENT", "DATASET") and len(rest) == 3:
            return self._said(self.datasets.refresh(rest[2].text))
        if words(rest, "MATERIALIZED", "VIEW") and len(rest) == 3:
            return self._said(self.views.refresh(rest[2].text))
        raise UnsupportedSql("REFRESH EVENT DATASET name, or REFRESH MATERIALIZED VIEW name")

    def _rebuild(self, text: str, items: list) -> DataFrame:
        if not (words(items[1:], "EVENT", "DATASET") and len(items) == 4):
            raise UnsupportedSql("REBUILD EVENT DATASET name")
        self.datasets.rebuild(items[3].text)
        return self._said("rebuilt")

    def _grant(self, text: str, items: list) -> DataFrame:
        m = re.fullmatch(r"(?is)\s*(GRANT|REVOKE)\s+SELECT\s+ON\s+([\w.]+)\s+(?:TO|FROM)\s+(\w+)\s*;?\s*", text)
        if not m:
            raise UnsupportedSql("GRANT SELECT ON object TO user, or REVOKE SELECT ON object FROM user")
        if m[3] not in self.grants:
            raise unknown("user", m[3], self.grants)
        parts = m[2].lower().split(".")
        (self.grants[m[3]].add if m[1].upper() == "GRANT" else self.grants[m[3]].discard)(".".join([parts[0], parts[-1]]) if len(parts) > 1 else parts[0])
        return self._said(f"{m[1].lower()}ed" if m[1].upper() == "GRANT" else "revoked")
