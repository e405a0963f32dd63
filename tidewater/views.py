"""Materialized views: stored results with skip, append, key-merge and whole refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.errors import EngineError, UnsupportedSql, unknown
from tidewater.plans.tokens import tree, words


class Views:
    """``key`` (merge) and ``watermark`` (append) are options of a view over one table."""

    def __init__(self, spark, registry, catalog, rewriter):
        self.spark, self.registry, self.catalog, self.rewriter = spark, registry, catalog, rewriter

    def entry(self, name: str) -> dict:
        found = self.registry.get(name)
        if not found:
            raise unknown("materialized view", name, self.registry.names())
        return found

    def sources(self, sql: str) -> list[str]:
        """Catalog tables that the statement names."""
        return self.catalog.named(self.rewriter.rewrite(sql))

    def _tokens(self, sql: str) -> dict:
        return {t: self.catalog.token(self.registry, t) for t in self.sources(sql)}

    def _result(self, sql: str) -> DataFrame:
        return self.spark.sql(self.rewriter.rewrite(sql))

    def _store(self, df: DataFrame, name: str) -> str:
        path = self.registry.new_path(name)
        df.write.parquet(path)
        return path

    def create(self, name: str, sql: str, options: dict) -> None:
        if self.registry.get(name):
            raise EngineError(f"materialized view {name!r} exists")
        if options and not self.plain(sql, [v for v in options.values()]):
            raise UnsupportedSql("a key or watermark needs a plain projection and filter of one table that exposes it")
        df = self._result(sql)
        self.registry.put(name, {"sql": sql, "options": options, "tokens": self._tokens(sql), "paths": [self._store(df, name)]})
        self.publish(name)

    def plain(self, sql: str, exposed: list[str]) -> bool:
        """Only a scan with projections and filters without calls, whose result has the columns."""
        items = tree(sql)
        refused = {"JOIN", "GROUP", "DISTINCT", "UNION", "INTERSECT", "EXCEPT", "HAVING", "LIMIT", "WITH", "OVER", "OFFSET"}
        flat = [x.upper for x in items if x.kind == "word"]
        calls = any(x.kind == "group" and i and items[i - 1].kind == "word" and items[i - 1].upper not in ("IN", "AND", "OR", "NOT", "WHERE") for i, x in enumerate(items))
        columns = {c.lower() for c in self._result(sql).columns}
        return words(items, "SELECT") and not refused & set(flat) and not calls and len(self.sources(sql)) == 1 and all(e.lower() in columns for e in exposed)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*self.entry(name)["paths"])

    def publish(self, name: str) -> None:
        self.read(name).createOrReplaceTempView(name)

    def refresh(self, name: str) -> str:
        e = self.entry(name)
        now = self._tokens(e["sql"])
        if now == e["tokens"] and all(now.values()):
            return "skipped"
        fresh, old = self._result(e["sql"]), self.read(name)
        options, how, paths = e["options"], "whole", None
        if "watermark" in options:
            mark = options["watermark"]
            high = old.agg(F.max(mark)).first()[0]
            more = fresh if high is None else fresh.where(F.col(mark) > F.lit(high))
            paths, how = [*e["paths"], self._store(more, name)], "appended"
        elif "key" in options:
            key = options["key"]
            # Rows of unchanged keys stay as stored; changed and new keys come from the source, others go.
            same = [old[c].eqNullSafe(fresh[c]) for c in fresh.columns]
            kept = old.join(fresh, same, "left_semi")
            changed = fresh.join(old.select(*[F.col(c).alias(f"__old_{c}") for c in fresh.columns]), [fresh[c].eqNullSafe(F.col(f"__old_{c}")) for c in fresh.columns], "left_anti")
            merged = kept.unionByName(changed)
            if merged.groupBy(key).count().where("count > 1").take(1):
                raise EngineError(f"key {key} of view {name} is not unique")
            paths, how = [self._store(merged, name)], "merged"
        if paths is None:
            paths = [self._store(fresh, name)]
        self.registry.put(name, {**e, "tokens": now, "paths": paths})
        self.publish(name)
        return how

    def drop(self, name: str) -> None:
        self.entry(name)
        self.registry.drop(name)
        self.spark.catalog.dropTempView(name)

    def substitute(self, df: DataFrame, enabled: bool) -> DataFrame:
        """A fresh view's rows instead of an equal plan."""
        if not enabled:
            return df
        for name in self.registry.names():
            e = self.entry(name)
            if "sql" in e and self._tokens(e["sql"]) == e["tokens"] and all(e["tokens"].values()):
                if self._result(e["sql"]).sameSemantics(df):
                    return self.read(name).toDF(*df.columns)
        return df
