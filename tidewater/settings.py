"""Session settings of the engine."""

from __future__ import annotations

from tidewater.errors import EngineError, unknown

#: name: (default, type, what it does, Spark setting if it is one)
KNOWN = {
    "events.allow_unknown_names": (False, bool, "event names that never occur count as empty", None),
    "views.substitution": (True, bool, "answer from a fresh materialized view of the same plan", None),
    "join.broadcast_bytes": (10485760, int, "largest side that is sent to all executors", "spark.sql.autoBroadcastJoinThreshold"),
    "shuffle.partitions": (200, int, "partitions of a shuffle before they are coalesced", "spark.sql.shuffle.partitions"),
    "adaptive.enabled": (True, bool, "plan again at run time", "spark.sql.adaptive.enabled"),
    "adaptive.skew_join": (True, bool, "split skewed partitions of joins", "spark.sql.adaptive.skewJoin.enabled"),
    "scan.partition_bytes": (134217728, int, "bytes of a file split", "spark.sql.files.maxPartitionBytes"),
    "cbo.enabled": (True, bool, "use column statistics", "spark.sql.cbo.enabled"),
    "cbo.join_reorder": (True, bool, "reorder joins by statistics", "spark.sql.cbo.joinReorder.enabled"),
}


class Settings:
    def __init__(self, spark):
        self.spark, self.values = spark, {}

    def _entry(self, name: str):
        if name.lower() not in KNOWN:
            raise unknown("setting", name, KNOWN)
        return KNOWN[name.lower()]

    def get(self, name: str):
        default, kind, _, theirs = self._entry(name)
        if theirs:
            raw = self.spark.conf.get(theirs, str(default)).rstrip("b").strip()
            return raw.lower() == "true" if kind is bool else raw
        return self.values.get(name.lower(), default)

    def set(self, name: str, text: str) -> None:
        _, kind, _, theirs = self._entry(name)
        try:
            value = {"true": True, "on": True, "false": False, "off": False}[text.lower()] if kind is bool else kind(text)
        except (KeyError, ValueError):
            raise EngineError(f"{text!r} is no value of setting {name}") from None
        if theirs:
            self.spark.conf.set(theirs, str(value).lower())
        self.values[name.lower()] = value

    def reset(self, name: str | None = None) -> None:
        for n in [name.lower()] if name else list(self.values):
            theirs = self._entry(n)[3]
            self.values.pop(n, None)
            if theirs:
                self.spark.conf.unset(theirs)
