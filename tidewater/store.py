"""A small registry in one JSON file: new data first, then the registry, then the old data goes.

The folder may be on any file system that Spark's Hadoop layer opens.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Registry:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self) -> dict:
        at = self._path(f"{self.folder}/registry.json")
        if not self._fs.exists(at):
            return {}
        stream = self._fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write(self, entries: dict) -> None:
        self._fs.mkdirs(self._path(self.folder))
        fresh = self._path(f"{self.folder}/registry-{uuid.uuid4().hex}.json")
        stream = self._fs.create(fresh, True)
        try:
            stream.write(bytearray(json.dumps(entries, default=str).encode()))
        finally:
            stream.close()
        # One rename puts the new registry in the old one's place, so there is one at any time.
        gateway, jvm = self.spark.sparkContext._gateway, self.spark.sparkContext._jvm
        option = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = gateway.new_array(option, 1)
        options[0] = option.OVERWRITE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._fs.getConf())
        files.rename(fresh, self._path(f"{self.folder}/registry.json"), options)

    def new_path(self, name: str) -> str:
        return f"{self.folder}/{name}-{uuid.uuid4().hex}"

    def get(self, name: str) -> dict | None:
        return self._read().get(name.lower())

    def names(self) -> list[str]:
        return sorted(self._read())

    def put(self, name: str, entry: dict) -> None:
        """Register; data that only the former entry named is removed afterwards."""
        entries = self._read()
        old = entries.get(name.lower(), {}).get("paths", [])
        entries[name.lower()] = entry
        self._write(entries)
        for path in set(old) - set(entry.get("paths", [])):
            self._fs.delete(self._path(path), True)

    def drop(self, name: str) -> None:
        entries = self._read()
        gone = entries.pop(name.lower())
        self._write(entries)
        for path in gone.get("paths", []):
            self._fs.delete(self._path(path), True)

    def token(self, path: str) -> str:
        """Size and modification time of all files of a source, as a version token."""
        status = self._fs.getFileStatus(self._path(path))
        files = [f for f in self._fs.listStatus(status.getPath())] if status.isDirectory() else [status]
        return ";".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in files))
