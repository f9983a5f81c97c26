"""Versioned tables: every write makes new snapshots, checks them, and then swaps one small manifest.

A table is a folder of versions; CURRENT.json names the version of each. Readers see only what it names, writers never touch
it until all checks pass, a failed write leaves nothing behind. The folder can be on any file system Spark can write to.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvina.constraints import Rules, violations


class ConstraintError(ValueError):
    """A write that would break a rule; nothing was changed."""


class Store:
    def __init__(self, spark: SparkSession, root: str, rules: dict[str, Rules] | None = None):
        self.spark, self.root, self.rules = spark, root.rstrip("/"), rules or {}
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def manifest(self) -> dict[str, int]:
        p = self._path(f"{self.root}/CURRENT.json")
        if not self._fs.exists(p):
            return {}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/CURRENT.json").collect()))

    def tables(self) -> list[str]:
        return sorted(self.manifest())

    def has(self, name: str) -> bool:
        return name in self.manifest()

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """The current version; a table that is not there is empty, if its schema is given."""
        version = self.manifest().get(name)
        if version is None:
            if schema is None:
                raise KeyError(name)
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.root}/{name}/v={version}")

    def write(self, new: dict[str, DataFrame], guard: Callable[[dict[str, DataFrame]], None] | None = None) -> dict[str, int]:
        """All of new or nothing. guard gets the new versions of all tables and raises to stop the write."""
        before = self.manifest()
        after = before | {name: before.get(name, 0) + 1 for name in new}
        made: list[str] = []
        try:
            for name, df in new.items():
                path = f"{self.root}/{name}/v={after[name]}"
                made.append(path)
                df.write.mode("overwrite").parquet(path)
            seen = {n: self.spark.read.parquet(f"{self.root}/{n}/v={v}") for n, v in after.items()}
            broken = [r for n in after if n in self.rules for r in violations(n, seen[n], self.rules[n], seen).collect()]
            if broken:
                raise ConstraintError("; ".join(f"{r.table_name}: {r.rule} ({r.n})" for r in broken))
            if guard:
                guard(seen)
        except BaseException:
            for path in made:
                self._fs.delete(self._path(path), True)
            raise
        self._swap(after)
        return after

    def _swap(self, manifest: dict[str, int]) -> None:
        new, current = self._path(f"{self.root}/CURRENT.new"), self._path(f"{self.root}/CURRENT.json")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(new, current, options)

    def vacuum(self) -> None:
        """Versions the manifest no longer names go."""
        keep = self.manifest()
        for name, version in keep.items():
            for status in self._fs.listStatus(self._path(f"{self.root}/{name}")):
                if status.getPath().getName() != f"v={version}":
                    self._fs.delete(status.getPath(), True)
