"""Several tables written as one: a version of the store is a manifest that names the files of each table.

A commit writes its rows into folders of its own, checks them, and then creates the next manifest, which is one
atomic step that fails if another commit took the number first. Readers go by the newest manifest, so a failure
anywhere before that step leaves the old version readable and whole. A commit that is sent again finds its id in
the manifests and gets the receipt it got before. Rows are only ever added; what takes rows away is ``rewritten``.

* A table that a commit does not name stays as it is; an empty table of a commit adds an empty folder.
* Checks get the tables as they would be and return rows that break a rule: one such row stops the commit.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class CommitError(ValueError):
    """A commit broke a rule or met another one."""


@dataclass(frozen=True)
class Receipt:
    commit: str
    version: int
    rows: dict[str, int]
    replayed: bool


class VersionedStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- manifests

    def versions(self) -> list[int]:
        root = self._path(f"{self.folder}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest or that of a version: {version, commit, digest, rows, tables: {name: [folders]}}."""
        there = self.versions()
        if not there:
            return {"version": 0, "commit": None, "tables": {}, "commits": {}}
        stream = self._fs.open(self._path(f"{self.folder}/manifests/{there[-1] if version is None else version:012d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """Write aside, then rename to the number: the rename fails where that number is taken."""
        data = json.dumps(manifest, sort_keys=True).encode()
        name = hashlib.sha256(data).hexdigest()[:16]
        aside, target = self._path(f"{self.folder}/manifests/_{name}"), self._path(f"{self.folder}/manifests/{manifest['version']:012d}.json")
        out = self._fs.create(aside, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        if self._fs.exists(target) or not self._fs.rename(aside, target):
            raise CommitError(f"version {manifest['version']} was taken by another commit")

    # --- tables

    def read(self, table: str, version: int | None = None) -> DataFrame:
        folders = self.manifest(version)["tables"].get(table)
        if not folders:
            raise CommitError(f"the store has no table {table}")
        return self.spark.read.parquet(*folders)

    def commit(self, commit: str, digest: str, tables: dict[str, DataFrame], checks: dict[str, Callable[[Callable[[str], DataFrame]], DataFrame]] | None = None, replace: bool = False) -> Receipt:
        """Add the rows of ``tables`` (``replace``: they take the tables' place) as one version.

        ``digest`` tells the commit's content: the same id with another digest is refused."""
        base = self.manifest()
        known = base["commits"].get(commit)
        if known:
            if known["digest"] != digest:
                raise CommitError(f"the commit {commit} came with another content")
            return Receipt(commit, known["version"], known["rows"], True)
        mine, rows = {}, {}
        for name, df in tables.items():
            mine[name] = f"{self.folder}/data/{name}/{commit}-{base['version'] + 1}"
            df.write.mode("overwrite").parquet(mine[name])
            rows[name] = self.spark.read.schema(df.schema).parquet(mine[name]).count()
        after = base["tables"] | {n: ([] if replace else base["tables"].get(n, [])) + [f] for n, f in mine.items()}
        for rule, check in (checks or {}).items():
            broken = check(lambda name: self.spark.read.parquet(*after[name]))
            if not broken.isEmpty():
                raise CommitError(f"the commit {commit} breaks the rule {rule}: {broken.first().asDict()}")
        version = base["version"] + 1
        self._publish({"version": version, "commit": commit, "tables": after, "commits": base["commits"] | {commit: {"digest": digest, "version": version, "rows": rows}}})
        return Receipt(commit, version, rows, False)


def orphans(child: str, key: str, parent: str, parent_key: str) -> Callable[[Callable[[str], DataFrame]], DataFrame]:
    """The rule that each row of ``child`` has its parent."""

    def check(table: Callable[[str], DataFrame]) -> DataFrame:
        have = table(parent).selectExpr(f"{parent_key} as _key").distinct()
        rows = table(child)
        return rows.join(have, rows[key] == have["_key"], "left_anti")

    return check


def repeated(table_name: str, key: str) -> Callable[[Callable[[str], DataFrame]], DataFrame]:
    """The rule that a key is unique."""
    return lambda table: table(table_name).groupBy(key).count().where("count > 1")
