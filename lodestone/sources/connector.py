"""Source connectors as a Python data source whose offset is the connector's own opaque checkpoint.

A connector describes itself (key, version, capabilities), hands out envelopes and ends a run with a report: its
coverage, how many envelopes it emitted and the checkpoint to go on from. The host (``streaming.inbox``) never looks
into a checkpoint; it is kept in the stream's checkpoint folder and returned as bytes.

``RecordFeed`` is the connector over a folder of Parquet files that only grows: files in the order of their names,
rows in the order of the file. The driver reads footers and plans slices of rows; the slices are read by the
executors, one task each.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# Names of capabilities, coverages and outcomes.
CAPABILITIES = frozenset({"pull", "push", "inventory", "incremental", "checkpointing"})
COVERAGE = frozenset({"unknown", "incremental", "complete_inventory"})
OUTCOMES = frozenset({"success", "partial", "not_found", "failed"})

ENVELOPE = "id string, locator string, observed_at timestamp_ntz, outcome string, payload string, digest string"


class ConnectorError(ValueError):
    """A connector or its report breaks the contract."""


@dataclass(frozen=True)
class Descriptor:
    key: str
    version: str
    capabilities: frozenset[str]

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[a-z0-9][a-z0-9._-]*", self.key) or not self.version.strip():
            raise ConnectorError("a connector has a lower-case key and a version")
        if not self.capabilities or not self.capabilities <= CAPABILITIES:
            raise ConnectorError(f"capabilities are some of {', '.join(sorted(CAPABILITIES))}")


@dataclass(frozen=True)
class RunReport:
    """What a run of a connector amounts to: a summary, not data."""

    coverage: str
    emitted: int
    accepted: int
    replayed: int
    next_checkpoint: bytes | None

    def checked(self, by: Descriptor) -> RunReport:
        if self.coverage not in COVERAGE:
            raise ConnectorError(f"unknown coverage {self.coverage!r}")
        if self.emitted != self.accepted + self.replayed:
            raise ConnectorError(f"emitted {self.emitted} envelopes, the inbox saw {self.accepted + self.replayed}")
        for need, when in (("inventory", self.coverage == "complete_inventory"), ("incremental", self.coverage == "incremental"), ("checkpointing", self.next_checkpoint is not None)):
            if when and need not in by.capabilities:
                raise ConnectorError(f"the report needs the capability {need}")
        return self


def sealed(checkpoint: bytes) -> dict:
    """A checkpoint as a stream's offset."""
    return {"checkpoint": base64.b64encode(checkpoint).decode()}


def opened(offset: dict) -> bytes:
    return base64.b64decode(offset["checkpoint"])


@dataclass
class _Slice(InputPartition):
    file: str
    first: int
    end: int


def _position(offset: dict) -> tuple[str, int]:
    at = json.loads(opened(offset))
    return at["file"], at["row"]


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.step, self.task = options["path"], int(options.get("rows_per_step", "100000")), int(options.get("rows_per_task", "20000"))
        self.share = float(options.get("catch_up", "0"))
        self.columns = {c: options[c] for c in ("id", "locator", "observed_at")}
        self.failed = (options["outcome"], options["failed"].split(",")) if "outcome" in options else None
        if min(self.step, self.task) < 1:
            raise ConnectorError("steps and tasks have at least one row")
        if not 0 <= self.share <= 1:
            raise ConnectorError("a step catches up with a share of what is left, 0 to 1")
        self.at: tuple[str, int] | None = None

    def _files(self) -> list[tuple[str, int]]:
        """Names and rows of the files, in order. A path without scheme is local."""
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        names = sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.endswith(".parquet"))
        return [(n, pq.read_metadata(n, filesystem=system).num_rows) for n in names]

    def initialOffset(self) -> dict:
        return sealed(json.dumps({"file": "", "row": 0}).encode())

    def latestOffset(self) -> dict:
        """At most a step beyond where the last one ended; a step is longer where more is left to catch up with."""
        name, row = self.at or _position(self.initialOffset())
        files = self._files()
        behind = sum(max(rows - (row if file == name else 0), 0) for file, rows in files if file >= name)
        left = max(self.step, math.ceil(self.share * behind))
        for file, rows in files:
            if file < name or left == 0:
                continue
            start = row if file == name else 0
            taken = min(left, max(rows - start, 0))
            if taken:
                name, row, left = file, start + taken, left - taken
        self.at = name, row
        return sealed(json.dumps({"file": name, "row": row}).encode())

    def partitions(self, start: dict, end: dict) -> list[_Slice]:
        (first, skip), (last, stop) = _position(start), _position(end)
        if self.at is None:  # a restart plans its last step again before it asks for the next one
            self.at = last, stop
        out = []
        for file, rows in self._files():
            if first <= file <= last:
                lo, hi = skip if file == first else 0, stop if file == last else rows
                out += [_Slice(file, k, min(k + self.task, hi)) for k in range(lo, hi, self.task)]
        return out

    def read(self, partition: _Slice) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        at = 0
        source = pq.ParquetFile(partition.file, filesystem=system)
        for group in range(source.num_row_groups):
            if at >= partition.end:
                break
            rows = source.metadata.row_group(group).num_rows
            if at < partition.end and at + rows > partition.first:
                for batch in source.iter_batches(2000, row_groups=[group]):
                    lo, hi = max(partition.first - at, 0), min(partition.end - at, batch.num_rows)
                    if lo < hi:
                        yield self._envelopes(batch.slice(lo, hi - lo))
                    at += batch.num_rows
                    if at >= partition.end:
                        break
            else:
                at += rows

    def _envelopes(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.to_pylist()
        payload = [json.dumps(r, sort_keys=True, ensure_ascii=False, default=str, separators=(",", ":")) for r in rows]
        text = lambda c: pa.array([None if r[c] is None else str(r[c]) for r in rows], pa.string())
        outcome = ["failed" if self.failed and r[self.failed[0]] in self.failed[1] else "success" for r in rows]
        observed = batch.column(self.columns["observed_at"]).cast(pa.timestamp("us"))
        return pa.record_batch(
            [text(self.columns["id"]), text(self.columns["locator"]), observed, pa.array(outcome), pa.array(payload), pa.array([hashlib.sha256(p.encode()).hexdigest() for p in payload])],
            ["id", "locator", "observed_at", "outcome", "payload", "digest"],
        )


class RecordFeed(DataSource):
    """Options: ``path``; the columns ``id``, ``locator`` and ``observed_at``; ``outcome`` with the comma-separated
    values that count as ``failed``; ``rows_per_step`` and ``rows_per_task``. ``catch_up``: the share of
    what is left that a step takes if that is more than ``rows_per_step``, so that the number of steps grows with the
    logarithm of what is left; 0 (the default) takes ``rows_per_step`` at most. Tasks stay as long as they are."""

    descriptor = Descriptor("record-feed", "1", frozenset({"pull", "incremental", "checkpointing"}))

    @classmethod
    def name(cls) -> str:
        return "lodestone_record_feed"

    def schema(self) -> str:
        return ENVELOPE

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options)


def register(spark: SparkSession, connector: type[DataSource] = RecordFeed) -> str:
    spark.dataSource.register(connector)
    return connector.name()
