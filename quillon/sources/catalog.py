"""Versioned tables on plain Parquet: a directory for each version, and numbered pointer files, the last of which counts."""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class GateError(RuntimeError):
    """A publish was refused: ``reason`` is missing, malformed, concurrent or count."""

    def __init__(self, reason: str, text: str):
        super().__init__(f"{reason}: {text}")
        self.reason = reason


@dataclass
class Catalog:
    """Tables under ``root``: ``root/<table>/v=<n>``. ``root/_pointers/<table>/<no>`` name its version and row count.

    Writers build a version beside the current one and add a pointer after a check of the counts; readers of an older
    version go on reading it. Each table has pointers of its own, so writers of different tables don't meet. Files go over
    Hadoop's file system, so the root may be on any shared store on which a file is created once.
    """

    spark: SparkSession
    root: str

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointers(self, name: str) -> list[int]:
        path, fs = self._path(f"_pointers/{name}")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(path) if x.getPath().getName().isdigit()) if fs.exists(path) else []

    def _pointer(self, name: str) -> tuple[int, dict]:
        """Number and content of a table's newest pointer file; 0 and empty where there is none."""
        for no in reversed(self._pointers(name)):
            path, fs = self._path(f"_pointers/{name}/{no}")
            stream = fs.open(path)
            try:
                raw = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            finally:
                stream.close()
            try:
                out = json.loads(raw)
            except ValueError as e:
                raise GateError("malformed", f"pointer {no} of {name}") from e
            if not isinstance(out, dict):
                raise GateError("malformed", f"pointer {no} of {name}")
            return no, out
        return 0, {}

    def manifest(self) -> dict:
        """The pointer of every table."""
        path, fs = self._path("_pointers")
        names = sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []
        return {n: p for n in names if (p := self._pointer(n)[1])}

    def _flip(self, name: str, entry: dict, after: int) -> None:
        """Publish pointer ``after`` + 1 of a table. A pointer is a file of its own, whole when it gets its name, and a number
        is given once: of two writers that saw the same state one is refused, and readers always find the one before."""
        path, fs = self._path(f"_pointers/{name}/{after + 1}")
        temp, _ = self._path(f"_pointers/{name}/.{uuid.uuid4().hex}")
        out = fs.create(temp, False)
        try:
            out.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
        finally:
            out.close()
        lock, _ = self._path(f"_pointers/{name}/.lock-{after + 1}")
        try:
            fs.create(lock, False).close()  # fails if somebody else has taken the number
        except Exception as e:  # noqa: BLE001 - the file system's own kind of error
            fs.delete(temp, False)
            raise GateError("concurrent", f"{name} moved on from pointer {after}") from e
        if not fs.rename(temp, path):
            raise GateError("concurrent", f"{name} moved on from pointer {after}")

    def version(self, name: str) -> int:
        return int(self._pointer(name)[1].get("version", 0))

    def versions(self, name: str) -> list[int]:
        path, fs = self._path(name)
        if not fs.exists(path):
            return []
        return sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v="))

    def scan(self, name: str, version: int | None = None) -> DataFrame:
        """A version of a table, the current one if none is given; ValueError if there is no such version."""
        v = self.version(name) if version is None else version
        if v not in self.versions(name):
            raise ValueError(f"{name} has no version {v}")
        return self.spark.read.parquet(f"{self.root}/{name}/v={v}")

    def scan_or_previous(self, name: str) -> tuple[DataFrame, bool]:
        """The current version if a row of it can be read, else the one before; and whether that was needed."""
        v = self.version(name)
        for n, degraded in ((v, False), (v - 1, True)):
            try:
                df = self.scan(name, n)
                df.limit(1).collect()
                return df, degraded
            except Exception:  # noqa: BLE001 - whatever makes a version unreadable
                if degraded:
                    raise
        raise AssertionError

    def write(self, name: str, df: DataFrame, expect: int | None = None, based_on: int | None = None, partition_by: list[str] | None = None) -> int:
        """Write the next version and make it current, once its rows are counted; returns its number.

        ``expect``: the row count it must have. ``based_on``: the version it was made from; another current one means that
        somebody else published meanwhile.
        """
        pointer, now = self._pointer(name)
        at = int(now.get("version", 0))
        if based_on is not None and based_on != at:
            raise GateError("concurrent", f"{name} is at {at}, not {based_on}")
        v = max([at, *self.versions(name)]) + 1
        out = df.write.option("compression", "zstd")
        (out.partitionBy(*partition_by) if partition_by else out).parquet(f"{self.root}/{name}/v={v}")
        rows = self.scan(name, v).count()
        if expect is not None and rows != expect:
            raise GateError("count", f"{name} v{v} has {rows} rows, expected {expect}")
        self._flip(name, {"version": v, "rows": rows, "created_at": time.time()}, pointer)
        return v

    def rollback(self, name: str, version: int) -> None:
        """Point at an earlier version; no data moves."""
        pointer, _ = self._pointer(name)
        rows = self.scan(name, version).count()
        self._flip(name, {"version": version, "rows": rows, "created_at": time.time()}, pointer)

    def reconcile(self, name: str) -> dict:
        """Count the current version again and write the pointer anew: {rows, before, diverged}."""
        pointer, now = self._pointer(name)
        v, before = int(now.get("version", 0)), now.get("rows")
        rows = self.scan(name, v).count()
        self._flip(name, {"version": v, "rows": rows, "created_at": time.time()}, pointer)
        return {"rows": rows, "before": before, "diverged": before != rows}

    def prune_plan(self, name: str, ages: DataFrame, keep_days: float = 7, pinned: int | None = None) -> DataFrame:
        """(version, age_days) rows that may go: not the pinned one and the one before it, not the tip, nothing younger than
        the keep time or the pinned version's age and ten minutes."""
        tip = self.version(name)
        pin = tip if pinned is None else pinned
        limit = ages.where(F.col("version") == pin).agg(F.max("age_days")).head()[0] or 0.0
        return ages.where(~F.col("version").isin(pin, pin - 1, tip) & (F.col("age_days") > max(keep_days, limit + 10 / 1440)))


def evolve(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with the columns it lacks, as typed nulls, in the order of ``columns``; other columns follow."""
    more = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    return df.withColumns(more).select(*columns, *(c for c in df.columns if c not in columns)) if more else df.select(*columns, *(c for c in df.columns if c not in columns))


def local(path: str) -> str:
    """The local path of a file URL; for tests and single files."""
    return urlparse(path).path if path.startswith("file:") else os.path.abspath(path)
