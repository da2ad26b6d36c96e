"""Snapshots of graphs by remote, time and revision, and the last one at or before a time.

A snapshot is a stored graph and an entry, a small file whose name has its time and revision, in a folder for each remote
and day. The entry appears last and at once, so that a snapshot is seen as a whole or not at all. The search for the last
snapshot goes back day by day from the day asked for and lists no day it doesn't need.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from targetry.sources import graphs
from targetry.sources.tables import write_text

DAY = 86_400
_ENTRY = re.compile(r"([0-9]{20})_([0-9A-Za-z]+)\.entry")


@dataclass
class Store:
    """base: a folder that all machines share. listed: folders listed so far, for measurement."""

    spark: SparkSession
    base: str
    listed: list[str] = field(default_factory=list)

    def _remote(self, remote: str) -> str:
        return f"{self.base}/{hashlib.sha256(remote.encode()).hexdigest()[:32]}"

    def _names(self, path: str) -> list[str]:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        self.listed.append(path)
        return [s.getPath().getName() for s in files.listStatus(p)] if files.exists(p) else []

    @staticmethod
    def _key(ts: int, sha: str) -> str:
        if ts < 0 or not re.fullmatch("[0-9A-Za-z]+", sha):
            raise ValueError(f"no snapshot can be named {ts}, {sha!r}")
        return f"{ts:020}_{sha}"

    def put(self, remote: str, ts: int, sha: str, targets: DataFrame, like: graphs.Graph | None = None) -> graphs.Graph:
        """Stores a graph under (remote, ts, sha); one that is there is replaced. ts: seconds."""
        key, top = self._key(ts, sha), self._remote(remote)
        graph = graphs.put(targets, f"{top}/graphs", key, like)
        write_text(self.spark, f"{top}/days/{ts // DAY:012}/{key}.entry", remote)
        return graph

    def get(self, remote: str, ts: int, sha: str) -> graphs.Graph | None:
        """The graph under (remote, ts, sha), None if there is none."""
        return graphs.get(self.spark, f"{self._remote(remote)}/graphs", self._key(ts, sha))

    def floor(self, remote: str, ts: int) -> tuple[int, str] | None:
        """The greatest (time, revision) of the remote at or before ts, None if there is none."""
        top = f"{self._remote(remote)}/days"
        for day in sorted((d for d in self._names(top) if d.isdigit() and int(d) <= ts // DAY), reverse=True):
            found = [(int(m[1]), m[2]) for n in self._names(f"{top}/{day}") if (m := _ENTRY.fullmatch(n)) and int(m[1]) <= ts]
            if found:
                return max(found)
        return None

    def latest(self, remote: str, ts: int) -> graphs.Graph | None:
        """The graph of the floor; an entry whose graph is gone counts as none."""
        found = self.floor(remote, ts)
        return self.get(remote, *found) if found else None
