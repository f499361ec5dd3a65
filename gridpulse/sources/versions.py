"""Versioned tables: written data, then one manifest that names it, committed last.

    <root>/data/<name>-<id>/...       tables or parts of tables, never changed once written
    <root>/_versions/v00000007.json   manifest: table name -> folder, and notes

A reader resolves the newest manifest once and reads only the folders that it names, so it sees one version whole, whatever is written meanwhile.
A writer that fails before its commit leaves folders that no manifest names. Two writers that start from the same version can't both commit: the
manifest's name is taken by the first. ``expire`` deletes old manifests and the folders that no manifest left names, by age.
"""
from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


class CommitConflict(RuntimeError):
    """Another writer has committed since this one's base version."""


class VersionedStore:
    """Tables below one folder of a file system that Hadoop reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, below: str):
        return self._hadoop.Path(f"{self.root}/{below}" if below else self.root)

    def _list(self, below: str) -> list:
        path = self._path(below)
        return list(self._fs.listStatus(path)) if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._list("_versions")]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """A version's manifest, the newest by default; before the first commit an empty one."""
        if version is None:
            known = self.versions()
            if not known:
                return {"version": 0, "tables": {}, "notes": {}}
            version = known[-1]
        stream = self._fs.open(self._path(f"_versions/v{version:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def new_folder(self, name: str) -> str:
        """Where a writer puts new data; also a part of the manifest's entry (relative to the root)."""
        return f"data/{name}-{uuid.uuid4().hex[:12]}"

    def full(self, folder: str) -> str:
        return f"{self.root}/{folder}"

    def commit(self, tables: dict[str, str], base: dict, notes: dict | None = None, drop: list[str] | None = None) -> int:
        """The version after ``base``: its tables without those in ``drop``, those in ``tables`` replaced or added. All of them become visible at once."""
        version = base["version"] + 1
        gone = set(drop or ())
        stay = {name: folder for name, folder in base["tables"].items() if name not in gone}
        text = json.dumps({"version": version, "at": time.time(), "tables": stay | tables, "notes": base["notes"] | (notes or {})})
        new, final = self._path(f"_versions/.{uuid.uuid4().hex}"), self._path(f"_versions/v{version:08d}.json")
        out = self._fs.create(new, False)
        out.write(bytearray(text.encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(final.toUri() if final.isAbsolute() and final.toUri().getScheme() else self._fs.getUri(),
                                                          self.spark._jsc.hadoopConfiguration())
        keep = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(new), self._fs.makeQualified(final), keep)
        except Exception as failed:
            self._fs.delete(new, False)
            if self._fs.exists(final):
                raise CommitConflict(f"version {version} of {self.root} is taken") from failed
            raise
        return version

    def frame(self, name: str, manifest: dict | None = None) -> DataFrame:
        return self.spark.read.parquet(self.full((manifest or self.manifest())["tables"][name]))

    def frames(self, manifest: dict | None = None) -> dict[str, DataFrame]:
        """All tables of one version."""
        manifest = manifest or self.manifest()
        return {name: self.frame(name, manifest) for name in manifest["tables"]}

    def expire(self, older_than: float) -> list[str]:
        """Delete the versions committed more than ``older_than`` seconds ago, the newest excepted, and the data folders of that age that no version
        left names. A reader that resolved one of these versions longer ago than that loses its data: choose the age by the longest read."""
        before, kept = time.time() - older_than, []
        for version in self.versions():
            manifest = self.manifest(version)
            if manifest["at"] >= before or version == self.versions()[-1]:
                kept.append(manifest)
            else:
                self._fs.delete(self._path(f"_versions/v{version:08d}.json"), False)
        named = {folder.split("/")[1] for manifest in kept for folder in manifest["tables"].values()}
        gone = []
        for status in self._list("data"):
            name = status.getPath().getName()
            if name not in named and status.getModificationTime() / 1000 < before:
                self._fs.delete(status.getPath(), True)
                gone.append(name)
        return gone
