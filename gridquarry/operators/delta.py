"""A table of codes with a buffer of changes, in versions: every change is written first and counts once its manifest stands."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import hamming_knn, merge_delta

CODES = "id long, v array<long>"
CHANGES = "id long, v array<long>, deleted boolean, seq long"


class DeltaError(RuntimeError):
    """A change that cannot be made: another writer was first, or there is no such table."""


class DeltaIndex:
    """Codes (id, v: 64-bit words) in a folder that driver and executors share: a main table, segments of changes, and manifests.

    A manifest is a small file, numbered by version, that names the main table and the segments that count, in order. Tables
    are written under new names, then the manifest appears under its number in one rename, which fails if another writer has
    taken the number. So readers see a whole version, and what a writer left before its manifest stood does not count.
    Of an id's changes the last one holds; a deletion hides the id in the main table too."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.version, self.manifest = self._latest()

    # --- files

    def _at(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _latest(self) -> tuple[int, dict]:
        folder, store = self._at(f"{self.path}/manifests")
        names = [f.getPath().getName() for f in store.listStatus(folder)] if store.exists(folder) else []
        versions = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not versions:
            raise DeltaError(f"no table at {self.path}")
        version = max(versions)
        return version, json.loads(self.spark.read.text(f"{self.path}/manifests/{version}.json", wholetext=True).first()[0])

    def _commit(self, manifest: dict) -> None:
        """Make manifest the next version; older manifests stay, and can be read by their numbers."""
        aside, store = self._at(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = store.create(aside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        target, _ = self._at(f"{self.path}/manifests/{self.version + 1}.json")
        if store.exists(target) or not store.rename(aside, target):
            store.delete(aside, False)
            raise DeltaError(f"version {self.version + 1} of {self.path} is another writer's")
        self.version, self.manifest = self.version + 1, manifest

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{path}")
        return path

    # --- what a user does

    @classmethod
    def create(cls, codes: DataFrame, path: str, capacity: int) -> DeltaIndex:
        """A new table of codes (id, v; of rows of equal id one) whose buffer is to be flushed at capacity changes."""
        found = cls.__new__(cls)
        found.spark, found.path, found.version, found.manifest = codes.sparkSession, path.rstrip("/"), -1, {}
        where, store = found._at(f"{found.path}/manifests")
        if not store.mkdirs(where):
            raise DeltaError(f"cannot make {where}")
        rows = codes.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<long>").alias("v")).where("id IS NOT NULL").dropDuplicates(["id"])
        found._commit({"main": found._write(rows, "main"), "segments": [], "capacity": capacity})
        return found

    def main(self) -> DataFrame:
        return self.spark.read.schema(CODES).parquet(f"{self.path}/{self.manifest['main']}")

    def changes(self) -> DataFrame:
        """All changes that are not flushed: id, v, deleted, seq."""
        paths = [f"{self.path}/{s}" for s in self.manifest["segments"]]
        return self.spark.read.schema(CHANGES).parquet(*paths) if paths else self.spark.createDataFrame([], CHANGES)

    def _append(self, rows: DataFrame, deleted: bool) -> None:
        """One more segment; flushed with the others if the buffer is then full. Rows without id are left out."""
        v = F.lit(None).cast("array<long>") if deleted else F.col("v").cast("array<long>")
        seq = F.lit(self.version + 1).cast("long")
        own = rows.select(F.col("id").cast("long").alias("id"), v.alias("v"), F.lit(deleted).alias("deleted"), seq.alias("seq")).where("id IS NOT NULL")
        segment = self._write(own.dropDuplicates(["id"]), "segments")
        self._commit({**self.manifest, "segments": [*self.manifest["segments"], segment]})
        if self.needs_flush():
            self.flush()

    def insert(self, rows: DataFrame) -> None:
        """New codes (id, v), or new ones of ids that are there; of equal ids among rows one counts."""
        self._append(rows, False)

    def delete(self, ids: DataFrame) -> None:
        self._append(ids, True)

    def size(self) -> int:
        """Ids that the buffer holds and that are not deleted."""
        last = self.changes().groupBy("id").agg(F.max_by("deleted", "seq").alias("deleted"))
        return last.where("NOT deleted").count()

    def needs_flush(self) -> bool:
        """Whether the buffer holds as many changes (insertions and deletions) as its capacity, or more."""
        return self.changes().count() >= self.manifest["capacity"]

    def live(self) -> DataFrame:
        """The codes of this version: id, v."""
        return merge_delta(self.main(), self.changes())

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """The k nearest codes of this version to each of queries (query, v): query, id, distance, rank."""
        return hamming_knn(self.live(), queries, k)

    def flush(self) -> None:
        """Write the codes of this version as the main table of the next, with an empty buffer."""
        main = self._write(self.live(), "main")
        self._commit({**self.manifest, "main": main, "segments": []})

    def at(self, version: int) -> DeltaIndex:
        """The table as it was."""
        found = DeltaIndex.__new__(DeltaIndex)
        found.spark, found.path, found.version = self.spark, self.path, version
        found.manifest = json.loads(self.spark.read.text(f"{self.path}/manifests/{version}.json", wholetext=True).first()[0])
        return found

    def backup(self, path: str) -> None:
        """The buffer's changes as a table of their own."""
        self.changes().write.parquet(path)

    def restore(self, path: str) -> None:
        """Put the changes of a backup in the place of the buffer, in one version; the main table stays. A full buffer is flushed."""
        kept = self.spark.read.schema(CHANGES).parquet(path)
        last = kept.groupBy("id").agg(F.max_by(F.struct("v", "deleted"), "seq").alias("c"))
        seq = F.lit(self.version + 1).cast("long")
        segment = self._write(last.select("id", "c.v", "c.deleted", seq.alias("seq")), "segments")
        self._commit({**self.manifest, "segments": [segment]})
        if self.needs_flush():
            self.flush()
