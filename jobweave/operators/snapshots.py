"""A table as numbered snapshots: one writer's batch becomes visible at once or not at all, and no batch counts twice.

A folder holds ``data/`` (one Parquet folder for each attempt to write a snapshot) and ``commits/`` (one small file for
each snapshot: the place of its rows, and the last batch of each stream that it holds).  Rows are written first; then
the commit file gets its number by a rename that fails where that number exists, which the shared file system does in
one step.  So a run that is lost in between leaves the table as it was, the same batch can be run again, and readers keep
the snapshot that they opened.  Files are reached by Spark's own file system classes, never by local paths.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has taken the next number."""


@dataclass(frozen=True)
class Commit:
    version: int
    data: str
    ledger: dict[str, int]  # stream to its last batch in this snapshot


class SnapshotStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _listed(self, name: str) -> list[str]:
        path = self._path(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._listed("commits") if n.endswith(".json")]

    def _load(self, version: int) -> Commit:
        file = self._path(f"commits/{version:012}.json")
        stream = self._fs.open(file)
        try:
            body = bytes(stream.readNBytes(int(self._fs.getFileStatus(file).getLen())))
        finally:
            stream.close()
        told = json.loads(body)
        return Commit(version, told["data"], told["ledger"])

    def latest(self) -> Commit | None:
        found = self.versions()
        return self._load(found[-1]) if found else None

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a snapshot, the latest by default; the frame stays on that one whatever is committed later."""
        commit = self.latest() if version is None else self._load(version)
        if commit is None:
            raise FileNotFoundError(f"{self.folder} holds no snapshot")
        return self.spark.read.parquet(f"{self.folder}/data/{commit.data}")

    def commit(self, rows: DataFrame, stream: str | None = None, batch: int | None = None, after: Commit | None = None) -> int:
        """Writes rows as the snapshot after ``after`` and gives its number; Conflict if there is one already."""
        version = after.version + 1 if after else 1
        data = f"{version:012}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/data/{data}")
        ledger = dict(after.ledger if after else {}) | ({} if stream is None or batch is None else {stream: batch})
        self._publish(version, json.dumps({"data": data, "ledger": ledger}))
        return version

    def _publish(self, version: int, body: str) -> None:
        draft = self._path(f"drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(body.encode())
        out.close()
        self._fs.mkdirs(self._path("commits"))
        context = self._hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, self._path(f"commits/{version:012}.json"), none)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                raise Conflict(f"snapshot {version} of {self.folder} exists") from e
            raise

    def update(self, change: Callable[[DataFrame | None], DataFrame], stream: str | None = None, batch: int | None = None, tries: int = 5) -> int:
        """Commits change(latest rows, or None for a new table) and gives the number of the snapshot that holds it.

        A batch that the ledger knows changes nothing: batches of a stream are numbered upwards, as foreachBatch does.
        Where another writer was faster, the change is made again on what that one wrote.
        """
        for left in range(tries - 1, -1, -1):
            after = self.latest()
            if after and stream is not None and batch is not None and after.ledger.get(stream, -1) >= batch:
                return after.version
            try:
                return self.commit(change(self.read(after.version) if after else None), stream, batch, after)
            except Conflict:
                if not left:
                    raise
        raise ValueError("tries must be positive")

    def sweep(self, keep: int = 10) -> list[str]:
        """Removes all but the last ``keep`` snapshots and the rows that lost runs left, and names them.  Rows of numbers that
        nobody has committed yet stay: they may be under way."""
        found = self.versions()
        gone, last = found[: max(0, len(found) - keep)], found[-1] if found else 0
        kept = {self._load(v).data for v in found[len(gone) :]}
        removed = []
        for v in gone:  # first the number, then its rows
            self._fs.delete(self._path(f"commits/{v:012}.json"), False)
        for name in self._listed("data"):
            if int(name[:12]) <= last and name not in kept:
                self._fs.delete(self._path(f"data/{name}"), True)
                removed.append(name)
        return removed


def append_run(rows: DataFrame, path: str, run_col: str = "run_id") -> None:
    """Rows of a run added to a log; writing a run again replaces its rows alone."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run_col).parquet(path)
