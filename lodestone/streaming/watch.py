"""Watching folders: a file stream of new rows, and a stream of changes that keeps a project's index up to date."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.sources import files
from lodestone.sources.indexer import Project, Synced

# Folders whose changes are not looked at, and the quiet time before a sync.
UNWATCHED = ["node_modules", ".git", ".lodestone", "dist", "build", "coverage", ".next", ".nuxt"]
DEBOUNCE_MS = 500


def watch(spark: SparkSession, path: str, schema: str, on_change: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None, file_format: str = "parquet") -> StreamingQuery:
    """Call ``on_change`` with the rows of new files, a batch at a time; without ``interval`` once, for what is there.

    One batch runs at a time, and files that arrive meanwhile make the next one. A file stream does not report
    deletions: hold the manifest against a listing (``analysis.file_diff``) for these.
    """
    rows = spark.readStream.format(file_format).schema(schema).load(path)
    out = rows.writeStream.foreachBatch(lambda df, n: None if df.isEmpty() else on_change(df, n)).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=interval) if interval else out.trigger(availableNow=True)).start()


class FolderChanges(DataSource):
    """A stream of ``path``, ``change`` (new, changed, deleted) of the files below a folder, found by listing it for each micro-batch.

    The offset is a digest of the listing. After a restart the listing before is not known: then one row, ``resumed``, stands for
    whatever has changed meanwhile, and so it does for a batch that is replayed.
    """

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return "path string, change string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _Changes(self.options["path"])


class _Changes(SimpleDataSourceStreamReader):
    def __init__(self, root: str):
        self.root, self.seen, self.at = root, {}, None

    def listed(self) -> dict[str, tuple]:
        where, top = fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)
        found = {}
        for f in where.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True)):
            path = f.path.removeprefix(top).lstrip("/")
            if f.is_file and not set(path.split("/")) & set(UNWATCHED):
                found[path] = (f.mtime_ns, f.size)
        return found

    def initialOffset(self) -> dict:  # noqa: N802
        self.seen = self.listed()
        self.at = digest(self.seen)
        return {"listing": self.at}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = self.listed()
        end = digest(now)
        if end == start["listing"]:
            rows = []
        elif start["listing"] != self.at:
            rows = [("", "resumed")]
        else:
            rows = [(p, "new" if p not in self.seen else "changed") for p, x in now.items() if self.seen.get(p) != x] + [(p, "deleted") for p in self.seen if p not in now]
        self.seen, self.at = now, end
        return iter(rows), {"listing": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([("", "resumed")] if start != end else [])


def digest(listing: dict[str, tuple]) -> str:
    return hashlib.sha256(repr(sorted(listing.items())).encode()).hexdigest()


def quiet(changes: DataFrame, wait_ms: int) -> DataFrame:
    """``root``, ``changes``: a row for each burst of changes, once nothing has followed for ``wait_ms``.

    State is the number of changes since the last such row; each new batch of changes puts the timer off.
    """

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (n,) = state.get
            state.remove()
            yield pd.DataFrame({"root": [key[0]], "changes": [n]})
        else:
            n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
            state.update((n,))
            state.setTimeoutDuration(wait_ms)

    return changes.groupBy("root").applyInPandasWithState(count, "root string, changes long", "n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def watch_project(
    project: Project, root: str, checkpoint: str, on_sync: Callable[[Synced], None] | None = None, on_error: Callable[[Exception], None] | None = None,
    debounce_ms: int = DEBOUNCE_MS, interval: str = "250 milliseconds",
) -> StreamingQuery:
    """Keep a project's store like its folder: a burst of changes makes one sync, ``debounce_ms`` after its last change.

    One sync runs at a time, and all that happens meanwhile makes one more. ``on_sync`` hears of syncs that changed something;
    what a sync raises goes to ``on_error`` (without one it ends the stream), and the next change tries again. Syncs compare the store with the
    folder, so a batch that is replayed finds nothing to do. The store must exist.
    """
    spark = project.spark
    if project.store.latest() is None:
        raise ValueError(f"no store at {project.path}")
    spark.dataSource.register(FolderChanges)
    changes = spark.readStream.format("folder_changes").option("path", root).load().withColumn("root", F.lit(root))

    def sync(batch: DataFrame, _: int) -> None:
        if not batch.collect():  # a row a folder; reads all partitions, as the state store asks
            return
        try:
            done = project.sync(files.listing(spark, root))
        except Exception as e:
            if on_error is None:
                raise
            on_error(e)
            return
        for r in done.errors.collect() if on_error else []:
            on_error(ValueError(f"{r.path}: {r.error}"))
        if on_sync and (done.added or done.updated or done.removed):
            on_sync(done)

    return quiet(changes, debounce_ms).writeStream.outputMode("append").foreachBatch(sync).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def settled(query: StreamingQuery, until: Callable[[], bool], seconds: float = 60) -> bool:
    """Wait for a condition while a stream runs."""
    end = time.time() + seconds
    while time.time() < end:
        if until():
            return True
        if query.exception():
            raise query.exception()
        time.sleep(0.1)
    return False
