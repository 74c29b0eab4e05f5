"""Index and sync of a project: what has changed is extracted, references are resolved late, and one commit takes it all in.

A project is a table of files: path, size, mtime and content (``files.listing`` makes it from a folder). An extractor turns the
files of a kind into nodes and references; ``markdown.extract`` is the one for documents. References stay in the store beside what
they were resolved to, the unresolved ones too. After a sync only those are resolved again whose file has changed, or whose name
belongs to a node that has come, gone or moved. So the order in which files arrive does not matter, and a sync gives the
same links as a new index.

A reference of scope ``one`` goes to the node with this id, else to the first of this name (in ``ref_file`` if it can be; by path and
place in the file, so that no history decides); one of scope ``all`` goes to every node of the name that is no document.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schema
from lodestone.functions.columns import edge_bytes, node_bytes
from lodestone.graph import Graph
from lodestone.operators.analysis import file_diff
from lodestone.scratch import numbered, saved
from lodestone.sources import files as discovery
from lodestone.sources import markdown
from lodestone.sources.store import LINKS, NODES
from lodestone.sources.versions import PART_BYTES, Kind, Versions

FILES = Kind("files", "key string, kind string, mtime long, size long, file_no long")
#: path and text of the files of a kind, to nodes (path, place, id, type, name, ...) and references (path, place, source, ref, ...)
Extractor = Callable[[DataFrame], tuple[DataFrame, DataFrame]]
EXTRACTORS: dict[str, Extractor] = {"doc": markdown.extract}
_KEEP = ["key", "place", "source", "ref", "ref_file", "scope", "type", "weight", "metadata"]


@dataclass(frozen=True)
class Synced:
    """What an index or a sync did: counts, and the files that could not be read (path, error)."""

    version: int
    added: int
    updated: int
    removed: int
    parts_written: int
    parts_removed: int
    errors: DataFrame


@dataclass(frozen=True)
class Project:
    """A project's store, and how its files are read."""

    spark: SparkSession
    path: str
    extractors: dict[str, Extractor] = field(default_factory=lambda: dict(EXTRACTORS))
    ignore: list[str] = field(default_factory=list)
    part_bytes: int = PART_BYTES

    @property
    def store(self) -> Versions:
        return Versions(self.spark, self.path, self.part_bytes)

    def graph(self, version: int | None = None) -> Graph:
        from lodestone.sources.store import load

        return load(self.spark, self.path, version)

    def init(self, files: DataFrame, now: int | None = None) -> Synced:
        """Index all files; an error if there is a store."""
        if self.store.latest() is not None:
            raise ValueError(f"a store exists at {self.path}")
        return self._synced(files, None, now)

    def sync(self, files: DataFrame, now: int | None = None) -> Synced:
        """Take in what differs from the store by path and mtime; with no difference nothing is written."""
        version = self.store.latest()
        if version is None:
            raise ValueError(f"no store at {self.path}")
        return self._synced(files, version, now)

    def diff(self, files: DataFrame, version: int | None = None) -> DataFrame:
        """``path`` and ``state`` (new, changed, deleted, fresh) of what is found against what is known."""
        return file_diff(self.store.read(FILES, version).select(F.col("key").alias("path"), "mtime"), discovery.discover(files, self.ignore))

    def status(self, files: DataFrame) -> DataFrame:
        """One row: nodes, edges, files, parts and bytes of the store, its version and time, and how many files are new, changed, deleted."""
        store, version = self.store, self.store.latest()
        meta = store.meta(version)
        n = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0))
        kept = store.parts(version).agg(n("nodes", "rows").alias("nodes"), n("files", "rows").alias("files"), F.count(F.lit(1)).alias("parts"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
        edges = store.read(LINKS, version).filter("target is not null").agg(F.count(F.lit(1)).alias("edges"))
        states = self.diff(files, version).agg(*[F.count(F.when(F.col("state") == s, 1)).alias(s) for s in ("new", "changed", "deleted")])
        return kept.crossJoin(edges).crossJoin(states).withColumn("version", F.lit(meta["version"])).withColumn("last_sync", F.lit(meta["at"]))  # one row each

    # --- one pass -----------------------------------------------------------------------------

    def _synced(self, files: DataFrame, base: int | None, now: int | None) -> Synced:
        spark, store = self.spark, self.store
        found = discovery.discover(files, self.ignore)
        found = found.filter(F.col("kind").isin(list(self.extractors)))
        known = store.read(FILES, base) if base is not None else spark.createDataFrame([], FILES.schema)
        state = file_diff(known.select(F.col("key").alias("path"), "mtime"), found).filter("state <> 'fresh'")
        state = saved(state.withColumnRenamed("path", "key"), "changes")
        n = {r.state: r["count"] for r in state.groupBy("state").count().collect()}  # three rows
        none = spark.createDataFrame([], "path string, error string")
        if base is not None and not n:
            return Synced(base, 0, 0, 0, 0, 0, none)

        changed = state.filter("state <> 'deleted'").select(F.col("key").alias("path"))
        # of a new index all files are new, and their contents stay where they are
        picked = found.filter("path is not null") if base is None else found.join(changed, "path", "left_semi")
        read = picked.withColumn("text", F.try_validate_utf8(F.col("content").cast("string")))
        now = int(time.time()) if now is None else now
        nodes, refs, errors = self._extracted(read, now)
        numbers = numbered(state.filter("state = 'new'").select("key"), "file_no", "key")
        last = known.agg(F.coalesce(F.max("file_no"), F.lit(0)).alias("n")).first().n
        rows = read.filter("text is not null").select(F.col("path").alias("key"), "kind", "mtime", "size")
        rows = rows.join(known.select("key", F.col("file_no").alias("old_no")), "key", "left").join(numbers, "key", "left")
        rows = saved(rows.select("key", "kind", "mtime", "size", F.coalesce("old_no", F.col("file_no") + last).alias("file_no")), "files")
        at = rows.select("key", "file_no")
        # the number of the file, then the place in it
        seq = (F.shiftleft("file_no", 32) + F.col("place")).alias("seq")
        nodes = nodes.join(at, "key").select(seq, *[c for c in NODES_IN if c != "seq"])
        nodes = saved(nodes, "nodes")
        dirty = state.select("key")
        clean, old_links = self._old(base, dirty)
        self._unique(nodes, clean)
        all_nodes = nodes.unionByName(clean)
        refs = saved(refs, "refs")
        moved, keep, keys = self._reopened(base, dirty, nodes, old_links)
        links = resolved(refs.unionByName(moved), all_nodes, (rows if base is None else rows.unionByName(known.join(dirty, "key", "left_anti").select(*rows.columns))).select("key", "file_no"))
        links = saved(links.unionByName(keep), "links")
        changes = {
            NODES: (dirty if base is not None else None, nodes, node_bytes()),
            LINKS: (saved(dirty.unionByName(keys), "dirty") if base is not None else None, links, edge_bytes_of_links()),
            FILES: (dirty if base is not None else None, rows, F.lit(64)),
        }
        version, written, removed = store.commit(changes, base, "init" if base is None else "sync", now)
        bad = saved(errors, "errors")
        n_bad = {r.state: r["count"] for r in bad.join(state, F.col("path") == F.col("key")).groupBy("state").count().collect()}
        return Synced(version, n.get("new", 0) - n_bad.get("new", 0), n.get("changed", 0) - n_bad.get("changed", 0), n.get("deleted", 0), written, removed, bad)

    def _extracted(self, read: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        nodes, refs = [], []
        for kind, extract in self.extractors.items():
            got, said = extract(read.filter((F.col("kind") == kind) & F.col("text").isNotNull()).select("path", "text"))
            rows = got.withColumns({"file": F.col("path"), "name_lc": F.lower("name"), "created_at": F.lit(now * 1000), "updated_at": F.lit(now * 1000)})
            nodes.append(schema.complete(rows.withColumn("seq", F.col("place"))).select("*", F.col("file").alias("key"), F.col("seq").alias("place")))
            refs.append(said.withColumnRenamed("path", "key").select(*_KEEP))
        errors = read.filter("text is null").select("path", F.lit("the content is not UTF-8").alias("error"))
        return _all(nodes), _all(refs), errors

    def _old(self, base: int | None, dirty: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """The nodes that stay, and all links of the version."""
        if base is None:
            return self.spark.createDataFrame([], NODES.schema), None
        return self.store.read(NODES, base).join(dirty, "key", "left_anti"), self.store.read(LINKS, base)

    def _unique(self, nodes: DataFrame, clean: DataFrame) -> None:
        twice = nodes.groupBy("id").count().filter("count > 1").select("id").unionByName(clean.select("id").join(nodes.select("id"), "id", "left_semi")).limit(1).collect()
        if twice:
            raise ValueError(f"node {twice[0].id} exists")

    def _reopened(self, base: int | None, dirty: DataFrame, nodes: DataFrame, old_links: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Of the files that have not changed: references to resolve again, the other links of the same files, and the files' keys."""
        spark = self.spark
        if old_links is None:
            return spark.createDataFrame([], LINKS.schema).select(*_KEEP), spark.createDataFrame([], LINKS.schema), spark.createDataFrame([], "key string")
        said = lambda df: df.select("id", "name_lc", "key", "place", "type")
        before, now = said(self.store.read(NODES, base).join(dirty, "key", "left_semi")), said(nodes)
        touched = saved(before.exceptAll(now).unionByName(now.exceptAll(before)).select("id", "name_lc").distinct(), "touched")
        names = touched.select(F.col("name_lc").alias("n")).distinct().unionByName(touched.select(F.lower("id").alias("n"))).distinct()
        held = old_links.join(dirty, "key", "left_anti").select(*old_links.columns)
        again = held.join(names, F.lower("ref") == F.col("n"), "left_semi")
        moved = saved(again.select(*_KEEP).distinct(), "moved")
        keys = moved.select("key").distinct()
        keep = held.join(keys, "key", "left_semi").join(moved.select("key", "place"), ["key", "place"], "left_anti").select(*old_links.columns)
        return moved, keep, keys


NODES_IN = [x.split()[0] for x in NODES.schema.split(", ")]


def edge_bytes_of_links() -> Column:
    return F.coalesce(edge_bytes(), F.lit(100)) + F.length("ref")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def resolved(refs: DataFrame, nodes: DataFrame, numbers: DataFrame) -> DataFrame:
    """Links of references: a row each, or, of scope ``all``, a row for each node; ``target`` is null where there is none.

    Names meet one row each: the first of a name is found before any reference is met.
    """
    slim = nodes.select("id", "name_lc", "file", "type", F.struct("key", "place").alias("seq"))
    one = refs.filter("scope = 'one'").withColumnRenamed("ref_file", "file")
    one = Graph(slim, slim).resolve(one).withColumnRenamed("file", "ref_file").withColumnRenamed("id", "target").select(*_KEEP, "target")
    many = refs.filter("scope = 'all'").join(slim.filter("type <> 'doc'").select(F.col("name_lc").alias("n"), F.col("id").alias("target")), F.lower("ref") == F.col("n"), "left").select(*_KEEP, "target")
    seq = (F.shiftleft("file_no", 32) + F.col("place")).alias("seq")
    id_ = F.concat_ws("-", "type", F.concat("key", F.lit("@"), "place"), "target").alias("id")
    rows = one.unionByName(many).join(numbers, "key").withColumn("seq", seq).withColumn("id", id_)
    return rows.select(*[x.split()[0] for x in LINKS.schema.split(", ")])
