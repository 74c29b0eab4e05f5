"""Projects and scopes as rows: scope, project, path (of the store), last_sync."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.columns import age
from lodestone.graph import Graph
from lodestone.sources import folders, store
from lodestone.sources.versions import Versions

COLUMNS = "scope string, project string, path string, last_sync long"


def register(registry: DataFrame, scope: str, project: str, path: str, now: int) -> DataFrame:
    """The registry with a project, new or synced again."""
    row = registry.sparkSession.createDataFrame([(store.check_scope(scope), project, path, now)], COLUMNS)
    return remove_project(registry, scope, project).unionByName(row)


def remove_project(registry: DataFrame, scope: str, project: str, data: bool = False) -> DataFrame:
    """The registry without a project; with ``data`` its store is deleted, too, and a project that is not there is an error."""
    own = (F.col("scope") == scope) & (F.col("project") == project)
    if data:
        paths = [r.path for r in registry.filter(own).select("path").collect()]
        if not paths:
            raise ValueError(f"Project not found in registry: {project}")
        for p in paths:
            folders.delete(registry.sparkSession, p)
    return registry.filter(~own)


def delete_scope(registry: DataFrame, scope: str, data: bool = False) -> DataFrame:
    """The default scope can't be deleted, nor one that isn't there; with ``data`` the stores go, too."""
    if scope == "default":
        raise ValueError("Cannot delete the 'default' scope.")
    own = registry.filter(F.col("scope") == scope)
    if own.isEmpty():
        raise ValueError(f"Scope '{scope}' does not exist.")
    if data:
        for r in own.select("path").toLocalIterator():
            folders.delete(registry.sparkSession, r.path)
    return registry.filter(F.col("scope") != scope)


def resolve_store(registry: DataFrame, root: str, scope: str = "default", shared: bool = False) -> str:
    """The path of a project's store: the one in its folder, else the registered one of its scope, by path or else by the folder's name;
    where there is neither, the one that its folder would have. With ``shared`` only the registered one, or an error."""
    spark, root = registry.sparkSession, root.rstrip("/")
    local = f"{root}/.lodestone/{store.check_scope(scope)}"
    if not shared and Versions(spark, local).latest() is not None:
        return local
    name = root.rsplit("/", 1)[-1]
    near = registry.filter((F.col("scope") == scope) & F.col("project").isin(root, name)).orderBy(F.col("project") == name).select("path").limit(1).collect()
    if near:
        return near[0].path
    if shared:
        raise ValueError(f"Project not found in registry: {root}")
    return local


@dataclass
class Entry:
    """A project of a scope: its store's version, and its graph, which is opened when it is first asked for."""

    spark: SparkSession
    path: str
    version: int

    @functools.cached_property
    def graph(self) -> Graph:
        return store.load(self.spark, self.path, self.version)

    @functools.cached_property
    def stats(self) -> dict:
        """nodes and files, from the log of the store alone."""
        n = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rows"))), F.lit(0))
        return Versions(self.spark, self.path).parts(self.version).agg(n("nodes").alias("nodes"), n("files").alias("files")).first().asDict()


@dataclass
class Catalogue:
    """The projects of a scope, by name. ``refresh`` looks at the registry and at the stores' versions, and opens nothing.

    Projects without a readable store are passed over. What was taken from an entry before stays as it was: it reads its own version.
    """

    spark: SparkSession
    scope: str = "default"
    projects: dict[str, Entry] = field(default_factory=dict)

    def refresh(self, registry: DataFrame) -> dict[str, str]:
        """Bring the projects up to date; tells which were added, updated or removed."""
        known = {r.project: r.path for r in registry.filter(F.col("scope") == self.scope).select("project", "path").collect()}  # a small row a project
        said = {}
        for name in [x for x in self.projects if x not in known]:
            del self.projects[name]
            said[name] = "removed"
        for name, path in sorted(known.items()):
            old = self.projects.get(name)
            try:
                version = Versions(self.spark, path).latest()
            except Exception:  # a store that can't be listed: the project stays as it was
                version = None
            if version is None or (old and (old.path, old.version) == (path, version)):
                continue
            self.projects[name] = Entry(self.spark, path, version)
            said[name] = "updated" if old else "added"
        return said

    def graphs(self) -> dict[str, Graph]:
        """All graphs that can be opened; a corrupt project is passed over."""
        out = {}
        for name, entry in self.projects.items():
            try:
                out[name] = entry.graph
            except Exception:  # its log or its files are gone or broken
                continue
        return out


def load_all(spark: SparkSession, registry: DataFrame, scope: str) -> dict[str, Graph]:
    """The graphs of a scope's projects; nothing of them is read before it is asked for, and a corrupt project is passed over."""
    found = Catalogue(spark, scope)
    found.refresh(registry)
    return found.graphs()


def described(registry: DataFrame, stats: DataFrame, now: int) -> DataFrame:
    """Projects with nodes, edges, files (of ``store.list_projects``) and the age of the last sync."""
    return registry.join(stats, "project", "left").withColumn("age", F.when(F.col("last_sync") > 0, age(F.lit(now) - F.col("last_sync"))).otherwise("never"))
