"""Watching a project, and a catalogue that follows its stores."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from lodestone.graph import from_rows
from lodestone.operators import tools
from lodestone.plans import catalog
from lodestone.sources import files, indexer, registry, store
from lodestone.streaming import watch
from lodestone.streaming.watch import _Changes, watch_project


def put(root, name, text):
    os.makedirs(os.path.dirname(root / name), exist_ok=True)
    (root / name).write_text(text)


def test_listing_differences(tmp_path):
    put(tmp_path, "a.md", "1")
    put(tmp_path, "sub/b.md", "1")
    reader = _Changes(f"file://{tmp_path}")
    first = reader.initialOffset()
    rows, same = reader.read(first)
    assert list(rows) == [] and same == first
    put(tmp_path, "a.md", "longer")
    put(tmp_path, "c.md", "1")
    put(tmp_path, "node_modules/x.md", "1")
    os.remove(tmp_path / "sub/b.md")
    rows, second = reader.read(same)
    assert sorted(rows) == [("a.md", "changed"), ("c.md", "new"), ("sub/b.md", "deleted")]
    again = _Changes(str(tmp_path))  # a new process does not know the listing before
    assert list(again.read(second)[0]) == [] and list(again.read(first)[0]) == [("", "resumed")]
    assert list(again.readBetweenOffsets(first, second)) == [("", "resumed")]


def test_bursts_make_one_sync_each(spark, tmp_path):
    root, old = tmp_path / "in", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    put(root, "a.ts", "one two")
    project = indexer.Project(spark, str(tmp_path / "p"), indexer.EXTRACTORS | {"source": catalog._lines})
    project.init(files.listing(spark, str(root)))
    heard, errors, calls = [], [], []
    real = indexer.Project.sync
    query = watch_project(project, str(root), str(tmp_path / "check"), lambda s: heard.append((s.added, s.updated, s.removed)), errors.append, debounce_ms=1500)
    try:
        assert watch.settled(query, lambda: query.lastProgress is not None)
        for i in range(5):  # a burst
            put(root, f"b{i}.ts", f"b{i} one")
        assert watch.settled(query, lambda: len(heard) == 1), (heard, errors)
        put(root, "c.ts", "two one")
        os.remove(root / "b0.ts")
        assert watch.settled(query, lambda: len(heard) == 2), (heard, errors)
        assert heard == [(5, 0, 0), (1, 0, 1)] and project.store.latest() == 2
        os.utime(root / "node_modules") if (root / "node_modules").exists() else put(root, "node_modules/x.ts", "x y")  # nothing to hear of
        version = project.store.latest()
    finally:
        query.stop()
        spark.conf.set("spark.sql.shuffle.partitions", old)
    # a replayed batch finds nothing to do
    assert real(project, files.listing(spark, str(root))).version == version and not errors and not calls
    links = {(r.source, r.target) for r in project.graph().edges.collect()}
    assert ("a.ts#one", "c.ts#two") in links


def test_a_catalogue_follows_its_stores(spark, tmp_path):
    g = lambda n: from_rows(spark, [{"id": f"n{i}", "file": "f"} for i in range(n)], [])
    paths = {x: f"file://{tmp_path}/{x}" for x in "abc"}
    store.save(g(2), paths["a"])
    rows = spark.createDataFrame([("default", x, p, 1) for x, p in paths.items()] + [("other", "z", paths["a"], 1)], registry.COLUMNS)
    held = registry.Catalogue(spark)
    assert held.refresh(rows) == {"a": "added"} and held.refresh(rows) == {}
    before = held.projects["a"].graph
    assert held.projects["a"].stats == {"nodes": 2, "files": 0}
    store.save(g(3), paths["b"])
    # a store committed in between
    kept = held.projects["a"]
    more = g(4).nodes.select("*", F.lit("f").alias("key"), F.lit(None).cast("long").alias("place"))
    registry.Versions(spark, paths["a"]).commit({store.NODES: (None, more, F.lit(1))}, 0)
    assert held.refresh(rows) == {"a": "updated", "b": "added"}
    assert held.projects["a"].graph.nodes.count() == 4 and kept.graph.nodes.count() == before.nodes.count() == 2
    assert held.refresh(rows.filter("project <> 'b'")) == {"b": "removed"} and list(held.projects) == ["a"]


def test_corrupt_projects_are_passed_over_and_data_goes(spark, tmp_path):
    g = from_rows(spark, [{"id": "n"}], [])
    paths = {x: f"file://{tmp_path}/{x}" for x in "ab"}
    for p in paths.values():
        store.save(g, p)
    shutil.rmtree(tmp_path / "b/data")
    rows = spark.createDataFrame([("s", x, p, 1) for x, p in paths.items()], registry.COLUMNS)
    assert list(registry.load_all(spark, rows, "s")) == ["a"]
    left = registry.remove_project(rows, "s", "b", data=True)
    assert not (tmp_path / "b").exists() and [r.project for r in left.collect()] == ["a"]
    assert registry.delete_scope(left, "s", data=True).count() == 0 and not (tmp_path / "a").exists()


def test_stores_are_resolved(spark, tmp_path):
    rows = spark.createDataFrame([("default", "app", "/far/app", 1), ("default", f"{tmp_path}/lib", "/far/lib", 1), ("other", "app", "/other/app", 1)], registry.COLUMNS)
    assert registry.resolve_store(rows, f"{tmp_path}/app/") == "/far/app" and registry.resolve_store(rows, f"{tmp_path}/app", "other") == "/other/app"
    assert registry.resolve_store(rows, f"{tmp_path}/lib", shared=True) == "/far/lib"
    local = f"{tmp_path}/app/.lodestone/default"
    assert registry.resolve_store(rows, f"{tmp_path}/none") == f"{tmp_path}/none/.lodestone/default"
    store.save(from_rows(spark, [{"id": "n"}], []), local)
    assert registry.resolve_store(rows, f"{tmp_path}/app") == local and registry.resolve_store(rows, f"{tmp_path}/app", shared=True) == "/far/app"
    for bad in ({"shared": True}, {"scope": "Bad"}):
        with pytest.raises(ValueError):
            registry.resolve_store(rows, f"{tmp_path}/none", **bad)


def test_arguments():
    args = {"a": "x", "n": "12", "e": "", "f": 3.5, "b": "many", "i": float("inf"), "l": [1]}
    assert tools.text_argument(args, "a", needed=True) == "x" and tools.text_argument(args, "z") is None and tools.text_argument(args, "f") == "3.5"
    for key in ("e", "z", "f"):
        with pytest.raises(ValueError, match=f'"{key}" must be a non-empty string'):
            tools.text_argument(args, key, needed=True)
    assert [tools.number_argument(args, k, 7) for k in ("n", "f", "b", "i", "z", "l", "e")] == [12, 3.5, 7, 7, 7, 7, 0]
