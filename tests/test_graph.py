"""Small graphs with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone import graph as G
from lodestone import scratch
from lodestone.operators import analysis, context, query, tools, traverse
from lodestone.scratch import numbered
from lodestone.sources import files, markdown, registry, store
from lodestone.streaming.watch import watch


def calls(spark, pairs, **more):
    ids = sorted({x for p in pairs for x in p[:2]})
    return G.from_rows(spark, [{"id": i, **more.get(i, {})} for i in ids], [{"source": p[0], "target": p[1], "type": p[2] if len(p) > 2 else "calls"} for p in pairs])


def listed(df, *cols, by="ord"):
    return [tuple(r[c] for c in cols) for r in df.orderBy(by).collect()]


DIAMOND = [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "E")]


def test_bfs_and_dfs(spark):
    g = calls(spark, DIAMOND)
    assert listed(traverse.bfs(g, ["A"], ordered=True), "id", "depth", "parent_id", by=["depth", "ord"]) == [("A", 0, None), ("B", 1, "A"), ("C", 1, "A"), ("D", 2, "B"), ("E", 3, "D")]
    assert {r.id for r in traverse.bfs(g, ["A"], 1).collect()} == {"A", "B", "C"}
    assert {r.id for r in traverse.bfs(g, ["D"], direction="inbound").collect()} == {"A", "B", "C", "D"}
    assert traverse.bfs(g, ["nope"]).collect() == []
    assert listed(traverse.dfs(g, "A"), "id") == [("A",), ("B",), ("D",), ("E",), ("C",)]


def test_bounded_dfs_can_miss_what_bfs_finds(spark):
    g = calls(spark, [("S", "A"), ("A", "B"), ("B", "C"), ("C", "D"), ("S", "C")])
    assert "D" not in {r.id for r in traverse.dfs(g, "S", 3).collect()}
    assert "D" in {r.id for r in traverse.bfs(g, ["S"], 3).collect()}


def test_random_multigraph_against_a_queue(spark):
    rng = random.Random(2)
    pairs = [(f"n{rng.randrange(25):02}", f"n{rng.randrange(25):02}") for _ in range(60)]
    g = calls(spark, pairs)
    start = pairs[0][0]
    seen, queue, want = {start}, [(start, 0)], [(start, 0, None)]
    while queue:
        node, depth = queue.pop(0)
        for other in [b for a, b in pairs if a == node] + [a for a, b in pairs if b == node]:
            if other not in seen:
                seen.add(other)
                queue.append((other, depth + 1))
                want.append((other, depth + 1, node))
    assert listed(traverse.bfs(g, [start], direction="both", ordered=True), "id", "depth", "parent_id", by=["depth", "ord"]) == want


def test_impact(spark):
    g = calls(spark, [("login", "validate"), ("handle", "login"), ("route", "handle")])
    found = analysis.impact_of(g, "validate")
    assert listed(found, "id", "distance", "path", by="distance") == [("login", 1, ["validate", "login"]), ("handle", 2, ["validate", "login", "handle"]), ("route", 3, ["validate", "login", "handle", "route"])]
    assert [r.id for r in analysis.impact_of(g, "validate", max_depth=0).collect()] == ["login"]
    assert {r.id for r in analysis.impact_of(g, "route", direction="dependencies").collect()} == {"handle", "login", "validate"}
    with pytest.raises(ValueError, match="Node not found: nope"):
        analysis.impact_of(g, "nope")


def test_queries_and_search(spark):
    nodes = [
        {"id": "handleLogin", "file": "src/auth.ts", "content": "async", "metadata": '{"isAsync":"true"}'}, {"id": "handleLogout", "file": "src/auth.ts"},
        {"id": "UserService", "type": "class", "file": "src/user.ts"}, {"id": "MAX_RETRIES", "type": "variable", "file": "src/config.ts"},
    ]
    g = G.from_rows(spark, nodes, [{"source": "handleLogin", "target": "UserService"}])
    q = query.Query(g)
    assert q.of_type("function").count() == 2 and q.of_type().count() == 0
    assert q.in_file(regex=r"\.ts$").count() == 4 and q.with_name(regex="^handle").count() == 2
    assert q.with_content("async").count() == q.with_metadata("isAsync", "true").count() == 1
    assert [r.id for r in q.with_out_edge("calls").results().collect()] == ["handleLogin"]
    assert q.of_type("module").first().collect() == []
    assert listed(query.ranked(query.search(g, "handlelogin"), 5), "id", "score", by="rank") == [("handleLogin", 59)]


def test_changes(spark):
    g = calls(spark, DIAMOND)
    assert g.remove_nodes(g.node("D").select("id")).edges.count() == 2
    assert [r.times for r in g.successors("A").groupBy("id").count().withColumnRenamed("count", "times").collect()] == [1, 1]
    with pytest.raises(ValueError, match="unknown end"):
        g.add_edges(g.edges.limit(1).selectExpr("seq", "'x' as id", "source", "'nope' as target", "type", "weight", "metadata"))
    with pytest.raises(ValueError, match="exists"):
        g.add_edges(g.edges.limit(1))
    assert g.clear().nodes.count() == 0 and G.empty(spark).counts().first().nodes == 0


def test_unused(spark):
    names = [("src/utils.ts", "file"), ("validate", "function"), ("deprecatedHelper", "function"), ("unusedExport", "function"), ("src/handler.ts", "file"), ("handleRequest", "function")]
    nodes = [{"id": n, "type": t, "file": "src/handler.ts" if "andle" in n else "src/utils.ts"} for n, t in names]
    nodes[2]["file"] = "src/utils.ts"
    g = G.from_rows(spark, nodes, [{"source": "src/utils.ts", "target": "unusedExport", "type": "exports"}, {"source": "handleRequest", "target": "validate"}])
    got = listed(analysis.unused(g), "id", "confidence", "reason", by=["unsure", "file", "seq"])
    assert got == [("handleRequest", "high", "no-callers"), ("deprecatedHelper", "high", "no-callers"), ("unusedExport", "medium", "no-importers")]


def test_context_fits_the_budget(spark, monkeypatch):
    sizes = {"login": (200, 0), "auth": (0, 0), "validate": (400, 40), "token": (300, 32)}
    nodes = [{"id": k, "name": "n" * 20, "content": "c" * a, "signature": "s" * b} for k, (a, b) in sizes.items()]
    g = G.from_rows(spark, nodes, [{"source": "auth", "target": "login", "type": "contains"}, {"source": "login", "target": "validate"}, {"source": "login", "target": "token"}])
    full = {r.id: r.tokens for r in context.build_context(g, ["login"], 10_000).collect()}
    assert full == {"login": 50, "auth": 1, "validate": 15, "token": 13}
    assert [r.id for r in context.build_context(g, ["login"], 64).orderBy("place").collect()] == ["login", "auth", "token"]
    assert [r.id for r in context.build_context(g, ["login"], 10).collect()] == ["login"]
    whole = context.build_context(g, ["login"], 64).orderBy("place").collect()
    monkeypatch.setattr(context, "BLOCK", 1)
    assert context.build_context(g, ["login"], 64).orderBy("place").collect() == whole


def test_vectors(spark):
    g = G.from_rows(spark, [{"id": "a", "embedding": [1.0, 0.0]}, {"id": "b", "embedding": [0.9, 0.1]}, {"id": "c", "embedding": [0.0, 0.0]}, {"id": "d"}], [])
    assert [(r.id, round(r.score, 6)) for r in context.find_similar(g, [1.0, 0.0], 3).collect()] == [("a", 1.0), ("b", 0.993884), ("c", 0.0)]
    with pytest.raises(ValueError):
        context.find_similar(g, [1.0, 0.0], 0)


def test_markdown(spark):
    files = spark.createDataFrame([("a.md", "intro\n# One\ntext `foo` and `foo`\n\n## Two\n\n# Three\nx"), ("b.md", "no heading"), ("c.md", None)], "path string, text string")
    found = markdown.sections(files)
    assert listed(found, "path", "section", "level", "title", by="section") == [("a.md", 1, 1, "One"), ("a.md", 3, 1, "Three")]
    g = G.from_rows(spark, [{"id": "f1", "name": "Foo"}, {"id": "f2", "name": "foo", "type": "doc"}], [])
    assert [(r.section, r.id) for r in markdown.links(found, g).collect()] == [(1, "f1")]


def test_store_and_json(spark, tmp_path):
    g = calls(spark, DIAMOND)
    store.save(g, f"file://{tmp_path}/s")
    back = store.load(spark, f"file://{tmp_path}/s")
    assert sorted(r.id for r in back.nodes.collect()) == list("ABCDE") and back.edges.count() == 5
    again = store.from_json(store.to_json(g))
    assert sorted(again.edges.collect()) == sorted(g.edges.collect())
    with pytest.raises(ValueError):
        store.check_scope("Bad")
    assert store.resolve_scope(None, "env", "config") == "env"


def test_watch(spark, tmp_path):
    spark.createDataFrame([("a.md", "# T\nx")], "path string, text string").write.parquet(f"{tmp_path}/in")
    seen = []
    watch(spark, f"{tmp_path}/in", "path string, text string", lambda df, n: seen.append(markdown.sections(df).count()), f"{tmp_path}/check").awaitTermination()
    assert seen == [1]


def test_files_and_ignore_rules(spark, tmp_path):
    for name, data in (("src/a.ts", b"x"), ("src/b.ts", b"x\0"), ("node_modules/c.ts", b"x"), ("d.md", b"# T"), ("e.png", b"x"), ("gen/f.ts", b"x"), ("gen/keep.ts", b"x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = files.discover(files.listing(spark, f"file://{tmp_path}"), ["gen/*", "!keep.ts"])
    assert sorted((r.path, r.kind) for r in found.collect()) == [("d.md", "doc"), ("gen/keep.ts", "source"), ("src/a.ts", "source")]
    assert files.ignore_pattern("# x") is None and files.ignore_pattern("a.b/") == (r"(?:^|/)a\.b(?:/|$)", False)
    assert files.manifest(files.listing(spark, f"file://{tmp_path}", with_content=False)).count() == 7


def test_registry_and_projects(spark, tmp_path):
    rows = registry.register(spark.createDataFrame([], registry.COLUMNS), "default", "p", f"file://{tmp_path}/p", 5)
    store.save(calls(spark, DIAMOND), f"file://{tmp_path}/p")
    loaded = registry.load_all(spark, rows, "default")
    assert tools.impact(loaded, "E")[1].count() == 4 and tools.unused(loaded, type_="function").count() == 1
    with pytest.raises(ValueError, match="Project not found: q"):
        tools.search(loaded, "A", project="q")
    with pytest.raises(ValueError, match="Cannot delete"):
        registry.delete_scope(rows, "default")
    assert registry.remove_project(rows, "default", "p").count() == 0


def test_numbers_over_ranges(spark):
    rows = numbered(spark.range(1000).selectExpr("(id * 7919) % 1000 as x").repartition(7), "n", "x")
    assert all(r.n == r.x + 1 for r in rows.collect())


def test_entry_files_and_stored_ids(spark):
    g = G.from_rows(spark, [{"id": "a", "file": "src/setup.ts"}, {"id": "b", "file": "main.tsx"}, {"id": "c", "file": "x/index.ts"}], [])
    assert [r.id for r in analysis.unused(g).collect()] == ["b"]
    twice = G.Graph(g.nodes.unionByName(g.nodes.withColumn("seq", g.nodes["seq"] + 9).withColumn("name", g.nodes["id"])), g.edges)
    assert sorted(r.seq for r in store.sound(twice).nodes.collect()) == [0, 1, 2]


def test_rows_move_only_where_an_id_is_there_twice(spark, tmp_path):
    """Later rows of an id go, null ids count as one, and whole rows of a sound graph stay where they are."""
    g = G.from_rows(spark, [{"id": x} for x in "abc"], [{"id": "e1", "source": "a", "target": "b"}, {"id": "e2", "source": "b", "target": "c"}])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(store.sound(g).nodes) + plan(store.sound(g).edges)
    added = g.add_nodes(spark.createDataFrame([(9, "a", "new"), (8, "d", "x"), (7, "d", "y"), (6, None, "n"), (5, None, "m")], "seq long, id string, name string"))
    assert sorted((r.id or "", r.name) for r in added.nodes.collect()) == [("", "m"), ("a", "a"), ("b", "b"), ("c", "c"), ("d", "y")]
    assert "Exchange" not in plan(g.add_nodes(spark.createDataFrame([(9, "z")], "seq long, id string")).nodes)
    bad = g.edges.unionByName(g.edges.filter("id = 'e1'").withColumn("seq", g.edges["seq"] + 9)).unionByName(g.edges.limit(1).withColumn("target", F.lit("nobody")).withColumn("id", F.lit("e3")))
    bad = bad.unionByName(g.edges.limit(1).withColumn("target", F.lit(None).cast("string")).withColumn("id", F.lit("e4")))
    store.snapshot(G.Graph(g.nodes, bad), f"file://{tmp_path}/s")
    back = store.from_snapshot(spark, f"file://{tmp_path}/s")
    assert sorted((r.id, r.seq) for r in back.edges.collect()) == [("e1", 0), ("e2", 1)] and back.nodes.count() == 3
    one = spark.read.schema("kind string, json string").json(f"file://{tmp_path}/s").filter("kind = 'node'")
    assert one.count() == 3 and all("kind=node" in x for x in one.select(F.input_file_name()).distinct().toPandas().iloc[:, 0])


def test_parts_follow_the_rows_that_a_task_keeps(spark, monkeypatch):
    monkeypatch.setattr(scratch, "TASK_ROWS", 8)
    names = [f"n{i}" for i in range(100)]
    edges = [{"source": "hub", "target": x, "type": "contains"} for x in names] + [{"source": "n1", "target": x, "type": "contains"} for x in names[:9]] + [{"source": "n3", "target": "n3"}]
    g = G.from_rows(spark, [{"id": "hub", "type": "file"}, *[{"id": x} for x in names]], edges)
    dealt, tasks = scratch.dealt, []
    monkeypatch.setattr(analysis, "dealt", lambda *x: tasks.append(dealt(*x).select(F.spark_partition_id()).distinct().count()) or dealt(*x))
    assert {r.id: r.degree for r in analysis.degrees(g).collect()} == {x: 1 + (i < 9) + 9 * (i == 1) + 2 * (i == 3) for i, x in enumerate(names)}
    assert analysis.status(g).first().isolated == 0
    # the last edge decides: the first nine belong to n1
    assert {r.id: r.children for r in analysis.child_counts(g).collect()} == {"hub": 92, "n1": 9}
    assert len(tasks) == 3 and min(tasks) > 8


def exchanged(plan) -> int:
    """Rows that the exchanges of a plan have moved, each exchange once."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return exchanged(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return exchanged(plan.plan())
    if kind == "ReusedExchangeExec":
        return 0
    own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(exchanged(plan.children().apply(i)) for i in range(plan.children().size()))


@pytest.mark.parametrize("words", [1, 1 << 20])
@pytest.mark.parametrize("few", [0, 100_000])
def test_a_sync_moves_only_edges_that_may_go(spark, monkeypatch, few, words):
    """Odd rows too: ends that are null or no nodes, an id in two files, ids that go and come back."""
    monkeypatch.setattr(scratch, "BROADCAST_ROWS", few)
    monkeypatch.setattr(scratch, "FILTER_WORDS", words)
    rng, ids = random.Random(5), [f"n{i}" for i in range(500)]
    node = lambda i, file: {"id": i, "file": file}
    old = [node(x, f"f{i % 25}" if i % 9 else None) for i, x in enumerate(ids)]
    twice = [node(x, "f9") for x in ids[1:60:25]]
    ends = [*ids, "nobody", None]
    edges = [{"id": f"e{i}", "source": rng.choice(ends), "target": rng.choice(ends)} for i in range(4000)]
    new = [node(x, "f1") for x in ids[26:300:25]] + [node("fresh", "f2")]
    more = [{"id": f"m{i}", "source": rng.choice([n["id"] for n in new]), "target": rng.choice([*ends, "fresh"])} for i in range(300)]
    g, own = G.from_rows(spark, old, edges), G.from_rows(spark, new, more)
    g = G.Graph(g.nodes.unionByName(G.from_rows(spark, twice, []).nodes), g.edges)
    dirty = {"f1", "f2", "gone"}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        synced = store.sync(g, own, spark.createDataFrame([(x,) for x in sorted(dirty)], "path string"))
        found = synced.edges.select("id", "source", "target")
        rows = [tuple(r) for r in found.collect()]
        some = spark.createDataFrame([(x,) for x in ids[::7]], "id string")
        assert sorted(r.id for r in scratch.within(g.edges, "source", some, len(ids[::7])).collect()) == sorted(e["id"] for e in edges if e["source"] in ids[::7])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    gone = {n["id"] for n in old + twice if n["file"] in dirty}
    there = {n["id"] for n in old + twice if n["file"] not in dirty} | {n["id"] for n in new}
    kept = [e for e in edges if e["source"] not in gone] + more
    assert sorted(rows) == sorted((e["id"], e["source"], e["target"]) for e in kept if {e["source"], e["target"]} <= there)
    assert synced.nodes.count() == sum(n["file"] not in dirty for n in old + twice) + len(new)
    if few or words > 1:
        assert exchanged(found._jdf.queryExecution().executedPlan()) < len(edges) / 2
