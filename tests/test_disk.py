"""What the queries move and write: tables of large graphs are made with few shuffles, and a query moves little beside them."""

import glob
import re

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from test_graph import exchanged

from lodestone import scratch
from lodestone.graph import from_rows
from lodestone.operators import analysis, traverse
from lodestone.plans import catalog
from lodestone.sources import folders, sample, store

SF = "/root/testdata/sf0.001"


def test_the_sample_graph_is_that_of_its_sql(spark, tmp_path):
    """Odd rows too: lines of one number, orders without customers, lines without orders, parts or suppliers, keys that are there twice."""
    for t in sample.TABLES:
        rows = pa.Table.from_batches(pq.read_table(f"{SF}/{t}.parquet").to_batches())
        if t in ("lineitem", "supplier", "customer"):
            rows = pa.concat_tables([rows, rows.slice(0, 3)])
        if t == "lineitem":
            more = rows.slice(5, 200)
            at = more.schema.get_field_index("l_returnflag")
            rows = pa.concat_tables([rows, more.set_column(at, more.schema.field(at), pa.array(["X", None] * 100, more.schema.field(at).type))])
        if t in ("orders", "part", "supplier"):
            rows = rows.slice(0, rows.num_rows - rows.num_rows // 10)
        pq.write_table(rows, tmp_path / f"{t}.parquet")
    frames = {t: spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in sample.TABLES}
    g = sample.sample_graph(spark, str(tmp_path))
    for got, sql in ((g.nodes, sample.NODES_FULL), (g.edges, sample.EDGES_FULL)):
        text = sql.replace("'{}'", "'{{}}'").replace("'{\"done\":\"true\"}'", "'{{\"done\":\"true\"}}'")
        want = spark.sql(text, **{t: frames[t] for t in set(re.findall(r"\{(\w+)\}", sql))})
        want = want.withColumn("embedding", F.col("embedding").cast("array<double>")) if "embedding" in want.columns else want
        assert got.dtypes == want.dtypes and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_a_side_that_is_broadcast_holds_no_subquery(spark):
    g = sample.sample_graph(spark, SF)
    assert "subquery" not in g.edges._jdf.queryExecution().optimizedPlan().toString().lower()


def test_lines_move_twice(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = sample.sample_graph(spark, SF).edges
        edges.collect()
        lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
        assert exchanged(edges._jdf.queryExecution().executedPlan()) < 3.5 * lines
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_search_stores_no_steps(spark):
    catalog._STORED.clear()
    assert catalog.queries()["rank_by_relevance"](spark, SF).count() > 1
    (held,) = catalog._STORED.values()
    assert set(held.values()) == {held["nodes"], held["edges"]}


def test_plain_edges_of_a_large_frontier_and_of_unknown_ends(spark, monkeypatch):
    monkeypatch.setattr(scratch, "BROADCAST_ROWS", 2)
    edges = [{"source": f"n{i}", "target": f"n{(i * 7 + 1) % 40}"} for i in range(30)] + [{"source": f"n{i}", "target": "nobody"} for i in range(30)]
    g = from_rows(spark, [{"id": f"n{i}"} for i in range(40)], edges)
    seeds = [f"n{i}" for i in range(10)]
    want = {(i, f"n{(i * 7 + 1) % 40}") for i in range(10)}
    assert {(r.seed_ord, r.id) for r in traverse.bfs(g, seeds, 1).filter("depth = 1").collect()} == {x for x in want if seeds[x[0]] != x[1]}
    inside = set(seeds) | {x for _, x in want}
    found = traverse.subgraph(g, seeds, 1, direction="outbound")
    assert {r.id for r in found.nodes.collect()} == inside
    assert sorted((r.source, r.target) for r in found.edges.collect()) == sorted((e["source"], e["target"]) for e in edges if {e["source"], e["target"]} <= inside)


def test_ends_are_counted_in_runs_before_they_move(spark, monkeypatch):
    edges = [{"source": f"n{i % 5}", "target": f"n{i % 7}"} for i in range(2000)]
    g = from_rows(spark, [{"id": f"n{i}"} for i in range(7)], edges)
    want = {f"n{k}": sum((e["source"] == f"n{k}") + (e["target"] == f"n{k}") for e in edges) for k in range(7)}
    for most in (1 << 19, 1):  # a run holds a batch at least
        monkeypatch.setattr(analysis, "COUNTED", most)
        found = analysis.degrees(g).select("id", "degree")
        assert {r.id: r.degree for r in found.collect()} == want
        assert exchanged(found._jdf.queryExecution().executedPlan()) < len(edges) / 2


def test_bins_move_nodes_few_times(spark):
    n = 300
    g = from_rows(spark, [{"id": f"n{i}", "file": f"a/f{i % 3}"} for i in range(n)], [])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = store.bins(g, 5_000)
        assert found.count() == len(found.collect()) == n
        assert exchanged(found._jdf.queryExecution().executedPlan()) <= 4 * n + 10
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_what_is_written_frees_its_shuffles(spark, tmp_path):
    before, seen = spark.conf.get(scratch.CLEANUP), []
    with scratch.freeing(spark):
        with scratch.freeing(spark):
            seen.append(spark.conf.get(scratch.CLEANUP))
        seen.append(spark.conf.get(scratch.CLEANUP))
    assert seen == ["true", "true"] and spark.conf.get(scratch.CLEANUP) == before
    rows = spark.range(1000).repartition(3, "id")
    assert scratch.saved(rows).count() == rows.count() == rows.count() == 1000
    g = from_rows(spark, [{"id": "a"}, {"id": "b"}], [{"source": "a", "target": "b"}])
    store.save(g, f"file://{tmp_path}/s")
    assert glob.glob(f"{tmp_path}/s/data/*/*/*.zstd.parquet") and folders.exists(spark, f"file://{tmp_path}/s")
    assert store.load(spark, f"file://{tmp_path}/s").edges.count() == 1


def test_the_context_of_a_file_has_its_whole_budget(spark):
    rows = catalog.queries()["context_for_file"](spark, SF).orderBy("place").collect()
    assert [r.place for r in rows] == list(range(len(rows))) and len({r.id for r in rows}) == len(rows) > 100
    assert [r.role for r in rows] == ["target"] + ["context"] * (len(rows) - 1)
    assert 3900 < sum(r.tokens for r in rows) <= 4000
    assert {r.id.split("/")[0] for r in rows} > {"brand"}
