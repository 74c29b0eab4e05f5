"""A property graph made from the star-schema tables; the same SQL runs on Spark and on other engines."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.graph import Graph
from lodestone.scratch import sized

#: Most suppliers (two numbers each) that are broadcast.
SUPPLIERS = 1 << 20

NODES_SQL = """
select cast(r_regionkey as bigint) as seq, 'region/' || r_regionkey as id, 'module' as type, r_name as name, '' as content, '' as signature, cast(null as string) as file, cast(null as bigint) as start_line, '{}' as metadata, cast(null as bigint) as vec from {region}
union all select 1000 + n_nationkey, 'nation/' || n_nationkey, 'file', n_name, '', '', 'nation/' || n_nationkey, null, '{}', null from {nation}
union all select 2000 + dense_rank() over (order by p_brand), 'brand/' || p_brand, 'file', p_brand, '', '', 'brand/' || p_brand, null, '{}', null from (select distinct p_brand from {part}) as b
union all select 1000000000000 + c_custkey, 'nation/' || c_nationkey || '#c' || c_custkey, 'class', c_name, '', c_mktsegment, 'nation/' || c_nationkey, null, '{}', null from {customer}
union all select 2000000000000 + s_suppkey, 'nation/' || s_nationkey || '#s' || s_suppkey, 'class', s_name, '', '', 'nation/' || s_nationkey, null, '{}', null from {supplier}
union all select 3000000000000 + o_orderkey, 'nation/' || c_nationkey || '#o' || o_orderkey, 'function', 'o' || o_orderkey, o_orderpriority || ' ' || o_orderstatus, '', 'nation/' || c_nationkey, o_orderkey, case when o_orderstatus = 'F' then '{"done":"true"}' else '{}' end, null from {orders} join {customer} on o_custkey = c_custkey
union all select 4000000000000 + p_partkey, 'brand/' || p_brand || '#p' || p_partkey, case when p_size < 25 then 'variable' else 'type' end, p_name, '', p_type, 'brand/' || p_brand, null, '{}', p_partkey from {part}
union all select 5000000000000 + doc_id, 'doc/' || doc_id, 'doc', source, text, '', null, null, '{}', null from {documents}
union all select 6000000000000 + item_id, 'bench/' || item_id, 'snippet', 'b' || item_id, text, '', null, null, '{}', null from {benchmark}
"""

EDGES_SQL = """
select 1000 + n_nationkey as seq, 'region/' || n_regionkey as source, 'nation/' || n_nationkey as target, 'contains' as type, cast(1 as double) as weight from {nation}
union all select 1000000000000 + c_custkey, 'nation/' || c_nationkey, 'nation/' || c_nationkey || '#c' || c_custkey, 'contains', 1 from {customer}
union all select 2000000000000 + s_suppkey, 'nation/' || s_nationkey, 'nation/' || s_nationkey || '#s' || s_suppkey, 'contains', 1 from {supplier}
union all select 3000000000000 + o_orderkey, 'nation/' || c_nationkey, 'nation/' || c_nationkey || '#o' || o_orderkey, 'contains', 1 from {orders} join {customer} on o_custkey = c_custkey
union all select 4000000000000 + p_partkey, 'brand/' || p_brand, 'brand/' || p_brand || '#p' || p_partkey, 'contains', 1 from {part}
union all select 5000000000000 + o_orderkey, 'nation/' || c_nationkey || '#o' || o_orderkey, 'nation/' || c_nationkey || '#c' || c_custkey, 'calls', 1 from {orders} join {customer} on o_custkey = c_custkey
union all select 6000000000000 + l_orderkey * 1000 + n, 'nation/' || c_nationkey || '#o' || o_orderkey, 'brand/' || p_brand || '#p' || p_partkey, case l_returnflag when 'R' then 'references' when 'A' then 'imports' else 'depends_on' end, l_quantity
  from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as n from {lineitem}) as l
  join {orders} on l_orderkey = o_orderkey join {customer} on o_custkey = c_custkey join {part} on l_partkey = p_partkey
union all select 700000000000000 + l_suppkey * 1000000000 + l_partkey, 'nation/' || s_nationkey || '#s' || s_suppkey, 'brand/' || p_brand || '#p' || p_partkey, 'implements', 1
  from (select distinct l_suppkey, l_partkey from {lineitem}) as d join {supplier} on l_suppkey = s_suppkey join {part} on l_partkey = p_partkey
union all select 9000000000000000 + a.p_partkey, 'brand/' || a.p_brand || '#p' || a.p_partkey, 'brand/' || b.p_brand || '#p' || b.p_partkey, 'extends', 1 from {part} as a join {part} as b on b.p_partkey = cast(floor(a.p_partkey / 2) as bigint) where a.p_partkey > 0
union all select 9100000000000000 + p_partkey, 'brand/' || p_brand, 'brand/' || p_brand || '#p' || p_partkey, 'exports', 1 from {part} where p_partkey % 3 = 0
union all select 9200000000000000 + c_custkey, 'nation/' || c_nationkey, 'nation/' || c_nationkey || '#c' || c_custkey, 'exports', 1 from {customer} where c_mktsegment = 'BUILDING'
union all select 9300000000000000 + doc_id, 'doc/' || doc_id, 'brand/' || p_brand || '#p' || p_partkey, 'documents', 1 from {documents} join {part} on p_partkey = doc_id % (select count(*) from {part})
union all select 9400000000000000 + d.doc_id, 'doc/' || d.doc_id, 'bench/' || item_id, 'tagged_with', 1 from {documents} as d join (select distinct doc_id from {labels} where toxic = 1) as t on t.doc_id = d.doc_id join {benchmark} on item_id = d.doc_id % 40
"""

NODES_FULL = "select seq, id, type, name, lower(name) as name_lc, name as qualified_name, content, signature, file, start_line, metadata, v.embedding from (" + NODES_SQL + ") as n left join (select vec_id, embedding from {embeddings}) as v on v.vec_id = n.vec"
EDGES_FULL = "select seq, type || '-' || seq as id, source, target, type, weight, '{}' as metadata from (" + EDGES_SQL + ") as e"
PARTS = "(select count(*) from {part})"
TABLES = ["region", "nation", "part", "customer", "supplier", "orders", "lineitem", "documents", "benchmark", "labels", "embeddings"]


def named(sql: str) -> str:
    """The statement with plain table names, as any SQL engine runs it."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def sample_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The rows of ``NODES_FULL`` and ``EDGES_FULL``. What would move large tables more often than it must is said in joins of its own."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}

    def run(sql: str) -> DataFrame:
        if PARTS in sql:  # as a number: a side that is broadcast by a key with a subquery in it may be asked for before the subquery is done, an error
            sql = sql.replace(PARTS, str(frames["part"].count() or "null"))
        used = set(re.findall(r"\{(\w+)\}", sql))
        return spark.sql(sql.replace("'{}'", "'{{}}'").replace('\'{"done":"true"}\'', '\'{{"done":"true"}}\''), **{t: frames[t] for t in used})

    return Graph(_nodes(run, frames), _edges(run, frames))


def _nodes(run: Callable[[str], DataFrame], frames: dict[str, DataFrame]) -> DataFrame:
    """Only nodes that may have a vector move to be joined with vectors."""
    rows = run(NODES_SQL)
    vectors = frames["embeddings"].select(F.col("vec_id").alias("vec"), F.col("embedding").cast("array<double>").alias("embedding"))
    full = rows.filter("vec is not null").join(vectors, "vec", "left").unionByName(rows.filter("vec is null"), allowMissingColumns=True)
    full = full.withColumns({"name_lc": F.lower("name"), "qualified_name": F.col("name")})
    return full.select("seq", "id", "type", "name", "name_lc", "qualified_name", "content", "signature", "file", "start_line", "metadata", "embedding")


def _edges(run: Callable[[str], DataFrame], frames: dict[str, DataFrame]) -> DataFrame:
    """Lines move twice, to their orders (whose nations are there already) and to their parts; both kinds of edges that they make come from there."""
    branches = EDGES_SQL.strip().split("\nunion all ")
    small = run("\nunion all ".join(b for b in branches if "{orders}" not in b and "{lineitem}" not in b))
    at = lambda kind, nation, mark, key: F.concat(F.lit(f"{kind}/"), nation, F.lit(f"#{mark}"), key)
    edge = lambda df, seq, source, target, type_, weight=F.lit(1.0): df.select(seq.cast("long").alias("seq"), source.alias("source"), target.alias("target"), type_.alias("type"), weight.cast("double").alias("weight"))

    placed = frames["orders"].join(frames["customer"], F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", "c_nationkey")
    key, nation = F.col("o_orderkey").cast("long"), F.col("c_nationkey")
    order = at("nation", nation, "o", F.col("o_orderkey"))
    held = edge(placed, 3_000_000_000_000 + key, F.concat(F.lit("nation/"), nation), order, F.lit("contains"))
    calls = edge(placed, 5_000_000_000_000 + key, order, at("nation", nation, "c", F.col("c_custkey")), F.lit("calls"))

    ties = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    lines = frames["lineitem"].withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ties)))
    lines = lines.join(placed.select("o_orderkey", "c_nationkey", F.lit(True).alias("placed")), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    lines = lines.select("o_orderkey", "n", "c_nationkey", "placed", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity").repartition("l_partkey")
    # the first line of a supplier and a part stands for these, too
    first = F.row_number().over(Window.partitionBy("l_partkey", "l_suppkey").orderBy("l_partkey")) == 1
    made = lines.withColumn("first", first).join(frames["part"].select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    made = made.withColumn("pair", F.explode(F.when(F.col("first"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    supplier = sized(frames["supplier"].select("s_suppkey", "s_nationkey"), bound=SUPPLIERS)
    made = made.withColumn("of", F.when(F.col("pair"), F.col("l_suppkey"))).join(supplier, F.col("of") == F.col("s_suppkey"), "left")
    made = made.filter((F.col("pair") & F.col("s_suppkey").isNotNull()) | (~F.col("pair") & F.col("placed")))
    either = lambda pair, line: F.when(F.col("pair"), pair).otherwise(line)
    flag = F.when(F.col("l_returnflag") == "R", "references").when(F.col("l_returnflag") == "A", "imports").otherwise("depends_on")
    seq = either(700_000_000_000_000 + F.col("l_suppkey").cast("long") * 1_000_000_000 + F.col("l_partkey"), 6_000_000_000_000 + key * 1000 + F.col("n"))
    source = either(at("nation", F.col("s_nationkey"), "s", F.col("l_suppkey")), order)
    used = edge(made, seq, source, at("brand", F.col("p_brand"), "p", F.col("p_partkey")), either(F.lit("implements"), flag), either(F.lit(1.0), F.col("l_quantity")))

    edges = functools.reduce(DataFrame.unionByName, (small, held, calls, used))
    return edges.select("seq", F.concat_ws("-", "type", "seq").alias("id"), "source", "target", "type", "weight", F.lit("{}").alias("metadata"))
