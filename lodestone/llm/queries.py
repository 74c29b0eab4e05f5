"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, clustering, exact_dedup, hard_negatives, hpylm, jaccard_join, line_dedup, mixing, sharding, substring_dedup, suffix_dedup, topk, toxicity
from lodestone.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return drawn.select(F.col("row.doc_id").alias("doc_id"), "source", "n_tokens", "block", "pass", F.round("weight", 6).alias("weight"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, tokenizer_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    out = topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=20, scale=64.0)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = sharding.shard(table(spark, sf_dir, "documents"), 40, grown=41)
    return placed.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        F.col("position").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version", "next_shard",
    )


def op7_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_links", "class_size")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"),
        F.col("tox_evidence.id").alias("evidence"),
    )


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, scale=64.0, dim=64)
    digest = F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256)
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = substring_dedup.deduplicate(docs, keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").filter("label is not null")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0, label=label, positives=5, negatives=3, low=50, high=95, scale=256.0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_line_dedup, op3_exact_dedup, op4_bpe, op5_topk, op6_sharding, op7_hpylm, op8_suffix_dedup, op9_jaccard_join, op10_toxicity, op11_clustering, op12_substring_dedup, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_ROUND = """
d{n} as materialized (select vec_id, v.x, c, list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, k.x) + list_dot_product(k.x, k.x) as d from v, c{n} as k qualify row_number() over (partition by vec_id order by d, c) = 1),
u{n} as (select c, i, floor(sum(x) / count(*)) as x from (select c, unnest(x) as x, generate_subscripts(x, 1) as i from d{n}) group by c, i),
c{m} as materialized (select c, coalesce(m.x, c{n}.x) as x from c{n} left join (select c, list(x order by i) as x from u{n} group by c) as m using (c)),"""

SQL = {
    "op11_clustering": """
with v as materialized (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as x from embeddings
  where vec_id is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (select row_number() over (order by h, x) - 1 as c, x from (select x, sha256('1:' || vec_id) as h from v order by h, x limit 16)),"""
    + "".join(_ROUND.format(n=n, m=n + 1) for n in range(3))
    + """
f as materialized (select vec_id, c, (list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, k.x) + list_dot_product(k.x, k.x))::bigint as d from v, c3 as k qualify row_number() over (partition by vec_id order by d, c) = 1)
select vec_id, c::integer as cluster, d as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
  sha256(array_to_string(list_transform(c3.x, lambda x: x::bigint), ',')) as centroid_sha256 from f join c3 using (c)""",
    "op12_substring_dedup": r"""
with d as materialized (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') as w from documents),
x as materialized (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from d),
p as (select doc_id, i, string_agg(word, ' ') over o as win, count(*) over o as n from x window o as (partition by doc_id order by i rows between current row and 19 following)),
r as (select doc_id, i, row_number() over (partition by win order by doc_id, i) as n from p where n = 20),
c as (select distinct doc_id, i + k as i from r, range(20) as t(k) where n > 1),
k as (select x.doc_id, count(*) as n_words, count(c.i) as n_removed, coalesce(string_agg(case when c.i is null then word end, ' ' order by x.i), '') as kept from x left join c on c.doc_id = x.doc_id and c.i = x.i group by x.doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)""",
    "op13_hard_negatives": """
with v as materialized (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as x from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.x, b.x)::bigint as score from v as a join v as b on a.vec_id % 50 = 0 and b.vec_id <> a.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select p.*, vec_id as negative_id, score as negative_score, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) as rank
  from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3""",
    "op2_line_dedup": """
with d as (select doc_id, coalesce(text, '') as text from documents),
l as (select doc_id, text, string_split(text, chr(10)) as ls from d),
p as (select doc_id, text, unnest(ls) as line, generate_subscripts(ls, 1) as i from l),
w as (select doc_id, text, i, line || chr(10) || lead(line, 1) over o || chr(10) || lead(line, 2) over o as w
      from p window o as (partition by doc_id, text order by i)),
r as (select doc_id, text, i, row_number() over (partition by w order by doc_id, md5(text), i) as n from w where w is not null),
c as (select distinct doc_id, text, i + k as i from r, (select unnest([0, 1, 2]) as k) where n > 1),
k as (select p.doc_id, p.text, count(*) as n_lines, count(c.i) as n_removed,
             coalesce(string_agg(case when c.i is null then p.line end, chr(10) order by p.i), '') as kept
      from p left join c on p.doc_id = c.doc_id and p.text = c.text and p.i = c.i group by p.doc_id, p.text)
select doc_id, n_lines, n_removed, sha256(kept) as kept_sha256 from k""",
    "op3_exact_dedup": f"""
with d as (select doc_id, {_NORM} as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.t) as text_sha256 from d join g using (t)""",
    "op8_suffix_dedup": """
with d as materialized (select row_number() over () as rn, doc_id, encode(coalesce(text, '')) as x from documents),
w as materialized (select rn, i, md5(x[i + 1:i + 200]) as k from (select rn, x, unnest(range(octet_length(x) - 199)) as i from d where octet_length(x) >= 200)),
r as materialized (select rn, i from w where k in (select k from w group by k having count(*) > 1)),
e as (select rn, i, coalesce(i > 200 + lag(i) over (partition by rn order by i), true) as first from r),
s as (select rn, i, sum(first::integer) over (partition by rn order by i) as run from e),
p as (select rn, run, min(i) as a, max(i) + 200 as b from s group by rn, run),
g as (select rn, a, b, coalesce(lag(b) over (partition by rn order by a), 0) as last, lead(a) over (partition by rn order by a) is null as final from p),
k as (select rn, sum(b - a)::bigint as n_removed, count(*) as n_spans,
  string_agg(hex(x[last + 1:a]) || case when final then hex(x[b + 1:]) else '' end, '' order by a) as kept from g join d using (rn) group by rn)
select doc_id, octet_length(x) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(coalesce(unhex(kept), x)) as kept_sha256 from d left join k using (rn)""",
    "op9_jaccard_join": r"""
with recursive d as materialized (select row_number() over () as rn, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as materialized (select distinct rn, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end as g
  from (select rn, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)),
n as materialized (select rn, count(*) as n from s group by rn),
both_ as (select a.rn as a, b.rn as b, count(*) as k from s as a join s as b on a.g = b.g and a.rn <> b.rn group by all),
link as materialized (select a, b from both_ join n as x on x.rn = a join n as y on y.rn = b where k * 10 >= 8 * (x.n + y.n - k)),
reach as (select a as rn, a as other from link union select reach.rn, link.b from reach join link on link.a = reach.other),
class as (select r.rn, min(d.doc_id) as class_id, count(*) as class_size from reach as r join d on d.rn = r.other group by r.rn),
deg as (select a as rn, count(*) as n_links from link group by a)
select d.doc_id, coalesce(class_id, d.doc_id) as class_id, coalesce(n_links, 0) as n_links, coalesce(class_size, 1) as class_size
from d left join class using (rn) left join deg using (rn)""",
    "op5_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, v.vec_id, list_dot_product(q.x, v.x)::bigint as score
  from v as q join v on q.vec_id % 20 = 0 and v.vec_id <> q.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 20""",
}
