"""Mixing, sharding, top-k, line dedup and toxicity against brute force, and on odd rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import line_dedup, mixing, sharding, topk, toxicity


def simple_exponent(tokens, target, repeats):
    """By steps of 1e-4 from 1 down: the first that reaches both targets."""
    total, k = sum(tokens), len(tokens)
    for i in range(10_000, -1, -1):
        a = i / 10_000
        w = [(t / total) ** a for t in tokens]
        w = [x / sum(w) for x in w]
        if -sum(x * math.log(x) for x in w) >= target * math.log(k):
            break
    by_entropy = a
    for i in range(10_001):
        a = i / 10_000
        w = [(t / total) ** a for t in tokens]
        w = [x / sum(w) for x in w]
        whole = max(tokens) / w[tokens.index(max(tokens))]
        if whole * w[tokens.index(min(tokens))] / min(tokens) <= repeats:
            break
    return max(by_entropy, a)


def test_exponent_against_a_plain_search(spark):
    for tokens in ([1000, 500, 20], [70, 60, 50, 40], [10**6, 3, 3]):
        sources = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(tokens)], "source string, tokens long")
        for target, repeats in ((0.9, 100.0), (0.99, 2.0)):
            assert abs(mixing.exponent(sources, target, repeats) - simple_exponent(tokens, target, repeats)) < 3e-4


def test_budgets_are_met_by_permutations_of_blocks(spark):
    rng = random.Random(7)
    sizes = {"big": 400, "mid": 90, "small": 12}
    rows = [(n, s, "w " * rng.randrange(1, 9)) for n, s in enumerate(s for s, k in sizes.items() for _ in range(k))]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    plan = {r.source: r for r in mixing.plan(docs, target_entropy=0.9, max_repeats=3.0).collect()}
    drawn = mixing.mix(docs, n_blocks=16, target_entropy=0.9, max_repeats=3.0).collect()
    longest = 8
    for s in sizes:
        own = [r for r in drawn if r.source == s]
        tokens = sum(r.n_tokens for r in own)
        assert plan[s].budget - longest < tokens <= plan[s].budget
        passes = plan[s].budget // plan[s].tokens
        times = Counter(r.row.doc_id for r in own)
        assert len(times) == sizes[s] and set(times.values()) <= {passes, passes + 1}
        # blocks of the last pass are taken wholly, but for one
        whole = defaultdict(int)
        for r in own:
            whole[r.block] += r["pass"] == 1
        last = Counter(r.block for r in own if r["pass"] == passes + 1)
        assert sum(last[b] != whole[b] for b in last) <= 1
    assert plan["small"].budget > plan["small"].tokens


def test_a_budget_smaller_than_the_sources(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "a b c") for i in range(90)], "doc_id long, source string, text string")
    drawn = mixing.mix(docs, n_blocks=8, budget=90).collect()
    assert Counter(r.source for r in drawn) == {"s0": 10, "s1": 10, "s2": 10}
    assert len({r.row.doc_id for r in drawn}) == 30


def test_mixing_odd_rows(spark):
    rows = [(1, None, None, 5), (1, None, None, 5), (None, "x", "a b", None), (2, "x", " \t\n", 1), (3, "y", "w " * 30_000, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, block int")
    drawn = mixing.mix(docs)
    got = Counter(r.row.doc_id for r in drawn.collect())
    assert got[1] == 2 and got[3] == 1 and got[None] >= 1 and got[2] >= 1
    assert mixing.mix(docs.limit(0)).collect() == []


def documents(spark, n=3000):
    rng = random.Random(3)
    rows = [(i, "é" * rng.randrange(200), "x") for i in range(n)] + [(7, None, "x"), (7, None, "x"), (None, "", "x"), (8, "z" * 9000, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string"), rows


def test_shards_are_even_and_gapless(spark):
    docs, rows = documents(spark)
    placed, slot_map = sharding.shard(docs, 8)
    got = placed.collect()
    assert Counter((r.id, r.size, r.crc) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    load, places = Counter(), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        places[r.shard].append(r.position)
        assert slot_map.shard_of[r.vslot] == r.shard
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(load.values()) - min(load.values()) <= 9016
    assert sharding.shard(docs.limit(0), 8)[0].collect() == []


def test_rebalancing_edits_the_map(spark):
    docs, _ = documents(spark)
    sizes = sharding.slot_sizes(sharding.with_slots(docs))
    old = sharding.build_map(sizes, 8)
    for n in (9, 7):
        new = sharding.rebalance(old, sizes, n)
        load = Counter()
        for slot, shard in enumerate(new.shard_of):
            load[shard] += sizes[slot][0]
        assert new.version == 2 and set(load) == set(range(n)) and max(load.values()) < 1.1 * sum(load.values()) / n
        changed = {slot for slot in range(len(sizes)) if old.shard_of[slot] != new.shard_of[slot]}
        assert {e[1] for e in new.edits} == changed
        assert sum(sizes[s][0] for s in changed) < 0.25 * sum(load.values())
    kept = sharding.SlotMap.from_df(new.to_df(spark))
    assert (kept.version, kept.n_shards, kept.shard_of, sorted(kept.edits)) == (2, 7, new.shard_of, sorted(new.edits))


def test_versions_of_the_map_are_stored(spark, tmp_path):
    docs, rows = documents(spark)
    placed, _ = sharding.shard(docs, 8, grown=9, folder=f"{tmp_path}/map")
    got = placed.collect()
    first, second = (sharding.SlotMap.load(spark, f"{tmp_path}/map", v) for v in (1, 2))
    assert (first.n_shards, second.n_shards) == (8, 9) and len(got) == len(rows)
    assert {(e[1], e[3]) for e in second.edits} == {(i, b) for i, (a, b) in enumerate(zip(first.shard_of, second.shard_of)) if a != b}
    assert all((r.shard, r.next_shard) == (first.shard_of[r.vslot], second.shard_of[r.vslot]) for r in got)
    with pytest.raises(Exception, match="(?i)exist"):
        first.save(spark, f"{tmp_path}/map")
    with pytest.raises(ValueError):
        sharding.SlotMap.from_df(first.to_df(spark).filter("slot > 0"))


def test_equal_texts_share_a_shard_unless_they_are_many(spark):
    rows = [(i, "copy " * 20, 1) for i in range(400)] + [(1000 + i, f"text {i // 2} " * 15, 1) for i in range(600)]
    rows += [(5000, None, 1), (5001, "", 1), (None, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, vslot int")
    got = sharding.shard(docs, 5)[0].collect()
    load, shards = Counter(), defaultdict(set)
    for r in got:
        load[r.shard] += r.size
        shards[r.crc].add(r.shard)
    assert len(got) == len(rows) and max(load.values()) - min(load.values()) < 0.02 * sum(load.values())
    assert shards.pop(zlib.crc32(("copy " * 20).encode())) == set(range(5)) and all(len(s) == 1 for s in shards.values())


def test_top_k_against_all_products(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist(), "q") for i in range(90)]
    rows += [(90 + i, rows[40][1], "q") for i in range(30)]  # ties
    rows += [(200, None, "q"), (220, [1.0, None, 0.0, 0.0, 0.0, 0.0], "q"), (240, [float("nan")] * 6, "q"), (260, [float("inf")] * 6, "q")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    ints = {i: np.floor(64 * np.array(v)).astype(int) for i, v, _ in rows[:120]}
    want = set()
    for q in (i for i in ints if i % 20 == 0):
        best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:20]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    got = topk.top_k(df, df["vec_id"] % 20 == 0, k=20, scale=64.0).collect()
    assert {(r.query_id, r["rank"], r.id, r.score) for r in got} == want and len(got) == len(want)
    assert topk.top_k(df.limit(0), df["vec_id"] % 20 == 0, k=20, scale=64.0).collect() == []


def test_line_dedup_against_a_plain_loop(spark):
    rng = random.Random(2)
    texts = ["\n".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(40)] + ["", "one", "x\n" * 500]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(99, None, 1)], "doc_id long, text string, line int")
    seen, want = set(), {99: ""}
    for i, t in enumerate(texts):
        lines = t.split("\n")
        gone = set()
        for j in range(len(lines) - 2):
            w = tuple(lines[j : j + 3])
            if w in seen:
                gone |= {j, j + 1, j + 2}
            seen.add(w)
        want[i] = "\n".join(x for j, x in enumerate(lines) if j not in gone)
    assert {r.doc_id: r.kept_text for r in line_dedup.dedup_lines(docs).collect()} == want


def toxic_corpus(spark, n=1200):
    rng = random.Random(11)
    plain, bad = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)], ["grok", "blarg", "zonk", "vile"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        if toxic:
            words[::5] = [rng.choice(bad) for _ in words[::5]]
        docs.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    docs += [(None, None), (n, ""), (n + 1, "grok " * 40_000), (0, docs[0][1])]
    labels += [(None, 1), (4, None), (0, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_corpus(spark)
    index = toxicity.fit(docs, labels)
    assert not [i for i in index.ids.tolist() if zlib.crc32(str(i).encode()) % 5 == 0]
    got = toxicity.score(docs, index).collect()
    assert len(got) == docs.count() and all(0 <= r.tox_score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 1200 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 100 and sum((r.tox_score >= 0.5) == (r.doc_id % 6 == 0) for r in held) >= 0.95 * len(held)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1201].tox_score > 0.5 > by_id[1200].tox_score == by_id[None].tox_score
    # copies under other ids, and without one, score the same as the examples
    copies = docs.union(docs.selectExpr("doc_id + 5000", "text")).union(docs.selectExpr("null", "text")).collect()
    score = {}
    for r in toxicity.score(spark.createDataFrame(copies, docs.schema), index).collect():
        score.setdefault(r.text, set()).add(r.tox_score)
    assert len(copies) == 3 * docs.count() and all(len(s) == 1 for s in score.values())


def test_cosines_are_exact_and_blocks_are_left_out(spark):
    """Cosines of whole texts by brute force over all terms, with small blocks; hidden examples have lower ones."""
    docs, labels = toxic_corpus(spark, 240)
    docs = docs.union(spark.createDataFrame([(500, "waa wba unheard"), (501, "Waa, 12 unheard--unheard twice"), (502, "\u00fcber \u4e2d\u6587")], "doc_id long, text string"))
    index = toxicity.fit(docs, labels, block=8)

    def terms(text):
        words = "".join(c if c.isalpha() or ord(c) > 127 else " " for c in (text or "").lower()).split()
        b = f" {' '.join(words)} ".encode() if words else b""
        return Counter(b[i : i + 3] for i in range(len(b) - 2))

    rows = docs.collect()
    df = Counter(t for r in rows for t in terms(r.text))
    vec = lambda c: {t: (1 + math.log(n)) * math.log((len(rows) + 1) / (df[t] + 0.5)) for t, n in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values())) or 1.0
    chosen = {r.ex_id for r in toxicity.examples(labels).collect()}
    texts = {}
    for r in rows:
        if r.doc_id in chosen:
            texts[r.doc_id] = min(r.text, texts.get(r.doc_id, r.text))
    assert sorted(index.ids.tolist()) == sorted(texts)
    held = {i: vec(terms(t)) for i, t in texts.items()}
    hidden = 0
    for r in rows:
        q = vec(terms(r.text))
        all_ = np.array([sum(x * held[j].get(t, 0) for t, x in q.items()) / norm(q) / norm(held[j]) if j != r.doc_id else -1 for j in index.ids.tolist()])
        got = index.cosines([toxicity.plain(r.text)], [r.doc_id], 5)[0]
        seen = got > -1
        assert np.allclose(got[seen], all_[seen], atol=1e-5)
        if q:
            assert (all_[~seen] <= np.sort(all_)[-5] + 1e-5).all()
            hidden += (~seen).sum()
    assert hidden > 0
    shown = {r.doc_id: r for r in toxicity.score(docs, index, k=5).collect()}
    assert len(shown[500].tox_evidence) == 5 and shown[None].tox_evidence == []


def test_calibration_rises_with_the_votes():
    index = toxicity.Index(9, np.empty(0), np.empty(0), np.arange(4), np.array([0.0, 1.0, 0.0, 1.0]))
    index.calibrate(np.array([0.1, 0.2, 0.3, 0.9, 0.95]), np.array([0, 1, 0, 1, 1]))
    assert (np.diff(index.rates) > 0).all() and (np.diff(index.votes) > 0).all() and 0 < index.rates[0] < 0.5 < index.rates[-1] < 1


def test_toxicity_without_examples(spark):
    docs, labels = toxic_corpus(spark, 30)
    for d, n in ((docs, labels.limit(0)), (docs, labels.withColumn("toxic", labels["toxic"] * 0)), (docs.limit(0), labels)):
        clash = d.withColumns({c: d["text"] for c in ("row", "id", "vote", "evidence", "tox_score")})
        assert {r.tox_score for r in toxicity.score(clash, toxicity.fit(clash, n)).collect()} <= {0.0}


def test_the_fitted_index_holds_no_table_of_all_terms_on_the_driver(spark):
    docs = spark.createDataFrame([(i, "some words" if i % 2 else None) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels)
    assert len(index.ids) and not hasattr(index, "number") and max(x.nbytes for x in vars(index).values() if hasattr(x, "nbytes")) < 1 << 20
