"""Brute force, planted cases and odd rows for the join, the language model and the pipeline's stages."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from lodestone.llm import exact_dedup, hpylm, jaccard_join, mixing


def words(rng, n):
    return [f"w{rng.randrange(400)}" for _ in range(n)]


def near_copies(seed=1):
    rng = random.Random(seed)
    texts = [None, "", "  ", "one two", "One TWO"]
    for _ in range(8):
        base = words(rng, 60)
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(60)] = "new"
            texts.append(" ".join(copy))
    return texts + [" ".join(words(rng, 30)) for _ in range(20)]


def brute(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = [[j for j, b in enumerate(sets) if i != j and a and b and len(a & b) * 10 >= 8 * len(a | b)] for i, a in enumerate(sets)]
    label = list(range(len(texts)))
    for _ in texts:
        label = [min([label[i], *(label[j] for j in near[i])]) for i in range(len(texts))]
    return {i: (label[i], len(near[i])) for i in range(len(texts))}


def test_join_finds_every_link(spark):
    texts = near_copies()
    docs = spark.createDataFrame([(i, t, b"k", 0) for i, t in enumerate(texts)], "doc_id long, text string, key binary, n int")
    for limit in (2048, 8):  # all in one bucket, and deep recursion with blocks
        got = {r.id: (r.class_id, r.n_links) for r in jaccard_join.classes(docs, limit=limit).collect()}
        assert got == brute(texts)


def test_one_of_each_class_stays(spark):
    texts = near_copies(2)
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(3, "one two", "s"), (None, texts[-1], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _rk string")
    kept = jaccard_join.deduplicate(docs)
    assert kept.columns == docs.columns
    labels = brute([r[1] for r in rows])
    assert kept.count() == len({v[0] for v in labels.values()})
    assert jaccard_join.deduplicate(docs.limit(0)).collect() == []


def test_exact_dedup_keeps_one(spark):
    docs = spark.createDataFrame([(1, "A", "x"), (2, "a", "y"), (None, None, "z"), (3, "", "z"), (4, "é", "z"), (5, "É", "z")], "doc_id long, text string, h string")
    assert sorted(r.doc_id for r in exact_dedup.deduplicate(docs).collect()) == [2, 3, 4, 5]
    assert exact_dedup.report(docs).count() == 6


def test_language_model(spark):
    rng = random.Random(4)
    texts = [None, "", "A b\x0bC"] + [" ".join(words(rng, rng.randrange(1, 40))) for _ in range(60)] + ["unknown words only"]
    texts += ["the same old words"] * 5
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r.id: r for r in hpylm.score(docs, part_tokens=200).collect()}
    tokens = {i: (t or "").encode().lower().split() + [b" "] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    count = Counter(w for i, x in tokens.items() if not held[i] for w in x)
    n, v = sum(count.values()), len(count)
    for i, x in tokens.items():
        r = got[i]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in x)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(x), sum(w in count for w in x), n)
        assert abs(r.base_score - base) < 1e-6 and r.score < 0
    learnt = [i for i in tokens if not held[i] and len(tokens[i]) > 5]
    assert sum(got[i].score for i in learnt) > sum(got[i].base_score for i in learnt)
    assert hpylm.score(docs.limit(0)).collect() == []


def test_equal_parts_stay_apart(spark):
    """The same rows in two partitions, and equal parts in one partition."""
    docs = spark.createDataFrame([(i, f"a b c{i}") for i in range(20)], "doc_id long, text string").coalesce(1)
    same = spark.createDataFrame([(None, "x y z")] * 6, "doc_id long, text string").coalesce(1)
    got = hpylm.score(docs.union(docs).union(same), part_tokens=8).collect()
    assert Counter(r.id for r in got) == {**{i: 2 for i in range(20)}, None: 6}
    tokens = sum(4 * 2 for i in range(20) if not hpylm.is_held_out(i)) + 4 * 6
    assert {r.train_tokens for r in got} == {tokens}
    for i in [None, *range(20)]:
        assert np.ptp([r.score for r in got if r.id == i]) < 1e-9


class PlainModel:
    """The same hierarchy with tables kept one by one, and customers moved one by one through all levels."""

    def __init__(self, triples, n_words, rng):
        self.rng, self.n_words, self.seats = rng, n_words, {}
        self.triples = triples
        for key, w in triples:
            self.add(key, w)

    def p(self, key, w):
        if key is None:
            return 1 / (self.n_words + 1)
        d, s = hpylm.DISCOUNTS[len(key)], hpylm.STRENGTHS[len(key)]
        dishes = self.seats.get(key, {})
        tables, n = sum(len(x) for x in dishes.values()), sum(sum(x) for x in dishes.values())
        own = dishes.get(w, [])
        return (sum(own) - d * len(own) + (s + d * tables) * self.p(key[1:] if key else None, w)) / (s + n)

    def add(self, key, w):
        if key is None:
            return
        d, s = hpylm.DISCOUNTS[len(key)], hpylm.STRENGTHS[len(key)]
        dishes = self.seats.setdefault(key, {})
        own, up = dishes.setdefault(w, []), key[1:] if key else None
        tables = sum(len(x) for x in dishes.values())
        x = self.rng.random() * (sum(own) - d * len(own) + (s + d * tables) * self.p(up, w))
        for i, n in enumerate(own):
            x -= n - d
            if x < 0:
                own[i] += 1
                return
        own.append(1)
        self.add(up, w)

    def remove(self, key, w):
        if key is None:
            return
        own = self.seats[key][w]
        i = self.rng.choices(range(len(own)), own)[0]
        own[i] -= 1
        if not own[i]:
            del own[i]
            self.remove(key[1:] if key else None, w)

    def sweep(self):
        for key, w in self.triples:
            self.remove(key, w)
            self.add(key, w)


def test_score_against_customers_moved_one_by_one(spark):
    rng = random.Random(6)
    pool = [f"w{int(rng.paretovariate(0.9)) % 30}" for _ in range(3000)]
    texts = [" ".join(rng.choices(pool, k=rng.randrange(3, 25))) for _ in range(70)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r for r in hpylm.score(docs, part_tokens=300, burn_in=20, samples=60).collect()}

    def triples(t):
        x = [b" ", b" ", *t.encode().split(), b" "]
        return [((x[i - 2], x[i - 1]), x[i]) for i in range(2, len(x))]

    learnt = [y for i, t in enumerate(texts) if not hpylm.is_held_out(i) for y in triples(t)]
    model = PlainModel(learnt, len({w for _, w in learnt}), rng)
    total = {i: np.zeros(len(triples(t))) for i, t in enumerate(texts)}
    for sweep in range(80):
        model.sweep()
        if sweep >= 20:
            for i, t in enumerate(texts):
                total[i] += [model.p(*y) / 60 for y in triples(t)]
    want = {i: float(np.log10(x).sum()) for i, x in total.items()}
    for some in ([i for i in want if hpylm.is_held_out(i)], [i for i in want if not hpylm.is_held_out(i)]):
        a, b = (sum(s[i] for i in some) for s in ({i: r.score for i, r in got.items()}, want))
        assert abs(a - b) < 0.02 * abs(b)
        assert all(abs(got[i].score - want[i]) < 0.03 * len(total[i]) for i in some)


def test_probabilities_of_the_model_sum_to_one():
    rng = np.random.default_rng(5)
    u, v, w = rng.integers(0, 12, (3, 900))
    w[:12] = np.arange(12)
    asked = np.concatenate([w, np.arange(12)])  # each word once more after one context, not learnt
    learnt = np.concatenate([np.ones(900, dtype=np.int64), np.zeros(12, dtype=np.int64)])
    found = hpylm.Contexts(np.concatenate([u, np.full(12, u[0])]), np.concatenate([v, np.full(12, v[0])]), asked, learnt, 12)
    root = rng.random(12)
    p, _ = found.sample(root / root.sum(), [1], 3, 5, 12)
    assert abs(p[found.of_token[-12:]].sum() - 1) < 1e-9


def test_frequent_words_over_several_buckets(spark):
    """A word that stands in every other place; parts, buckets and partitions of any size give the same counts."""
    rng = random.Random(9)
    texts = [" ".join(x for w in words(rng, 12) for x in ("hot", w)) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r.id: r for r in hpylm.score(docs).collect()}
    got = {r.id: r for r in hpylm.score(docs.repartition(5), part_tokens=90, bucket_tokens=300, class_tokens=100).collect()}
    assert all((got[i].n_known, got[i].n_tokens) == (want[i].n_known, want[i].n_tokens) and abs(got[i].base_score - want[i].base_score) < 1e-4 for i in want)
    assert abs(sum(r.score for r in got.values()) / sum(r.score for r in want.values()) - 1) < 0.06


def test_one_corpus_gives_one_model(spark, monkeypatch):
    """Neither the number of cores nor how rows are dealt changes a score."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(words(rng, 40) + ["hot"] * (i % 5))) for i in range(150)], "doc_id long, text string")
    assert sorted(hpylm.frequent_words(docs.repartition(3), 200)[0]) == sorted(hpylm.frequent_words(docs.coalesce(1), 200)[0]) == [(b"hot", sum(i % 5 for i in range(150)))]
    monkeypatch.setattr(hpylm, "SEATED_TOKENS", 700)
    scores = lambda d: {r.id: r.score for r in hpylm.score(d, class_tokens=100).collect()}
    want = scores(docs)
    for cores, n in ((1, 1), (2, 7), (64, 7)):
        monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", cores)
        got = scores(docs.repartition(n))
        assert all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_seats_stay_possible():
    rng = np.random.default_rng(1)
    c = np.array([1, 2, 3, 30, 500, 5000, 100_000])
    seats = hpylm.Seats(c.copy(), np.zeros(7, dtype=np.int64), 1, 0.6, 1.0, rng)
    for _ in range(4):
        seats.sweep(np.full(7, 0.1))
        assert (seats.t >= 1).all() and (seats.t <= c).all() and seats.tables[0] == seats.t.sum()
    seats.become(np.array([0, 4, 1, 40, 400, 5001, 99_990]), np.full(7, 0.1))
    assert seats.t[0] == 0 and (seats.t[1:] >= 1).all() and seats.customers[0] == seats.c.sum() and seats.tables[0] == seats.t.sum()
    exact = hpylm.stirling_ratios(0.6, 1024)
    assert exact[2, 2] == 1 and abs(exact[3, 1]) < 1e-6
    t = np.array([2, 10, 40, 100, 300, 800])
    assert np.allclose(hpylm.limit_ratios(np.full(6, 1024), t, 0.6), exact[1024, t], rtol=0.03)


def test_mixing_gives_one_pass_at_least(spark):
    rows = [(i, "w " * (i % 9), f"s{min(i % 7, 2)}" if i % 11 else None) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    drawn = mixing.mix(docs).select("row.*")
    assert drawn.columns == docs.columns
    assert {r.doc_id for r in drawn.collect()} == set(range(200))


def test_recall_bound_counts_shared_coordinates():
    cases = jaccard_join.missed(0.8)
    assert abs(sum(p for p, _, _ in cases) - 1) < 1e-9 and cases[-1][2] == 1
    one = 1 - sum(p * (1 - (1 - jaccard_join.meets(share, 1)) ** 8) * passes for p, share, passes in cases)
    assert (1 - jaccard_join.meets(0.8, 1)) ** 8 < one < 1e-4  # more than if runs were independent


def test_branching_paths_meet_as_often_as_the_bound_says():
    rng = np.random.default_rng(3)
    n, agree = 20_000, 96
    sig = rng.integers(0, 1 << 32, (2, n, 128), dtype=np.uint64).astype(np.uint32)
    sig[1, :, :agree] = sig[0, :, :agree]
    roots = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    alive = [(np.arange(n), roots)]  # nodes that hold both signatures of a pair
    for depth in range(1, 5):
        below, branches, nodes = [], 0, 0
        for pair, at in alive:
            nodes += len(at)
            both = zip(jaccard_join.children(sig[0, pair], at), jaccard_join.children(sig[1, pair], at))
            for (_, rows, a), (_, same_rows, b) in both:
                assert (rows == same_rows).all()
                branches += len(rows)
                below.append((pair[rows][a == b], a[a == b]))
        alive = below
        assert abs(branches / nodes - 1 - jaccard_join.SECOND) < 0.02
        met = len(np.unique(np.concatenate([pair for pair, _ in alive]))) / n
        bound = jaccard_join.meets(agree / 128, depth)
        assert bound - 0.015 < met < bound + 0.03


def test_pipeline_over_a_small_folder(spark, tmp_path):
    """All stages: equal and near copies go, toxic documents go, clean ones stay, ids decode to the texts."""
    import corpus_pipeline

    rng = random.Random(12)
    clean = [" ".join(words(rng, 40)) for _ in range(60)]
    bad = [" ".join(x for w in words(rng, 20) for x in (w, rng.choice(["zonk", "blarg"]))) for _ in range(60)]
    texts = clean + bad + [clean[0].upper(), clean[1] + " w1"]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(60 <= i < 120)) for i in range(120)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}").collect()
    kept = {r.doc_id for r in got}
    assert kept == (set(range(1, 60)) | {120}) and len(got) >= len(kept)
    for r in got:
        assert r.n_tokens == len(r.ids) and r.decoded.replace("</w>", "").replace(" ", "") == texts[r.doc_id].lower().replace(" ", "")
