"""Clustering, substring dedup and hard negatives against brute force, and odd rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import clustering, hard_negatives, substring_dedup

VECTORS = "vec_id long, embedding array<float>, label int, v int, cluster string"


def vectors(spark, n=300, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, dim))
    rows = []
    for i in range(n):
        x = centers[i % 5] + 0.4 * rng.normal(size=dim) if i % 3 else centers[i % 5]  # a third are copies
        rows.append((i, [float(np.float32(y)) for y in x], int(rng.integers(4)) if i % 11 else None, 7, "x"))
    odd = [(1000, None, 1, 0, ""), (1001, [], 1, 0, ""), (1002, [None] * dim, 1, 0, ""), (1003, [float("nan")] * dim, 1, 0, ""), (1004, [float("inf")] + [0.0] * (dim - 1), 1, 0, ""), (None, [1.0] * dim, 1, 0, ""), (1005, [1.0] * (dim + 1), 1, 0, "")]
    return spark.createDataFrame(rows + odd, VECTORS), rows


def floors(rows, scale):
    return {r[0]: np.floor(np.array(r[1], dtype=np.float64) * scale).astype(np.int64) for r in rows}


def test_clustering_is_plain_k_means(spark):
    import hashlib

    df, rows = vectors(spark)
    x = floors(rows, 64)
    ids = sorted(x, key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())
    c = [x[i].copy() for i in ids[:7]]
    near = lambda v: min(range(7), key=lambda j: (int(((v - c[j]) ** 2).sum()), j))
    for _ in range(3):
        own = {i: near(v) for i, v in x.items()}
        for j in range(7):
            mine = [x[i] for i in x if own[i] == j]
            if mine:
                c[j] = np.array([sum(int(v[d]) for v in mine) // len(mine) for d in range(12)])
    got = {r.id: r for r in clustering.cluster(df, k=7, dim=12).collect()}
    assert got.keys() == x.keys()
    distance = {i: int(((v - c[near(v)]) ** 2).sum()) for i, v in x.items()}
    for i, r in got.items():
        assert (r.cluster, r.distance, r.centroid) == (near(x[i]), distance[i], c[near(x[i])].tolist())
        assert r.cluster_inertia == sum(d for j, d in distance.items() if got[j].cluster == r.cluster) and r.inertia == sum(distance.values())


def test_screening_never_drops_the_nearest_and_does_drop():
    rng = np.random.default_rng(1)
    for size, segment in ((30, 4), (100000, 5), (1 << 26, 64)):
        c = rng.integers(-size, size, (16, 64))
        x = c[rng.integers(16, size=500)] + rng.integers(-size // 4, size // 4, (500, 64))
        cluster, distance, exact = clustering.nearest(x, *clustering.compressed(x, segment), c, segment)
        all_ = ((x[:, None] - c) ** 2).sum(axis=2)
        assert (cluster == all_.argmin(axis=1)).all() and (distance == all_.min(axis=1)).all()
        low = clustering.lower_bounds((x * x).sum(axis=1), *clustering.compressed(x, segment), c, segment)
        assert (low <= all_).all() and (segment > 5 or exact < 500 * 16)


def test_clustering_of_odd_tables(spark):
    df, _ = vectors(spark)
    assert clustering.cluster(df.limit(0), dim=12).collect() == []
    one = spark.createDataFrame([(4, [1.0, -0.5]), (4, [1.0, -0.5])], "vec_id long, embedding array<double>")
    assert [(r.id, r.cluster, r.distance, r.centroid) for r in clustering.cluster(one, dim=2).collect()] == [(4, 0, 0, [64, -32])] * 2
    with pytest.raises(Exception, match="goes beyond"):
        clustering.cluster(spark.createDataFrame([(1, [1e9, 1.0])], "vec_id long, embedding array<double>"), dim=2).collect()


def mined(rows, n_pos, n_neg, anchors):
    x = floors(rows, 256)
    label = {r[0]: r[2] for r in rows if r[2] is not None}
    out = []
    for a in label:
        if anchors(a):
            score = {i: int(x[a] @ x[i]) for i in label if i != a}
            order = sorted(score, key=lambda i: (-score[i], i))
            for p in [i for i in order if label[i] == label[a]][:n_pos]:
                far = [i for i in order if label[i] != label[a] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:n_neg]
                out += [(a, p, n + 1, i, score[p], score[i]) for n, i in enumerate(far)]
    return sorted(out)


def test_hard_negatives_match_brute_force(spark):
    for dim, seed in ((12, 3), (70, 4)):  # one word a plane, and two
        df, rows = vectors(spark, dim=dim, seed=seed)
        for block, anchors in ((16384, 128), (32, 5)):
            got = hard_negatives.mine(df, F.col("vec_id") % 9 == 0, block_rows=block, anchor_rows=anchors)
            assert sorted(map(tuple, got.collect())) == mined(rows, 5, 3, lambda a: a % 9 == 0)


def test_intervals_hold_the_scores_and_drop_rows():
    rng = np.random.default_rng(2)
    x, q = rng.integers(-300, 300, (400, 64)), rng.integers(-300, 300, 64)
    seen = []

    def useful(low, high):
        seen.append((low, high))
        return hard_negatives.among_best(5)(low, high)

    rows, score = hard_negatives.Planes(x).screen(q, np.arange(400), useful)
    assert set(rows.tolist()) >= set(np.argsort(-(x @ q))[:5].tolist()) and (score == (x @ q)[rows]).all()
    assert all((low <= high).all() for low, high in seen) and len(seen[-1][0]) < 40


def test_hard_negatives_of_odd_tables(spark):
    df, _ = vectors(spark)
    assert hard_negatives.mine(df.limit(0), F.lit(True)).collect() == []
    one = spark.createDataFrame([(1, [0.0], 1), (2, [0.0], 1), (3, [0.0], 2), (3, [0.0], 2)], "vec_id long, embedding array<double>, label int")
    got = hard_negatives.mine(one, F.col("vec_id") == 1)
    assert sorted(map(tuple, got.collect())) == [(1, 2, 1, 3, 0, 0), (1, 2, 2, 3, 0, 0)]
    with pytest.raises(Exception, match="beyond 62 bits"):
        hard_negatives.mine(spark.createDataFrame([(1, [1e8], 1), (2, [1e8], 1)], one.schema), F.lit(True)).collect()


def windows(rows, n=20):
    """Every window judged against all earlier ones."""
    words = [(i, re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())) for i, t in rows]
    seen, out = set(), []
    for i, w in sorted(words, key=lambda r: (r[0] is not None, r[0] or 0)):
        stays = [True] * len(w)
        for s in range(len(w) - n + 1):
            if (k := tuple(w[s : s + n])) in seen:
                stays[s : s + n] = [False] * n
            seen.add(k)
        out.append((i, len(w), len(w) - sum(stays), b" ".join(x for x, y in zip(w, stays) if y).decode()))
    return sorted(out, key=str)


def texts(seed):
    rng = random.Random(seed)
    many = [f"w{i}é" for i in range(60)]
    shared = [[rng.choice(many) for _ in range(rng.randrange(15, 50))] for _ in range(6)]
    out = [None, "", " \t ", "one two", "a " * 100, "a b " * 40, "x y " * 30, " ".join(many) * 3]
    for _ in range(80):
        t = []
        for _ in range(rng.randrange(1, 7)):
            cut = rng.choice(shared)
            t += cut[rng.randrange(8) :] if rng.random() < 0.5 else cut[: rng.randrange(5, 50)] if rng.random() < 0.5 else [rng.choice(many) for _ in range(rng.randrange(30))]
        out.append(rng.choice([" ", "\n", "  ", "\x0b"]).join(t))
    return out + [out[20]] * 8


@pytest.mark.parametrize("small", [1000, 1])
def test_every_repeated_window_is_removed(spark, small):
    rows = list(enumerate(texts(5))) + [(None, texts(5)[30])]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, pos int, spans string").repartition(5)
    got = substring_dedup.deduplicate(docs, small=small)
    assert got.columns == ["doc_id", "text", "pos", "n_words", "n_removed", "kept_text", "spans"]
    found = got.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found), key=str) == windows(rows)
    assert all(sum(s.b - s.a for s in r.spans) == r.n_removed for r in found)


def test_substrings_of_odd_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.deduplicate(docs).collect() == []
    run = " ".join(f"n{i}" for i in range(25))
    same = spark.createDataFrame([(2, run), (2, run), (1, "lead " + run), (2, run + " tail")], "doc_id long, text string")
    got = sorted((r.n_words, r.n_removed) for r in substring_dedup.deduplicate(same).collect())
    assert got == [(25, 25), (25, 25), (26, 0), (26, 25)]  # rows of one id and text are one document


def test_a_very_long_text(spark):
    rng = random.Random(1)
    run = [str(rng.random()) for _ in range(3000)]
    text = " ".join(run + ["gap"] + run * 20)
    (row,) = substring_dedup.deduplicate(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (row.n_words, row.n_removed) == (63001, 60000)
