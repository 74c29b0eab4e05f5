"""The sorter against sorted(), the operator against all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import suffix_dedup as S


def common(u, v, cap):
    k = 0
    while k < min(len(u), len(v), cap) and u[k] == v[k]:
        k += 1
    return k


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60), st.integers(1, 4), st.sampled_from([3, 10**6]), st.sampled_from([7, 200]))
def test_order_and_common_prefixes(part, times, held, cap):
    x = np.array(part * times, dtype=np.int16)
    pos, lcp = S.suffix_order(x, cap, held)
    suffixes = [tuple(x[i:].tolist()) for i in range(len(x))]
    # suffixes that are equal up to the cap may stand in any order
    assert [suffixes[i][:cap] for i in pos.tolist()] == [s[:cap] for s in sorted(suffixes)]
    assert sorted(pos.tolist()) == list(range(len(x)))
    assert lcp.tolist() == [0] + [common(suffixes[a], suffixes[b], cap) for a, b in zip(pos.tolist(), pos[1:].tolist())]


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), dtype=bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = int(gone[:1].sum() + (np.diff(gone.astype(int)) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, length=20, **options):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tk string, h int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.digests(docs, length=length, anchor=8, **options).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_against_all_windows(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 5)))
    passage = [" ".join(word() for _ in range(12)) for _ in range(6)]
    texts = [None, "", "short", "a" * 90, "a" * 20, "a" * 19, "ab" * 40]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 15))) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(passage)[rng.randint(0, 9) :])
        texts.append(" ".join(parts))
    texts += texts[10:14]
    check(spark, texts)
    check(spark, texts, shard=300, held=50)


def test_long_text_and_empty_table(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh") for _ in range(40_000))
    check(spark, [long, long[100:400] + "x" * 10, "y" + long[39_000:]], 200)
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.digests(docs).collect() == []


def test_bytes_left(spark):
    docs = spark.createDataFrame([(1, "q" * 5 + "repeat me now" + "r"), (2, "repeat me now")], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in S.remove_repeats(docs, length=13, anchor=4).collect()}
    assert got == {1: b"qqqqqr", 2: b""}
