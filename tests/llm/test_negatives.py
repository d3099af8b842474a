"""Hard negatives against a plain search."""

import random

import numpy as np

from shelfscope.llm import negatives


def plain(rows, every=4, relabel=0, scale=256):
    """The contract, row by row: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    good = set()
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        if relabel and i % relabel == 0:
            label = (label + 1) % 10
        good.add((i, label, tuple(int(np.floor(scale * float(x))) for x in v)))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for a in good:
        if a[0] % every:
            continue
        met = sorted(((-dot(a[2], c[2]), c[0], c) for c in good if c != a and len(c[2]) == len(a[2])), key=lambda x: x[:2])
        for p, pid, _ in [m for m in met if m[2][1] == a[1]][:5]:
            inside = [m for m in met if m[2][1] != a[1] and 50 * -p <= 100 * -m[0] <= 95 * -p]
            out += [(a[0], pid, r, n[1], -p, -n[0]) for r, n in enumerate(inside[:3], 1)]
    return sorted(out)


def got(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in df.collect())


def test_strassen_is_exact():
    r = np.random.default_rng(1)
    for n, k, m in ((1, 1, 1), (33, 64, 70), (100, 37, 129), (65, 65, 65), (3, 200, 2), (128, 64, 0)):
        a, b = r.integers(-(10**6), 10**6, (n, k)), r.integers(-(10**6), 10**6, (k, m))
        assert (negatives.strassen(a, b, 4) == a @ b).all() and (negatives.strassen(a.astype(object), b.astype(object), 8) == a @ b).all()
    # sums on the way leave 64 bits, the results don't
    a = np.full((64, 64), 2**61) * np.where(np.arange(64) % 2, 1, -1)
    assert (negatives.strassen(a, np.ones((64, 64), dtype=np.int64), 4) == 0).all()
    huge = np.full((2, 3), 2**40)
    assert (negatives.scores(huge, huge) == 2**63 - 1).all() and (negatives.scores(huge, -huge) < -(2**62)).all()


def test_windows_hold_what_the_rule_says():
    for p in [*range(0, 400), 2**62 + 12345]:
        low, high = (int(x) for x in negatives.window(p))
        for s in {low - 1, low, high, high + 1, p, p // 2}:
            assert (low <= s <= high) == (50 * p <= 100 * s <= 95 * p)


def test_heaps_merge():
    r = np.random.default_rng(2)
    heap, seen = negatives.Heap(3, 4), [[], [], []]
    for _ in range(6):
        s, i, p = r.integers(-5, 5, (3, 7)), r.integers(0, 50, (3, 7)), r.integers(0, 9, (3, 7))
        heap.add(s, i, p)
        for j in range(3):
            seen[j] += zip(-s[j], i[j], p[j], strict=True)
            assert [(-a, b, c) for a, b, c in zip(heap.score[j], heap.id[j], heap.point[j], strict=True)] == sorted(seen[j])[:4]


SCHEMA = "vec_id long, embedding array<double>, label int, score double, point int"


def test_equals_a_plain_search(spark, monkeypatch):
    r = random.Random(3)
    some = [[r.uniform(-1, 1) for _ in range(5)] for _ in range(60)]
    rows = [(i, r.choice(some) if i % 3 else some[0], r.choice([0, 0, 1, 2, 9])) for i in range(400)]
    rows += [(500, None, 1), (504, [1.0, None, 0.0, 0.0, 0.0], 1), (508, [float("nan")] * 5, 1), (512, [float("inf")] * 5, 1), (516, some[1], None), (None, some[2], 1), (520, [1.0, 2.0], 0), (521, [1.0, 2.5], 0), (522, [1.0, 1.5], 1), (524, [], 0), (525, [], 1)]
    rows += [rows[4], rows[4], (8, some[3], 0), (8, some[3], 1)]
    df = spark.createDataFrame([(*x, 0.5, 1) for x in rows], SCHEMA)
    want = plain(rows)
    assert len(want) > 300 and got(negatives.hard_negatives(df, every=4)) == want
    for name, value in (("CANDIDATES", 40), ("ANCHORS", 11), ("TILE", 7), ("LEAF", 2), ("SPREAD", 10)):
        monkeypatch.setattr(negatives, name, value)
    assert got(negatives.hard_negatives(df, every=4, relabel=7)) == plain(rows, relabel=7)
    for empty in (df.limit(0), df.where("vec_id % 4 > 0"), df.where("label = 1")):
        assert negatives.hard_negatives(empty, every=4).count() == 0
    one = df.where("label = 0 OR vec_id = 16").limit(3)
    assert got(negatives.hard_negatives(one, every=1)) == plain([(x.vec_id, x.embedding, x.label) for x in one.collect()], every=1)


def test_scores_beyond_64_bits(spark):
    rows = [(0, [1e15, 1.0], 0, 0.0, 0), (1, [1e15, 2.0], 0, 0.0, 0), (2, [0.0, 1.0], 1, 0.0, 0), (3, [1e9, 3.0], 1, 0.0, 0)]
    out = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), every=50).collect()
    assert all(r.positive_score == 2**63 - 1 for r in out)
