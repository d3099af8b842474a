"""Near hashes against all pairs, and the greedy choice in rounds against the loop."""

import random

import pytest

from shelfscope.operators import near


@pytest.mark.parametrize(("apart", "bits", "radius"), [(5, 64, 1), (5, 64, 0), (3, 24, 1), (8, 63, 2)])
def test_near_hashes_equal_all_pairs(spark, apart, bits, radius):
    r = random.Random(apart * bits + radius)
    base = [r.getrandbits(64) for _ in range(12)]
    rows = [(r.choice(("x", "y")), i, h if h < 2**63 else h - 2**64) for i in range(160) for h in [r.choice(base) ^ sum(1 << p for p in r.sample(range(64), r.randint(0, 7)))]]
    rows += [("x", 1000, None), (None, 1001, rows[0][2])]
    got = near.near_hashes(spark.createDataFrame(rows, "within string, id int, hash long"), apart=apart, bits=bits, radius=radius).collect()
    low = 2**bits - 1
    want = [(w, a, b, d) for w, a, x in rows for v, b, y in rows if w == v and w and a < b and x is not None and y is not None and (d := ((x ^ y) & low).bit_count()) <= apart]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100


def test_too_many_parts(spark):
    with pytest.raises(ValueError):
        near.near_hashes(spark.createDataFrame([], "within int, id int, hash long"), apart=22, bits=16, radius=0)


def chosen(rows, most, apart):
    out = []
    for product in {r[0] for r in rows}:
        taken = []
        for r in sorted((r for r in rows if r[0] == product), key=lambda r: (-r[2] * r[3], r[1])):
            if r[4] is None or all(t[4] is None or ((r[4] ^ t[4]) & (2**64 - 1)).bit_count() > apart for t in taken):
                taken.append(r)
        out += taken[:most]
    return sorted(out, key=str)


def test_greedy_images_equal_the_loop(spark):
    r = random.Random(2)
    rows = []
    for product in range(6):
        h = r.getrandbits(63)
        for i in range(60):  # chains of images of which each looks like the one before
            h = h ^ sum(1 << p for p in r.sample(range(63), r.choice((0, 2, 3, 9))))
            rows.append((product, i, r.randint(1, 9), r.randint(1, 9), h if r.random() > 0.05 else None))
    table = spark.createDataFrame(rows, "product_id int, image_id int, width int, height int, hash long")
    for most in (12, 1000):
        got = near.greedy_images(table, most=most)
        assert got.columns == table.columns and sorted(map(tuple, got.collect()), key=str) == chosen(rows, most, 5)
    assert not near.greedy_images(table.limit(0)).count()
