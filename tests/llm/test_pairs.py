import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from marquee.llm.pair_table import PairTable, added, pack, unpack

SCHEMA = "user bigint, item bigint, extra string, a int"


def frame(spark, baskets):
    rows = [(u, i, "x", 1) for u, items in baskets.items() for i in items]
    return spark.createDataFrame(rows + [(None, 1, None, None), (1, None, None, None)], SCHEMA)


def brute(baskets, least, lift):
    n, ab = Counter(), Counter()
    for items in baskets.values():
        n.update(set(items))
        ab.update(combinations(sorted(set(items)), 2))
    total = sum(1 for x in baskets.values() if x)
    return {(a, b, c, n[a], n[b], total) for (a, b), c in ab.items() if c >= least and c * total >= lift * n[a] * n[b]}


def scored(t, least, lift):
    return {(r.a, r.b, r.n_ab, r.n_a, r.n_b, r.baskets) for r in t.scores(least, lift).collect()}


@pytest.mark.parametrize("large,kept", [(4000, 2), (12, 2), (6, 1)])
def test_changes_in_steps_equal_brute_force(spark, large, kept):
    rng = random.Random(large)
    baskets = {u: [rng.randrange(30) for _ in range(rng.choice([0, 1, 3, 8, 20]))] for u in range(40)}
    baskets[0] = list(range(30)) * 2
    t = PairTable.create(spark, buckets=3, large=large, most_kept=kept).update(frame(spark, baskets), basket="user", item="item")
    assert scored(t, 3, 1) == brute(baskets, 3, 1)
    after = dict(baskets)
    changed = {u: [rng.randrange(30) for _ in range(rng.choice([0, 2, 9, 25]))] for u in rng.sample(range(50), 15)}
    before = {u: baskets[u] for u in changed if u in baskets}
    after |= changed
    t.update(frame(spark, changed), frame(spark, before), basket="user", item="item")
    assert scored(t, 3, 1) == brute(after, 3, 1)
    again = PairTable.load(spark, t.path, t.version)
    assert scored(again, 4, 2) == brute(after, 4, 2)
    items = spark.createDataFrame([(3,)], "item bigint")
    assert {(r.a, r.b) for r in t.scores(3, 1, items).collect()} == {x[:2] for x in brute(after, 3, 1) if 3 in x[:2]}


def test_empty_table(spark):
    t = PairTable.create(spark, buckets=2).update(frame(spark, {}), basket="user", item="item")
    assert t.scores(15, 5).count() == 0


def test_low_support_counts_the_kept_baskets(spark):
    baskets = {1: range(9), 2: range(9), 3: range(4, 12)}
    t = PairTable.create(spark, buckets=2, large=3, most_kept=3).update(frame(spark, baskets), basket="user", item="item")
    for least in (3, 2, 1):
        assert scored(t, least, 0) == brute(baskets, least, 0)


def test_only_touched_buckets_are_written(spark):
    rng = random.Random(11)
    baskets = {u: [rng.randrange(400) for _ in range(6)] for u in range(200)}
    t = PairTable.create(spark, buckets=64).update(frame(spark, baskets), basket="user", item="item")
    change = {7: [1, 2]}
    t.update(frame(spark, change), frame(spark, {7: baskets[7]}), basket="user", item="item")
    wrote = spark.read.parquet(f"{t.path}/state/version=1").count()
    assert 0 < wrote < t.state().count() / 3
    assert scored(t, 1, 0) == brute(baskets | change, 1, 0)
    assert scored(PairTable.load(spark, t.path, "v0"), 1, 0) == brute(baskets, 1, 0)


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    for size in (0, 1, 500):
        for wide in (100, 1 << 40):
            a, b, n = added(rng.integers(-5, wide, size), rng.integers(-5, wide, size), rng.integers(1, 4, size))
            for left, right in zip((a, b, n), unpack(pack(a, b, n))):
                assert (left == right).all()
            a, _, n = added(a, None, n)
            assert all((x == y).all() for x, y in zip((a, n), unpack(pack(a, None, n))[::2]))
