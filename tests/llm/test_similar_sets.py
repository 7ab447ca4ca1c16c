import random

import numpy as np
import pytest

from marquee.llm import similar_sets as S


def brute(sets, least, num, den):
    users = sorted(u for u, s in sets.items() if len(s) >= least)
    return {(a, b) for i, a in enumerate(users) for b in users[i + 1 :] if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])}


def frame(spark, sets):
    rows = [(u, i, 1) for u, s in sets.items() for i in s for _ in range(1 + (i % 3 == 0))]
    return spark.createDataFrame(rows + [(None, 1, 1), (1, None, 1)], "user bigint, item bigint, size int")


def test_against_brute_force(spark):
    rng = random.Random(4)
    sets = {}
    for u in range(0, 900, 3):
        base = set(rng.sample(range(400), rng.choice([5, 8, 12, 30, 60])))
        sets[u] = base
        sets[u + 1] = set(list(base)[: max(1, len(base) - rng.randint(0, 6))]) | set(rng.sample(range(400), rng.randint(0, 3)))
        sets[u + 2] = set(base) if rng.random() < 0.3 else {1}
    want = brute(sets, 8, 7, 10)
    pairs, members = S.similar_sets(frame(spark, sets), "user", "item")
    got = {(r.id_a, r.id_b) for r in S.expand(pairs, members, "user").collect()}
    assert got <= want and len(want - got) <= 0.01 * len(want)
    assert got == {(a, b) for a, b in got if a < b}


def test_crowded_cells_lose_no_pair(spark):
    rng = random.Random(8)
    core = set(range(30))
    sets = {u: core - set(rng.sample(range(30), 2)) | {100 + rng.randrange(40)} for u in range(150)}
    signed = S.signatures(frame(spark, sets), "user", "item")
    plan = S.calibrate(150, 0.7, 0.99)
    cells = {(s << 24): 1 + s % 4 for s in range(len(plan.bits))}
    found = [sorted(map(tuple, S.candidates(signed, plan, 7, 10, 150, parts).collect())) for parts in ({}, cells)]
    assert found[0] == found[1] and len(found[0]) > 5000


def test_segments_go_through_shuffles_in_turn(spark, monkeypatch):
    """At most so many segments lie on disk at once, however many there are; all rounds together find what one finds."""
    rng = random.Random(4)
    core = set(range(30))
    sets = {u: core - set(rng.sample(range(30), 3)) | {100 + rng.randrange(40)} for u in range(80)}
    signed = S.signatures(frame(spark, sets), "user", "item")
    plan = S.calibrate(80, 0.7, 0.99)
    want, whole, asked = sorted(map(tuple, S.candidates(signed, plan, 7, 10, 80).collect())), S.candidates, []
    monkeypatch.setattr(S, "candidates", lambda *args: asked.append(args[-1]) or whole(*args))
    assert sorted(map(tuple, S.near_pairs(signed, plan, 7, 10, 80, 3).collect())) == want and len(want) > 1000
    assert [s for part in asked for s in part] == list(range(len(plan.bits))) and max(map(len, asked)) == 3


def test_empty(spark):
    pairs, members = S.similar_sets(frame(spark, {}), "user", "item")
    assert S.expand(pairs, members, "user").count() == 0


@pytest.mark.parametrize("records", [10, 30_000, 3_000_000])
def test_calibrated_recall(records):
    plan = S.calibrate(records, 0.7, 0.99)
    rng = np.random.default_rng(2)
    flips = rng.random((4000, 128)) < 0.15
    weights = flips.sum(axis=1)
    first = flips[:, :64].sum(axis=1)
    hit = np.zeros(4000, bool)
    for bits in plan.bits:
        hit |= ~flips[:, bits].any(axis=1)
    assert (hit & (weights <= plan.radius) & (first <= plan.first)).mean() >= 0.98


def test_bits_agree_as_the_sets_do():
    a, b = np.arange(60), np.arange(15, 75)
    m = S.minhashes(np.concatenate([a, b]), np.array([0, 60]), np.array([60, 60]))
    c1, c2 = S.packed(m)
    far = np.bitwise_count(c1[0] ^ c1[1]) + np.bitwise_count(c2[0] ^ c2[1])
    assert 10 < far < 45  # 25.6 expected at similarity 0.6


def test_parts_of_a_record_join_to_its_signature():
    import pyarrow as pa

    x = np.arange(500, dtype=np.int64)
    batch = lambda k, p, x: pa.RecordBatch.from_arrays([pa.array(k), pa.array(p, pa.int32()), pa.array(x)], ["k", "part", "x"])
    whole = next(S._signatures(iter([batch(np.zeros(500, np.int64), np.zeros(500, int), x)])))
    part = np.sort(x % 3 + 1)
    order = np.argsort(x % 3, kind="stable")
    split = next(S._signatures(iter([batch(np.zeros(500, np.int64), part, x[order])])))
    joined = S._joined((pa.scalar(0),), pa.Table.from_batches([split]))
    for c in ("size", "h1", "h2", "c1", "c2"):
        assert joined[c][0].as_py() == whole.column(c)[0].as_py()
