import random

import numpy as np
import pyarrow as pa
import pytest
from test_similar_sets import brute, frame

from marquee.llm import similar_sets as S
from marquee.llm.set_prefixes import Prefixes, _tokens


def near_copies(items, records, seed):
    rng = random.Random(seed)
    sets = {}
    for u in range(0, records, 2):
        base = rng.sample(range(items), rng.choice([8, 9, 12, 30, 60]))
        sets[u] = set(base)
        sets[u + 1] = set(base[: max(1, len(base) - rng.randint(0, 6))]) | set(rng.sample(range(items), rng.randint(0, 3)))
    return sets


@pytest.mark.parametrize("items", [400, 5000])
def test_every_pair_is_found_without_sketches(spark, monkeypatch, items):
    sets = near_copies(items, 800, 6)
    monkeypatch.setattr(S, "near_pairs", lambda *args: pytest.fail("sketches"))
    pairs, members = S.similar_sets(frame(spark, sets), "user", "item")
    want = brute(sets, 8, 7, 10)
    assert {(r.id_a, r.id_b) for r in S.expand(pairs, members, "user").collect()} == want and len(want) > 150


def test_long_lists_are_left_to_sketches(spark, monkeypatch):
    sets, asked, whole = near_copies(70, 200, 6), [], S.near_pairs
    monkeypatch.setattr(Prefixes, "estimate", lambda self, representatives, records: (1e18, {}))
    monkeypatch.setattr(S, "near_pairs", lambda *args: asked.append(1) or whole(*args))
    pairs, members = S.similar_sets(frame(spark, sets), "user", "item")
    got, want = {(r.id_a, r.id_b) for r in S.expand(pairs, members, "user").collect()}, brute(sets, 8, 7, 10)
    assert asked and got <= want and len(want - got) <= 0.02 * len(want)


def test_crowded_tokens_lose_no_pair(spark):
    df = frame(spark, near_copies(60, 300, 7))
    prefixes = Prefixes(df, "item", 7, 10, 8)
    signed = S.signatures(df, "user", "item", prefixes).where("size >= 8")
    token = sorted({int(t) for r in signed.collect() for t in np.frombuffer(r.tokens, np.uint32)})
    cut = {t: 2 + k % 3 for k, t in enumerate(token[::2])}
    found = [sorted(map(tuple, prefixes.pairs(signed, 300, parts).collect())) for parts in ({}, cut)]
    assert found[0] == found[1] and len(found[0]) > 100 and len({x[:2] for x in found[0]}) == len(found[0])


def test_tokens_of_a_set_in_parts(spark):
    """The rarest items come first, and a set that lies in parts has the tokens it has whole."""
    df = spark.createDataFrame([(u, i) for i in range(100) for u in range(i % 7 + 1)], "user bigint, item bigint")
    prefixes = Prefixes(df, "item", 7, 10, 8)
    x = np.arange(100, dtype=np.int64)
    whole = prefixes.of(x, np.array([0]), np.array([100]), np.array([0]))
    part = prefixes.of(np.concatenate([x[::2], x[1::2]]), np.array([0, 50]), np.array([50, 50]), np.array([1, 2]))
    token, counts = _tokens(whole)
    first = sorted(x, key=lambda i: prefixes.keys(np.array([i]))[0])
    assert counts.tolist() == [31] and token.tolist() == prefixes.keys(np.array(first[:31])).astype(np.uint32).tolist()
    assert max(i % 7 for i in first[:30]) < 3 and prefixes.joined(part.to_pylist()) == whole[0].as_py()
    assert _tokens(pa.array([b"", b""], pa.binary()))[1].tolist() == [0, 0]


def test_a_pair_meets_for_every_size():
    """Two sets that just reach the threshold share at least as many items as the prefixes leave out."""
    law = Prefixes.__new__(Prefixes)
    law.numerator, law.denominator = 7, 10
    for a in range(8, 60):
        for b in range(a, 60):
            common = -(-7 * (a + b) // 17)
            if common <= a:
                assert law.short(np.array([a]))[0] > a - common and law.long(np.array([b]))[0] > b - common
