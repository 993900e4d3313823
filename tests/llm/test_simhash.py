from __future__ import annotations

import random
from itertools import combinations

import numpy as np

from tests.llm._data import WORDS, awkward, frame, row, text
from windrose.llm import _text, golay, simhash


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 300)
    at, index = golay.keys(words)
    own = [set(index[at == i].tolist()) for i in range(len(words))]
    assert {len(o) for o in own} <= {1, 6}
    for i, w in enumerate(words[:40].tolist()):
        for bits in [(a,) for a in range(23)] + list(combinations(range(23), 2)):
            at, other = golay.keys(np.array([w ^ sum(1 << b for b in bits)]))
            assert own[i] & set(other.tolist())


def prints(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts]))).astype(np.int64)
    packed, count = simhash.fingerprints(data, offsets)
    return [int(sum(int(packed[i, k]) << 46 * k for k in range(4))) for i in range(len(texts))], count


def test_fingerprint_is_the_majority_of_word_hashes():
    t = text(random.Random(3), 30)
    data = np.frombuffer(t.encode(), np.uint8)
    hashes, _ = _text.distinct_words(data, np.array([0, len(data)]))
    got, count = prints([t])
    assert count[0] == len(hashes) == len({w.strip(".").lower() for w in t.split()})
    assert prints([t.upper()])[0] == got and bin(got[0]).count("1") in range(60, 125)


def rows_with_copies(rng, groups=40):
    rows, nth = [], 0
    for _ in range(groups):
        base = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(150)]
        for c in range(rng.randrange(1, 6)):
            words = list(base)
            for _ in range(rng.randrange(0, 4) if c else 0):
                words[rng.randrange(len(words))] = rng.choice(WORDS) + rng.choice(WORDS)
            rows.append(row(nth, " ".join(words)))
            nth += 1
    return rows


def roots(n, pairs):
    forest = simhash.Forest(n)
    for a, b in pairs:
        forest.join(a, b)
    return [forest.root(i) for i in range(n)]


def test_recall_and_precision_against_all_pairs(spark):
    rows = rows_with_copies(random.Random(4))
    found, _ = prints([r[1] for r in rows])
    near = [(i, j) for i, j in combinations(range(len(rows)), 2) if (found[i] ^ found[j]).bit_count() <= simhash.MAX_DISTANCE]
    sure = [(i, j) for i, j in near if (found[i] ^ found[j]).bit_count() <= 20]
    want = roots(len(rows), near)
    got = {r["node"]: r["root"] for r in simhash.near_copies(frame(spark, rows)).collect()}
    mine = [got.get(i, i) for i in range(len(rows))]
    assert all(mine[i] == mine[j] for i, j in sure) and len(sure) > 20
    assert sum(mine[i] == mine[j] for i, j in near) >= 0.9 * len(near)
    assert all(want[i] == want[j] for i, j in combinations(range(len(rows)), 2) if mine[i] == mine[j])
    kept = {r["doc_id"] for r in simhash.keep_one(frame(spark, rows)).collect()}
    assert kept == {i for i, r in enumerate(mine) if r == i}


def test_large_group_and_clean_documents(spark):
    rng = random.Random(5)
    same = text(rng, 20)
    rows = [row(i, same) for i in range(400)] + [row(1000 + i, " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(150))) for i in range(30)]
    got = {r["doc_id"]: r for r in simhash.kept_with_copies(frame(spark, rows)).collect()}
    assert set(got) == {0, *range(1000, 1030)} and got[0]["n_copies"] == 400 and got[0]["copies"] == list(range(400))


def test_awkward_rows(spark):
    rows = awkward(random.Random(6))
    df = frame(spark, rows, extra=True)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(repr(r[0]) for r in rows)
    listed = {r["doc_id"]: r["copies"] for r in simhash.kept_with_copies(df).collect()}
    assert listed == {r[0]: [r[0]] for r in rows if r[0] is not None}
    assert simhash.kept_with_copies(frame(spark, [])).count() == 0 and simhash.keep_one(frame(spark, [])).count() == 0


def test_large_groups_take_several_rows(spark, monkeypatch):
    import random

    import pytest

    from tests.llm._data import frame, row, text
    from windrose.llm import simhash as D

    monkeypatch.setattr(D, "PART_ROWS", 3)
    rng = random.Random(8)
    body, other = text(rng, 9), text(rng, 9)
    rows = [row(i, body) for i in range(20)] + [row(100, other), row(101, other), row(200, text(rng, 9))]
    got = D.kept_with_copies(frame(spark, rows)).collect()
    large = [r for r in got if r["doc_id"] == 0]
    assert len(large) > 1 and sorted(c for r in large for c in r["copies"]) == list(range(20)) and {r["n_copies"] for r in large} == {20}
    assert len({r["part"] for r in large}) == len(large)
    assert {(r["doc_id"], tuple(r["copies"])) for r in got if r["doc_id"]} == {(100, (100, 101)), (200, (200,))}
    with pytest.raises(TypeError):
        D.kept_with_copies(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_near_copies_of_one_text_do_not_multiply(monkeypatch):
    """2,000 fingerprints around one and 300 others in a bucket: all pairs are judged, without comparing near copies with each other again and again."""
    rng = np.random.default_rng(9)
    bits = np.concatenate([np.repeat(rng.integers(0, 2, (1, 184)), 2000, axis=0), rng.integers(0, 2, (300, 184))]).astype(np.uint8)
    bits[2000:, 23:69] = bits[0, 23:69]
    for i in range(1, 2000):
        bits[i, rng.integers(69, 184, rng.integers(4, 15))] ^= 1
    bits[2000:2010] = bits[5:15]
    bits[2000:2010, 69 + np.arange(30)] ^= 1
    packed = np.stack([(bits[:, 46 * k : 46 * k + 46].astype(np.uint64) << np.arange(46, dtype=np.uint64)).sum(axis=1) for k in range(4)], axis=1)
    order = rng.permutation(len(packed))
    packed, ids = packed[order], np.arange(len(order), dtype=np.int64) * 7
    distance = sum(np.bitwise_count(packed[:, None, k] ^ packed[None, :, k]).astype(int) for k in range(4))
    want = np.arange(len(packed))
    while not np.array_equal(want, least := np.where(distance <= simhash.MAX_DISTANCE, want, len(packed)).min(axis=1)):
        want = least

    compared = 0
    count = np.bitwise_count

    def counting(x):
        nonlocal compared
        compared += x.size
        return count(x)

    monkeypatch.setattr(simhash.np, "bitwise_count", counting)
    at, index = golay.keys(simhash.segment(packed, 1))
    assert np.count_nonzero(index == index[0]) == len(packed)
    member, root = simhash._search(np.full(len(packed), 1 << 12 | index[0], np.int32), ids, packed, simhash.MAX_DISTANCE)
    got = ids.copy()
    got[member // 7] = root
    assert (got == want * 7).all() and 250 < len(set(want.tolist())) < 310
    assert compared < 6 * 4 * 2000 * 500  # six groups, four words each: near copies against the 300 others, not against 2,000
