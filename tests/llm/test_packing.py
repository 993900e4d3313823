from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm._data import awkward, frame, row, text
from windrose.llm.packing import Limits, best_fit


def literal(items: list[tuple], limits: Limits) -> dict:
    """(doc_id, copy, piece) -> bin's number, one item at a time in plain Python."""
    pieces = [(min(limits.piece, n - a), d, c, a // limits.piece) for d, c, n in items for a in range(0, n, limits.piece)]
    order = {(d, c): i for i, (d, c, _) in enumerate(items)}
    pieces.sort(key=lambda p: (-p[0], order[p[1], p[2]], p[3]))
    caps = (limits.tokens, limits.docs, limits.cost)
    bins: list[list[int]] = []
    out = {}
    for size, d, c, nth in pieces:
        need = (size, 1, size * size)
        best, at = None, None
        for i, free in enumerate(bins):
            if all(f >= x for f, x in zip(free, need)):
                if limits.rule == "dot":
                    value = -sum(w * x / cap * f / cap for w, x, f, cap in zip(limits.weights, need, free, caps))
                else:
                    value = sum(w * ((f - x) / cap) ** 2 for w, x, f, cap in zip(limits.weights, need, free, caps))
                if best is None or value < best - 1e-15:
                    best, at = value, i
        if at is None:
            bins.append(list(caps))
            at = len(bins) - 1
        bins[at] = [f - x for f, x in zip(bins[at], need)]
        out[d, c, nth] = at
    return out


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_equals_literal_loop(spark, rule):
    rng = random.Random(1)
    limits = Limits(tokens=100, docs=5, cost=4000, rule=rule)
    sizes = [rng.choice([0, 1, 3, 10, 30, 50, 63, 64, 99, 200, rng.randrange(1, 90)]) for _ in range(150)]
    rows = [row(i, "x" * (4 * n)) for i, n in enumerate(sizes)]
    got = {(r["doc_id"], r["copy"], r["piece"]): r["bin_id"] for r in best_fit(frame(spark, rows), limits).collect()}
    items = sorted(((i, 1, n) for i, n in enumerate(sizes) if n), key=lambda x: (-x[2], x[0]))
    assert got == literal(items, limits)


def test_every_token_once_within_all_limits(spark):
    rng = random.Random(2)
    rows = [row(i, text(rng, rng.choice([1, 5, 40, 300]))) for i in range(400)] + awkward(rng)
    limits = Limits(tokens=512, docs=4, cost=100_000, shard_rows=64)
    out = best_fit(frame(spark, rows, extra=True), limits)
    bins, items = defaultdict(list), defaultdict(list)
    for r in out.collect():
        bins[r["bin_id"]].append(r)
        items[r["doc_id"], r["copy"]].append(r)
    for b in bins.values():
        assert sum(r["tokens"] for r in b) <= 512 and len(b) <= 4 and sum(r["tokens"] ** 2 for r in b) <= 100_000
        assert sorted(r["position"] for r in b) == list(range(len(b)))
    for own in items.values():
        own.sort(key=lambda r: r["piece"])
        assert [r["first_token"] for r in own] == [sum(x["tokens"] for x in own[:i]) for i in range(len(own))]
    want = sum(-(-len(t.encode()) // 4) for _, t, *_ in rows if t)
    assert sum(r["tokens"] for b in bins.values() for r in b) == want
    assert {c for d, c in items if d == 900} == {1, 2} and not {901, 902, 907} & {d for d, _ in items}


def test_production_limits_fill_bins(spark):
    rng = random.Random(3)
    out = best_fit(frame(spark, [row(i, text(rng, rng.randrange(5, 200))) for i in range(500)])).groupBy("bin_id").agg(F.sum("tokens").alias("t"))
    assert out.agg(F.sum("t") / F.count("*") / 8192).first()[0] > 0.9


def test_empty_and_wrong(spark):
    assert best_fit(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        Limits(tokens=0)


def test_an_id_that_many_rows_share_is_spread(spark):
    rng = random.Random(7)
    rows = [row(None, text(rng, rng.randrange(1, 4))) for _ in range(300)] + [row(5, "same text here")] * 200 + [row(i, text(rng, 2)) for i in range(100, 200)]
    out = best_fit(frame(spark, rows), Limits(tokens=256, docs=8, shard_rows=64)).collect()
    keys = [(r["doc_id"], r["copy"], r["piece"]) for r in out]
    assert len(keys) == len(set(keys)) and {len({c for d, c, _ in keys if d == i}) for i in (None, 5)} == {300, 200}
    shards = defaultdict(set)
    for r in out:
        shards[r["bin_id"] >> 32].add((r["doc_id"], r["copy"]))
    assert max(map(len, shards.values())) < 4 * 64 and sum(map(len, shards.values())) == 600
    assert sum(r["tokens"] for r in out) == sum(-(-len(t.encode()) // 4) for _, t, *_ in rows)
