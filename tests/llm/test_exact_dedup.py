from __future__ import annotations

import random
from collections import defaultdict

import numpy as np

from tests.llm._data import awkward, frame, row, text
from windrose.llm import exact_dedup as E


def test_index_equals_dict():
    rng = np.random.default_rng(1)
    index = E.Index(memtable_rows=500, fanout=3)
    want: dict = {}
    for _ in range(60):
        keys = np.empty(300, E._KEY)
        keys["hi"], keys["lo"] = rng.integers(0, 40, 300), rng.integers(0, 90, 300)
        ids = rng.integers(0, 1 << 40, 300)
        index.add(keys, ids)
        for h, lo, i in zip(keys["hi"].tolist(), keys["lo"].tolist(), ids.tolist()):
            least, n = want.get((h, lo), (1 << 62, 0))
            want[h, lo] = (min(least, i), n + 1)
    run = index.compact()
    assert {(int(h), int(lo)): (int(i), int(n)) for (h, lo), i, n in zip(run.keys.tolist(), run.ids, run.counts)} == want
    assert len(index.levels) > 1 and len(E.Index().compact().keys) == 0


def test_equals_brute_force(spark):
    rng = random.Random(2)
    texts = [text(rng, 3) for _ in range(20)] + ["", "é", "é"]
    rows = [row(i, rng.choice(texts)) for i in range(300)] + awkward(rng)
    groups = defaultdict(set)
    for d, t, *_ in rows:
        if d is not None:
            groups[t if t is not None else d].add(d)
    got = {(r["doc_id"], r["n_copies"], tuple(r["copies"])) for r in E.kept_with_copies(frame(spark, rows, extra=True)).collect()}
    assert got == {(min(g), len(g), tuple(sorted(g))) for g in groups.values()}
    kept = E.keep_one(frame(spark, rows, extra=True))
    ids = sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect())
    assert ids == sorted([min(g) for g in groups.values()] + [900]) and kept.where("doc_id is null").count() == 1


def test_texts_that_share_a_digest_stay_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    def same(docs, doc_id, text):
        return docs.select(F.col(doc_id).alias("node"), F.col(text).alias("text"), F.lit(1).cast("bigint").alias("hi"), F.lit(2).cast("bigint").alias("lo"))

    monkeypatch.setattr(E, "_digested", same)
    got = E.kept_with_copies(frame(spark, [row(1, "a"), row(2, "b"), row(3, "a")]))
    assert {(r["doc_id"], tuple(r["copies"])) for r in got.collect()} == {(1, (1, 3)), (2, (2,))}


def test_empty(spark):
    assert E.kept_with_copies(frame(spark, [])).count() == 0 and E.keep_one(frame(spark, [])).count() == 0


def test_large_groups_take_several_rows(spark, monkeypatch):
    import random

    import pytest

    from tests.llm._data import frame, row, text
    from windrose.llm import exact_dedup as D

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
