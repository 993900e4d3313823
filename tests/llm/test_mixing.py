from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from tests.llm._data import awkward, frame, row, text
from windrose.llm import mixing as M


def literal(rows, weights=None, power=0.5, total=None) -> Counter:
    """doc_id -> copies, by one running sum in whole millionths per source; ids must be distinct."""
    by = defaultdict(list)
    for d, _, _, source, _ in rows:
        by[source].append(d)
    weight = {s: (len(v) ** power if weights is None else weights.get(s, 0)) for s, v in by.items()}
    out: Counter = Counter()
    for s, ids in by.items():
        e = int((len(rows) if total is None else total) * weight[s] / sum(weight.values()) / len(ids) * 1_000_000 + 0.5)
        at = int(hashlib.md5(f"{M.SEED}:{s if s is not None else chr(0)}".encode()).hexdigest()[:8], 16) % 1_000_000
        for d in sorted(ids, key=lambda d: hashlib.md5(str(d).encode()).hexdigest()):
            out[d] = (at + e) // 1_000_000 - at // 1_000_000
            at += e
    return +out


def documents(rng, n=300):
    return [row(i, text(rng, 1), source=rng.choice(["a"] * 8 + ["b", "b", "c", None])) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"weights": {"a": 1.0, "b": 3.0, None: 0.5}}, {"power": 0.0}, {"total": 1000}])
def test_equals_running_sums(spark, options):
    rows = documents(random.Random(1))
    want = literal(rows, **options)
    got = Counter(r["doc_id"] for r in M.emitted_ids(frame(spark, rows), **options).collect())
    assert got == want
    assert Counter(r["doc_id"] for r in M.mix(frame(spark, rows), **options).collect()) == want


def test_buckets_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", 5)
    rows = documents(random.Random(2))
    assert Counter(r["doc_id"] for r in M.emitted_ids(frame(spark, rows)).collect()) == literal(rows)


def test_targets_within_one(spark):
    rows = documents(random.Random(3))
    source = {r[0]: r[3] for r in rows}
    got = Counter(source[r["doc_id"]] for r in M.emitted_ids(frame(spark, rows)).collect())
    sizes = Counter(source.values())
    for s, n in sizes.items():
        assert abs(got[s] - 300 * n**0.5 / sum(x**0.5 for x in sizes.values())) <= 1.01


def test_awkward_rows(spark):
    rows = awkward(random.Random(4)) * 3
    df = frame(spark, rows, extra=True)
    out = M.mix(df, total=90)
    assert sorted(out.columns) == sorted(df.columns) and abs(out.count() - 90) <= 2
    counts = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert set(counts) == {r[:2] for r in rows}
    assert sum(1 for _ in M.emitted_ids(df, total=90).collect()) == out.count()
    assert M.mix(frame(spark, [])).count() == 0 and M.emitted_ids(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        M.emitted_ids(df, {"web": 0.0})


def test_columns_of_any_kind_and_ids_that_are_texts(spark):
    rows = documents(random.Random(6), 60)
    df = frame(spark, rows).selectExpr("concat('id', doc_id) as doc_id", "text", "source", "map('k', doc_id) as m", "array(map('a', map(1, source))) as deep", "parse_json('{\"x\": 1}') as v", "cast(text as binary) as raw", "cast(null as void) as nothing")
    out = M.mix(df)
    assert out.columns == [*df.columns, "copy"] and abs(out.count() - 60) <= 4
    assert M.emitted_ids(df).count() == out.count()


def test_as_many_sources_as_documents(spark):
    rows = [row(i, "x", source=f"host{i}") for i in range(500)]
    assert {r["doc_id"]: r["copy"] for r in M.emitted_ids(frame(spark, rows)).collect()} == {i: 1 for i in range(500)}
