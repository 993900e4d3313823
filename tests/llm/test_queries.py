"""The registered queries over the driver's smallest tables: against their SQL, or against brute force where there is none."""

from __future__ import annotations

import os
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from windrose.llm import oracles, packing, queries, simhash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def table(spark, name):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]


def test_one_query_per_operator():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]


@pytest.mark.parametrize("name", list(oracles.ORACLES))
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    got, want = queries.QUERIES[name](spark, SF), con.sql(oracles.ORACLES[name])
    assert got.columns == want.columns
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, want.fetchall()))


def test_line_dedup(spark):
    from tests.llm.test_line_dedup import brute

    want = brute(table(spark, "documents"))
    got = {r["doc_id"]: r["text"] for r in queries.op1_line_dedup(spark, SF).collect()}
    assert got == {d: t for (d, _), t in want.items()} and any(len(t) < len(o) for (_, o), t in want.items())


def test_near_dedup(spark):
    from tests.llm.test_simhash import prints, roots

    docs = sorted(table(spark, "documents"))
    found, _ = prints([d[1] for d in docs])
    near = [(i, j) for i, j in combinations(range(len(docs)), 2) if (found[i] ^ found[j]).bit_count() <= simhash.MAX_DISTANCE]
    want = roots(len(docs), near)
    kept = {r["doc_id"]: r["copies"] for r in queries.op3_simhash_near_dedup(spark, SF).collect()}
    root = {c: d for d, copies in kept.items() for c in copies}
    together = [root[docs[i][0]] == root[docs[j][0]] for i, j in near]
    assert near and sum(together) >= 0.9 * len(near)
    assert all(want[i] == want[j] for i, j in combinations(range(len(docs)), 2) if root[docs[i][0]] == root[docs[j][0]])


def test_packing(spark):
    from tests.llm.test_packing import literal

    items = sorted(((d[0], 1, -(-len(d[1].encode()) // 4)) for d in table(spark, "documents") if d[1]), key=lambda x: (-x[2], x[0]))
    got = {(r["doc_id"], r["copy"], r["piece"]): r["bin_id"] for r in queries.op4_best_fit_packing(spark, SF).collect()}
    assert got == literal(items, packing.Limits())


def test_private_data(spark):
    from tests.llm.test_pii import naive

    want = Counter((d[0], k, a, b, d[1][a:b]) for d in table(spark, "documents") if d[1] for a, b, k in naive(d[1]))
    assert Counter(map(tuple, queries.op5_pii(spark, SF).collect())) == want and want


def test_quality(spark):
    labels = {d: (q, t) for d, q, t in table(spark, "labels")}
    kept = {r["doc_id"] for r in queries.op7_quality_classifier(spark, SF).collect()}
    good = [d for d, x in labels.items() if x == (1, 0)]
    assert sum(d in kept for d in good) >= 0.95 * len(good)


def test_quality_holds_on_labels_it_never_saw(spark, tmp_path):
    """Half of the good labels train; the other half stay, and far more of the labelled junk goes than of them."""
    from windrose.llm.pu_quality import accepted, train, trusted_ids

    larger = SF.replace("0.001", "0.1")
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    kept = {r[0] for r in accepted(docs, train(docs, trusted_ids(labels.where("doc_id % 2 = 0"))), columns=["doc_id"]).collect()}
    held = {d: (q, t) for d, q, t in map(tuple, labels.where("doc_id % 2 = 1").collect())}
    good = [d in kept for d, x in held.items() if x == (1, 0)]
    bad = [d in kept for d, x in held.items() if x[0] == 0]
    print("held-out good kept", sum(good), len(good), "bad kept", sum(bad), len(bad))
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.5 * len(bad)


def test_media(spark):
    from tests.llm.test_progressive_jpeg import direct
    from windrose.llm.progressive_jpeg import thumbnail

    vectors = {v[0]: v[1] for v in table(spark, "embeddings")}
    rows = queries.op8_progressive_jpeg(spark, SF).collect()
    assert len(rows) == len(vectors)
    sizes = defaultdict(int)
    for r in rows:
        want = direct(thumbnail(vectors[r["vec_id"]], r["vec_id"]))
        sizes[want.shape] += 1
        assert np.abs(np.frombuffer(r["rgb"], np.uint8).reshape(want.shape).astype(float) - want).max() <= 1
    assert len(sizes) > 10
