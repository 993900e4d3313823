"""Documents for the tests: sentences from a small vocabulary, and the awkward rows every operator must stand."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "te", "sha", "vo", "ny", "pra", "gli") for b in ("ran", "bel", "tix", "dom", "sup", "wen", "mar", "fog", "lin", "quo")]


def sentence(rng: random.Random, n: int = 0) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n or rng.randrange(5, 12))).capitalize() + "."


def text(rng: random.Random, sentences: int) -> str:
    return " ".join(sentence(rng) for _ in range(sentences))


def row(doc_id, body, lang="en", source="web"):
    return (doc_id, body, lang, source, None if body is None else len(body))


def awkward(rng: random.Random) -> list[tuple]:
    """Null and empty texts, no words, a very long text, a null id, null columns, and a row that comes twice."""
    twice = row(900, text(rng, 12))
    return [
        row(901, None), row(902, ""), row(903, "... !!! \n"), row(904, text(rng, 6000)), row(None, text(rng, 9)), row(905, "ü"), row(906, text(rng, 3), None, None),
        twice, twice, row(907, ""),
    ]


def frame(spark, rows, extra: bool = False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        names = ["k", "hi", "copy", "part", "copies", "n", "h", "shard", "length", "__k", "quality_score", "n_private", "stretches_removed", "chars_removed", "gone", "__gone", "tie", "a.b"]
        df = df.select("*", *(F.lit("x").alias(n) for n in names))
    return df
