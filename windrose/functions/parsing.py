"""Strict reading of answers: a permutation or a winner, and never a repaired one."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from windrose.errors import RerankParseError


@dataclass(frozen=True)
class ParsedRanking:
    ranking: tuple[int, ...] = ()
    valid: bool = False
    failure_type: str | None = None


def _field(raw: str, name: str) -> Any:
    parsed = json.loads(raw)
    return parsed.get(name) if isinstance(parsed, dict) else None


def classify_ranking(raw: str, n: int) -> ParsedRanking:
    """The ranking in ``{"ranking": [...]}``, or the first reason for which it is none; JSON's true is not a rank."""
    try:
        ranks = _field(raw, "ranking")
    except (ValueError, TypeError, RecursionError):
        return ParsedRanking(failure_type="json_parse_failure")
    if not isinstance(ranks, list):
        return ParsedRanking(failure_type="missing_ranking")
    if not all(type(r) is int for r in ranks):
        return ParsedRanking(failure_type="non_integer_rank")
    if len(ranks) != n:
        return ParsedRanking(tuple(ranks), failure_type="length_mismatch")
    if any(not 1 <= r <= n for r in ranks):
        return ParsedRanking(tuple(ranks), failure_type="out_of_range_rank")
    if len({*ranks}) != n:
        return ParsedRanking(tuple(ranks), failure_type="duplicate_rank")
    return ParsedRanking(tuple(ranks), True)


def parse_ranking(raw: str, n: int) -> list[int]:
    found = classify_ranking(raw, n)
    if not found.valid:
        raise RerankParseError(f"not a ranking of {n} documents: {found.failure_type}", raw)
    return list(found.ranking)


def parse_winner(raw: str) -> str:
    """``A`` or ``B`` from ``{"winner": ...}``, in this very spelling."""
    try:
        winner = _field(raw, "winner")
    except (ValueError, TypeError, RecursionError):
        raise RerankParseError("not JSON", raw) from None
    if not isinstance(winner, str) or winner not in ("A", "B"):
        raise RerankParseError("the winner is neither A nor B", raw)
    return winner


def is_permutation(ranking: Column, n: Column) -> Column:
    return F.coalesce((F.size(ranking) == n) & (F.array_sort(ranking) == F.sequence(F.lit(1), F.greatest(n, F.lit(1)))), F.lit(False))


def ranking_failure(ranking: Column, n: Column) -> Column:
    """failure_type of an array that is already typed; null where it is a permutation of 1..n."""
    wrong = F.exists(ranking, lambda x: (x < 1) | (x > n))
    return (
        F.when(ranking.isNull(), "missing_ranking")
        .when(F.exists(ranking, lambda x: x.isNull()), "non_integer_rank")
        .when(F.size(ranking) != n, "length_mismatch")
        .when(wrong, "out_of_range_rank")
        .when(F.size(F.array_distinct(ranking)) != F.size(ranking), "duplicate_rank")
    )


def apply_permutation(items: Column, ranking: Column) -> Column:
    """``items`` in the order of a permutation of 1..n."""
    return F.transform(ranking, lambda i: F.element_at(items, i))
