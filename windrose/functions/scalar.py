"""Scalar expressions: prompts, seeds, costs, call counts, window plans, tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from windrose.config import Listwise, Pairwise, PriceConfig, Strategy


def tokens(text: Column) -> Column:
    """The distinct runs of small ASCII letters and digits, after lower-casing."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


_QUERY, _PASSAGES, _A, _B = "Search query:\n", "\n\nPassages:\n", "\n\nPassage A:\n", "\n\nPassage B:\n"


def listwise_prompt(query: Column, texts: Column) -> Column:
    """The query, and the numbered texts of an array in its order; nothing else of a document is sent."""
    numbered = F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]\n"), t))
    return F.concat(F.lit(_QUERY), query, F.lit(_PASSAGES), F.array_join(numbered, "\n\n"))


def pairwise_prompt(query: Column, a: Column, b: Column) -> Column:
    return F.concat(F.lit(_QUERY), query, F.lit(_A), a, F.lit(_B), b)


def listwise_message(query: str, texts: Sequence[str]) -> str:
    """``listwise_prompt`` of plain strings: what a provider sends."""
    return _QUERY + query + _PASSAGES + "\n\n".join(f"[{i}]\n{t}" for i, t in enumerate(texts, 1))


def pairwise_message(query: str, a: str, b: str) -> str:
    return _QUERY + query + _A + a + _B + b


def stable_seed(*parts: Column) -> Column:
    """The first four bytes, big-endian, of the SHA-256 of the parts joined by colons."""
    key = F.concat_ws(":", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint")


def estimate_cost(prompt_tokens: Column, completion_tokens: Column, price: PriceConfig | None) -> Column:
    """Dollars; null where a token count or the price is missing."""
    if price is None:
        return F.lit(None).cast("double")
    return (prompt_tokens * F.lit(float(price.input_per_million)) + completion_tokens * F.lit(float(price.output_per_million))) / 1e6


def estimate_calls(n: Column, strategy: Strategy) -> Column:
    """Provider calls that ``strategy`` makes for ``n`` documents; none for an empty list."""
    if isinstance(strategy, Pairwise):
        return (F.lit(2 * strategy.passes) * F.greatest(n - 1, F.lit(0))).cast("int")
    w, s = strategy.window_size, strategy.stride
    return F.when(n < 1, 0).when(n <= w, 1).otherwise(F.ceil((n - w) / F.lit(s)) + 1).cast("int")


def window_starts(n: Column, strategy: Listwise) -> Column:
    """First positions of the windows in the order of their ranking: back to front, the last one at 0 and full."""
    w, s = strategy.window_size, strategy.stride
    back = F.sequence(F.greatest(n - w, F.lit(1)), F.lit(1), F.lit(-s))
    return F.when(n <= w, F.array(F.lit(0))).otherwise(F.concat(back, F.array(F.lit(0))))


def window_ranges(document_count: int, window_size: int, step: int, rank_start: int = 0, rank_end: int | None = None) -> tuple[tuple[int, int], ...]:
    """(start, end) of windows moved by their end, so that the last may be short; a planning aid, not the strategy's windows.

    An end beyond the list is its end; a list without documents has no windows; a range without places is refused.
    """
    if document_count < 1:
        return ()
    rank_end = document_count if rank_end is None else rank_end
    if rank_start < 0 or window_size < 1 or not 1 <= step <= window_size or rank_end <= rank_start:
        raise ValueError("0 <= rank_start < rank_end and 1 <= step <= window_size must hold")
    end = min(rank_end, document_count)
    if end <= rank_start:
        raise ValueError("the range begins behind the last document")
    starts = range(end - window_size, rank_start, -step)
    ends = range(end, end - step * len(starts), -step)
    return (*zip(starts, ends), (rank_start, end - step * len(starts)))


def range_plan(n: Column, window_size: int, step: int) -> Column:
    """``window_ranges`` over all of ``n`` documents: an array of (start, upto) in the order of the calls."""
    moved = F.when(n > window_size, F.ceil((n - window_size) / F.lit(step))).otherwise(0)
    steps = F.sequence(F.lit(0), moved.cast("int"))
    made = F.transform(steps, lambda i: F.struct(F.greatest(n - i * step - window_size, F.lit(0)).cast("int").alias("start"), (n - i * step).cast("int").alias("upto")))
    return F.when(n < 1, F.array().cast("array<struct<start:int,upto:int>>")).otherwise(made)


def compose_title(title: Column, text: Column) -> Column:
    """Title, blank line, text; a missing title counts as empty."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), text)


def compose_optional_title(title: Column, text: Column) -> Column:
    """As ``compose_title``, but without an empty title and without white space around the whole."""
    both = F.when(F.coalesce(title, F.lit("")) != "", F.concat(title, F.lit("\n\n"), text)).otherwise(text)
    return F.regexp_replace(both, r"(?U)^\s+|\s+$", "")
