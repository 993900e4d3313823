"""The two ranking strategies as folds over one array a query, within the JVM.

The array's elements are structs that begin with (k, i): ``k`` is smaller for the better document and ``i`` is the original
index. Texts stay out of it; they are joined again afterwards. A stable order of windows never swaps equals, so sorting by (k, i)
is sorting by score and place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from windrose.config import Listwise, Pairwise, Strategy
from windrose.functions.scalar import window_starts


def listwise(items: Column, strategy: Listwise) -> Column:
    """``items`` after all windows, from the back to the front."""
    w, n = strategy.window_size, F.size(items)

    def step(acc: Column, at: Column) -> Column:
        rest = F.greatest(n - at - w, F.lit(0))
        return F.concat(F.slice(acc, F.lit(1), at), F.sort_array(F.slice(acc, at + 1, F.lit(w))), F.slice(acc, at + w + 1, rest))

    return F.aggregate(window_starts(n, strategy), items, step)


def _one_pass(items: Column) -> Column:
    up = F.reverse(items)
    start = F.struct(F.get(up, F.lit(0)).alias("held"), F.slice(up, 1, 0).alias("out"))

    def step(state: Column, x: Column) -> Column:
        held, out = state["held"], state["out"]
        passed = F.struct(held.alias("held"), F.concat(F.array(x), out).alias("out"))
        stayed = F.struct(x.alias("held"), F.concat(F.array(held), out).alias("out"))
        return F.when(held["k"] < x["k"], passed).otherwise(stayed)

    folded = F.aggregate(F.slice(up, F.lit(2), F.greatest(F.size(up) - 1, F.lit(0))), start, step, lambda s: F.concat(F.array(s["held"]), s["out"]))
    return F.when(F.size(items) > 1, folded).otherwise(items)


def pairwise(items: Column, strategy: Pairwise) -> Column:
    """``items`` after ``passes`` passes from the bottom; equals keep their order, as both orders of asking conflict."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(strategy.passes)), items, lambda acc, _: _one_pass(acc))


def fold(items: Column, strategy: Strategy) -> Column:
    return listwise(items, strategy) if isinstance(strategy, Listwise) else pairwise(items, strategy)
