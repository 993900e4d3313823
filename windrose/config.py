"""Strategies, methods and prices: small frozen parameter sets that are checked on the driver before any job."""

from __future__ import annotations

import re
from collections.abc import Awaitable, Callable
from dataclasses import dataclass
from typing import Protocol, runtime_checkable

from windrose.errors import RerankInputError

LISTWISE, PAIRWISE, ORIGINAL = "rankgpt_sliding_window", "prp_sliding_k", "original"


def _positive(**values: int) -> None:
    for name, value in values.items():
        if value < 1:
            raise ValueError(f"{name} must be 1 or more, not {value}")


@dataclass(frozen=True)
class Listwise:
    """Overlapping windows from the end of the list to its start, each put in order as a whole."""

    window_size: int = 20
    stride: int = 10
    max_document_chars: int = 4000
    algorithm: str = LISTWISE

    def __post_init__(self) -> None:
        if self.algorithm != LISTWISE:
            raise ValueError(f"a listwise strategy has no algorithm {self.algorithm!r}")
        _positive(window_size=self.window_size, stride=self.stride, max_document_chars=self.max_document_chars)
        if self.stride > self.window_size:
            raise RerankInputError(f"a stride of {self.stride} leaves gaps between windows of {self.window_size}")


@dataclass(frozen=True)
class Pairwise:
    """Passes from the bottom up; neighbours change places where both orders of asking prefer the lower one."""

    passes: int = 10
    max_document_chars: int = 4000
    pair_order_parallelism: int = 2
    algorithm: str = PAIRWISE

    def __post_init__(self) -> None:
        if self.algorithm != PAIRWISE:
            raise ValueError(f"a pairwise strategy has no algorithm {self.algorithm!r}")
        _positive(passes=self.passes, max_document_chars=self.max_document_chars)
        if self.pair_order_parallelism not in (1, 2):
            raise ValueError("pair_order_parallelism must be 1 or 2")


@runtime_checkable
class CustomStrategy(Protocol):
    """A walk of one's own: any picklable object with these.

    ``walk`` gets ``ask(name, *args)``, which calls the provider's method and counts the call, the query and its texts, and returns
    the positions of the texts, best first, each once. ``needs`` names the provider's methods that it calls.
    """

    algorithm: str
    max_document_chars: int
    needs: tuple[str, ...]

    async def walk(self, ask: Callable[..., Awaitable[str]], query: str, texts: list[str]) -> list[int]: ...


Strategy = Listwise | Pairwise | CustomStrategy


@dataclass(frozen=True)
class PriceConfig:
    """US dollars per million tokens."""

    input_per_million: float
    output_per_million: float

    def __post_init__(self) -> None:
        if min(self.input_per_million, self.output_per_million) < 0:
            raise ValueError("prices must not be negative")


@dataclass(frozen=True)
class Method:
    """An evaluated method: ``original``, or an algorithm over the first ``depth`` candidates."""

    family: str
    depth: int | None = None

    @property
    def name(self) -> str:
        return self.family if self.depth is None else f"{self.family}@{self.depth}"


def parse_method(name: str) -> Method:
    """``original``, ``rankgpt_sliding_window@N`` or ``prp_sliding_k@N`` with N of 1 or more."""
    if name == ORIGINAL:
        return Method(ORIGINAL)
    found = re.fullmatch(rf"({LISTWISE}|{PAIRWISE})@([0-9]+)", name)
    if not found or int(found[2]) < 1:
        raise ValueError(f"no such method: {name!r}")
    return Method(found[1], int(found[2]))


def check_top_k(top_k: int | None) -> None:
    if top_k is not None and top_k < 0:
        raise RerankInputError(f"top_k must not be negative, but is {top_k}")


def check_capability(provider: object, strategy: Strategy) -> None:
    needs = ("rank",) if isinstance(strategy, Listwise) else ("compare",) if isinstance(strategy, Pairwise) else strategy.needs
    for wanted in needs:
        if not callable(getattr(provider, wanted, None)):
            raise RerankInputError(f"{type(provider).__name__} has no method {wanted}, which {strategy.algorithm} calls")


def kind_of(strategy: Strategy) -> str:
    return "listwise" if isinstance(strategy, Listwise) else "pairwise" if isinstance(strategy, Pairwise) else "custom"
