"""Reranking and ranking evaluation as PySpark DataFrame operations."""

from windrose.config import Listwise, Pairwise, PriceConfig
from windrose.errors import DocumentTooLongError, RerankError, RerankInputError, RerankParseError, RerankProviderError
from windrose.operators.providers import Usage
from windrose.operators.rerank import Document, Ranked, Reranker

__all__ = [
    "Document", "DocumentTooLongError", "Listwise", "Pairwise", "PriceConfig", "Ranked", "RerankError", "RerankInputError", "RerankParseError",
    "RerankProviderError", "Reranker", "Usage",
]
