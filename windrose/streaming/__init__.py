"""Reranking of candidates that arrive as a stream."""
