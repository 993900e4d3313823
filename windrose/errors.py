"""What can go wrong with a reranking."""

from __future__ import annotations


class RerankError(Exception):
    """Base of all errors of this package."""


class RerankParseError(RerankError):
    """A provider's answer breaks the contract; it is kept in ``raw_response``."""

    def __init__(self, reason: str, raw_response: str = "") -> None:
        super().__init__(reason)
        self.reason, self.raw_response = reason, raw_response


class RerankProviderError(RerankError):
    """The provider failed, or answered nothing."""


class RerankInputError(RerankError):
    """The request can't be carried out as it is."""


class DocumentTooLongError(RerankInputError):
    """A document is longer than the limit; documents are never cut."""


#: failure_type of a recorded row -> the error raised for it in fail-fast mode.
BY_FAILURE = {"llm_output_invalid": RerankParseError, "provider_error": RerankProviderError, "document_too_long": DocumentTooLongError}
