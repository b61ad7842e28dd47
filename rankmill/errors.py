"""Failures that callers can tell apart."""

from __future__ import annotations


class SearchError(Exception):
    """Base of all; code and stage are the same for every error of a kind."""

    code, stage = "SEARCH_ERROR", "search"


class ConfigurationError(SearchError):
    """A setting is wrong. problems: one message for each."""

    code, stage = "CONFIGURATION_ERROR", "config"

    def __init__(self, message: str, problems: list[str] | None = None):
        super().__init__(message)
        self.problems = problems or [message]


class ModelError(SearchError):
    """A model's failure; provider names it."""

    stage = "model"

    def __init__(self, message: str, provider: str):
        super().__init__(message)
        self.provider = provider


class ModelUnavailableError(ModelError):
    """The model is not installed or cannot be reached; remediation says what would help."""

    code = "MODEL_UNAVAILABLE"

    def __init__(self, message: str, provider: str, remediation: str | None = None):
        super().__init__(message, provider)
        self.remediation = remediation


class ModelInferenceError(ModelError):
    """The model failed on a request."""

    code = "MODEL_INFERENCE_ERROR"


class StoreError(SearchError):
    """Stored data is missing, malformed, or being written by another."""

    code, stage = "STORE_ERROR", "store"


def summary(error: BaseException) -> dict[str, str | None]:
    """Name, first line of the message, and code of a failure."""
    return {"name": type(error).__name__, "message": str(error).split("\n", 1)[0], "code": getattr(error, "code", None) if isinstance(error, SearchError) else None}
