"""Errors with a code, a context, a hint and a cause."""

from __future__ import annotations


class VeilError(Exception):
    code = "ERROR"

    def __init__(self, message: str, *, code: str | None = None, context: dict | None = None, hint: str | None = None, cause: Exception | None = None):
        super().__init__(message)
        self.message, self.code, self.context, self.hint, self.cause = message, code or type(self).code, context or {}, hint, cause

    def to_dict(self) -> dict:
        return {"type": type(self).__name__, "code": self.code, "message": self.message, "context": self.context, "hint": self.hint, "cause": None if self.cause is None else str(self.cause)}


def _kind(name: str, base: type, code: str) -> type:
    return type(name, (base,), {"code": code, "__module__": __name__})


ValidationError = _kind("ValidationError", VeilError, "VALIDATION_ERROR")
QueryParseError = _kind("QueryParseError", ValidationError, "QUERY_PARSE_ERROR")
UnsupportedQueryError = _kind("UnsupportedQueryError", ValidationError, "UNSUPPORTED_QUERY")
PrivacyConstraintError = _kind("PrivacyConstraintError", ValidationError, "PRIVACY_CONSTRAINT")
PrivacyError = _kind("PrivacyError", VeilError, "PRIVACY_ERROR")
InsufficientPrivacyBudgetError = _kind("InsufficientPrivacyBudgetError", PrivacyError, "INSUFFICIENT_BUDGET")
InvalidPrivacyParametersError = _kind("InvalidPrivacyParametersError", PrivacyError, "INVALID_PARAMETERS")
AggregationError = _kind("AggregationError", VeilError, "AGGREGATION_ERROR")
BackendError = _kind("BackendError", VeilError, "BACKEND_ERROR")
UnsupportedBackendError = _kind("UnsupportedBackendError", BackendError, "UNSUPPORTED_BACKEND")
ExecutionBackendError = _kind("ExecutionBackendError", BackendError, "EXECUTION_ERROR")
EngineError = _kind("EngineError", VeilError, "ENGINE_ERROR")
InternalError = _kind("InternalError", VeilError, "INTERNAL_ERROR")
