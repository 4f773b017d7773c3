"""Rejections: every operator that won't guess raises one of these with a stable code."""

from __future__ import annotations


class EngineError(ValueError):
    """A rejection; ``code`` is part of the contract, the message is for people."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


class AnalysisError(EngineError):
    pass


class SqlPolicyError(EngineError):
    pass


class FileError(EngineError):
    pass


class RetrievalError(EngineError):
    pass


def require(holds: bool, code: str, kind: type[EngineError] = AnalysisError) -> None:
    if not holds:
        raise kind(code)
