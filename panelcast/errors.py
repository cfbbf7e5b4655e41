"""Errors with a code, a context and a hint for the fix."""

from __future__ import annotations

from typing import Any


class PanelcastError(Exception):
    """``str`` reads ``[CODE] message (context: ...) [hint: ...]``."""

    code = "E_UNKNOWN"
    hint = ""

    def __init__(self, message: str, context: dict[str, Any] | None = None, fix_hint: str | None = None) -> None:
        super().__init__(message)
        self.message, self.context = message, context or {}
        if fix_hint:
            self.hint = fix_hint

    error_code = property(lambda self: self.code)
    fix_hint = property(lambda self: self.hint)

    def __str__(self) -> str:
        context = f" (context: {self.context})" if self.context else ""
        return f"[{self.code}] {self.message}{context}" + (f" [hint: {self.hint}]" if self.hint else "")


class EContract(PanelcastError):
    """The input breaks the data contract."""

    code = "E_CONTRACT"
    hint = "A panel needs the columns unique_id, ds and y, none of them empty."


class ENoTSFM(PanelcastError):
    """No pretrained model is registered or loads."""

    code = "E_NO_TSFM"
    hint = "Register a model provider or install the packages that check_health() lists."


class EInsufficient(PanelcastError):
    """Too few models gave a forecast."""

    code = "E_INSUFFICIENT"
    hint = "See the recorded model errors; compare the data's frequency and length with the models' limits."


class ETemporal(PanelcastError):
    """Time stamps repeat or lie where they must not."""

    code = "E_TEMPORAL"
    hint = "Each series needs distinct time stamps; covariates of the past end with the history."
