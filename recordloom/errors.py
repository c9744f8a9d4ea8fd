"""Errors with a stable code."""

from __future__ import annotations


class ToolError(Exception):
    """``code`` names the condition; further details are attributes and in ``details``."""

    def __init__(self, code: str, message: str, **details):
        super().__init__(message)
        self.code, self.message, self.details = code, message, details
        for name, value in details.items():
            setattr(self, name, value)


class FilterSyntaxError(ToolError, ValueError):
    """A filter text that cannot be read; places count from 0 (offset) and 1 (line, column)."""

    def __init__(self, text: str, offset: int, message: str, code: str = "filter_syntax"):
        before = text[:offset]
        super().__init__(code, message, offset=offset, line=before.count("\n") + 1, column=offset - (before.rfind("\n") + 1) + 1)
