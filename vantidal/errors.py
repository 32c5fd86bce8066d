"""Refusals: checks that fail before a plan is built, with a stable code."""

from __future__ import annotations


class Refusal(Exception):
    """A request that can't be answered. `code` is stable, `hint` says what to do instead."""

    def __init__(self, code: str, message: str, hint: str | None = None):
        super().__init__(f"{code}: {message}" + (f" {hint}" if hint else ""))
        self.code, self.message, self.hint = code, message, hint
