"""Errors of the engine, with near names where a name is unknown."""

from __future__ import annotations

import difflib


class EngineError(ValueError):
    """A request that can't be carried out."""


class UnknownName(EngineError):
    def __init__(self, kind: str, name: str, known):
        near = difflib.get_close_matches(name, list(known), 3)
        super().__init__(f"unknown {kind} {name!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))


class MissingColumn(UnknownName):
    def __init__(self, name: str, known):
        super().__init__("column", name, known)


class ContractViolation(EngineError):
    """A declared schema doesn't hold."""
