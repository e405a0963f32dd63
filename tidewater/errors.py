"""Errors of the engine. Whatever cannot be answered correctly raises one of them."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors that the engine raises itself."""


class UnsupportedSql(EngineError):
    """A form that the engine refuses on purpose."""


class UnknownName(EngineError):
    """A name that isn't in the catalog; the message lists the nearest ones."""


def unknown(kind: str, name: str, known) -> UnknownName:
    import difflib

    near = difflib.get_close_matches(name, list(known), 3, 0.0)
    return UnknownName(f"unknown {kind} {name!r}" + (f"; nearest: {', '.join(near)}" if near else ""))
