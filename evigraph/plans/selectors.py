"""Small parsers of what names a view, a scope or a starting point."""

from __future__ import annotations

import re
from dataclasses import dataclass

VIEWS = ("context", "container", "component", "dynamic", "deployment")
PROJECTIONS = ("c4-context", "c4-container", "c4-component", "class", "sequence", "state", "usecase")
_IDENT = re.compile(r"[A-Za-z0-9._:/-]{1,64}\Z")


class BadSelector(ValueError):
    pass


@dataclass(frozen=True)
class Selector:
    view: str
    scope: str | None  # None: everything


def _parse(text: str, views: tuple[str, ...]) -> Selector:
    view, colon, scope = text.partition(":")
    if not colon or view not in views:
        raise BadSelector(f"{text!r}: expected <{'|'.join(views)}>:<scope>")
    if scope == "*":
        return Selector(view, None)
    if not _IDENT.match(scope):
        raise BadSelector(f"{text!r}: bad scope")
    return Selector(view, scope)


def view_selector(text: str) -> Selector:
    return _parse(text, VIEWS)


def project_selector(text: str) -> Selector:
    return _parse(text, PROJECTIONS)


def start_point(text: str) -> dict[str, str | int]:
    """`file:<path>:<line>`, a canonical key (with two colons at least), or a name: arguments of resolve_selector."""
    if text.startswith("file:"):
        path, _, line = text[5:].rpartition(":")
        if not path or not line.isdigit():
            raise BadSelector(f"{text!r}: expected file:<path>:<line>")
        return {"file": path, "line": int(line)}
    if not text:
        raise BadSelector("empty selector")
    return {"key": text} if text.count(":") >= 2 else {"name": text}
