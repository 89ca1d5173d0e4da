"""Every query of the library over the given tables, with its oracle."""

from __future__ import annotations

import importlib

from sparkdesk.registry.core import ORACLES, QUERIES

_MODULES = ["usage", "text", "conversations", "pages", "replies", "evaluation", "web", "markdown", "corpus", "streaming"]


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"sparkdesk.registry.{name}")


def registered():
    _load()
    return dict(QUERIES)


def oracles():
    _load()
    return dict(ORACLES)
