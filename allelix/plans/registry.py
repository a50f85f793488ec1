"""Where plan modules register their queries and oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from .views import with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable:
    """Register a function of (spark, sf_dir); ``sql`` may use the named views as tables."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            text = sql.strip()
            if views:
                head = with_views(*views)
                text = f"{head}, {text[4:].lstrip()}" if text.upper().startswith("WITH") else f"{head} {text}"
            ORACLES[name] = text
        return f

    return add
