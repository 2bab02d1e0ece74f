"""One registry of named queries; a query and its SQL oracle are always declared together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from markwell import constants as K
from markwell.plans.views import ORACLE_VIEWS

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    inventory_id: str
    build: QueryFn
    oracle: str | None


CATALOG: dict[str, Entry] = {}


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


# Shorthands that oracle texts may use for long fixed values.
SHORTHANDS = {
    "<SP>": K.SPACE_CLASS,
    "<WD>": K.WORD_CLASS,
    "<CHARS>": "'" + K.SPACE_CHARS + "'",
    "<STOP>": _list(K.RUSSIAN_STOP_WORDS + K.ENGLISH_STOP_WORDS),
    "<PHRASES>": _list(K.FORMAL_PHRASES),
    "<EMOJI>": K.EMOJI_CLASS,
}


def expand(sql: str) -> str:
    for short, text in SHORTHANDS.items():
        sql = sql.replace(short, text)
    return sql


def with_views(body: str, views: tuple[str, ...]) -> str:
    """Prefix ``body`` with the CTEs of ``views`` (each view may use the ones before it)."""
    if not views:
        return body.strip()
    ctes = ",\n".join(f"{v} AS ({ORACLE_VIEWS[v].strip()})" for v in views)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, inventory_id: str, oracle: str | None = None, views: tuple[str, ...] = ()):
    def register(fn: QueryFn) -> QueryFn:
        if name in CATALOG:
            raise ValueError(f"query {name!r} registered twice")
        CATALOG[name] = Entry(name, inventory_id, fn, expand(with_views(oracle, views)) if oracle else None)
        return fn

    return register
