"""Registry of every query of the library: name to plan, and name to oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import audit, evidence, graph, labels, metrics, text
from .schemas import SCHEMAS

_MODULES = (evidence, text, labels, graph, metrics, audit)
_PLACES = 6


def _columns(name: str) -> list[list[str]]:
    return [c.split(" ") for c in SCHEMAS[name].split(", ")]


def _typed(name: str, query):
    """The query with the columns and types of its schema."""

    def run(spark, sf_dir):
        df = query(spark, sf_dir)
        return df.select(*[(F.round(F.col(c).cast(t), _PLACES) if t == "double" else F.col(c).cast(t)).alias(c) for c, t in _columns(name)])

    run.__name__, run.__doc__ = name, query.__doc__
    return run


def _typed_sql(name: str, sql: str) -> str:
    kinds = {"string": "VARCHAR"}
    parts = [f'round("{c}"::DOUBLE, {_PLACES}) AS "{c}"' if t == "double" else f'"{c}"::{kinds.get(t, t.upper())} AS "{c}"' for c, t in _columns(name)]
    return f"SELECT {', '.join(parts)} FROM (\n{sql}\n) AS result"


QUERIES = {name: _typed(name, query) for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: _typed_sql(name, sql) for m in _MODULES for name, sql in m.ORACLES.items()}
