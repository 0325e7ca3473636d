"""Registered queries of the entity-resolution operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from erlink.plans.fixtures import ER, SCORES, Context

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Registers a function of a Context; sql is what DuckDB must say, after the common table expressions named."""

    def add(f: Callable[[Context], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Context(spark, sf_dir))
        if sql is not None:
            prefix = {"er": ER, "scores": SCORES, "both": f"{ER}, {SCORES}"}.get(ctes)
            body = sql.strip()
            ORACLES[name] = body if prefix is None else f"with {prefix}{', ' + body[5:] if body[:5].lower() == 'with ' else ' ' + body}"
        return f

    return add


def views(spark: SparkSession, sf_dir: str) -> None:
    """The fixtures as temporary views, for SQL."""
    c = Context(spark, sf_dir)
    for name in ("s1", "pool", "raw_pool", "truth", "pairs", "entities"):
        getattr(c, name).createOrReplaceTempView(name)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from erlink.plans.queries_match import match_query

    return match_query(Context(spark, sf_dir))


def _load() -> None:
    from erlink.plans import queries_analytics, queries_blocking, queries_decide, queries_files, queries_match, queries_numbers, queries_text, queries_tuning  # noqa: F401


_load()
