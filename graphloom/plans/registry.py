"""Where the registered queries are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.sources.model import MODEL_SQL, Model

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, model: bool = False) -> Callable[[Callable[[Model], DataFrame]], Callable[[Model], DataFrame]]:
    """Registers a function of the model under its name; ``model`` puts the model's tables before the SQL."""

    def register(f: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Model(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            start = "WITH RECURSIVE " if body.startswith("WITH RECURSIVE ") else "WITH "
            ORACLE_SQL[f.__name__] = f"{start}{MODEL_SQL.strip()}{', ' + body.removeprefix(start) if body.startswith(start) else ' ' + body}" if model else body
        return f

    return register
