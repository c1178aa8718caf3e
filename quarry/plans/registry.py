"""How modules declare queries: a Spark side and, where SQL can say it, an oracle side."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.session import TABLES, register

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def _add(self, name: str, query: Query, oracle: str | None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is declared twice")
        self.queries[name] = query
        if oracle is not None:
            self.oracle[name] = oracle

    def sql(self, name: str, text: str, oracle: str | None = None) -> None:
        """A query in Spark SQL; the oracle has the same text unless it has its own."""
        used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            register(spark, sf_dir, *used) if used else None
            return spark.sql(text)

        self._add(name, query, text if oracle is None else oracle)

    def frame(self, oracle: str | None = None, name: str | None = None):
        """Declare a function (spark, sf_dir) -> DataFrame; its name is the query's."""

        def declare(query: Query) -> Query:
            self._add(name or query.__name__, query, oracle)
            return query

        return declare
