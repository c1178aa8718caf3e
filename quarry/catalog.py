"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from quarry.functions import catalog as functions
from quarry.operators import graph, ml_queries, udf_queries
from quarry.operators import queries as blocks
from quarry.plans import aggregates, commands, relational
from quarry.sources import queries as sources
from quarry.streaming import queries as streams

MODULES = (blocks, relational, aggregates, functions, sources, streams, udf_queries, graph, commands, ml_queries)
QUERIES = {name: query for m in MODULES for name, query in m.R.queries.items()}
ORACLE_SQL = {name: text for m in MODULES for name, text in m.R.oracle.items()}
