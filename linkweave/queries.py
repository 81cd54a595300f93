"""Registry of the engine's queries and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkweave.operators import annotations, contracts, frontend, graph, increment, json_schema, linking, nest, reports, schema_texts, zod_chains
from linkweave.plans import python_graph, typescript_graph
from linkweave.session import shipped
from linkweave.sources import python_source, spec, typescript_source

MODULES = (contracts, graph, increment, linking, frontend, annotations, json_schema, schema_texts, zod_chains, reports, spec, python_source, typescript_source, nest, python_graph, typescript_graph)

QUERIES = {name: shipped(query) for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every contract."""
    return QUERIES["contract_severity_rollup"](spark, sf_dir)
