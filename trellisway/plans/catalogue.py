"""Registered queries of the transport library and their SQL."""

from __future__ import annotations

from . import area_queries, demand_queries, io_queries, journey_queries, mapping_queries, model_queries, network_queries, path_queries, spatial_queries, timed_queries

QUERIES = network_queries.QUERIES | path_queries.QUERIES | spatial_queries.QUERIES | demand_queries.QUERIES | io_queries.QUERIES | model_queries.QUERIES | journey_queries.QUERIES | timed_queries.QUERIES | area_queries.QUERIES | mapping_queries.QUERIES
ORACLE_SQL = network_queries.ORACLE_SQL | path_queries.ORACLE_SQL | spatial_queries.ORACLE_SQL | demand_queries.ORACLE_SQL | io_queries.ORACLE_SQL | model_queries.ORACLE_SQL | journey_queries.ORACLE_SQL | timed_queries.ORACLE_SQL | area_queries.ORACLE_SQL | mapping_queries.ORACLE_SQL
