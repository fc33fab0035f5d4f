"""Registered queries of the engine and the SQL that each is held against."""

from . import assembly_queries, catalog_queries, composed_queries, endpoint_queries, json_queries, output_queries, page_queries, schema_queries, stream_queries, traffic_queries, url_queries

_MODULES = (url_queries, traffic_queries, catalog_queries, schema_queries, endpoint_queries, json_queries, page_queries, output_queries, assembly_queries, stream_queries, composed_queries)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: sql for m in _MODULES for k, sql in m.ORACLE_SQL.items()}
FLAGSHIP = "page_records"
