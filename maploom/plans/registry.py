"""Every query of the engine, and its SQL where SQL can express it."""

from maploom.plans import catalogue_queries, colour_queries, detail_queries, editing_queries, geometry_queries, image_queries, polygon_queries, shape_queries, text_queries, timeline_queries
from maploom.plans.views import duckdb_sql

_ALL = catalogue_queries.QUERIES | timeline_queries.QUERIES | colour_queries.QUERIES | geometry_queries.QUERIES | text_queries.QUERIES | shape_queries.QUERIES | editing_queries.QUERIES | detail_queries.QUERIES | image_queries.QUERIES | polygon_queries.QUERIES

QUERIES = {name: build for name, (build, _) in _ALL.items()}
ORACLES = {name: duckdb_sql(sql) for name, (_, sql) in _ALL.items() if sql}
