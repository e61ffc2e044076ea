"""All registered queries of the core library and their SQL."""

from __future__ import annotations

from tidemark.plans import assessment_queries, class_queries, composite_queries, evaluation_queries, raster_queries, refit_queries, report_queries, series_queries, spatial_queries, vector_queries

MODULES = (series_queries, spatial_queries, class_queries, evaluation_queries, report_queries, vector_queries, raster_queries, refit_queries, composite_queries, assessment_queries)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL: dict[str, str] = {name: sql for module in MODULES for name, sql in module.SQL.items()}
