"""All registered queries of the time-series, vector and token operators."""

from __future__ import annotations

from tidewell.plans import geometry, geometry_sql, series, series_sql, states, states_sql

QUERIES = series.QUERIES | geometry.QUERIES | states.QUERIES
ORACLE_SQL = series_sql.ORACLE_SQL | geometry_sql.ORACLE_SQL | states_sql.ORACLE_SQL
