"""The registered queries and their SQL, gathered from the modules of this folder."""

from __future__ import annotations

from heddle.plans import base, q_access, q_catalog, q_dml, q_keyed, q_relational, q_search, q_sources, q_stream, q_usage, q_versions

MODULES = (q_relational, q_access, q_dml, q_catalog, q_keyed, q_versions, q_search, q_usage, q_sources, q_stream)


def queries():
    return dict(base.QUERIES)


def oracle_sql():
    return dict(base.SQL)
