"""Every query of the engine by name, with the SQL that must give the same rows."""

from __future__ import annotations

from . import finding_queries, kb_queries, log_queries, saml_queries

_MODULES = (log_queries, finding_queries, kb_queries, saml_queries)


def entry(spark, sf_dir):
    return queries()["incidents_order_cap"](spark, sf_dir)


def queries() -> dict:
    return {name: f for m in _MODULES for name, (f, _) in m.Q.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, (_, sql) in m.Q.items() if sql}
