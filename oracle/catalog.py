"""Assemble oracle SQL: the shared view CTEs plus each query body."""

from oracle.documents import SQL as DOCUMENT_SQL
from oracle.evaluation import SQL as EVALUATION_SQL
from oracle.relational import SQL as RELATIONAL_SQL
from oracle.screens import SQL as SCREEN_SQL
from oracle.store import SQL as STORE_SQL
from tidewater.sources.logistics_sql import duckdb_cte_prefix

BODIES: dict[str, str] = {}
BODIES.update(RELATIONAL_SQL)
BODIES.update(DOCUMENT_SQL)
BODIES.update(SCREEN_SQL)
BODIES.update(EVALUATION_SQL)
BODIES.update(STORE_SQL)


def oracle_sql() -> dict[str, str]:
    prefix = duckdb_cte_prefix()
    return {name: prefix + body.strip() for name, body in BODIES.items()}
