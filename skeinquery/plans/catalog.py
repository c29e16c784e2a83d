"""All queries of the engine over the driver's tables, and their SQL."""

from __future__ import annotations

from skeinquery.plans.web import QUERIES, Query
from skeinquery.plans.web_sql import SQL


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
