"""Every query by name, its DuckDB SQL, and the flagship."""

from __future__ import annotations

from . import queries as _q


def queries() -> dict:
    return dict(_q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_q.ORACLE)


def flagship(spark, sf_dir):
    return _q.QUERIES["case_justification"](spark, sf_dir)
