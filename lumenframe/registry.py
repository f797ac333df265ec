"""All queries of the library with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from lumenframe.session import ship

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "img_integral"


def query(name: str, sql: str | None = None):
    """Register a callable (spark, sf_dir) as a query, with the DuckDB SQL of its result if there is one."""

    def add(f: Callable) -> Callable:
        def run(spark, sf_dir):
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


from lumenframe.plans import arrays, geometry, images, lanes, learning, rects, scalars, signals  # noqa: E402, F401
