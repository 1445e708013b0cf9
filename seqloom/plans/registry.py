"""Registration of queries with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from seqloom.plans import reads as rd

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: Common parts of the equivalents, by the table that they define.
GC = "length(regexp_replace(seq, '[^GCgc]', '', 'g'))::DOUBLE / length(seq)"
PARTS = {
    "reads": rd.ORACLE_READS,
    "mates": f"{rd.ORACLE_READS},{rd.ORACLE_MATES}",
    "binned": f"{rd.ORACLE_READS}, gcs AS (SELECT *, {GC} AS gc FROM reads), binned AS (SELECT *, {rd.ORACLE_BIN} AS cluster FROM gcs)",
}


def query(sql: str | None = None, needs: str = "reads") -> Callable:
    """Registers a query under its function's name, and its SQL after the common table expressions that it needs; SQL
    that begins with a comma adds further ones."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {PARTS[needs]}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
        return f

    return register
