"""DuckDB statements that compute each registered query in another way, straight from the tables."""

from __future__ import annotations


def all_sql() -> dict[str, str]:
    from oracles import feed, loads, measures, reports, tests

    out: dict[str, str] = {}
    for part in (loads, feed, reports, measures, tests):
        out.update(part.SQL)
    return out
