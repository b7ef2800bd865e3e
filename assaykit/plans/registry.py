"""Queries by name, each with the SQL that an independent engine can run, if there is one."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        """Register the decorated (spark, sf_dir) -> DataFrame function under its name."""

        def put(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return put
