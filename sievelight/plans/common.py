"""Registration of queries, and a folder for what they write."""

from __future__ import annotations

from sievelight.functions.tables import shared_path as scratch  # noqa: F401


class Registry:
    """Queries by name, each with the SQL it must equal if there is one."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def query(self, sql: str | None = None, name: str | None = None):
        def add(f):
            self.queries[name or f.__name__] = f
            if sql is not None:
                self.sql[name or f.__name__] = sql
            return f

        return add
