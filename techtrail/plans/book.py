"""Collects the queries of a module and their SQL."""

from __future__ import annotations

from collections.abc import Callable


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable:
        def add(function: Callable) -> Callable:
            self.queries[name] = function
            if sql is not None:
                self.sql[name] = sql
            return function

        return add
