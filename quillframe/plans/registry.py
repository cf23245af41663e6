"""Registration of a query beside its SQL."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, statement: str | None = None) -> Callable:
        def add(function: Callable) -> Callable:
            self.queries[function.__name__] = function
            if statement is not None:
                self.sql[function.__name__] = statement
            return function

        return add
