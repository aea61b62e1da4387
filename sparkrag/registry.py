"""Makers of components by name."""

from __future__ import annotations

from collections.abc import Callable

from .errors import UnsupportedBackendError


class Registry:
    """Makers of components by name; those that are registered later win."""

    def __init__(self, kind: str, **makers: Callable):
        self.kind, self.makers = kind, dict(makers)

    def register(self, name: str, maker: Callable) -> None:
        self.makers[name] = maker

    def names(self) -> list[str]:
        return sorted(self.makers)

    def create(self, name: str, *args, **options):
        if name not in self.makers:
            raise UnsupportedBackendError(f"{self.kind} {name}", self.names())
        return self.makers[name](*args, **options)
