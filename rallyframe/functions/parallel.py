"""Independent Spark jobs side by side."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

A, B = TypeVar("A"), TypeVar("B")
#: Jobs that are submitted at once; Spark shares its cores among them.
WIDTH = 8


def concurrently(work: Callable[[A], B], items: Iterable[A], width: int = WIDTH) -> list[B]:
    """work of each item, in their order; the first error ends it."""
    with ThreadPoolExecutor(width) as pool:
        return list(pool.map(work, items))
