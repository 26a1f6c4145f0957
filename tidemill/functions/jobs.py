"""Independent Spark jobs side by side."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

WORKERS = 8


def together(tasks: Sequence[Callable[[], object]], workers: int = WORKERS) -> list:
    """Run each task in its own driver thread and return the results in order.

    The tasks only start Spark jobs and read their few result rows; while one job ends with a
    few slow tasks, the others use the free cores.
    """
    if len(tasks) < 2:
        return [t() for t in tasks]
    with ThreadPoolExecutor(min(workers, len(tasks))) as pool:
        return [f.result() for f in [pool.submit(t) for t in tasks]]
