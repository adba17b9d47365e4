"""What a Python worker keeps from task to task.

Spark uses a worker again for tasks of other operators. Tables that make an operator faster
would stay in memory while the others run, so a worker keeps those of the latest operator only.
"""

from __future__ import annotations

import gc
from collections.abc import Callable

import pyarrow as pa

_latest: tuple[str, Callable[[], None]] | None = None


def _nothing() -> None:
    pass


def begin(operator: str, forget: Callable[[], None] = _nothing) -> None:
    """To be called by a task: what another operator has kept is forgotten.

    ``forget`` does so for what this one is going to keep.
    """
    global _latest
    if _latest is not None and _latest[0] != operator:
        _latest[1]()
        gc.collect()
    # What earlier tasks have freed goes back to the machine.
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()
    _latest = operator, forget
