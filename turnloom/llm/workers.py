"""What a Python worker keeps from one task to the next: one thing at a time, so that an operator's caches don't outlive its turn."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa

_kept: dict[str, Any] = {}


def kept(key: str, make: Callable[[], Any]) -> Any:
    """The worker's thing of that key, made if need be; anything else goes."""
    if key not in _kept:
        free()
        _kept[key] = make()
    return _kept[key]


def free() -> None:
    """Drops what an earlier operator left; to be called by tasks that need their memory for themselves."""
    _kept.clear()
    pa.default_memory_pool().release_unused()
