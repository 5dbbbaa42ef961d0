"""Retry of network errors with growing pauses, around what the driver asks of storage."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable
from typing import TypeVar

from py4j.protocol import Py4JJavaError

from strandforge.functions.text import ArchiveError

T = TypeVar("T")
#: Pauses before the second, third and fourth call, in seconds.
PAUSES = (0.1, 0.4, 1.6)


def is_network_error(e: Exception) -> bool:
    """A packed return code of the network module, or an exception of Java's network package on the way."""
    if isinstance(e, ArchiveError):
        return e.network
    cause, seen = (e.java_exception, 0) if isinstance(e, Py4JJavaError) else (None, 0)
    while cause is not None and seen < 20:
        if cause.getClass().getName().startswith("java.net."):
            return True
        cause, seen = cause.getCause(), seen + 1
    return False


def on_network_error(what: str, call: Callable[[], T], sleep: Callable[[float], None] = time.sleep) -> T:
    for pause in (*PAUSES, None):
        try:
            return call()
        except (ArchiveError, Py4JJavaError) as e:
            if pause is None or not is_network_error(e):
                raise
            print(f"{what}: network error ({e if isinstance(e, ArchiveError) else e.java_exception.getClass().getName()}), again after {pause * 1000:.0f} ms", file=sys.stderr)
            sleep(pause)
    raise AssertionError
