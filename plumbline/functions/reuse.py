"""Column trees that are made once a session.

A column is a tree in the JVM that belongs to no table, and making a large one costs a call to the JVM per
node, far more than planning or running it over a small fleet.  Trees without parameters are kept.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from typing import Any

from pyspark import SparkContext

#: Trees kept; a session that makes more starts anew.
MOST = 500


def per_session(make: Callable) -> Callable:
    """``make(*names)``, worked out once a session for each ``names``, which are hashable."""
    held: dict[tuple, Any] = {}

    @wraps(make)
    def get(*names: Any) -> Any:
        context = SparkContext._active_spark_context
        key = (context.applicationId if context else None, *names)
        if key not in held:
            if len(held) >= MOST:
                held.clear()
            held[key] = make(*names)
        return held[key]

    return get
