"""Memoised Column builders.

A Column over column *names* is an immutable, session-independent
expression tree, but building a nested one from Python costs one JVM round
trip per node.  Builders decorated here are built once per distinct set of
plain arguments (names, numbers) and reused; calls with Column arguments are
not cached.
"""

from __future__ import annotations

import functools

_PLAIN = (str, int, float, bool, type(None))


def plain_args_cache(fn):
    cache: dict = {}

    @functools.wraps(fn)
    def wrapper(*args, **kwargs):
        items = tuple(sorted(kwargs.items()))
        flat = list(args) + [v for _, v in items]
        if not all(isinstance(a, _PLAIN) or (isinstance(a, tuple) and all(isinstance(x, _PLAIN) for x in a)) for a in flat):
            return fn(*args, **kwargs)
        key = (args, items)
        hit = cache.get(key)
        if hit is None:
            hit = cache[key] = fn(*args, **kwargs)
        return hit

    return wrapper
