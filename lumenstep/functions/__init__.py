"""Scalar functions by name. `call("CATX", ...)` builds a Column; every function returns a Column expression."""

from __future__ import annotations

from pyspark.sql import Column

FUNCTIONS: dict = {}


def function(*names: str):
    def keep(fn):
        for n in names:
            FUNCTIONS[n.upper()] = fn
        return fn

    return keep


def call(name: str, *args, **options) -> Column:
    try:
        fn = FUNCTIONS[name.upper()]
    except KeyError:
        raise ValueError(f"the function {name} is unknown") from None
    return fn(*args, **options)


from . import character, datetime, descriptive, distribution, maths, misc, regex  # noqa: E402,F401
