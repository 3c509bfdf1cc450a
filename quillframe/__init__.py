"""A dataframe engine on Spark: frames with a row order and an index over Spark's own plans."""

from importlib import import_module

from .session import session

_PLACES = {
    "build": ("SeriesBuilder", "concat", "parallel_info", "series"),
    "frame": ("Frame", "Series"),
    "index": ("ListIndex", "MultiIndex", "RangeIndex", "default_index"),
    "names": ("AggFunc", "JoinType", "ResampleFunc"),
    "plans.expr": ("Expr", "col", "lit"),
    "plans.lazy": ("LazyFrame",),
    "plans.sql": ("SQLContext",),
}
_OF = {name: place for place, names in _PLACES.items() for name in names}

__all__ = sorted([*_OF, "session"])


def __getattr__(name: str):
    """Names come when they are asked for, so that a part of the library loads no more than it needs."""
    if name not in _OF:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f".{_OF[name]}", __name__), name)
