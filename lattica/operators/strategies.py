"""Named strategies for one kernel: the library's own and those a user adds, run and compared alike."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import arrays, graph

_KERNELS: dict[str, dict[str, Callable[..., DataFrame]]] = {}


def register(kernel: str, name: str, strategy: Callable[..., DataFrame]) -> None:
    """Adds a strategy; one name stands for one strategy of a kernel (ValueError)."""
    named = _KERNELS.setdefault(kernel, {})
    if named.setdefault(name, strategy) is not strategy:
        raise ValueError(f"{kernel} has a strategy {name!r} already")


def unregister(kernel: str, name: str) -> None:
    _KERNELS[kernel].pop(name)


def names(kernel: str) -> list[str]:
    if kernel not in _KERNELS:
        raise ValueError(f"no kernel {kernel!r}; there are {', '.join(sorted(_KERNELS))}")
    return sorted(_KERNELS[kernel])


def run(kernel: str, name: str, *args, **options) -> DataFrame:
    if name not in names(kernel):
        raise ValueError(f"{kernel} has no strategy {name!r}; there are {', '.join(names(kernel))}")
    return _KERNELS[kernel][name](*args, **options)


def compare(kernel: str, *args, only: list[str] | None = None, **options) -> DataFrame:
    """The results of all strategies (or ``only`` some), one below the other, with the column ``strategy``."""
    results = [run(kernel, n, *args, **options).withColumn("strategy", F.lit(n)) for n in only or names(kernel)]
    return reduce(DataFrame.unionByName, results)


for _name, _strategy in (("wedges", graph.triangle_count), ("lower", graph.triangles_lower), ("upper", graph.triangles_upper), ("push", graph.triangles_push), ("pull", graph.triangles_pull)):
    register("triangles", _name, _strategy)
register("histogram", "aggregate", arrays.histogram)
register("gather", "join", arrays.gather)
register("toposort", "peel", graph.toposort_levels)
