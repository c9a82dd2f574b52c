"""Shipping Python code to executors.

Functions of this package are pickled by value, so workers need no copy of it on
their path.  ``worker_cache`` keeps what is costly to build (a vocabulary, an
index) for the life of a worker process.
"""

from __future__ import annotations

import sys
import types

from pyspark import cloudpickle


def ship_by_value() -> None:
    """Make cloudpickle send this package's functions whole, not by name."""
    package = sys.modules[__name__.split(".")[0]]
    if package.__name__ not in cloudpickle.list_registry_pickle_by_value():
        cloudpickle.register_pickle_by_value(package)


def worker_cache() -> dict:
    """A dict that outlives a task in a reused Python worker."""
    holder = sys.modules.get("_millrace_worker")
    if holder is None:
        holder = sys.modules["_millrace_worker"] = types.ModuleType("_millrace_worker")
    return holder.__dict__


def share(spark, value):
    """Broadcast ``value`` by value; the function returned gives it in a worker.

    A worker unpickles it once.  What is shared must be of a bounded size.
    """
    import uuid

    shared = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    name = uuid.uuid4().hex

    def get():
        held = worker_cache().setdefault("shared", {})
        if name not in held:
            while len(held) >= 4:
                del held[next(iter(held))]
            held[name] = cloudpickle.loads(shared.value)
        return held[name]

    return get
