"""Broadcasts of the package's own objects, pickled by value like its functions, so executors need no copy of it."""

from __future__ import annotations

import pickle

from pyspark import Broadcast, SparkContext, cloudpickle


def share(context: SparkContext, value) -> Broadcast:
    return context.broadcast(cloudpickle.dumps(value))


def opened(shared: Broadcast):
    """The object, made anew in every task."""
    return pickle.loads(shared.value)
