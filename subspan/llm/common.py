"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import threading
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subspan.plans.lineage import durable, scratch

__all__ = ["WORD", "Recent", "durable", "kept_while_busy", "scratch", "slices", "table", "text_or_empty"]

#: White space as the contracts count it; words are runs of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that Python objects are made of few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Recent(dict):
    """A cache of what make(key) gives, for keys of at most `longest` characters; it never holds over 2 * room of them.

    When room keys are held they become the older half, and the half before them goes; a key that is
    asked for again moves up, so what is frequent stays.
    """

    def __init__(self, room: int, longest: int = 64):
        super().__init__()
        self.room, self.longest, self.older = room, longest, {}

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.room:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


@contextmanager
def kept_while_busy(name: str, version, make: Callable, idle: float = 10.0) -> Iterator:
    """What make() gives, or what an earlier task of this Python process left under name for the same version.

    A task takes it and leaves it again for the next one. If no task has come for `idle` seconds it
    is dropped, so that a reused worker does not hold it through other stages.
    """
    store = vars(sys.modules.setdefault("subspan_process_cache", types.ModuleType("subspan_process_cache")))
    found = store.pop(name, None)
    value = found[1] if found and found[0] == version else make()
    try:
        yield value
    finally:
        entry = store[name] = (version, value)
        del value, found

        def drop() -> None:
            if store.get(name) is entry:
                store.pop(name, None)

        timer = threading.Timer(idle, drop)
        timer.daemon = True
        timer.start()
