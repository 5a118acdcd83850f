"""Sums of arrays over all rows, made in the tasks that hold the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Least tasks over which the rows of a fit are dealt, and tasks that add up what those send.
FIT_TASKS, ADD_TASKS = 16, 4
#: Partitions up to which the tasks' arrays go to the driver as they are: one task has added up its own.
DIRECT_PARTITIONS = 1
#: Bytes of all tasks' arrays up to which they go to the driver as they are, where a caller knows their size.
DIRECT_BYTES = 1 << 20
_SCHEMA = "key int, sums binary"


def dealt(df: DataFrame, by: str) -> DataFrame:
    """``df`` in at least ``FIT_TASKS`` partitions: a small table, however many
    models are fitted on it, would otherwise be the work of one task."""
    return df.repartition(max(FIT_TASKS, df.rdd.getNumPartitions()), by)


def array_sums(df: DataFrame, part: Callable[[pd.DataFrame], Iterable[tuple[int, np.ndarray]]],
               partitions: int | None = None, sums_bytes: int | None = None) -> dict[int, np.ndarray]:
    """The sums by key of the arrays of doubles that ``part`` gives for each
    batch of rows. A task adds its batches up and sends one array a key; their
    number and size must be bounded by parameters. Other tasks add those of a key,
    so what comes to the driver does not grow with the partitions. Arrays are
    added in a fixed order, so equal partitions give equal sums.

    A loop may name the partitions, which saves planning, and the bytes of a
    task's arrays: if those of all tasks are few, the driver adds them itself."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            if len(frame):
                for key, array in part(frame):
                    total[key] = total[key] + array if key in total else array
        if total:
            yield pd.DataFrame({"key": list(total), "sums": [np.ascontiguousarray(a, np.float64).tobytes() for a in total.values()]})

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[bytes]] = {}
        for frame in frames:
            for key, sums in zip(frame["key"], frame["sums"]):
                held.setdefault(key, []).append(sums)
        for key in sorted(held):
            yield pd.DataFrame({"key": [key], "sums": [np.sum([np.frombuffer(b) for b in sorted(held[key])], axis=0).tobytes()]})

    found = df.mapInPandas(run, _SCHEMA)
    partitions = partitions or df.rdd.getNumPartitions()
    if sums_bytes is not None and partitions * sums_bytes <= DIRECT_BYTES:
        return {r["key"]: np.frombuffer(r["sums"]) for frame in add([found.toPandas()]) for r in frame.to_dict("records")}
    if partitions > DIRECT_PARTITIONS:
        # the tasks' arrays are added by key in a few others, so the driver gets one a key
        found = found.repartition(ADD_TASKS, "key").mapInPandas(add, _SCHEMA)
    return {r["key"]: np.frombuffer(r["sums"]) for r in found.collect()}
