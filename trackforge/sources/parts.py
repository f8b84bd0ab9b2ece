"""One file from many tasks: each writes a part beside it, and the driver joins the parts in order.

What the tasks note of their parts goes to the driver, their bytes do not. Files must lie where driver and executors see
them.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


@contextmanager
def stored(rows: DataFrame, run: Callable, notes: str, path: str) -> Iterator[tuple[list[Row], list[str]]]:
    """Runs a mapInArrow whose batches have a column body; its tasks write the bodies to files.

    notes: the schema of the other columns, which may be none. Yields their rows in order, each with n, the bytes of its
    body, and the files in order, which go at the end. Of a task that runs twice only the file of one run counts.
    """
    folder = f"{path.removeprefix('file://')}.{uuid.uuid4().hex}"
    os.makedirs(folder)

    def store(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name, nth, f = f"{part:08d}-{uuid.uuid4().hex}", 0, None
        try:
            for batch in run(batches):
                f = f or open(f"{folder}/{name}", "wb")
                at = batch.schema.get_field_index("body")
                bodies = batch.column(at).to_pylist()
                for b in bodies:
                    f.write(b)
                k = len(bodies)
                own = [pa.array([name] * k), pa.array(range(nth, nth + k), pa.int64()), pa.array([len(b) for b in bodies], pa.int64())]
                nth += k
                kept = [i for i in range(batch.num_columns) if i != at]
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + own, [batch.schema.names[i] for i in kept] + ["file", "nth", "n"])
        finally:
            if f:
                f.close()

    try:
        out = rows.mapInArrow(store, f"{notes}, file string, nth long, n long".removeprefix(", ")).collect()
        out.sort(key=lambda r: (r["file"], r["nth"]))
        yield out, [f"{folder}/{x}" for x in sorted({r["file"] for r in out})]
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def append(out, files: list[str]) -> None:
    """Copies files to the end of an open one."""
    for name in files:
        with open(name, "rb") as f:
            shutil.copyfileobj(f, out, 1 << 22)


def write_text(lines: DataFrame, path: str, *order: str) -> None:
    """Writes lines(value) as one text file, in the order of these columns and else as they come."""
    local = path.removeprefix("file://")
    folder = f"{local}.{uuid.uuid4().hex}"
    ordered(lines, *order).write.option("compression", "none").text(f"file://{os.path.abspath(folder)}")
    try:
        with open(local, "wb") as out:
            append(out, [f"{folder}/{x}" for x in sorted(os.listdir(folder)) if x.startswith("part-")])
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def ordered(lines: DataFrame, *order: str) -> DataFrame:
    """value, dealt to partitions that follow these columns and else the order of the rows; a column of few values is dealt to many."""
    x = lines.withColumn("_nth", F.monotonically_increasing_id())
    return x.repartitionByRange(*order, "_nth").sortWithinPartitions(*order, "_nth").select("value")
