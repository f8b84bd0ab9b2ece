"""Spanning forests of the links that one task holds."""

from __future__ import annotations

import pyarrow as pa


def forest(batches):
    """mapInArrow over (a, b): the links of a spanning forest, each node linked to the least of its tree."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up[x]) != x:
            up[x] = y = up[y]
            x = y
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            up.setdefault(a, a)
            up.setdefault(b, b)
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    out = [(root(x), x) for x in up if root(x) != x]
    for i in range(0, len(out), 50_000):
        part = out[i : i + 50_000]
        yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in part], pa.int64()), "b": pa.array([x[1] for x in part], pa.int64())})
