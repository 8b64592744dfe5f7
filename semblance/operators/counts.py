"""In how many texts each feature occurs: files of a shared folder, looked up part by part.

A table of all features may exceed any memory, and a join would exchange every
feature of every text twice. Here only counts are exchanged, summed over
millions of features before; then each worker reads the table's parts as it
needs them, and holds a small table whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.grams import U, binary, release
from ..sources.store import opened, shared

BITS = 7
PARTS = 1 << BITS
#: Hashes summed at once, and the bytes of a table that a worker holds.
AT_ONCE, HELD = 1 << 21, 48 << 20
_held: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {}


@dataclass(frozen=True)
class Counts:
    """``n`` texts, empty ones counted. Features of fewer than ``least`` texts aren't listed:
    with 2, one that isn't is taken to be in one text, as if all asked for had been counted."""

    folder: str
    sizes: tuple[int, ...]
    n: int
    least: int

    def part(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        small = 12 * sum(self.sizes) <= HELD
        if small and k in _held.get(self.folder, {}):
            return _held[self.folder][k]
        where, root = opened(self.folder)
        with where.open_input_file(f"{root}/{k}") as f:
            raw = f.read()
        out = np.frombuffer(raw, U, self.sizes[k]), np.frombuffer(raw, np.uint32, self.sizes[k], 8 * self.sizes[k])
        if small:
            if self.folder not in _held and len(_held) > 2:
                _held.clear()
            _held.setdefault(self.folder, {})[k] = out
        return out

    def of(self, h: np.ndarray) -> np.ndarray:
        """The texts that each of these hashes occurs in."""
        u, back = np.unique(h, return_inverse=True)
        out = np.full(len(u), self.least - 1, np.int64)
        cuts = np.searchsorted(u, np.arange(1, PARTS, dtype=U) << U(64 - BITS)).tolist()
        for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(u)], strict=True)):
            if a < b and self.sizes[k]:
                known, n = self.part(k)
                at = np.minimum(np.searchsorted(known, u[a:b]), len(known) - 1)
                out[a:b] = np.where(known[at] == u[a:b], n[at], out[a:b])
        return out[back]

    def idf(self, h: np.ndarray) -> np.ndarray:
        return np.log((self.n + 1) / (self.of(h) + 1)) + 1


def _summed(held: list[np.ndarray]) -> pa.RecordBatch:
    h = np.sort(np.concatenate(held))
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    u, n = h[first], np.diff(first, append=len(h)).astype(np.uint32)
    cuts = [0, *np.searchsorted(u, np.arange(1, PARTS, dtype=U) << U(64 - BITS)).tolist(), len(u)]
    own = [k for k in range(PARTS) if cuts[k] < cuts[k + 1]]
    columns = [pa.array(own, pa.int32()), *(pa.array([x[cuts[k] : cuts[k + 1]].tobytes() for k in own], pa.binary()) for x in (u, n))]
    return pa.RecordBatch.from_arrays(columns, names=["part", "h", "n"])


def counted(df: DataFrame, of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], n: int, least: int = 2) -> Counts:
    """The table of ``df``; ``of`` gives the hashes of a batch, each once for every text it occurs in."""
    folder = f"{shared(df.sparkSession)}/counts-{uuid.uuid4().hex}"
    where, root = opened(folder)
    where.create_dir(root)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for h in of(b):
                held.append(h)
                size += len(h)
                if size >= AT_ONCE:
                    yield _summed(held)
                    held, size = [], 0
        if size:
            yield _summed(held)
        held = []
        release()

    def save(now: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h)
        h, n = h[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        h, n = h[first], np.add.reduceat(n, first, dtype=np.uint32)
        h, n = h[n >= least], n[n >= least]
        where, root = opened(folder)
        path = f"{root}/{uuid.uuid4().hex}"  # a task that runs again leaves no half of a part
        with where.open_output_stream(path) as f:
            f.write(h.tobytes())
            f.write(n.tobytes())
        where.move(path, f"{root}/{now}")
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([len(h)], pa.int64())], names=["part", "size"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        for b in batches:
            h, at = binary(b.column("h"), U)
            n, _ = binary(b.column("n"), np.uint32)
            for k, i, j in zip(b.column("part").to_pylist(), at[:-1], at[1:], strict=True):
                if k != now:
                    if held:
                        yield save(now, held)
                    now, held = k, []
                held.append((h[i:j].copy(), n[i:j].copy()))
        if held:
            yield save(now, held)
        held = []
        release()

    tasks = min(PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    made = df.mapInArrow(sums, "part int, h binary, n binary").repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(parts, "part int, size long").collect()
    size = {r.part: r.size for r in made}
    return Counts(folder, tuple(size.get(k, 0) for k in range(PARTS)), n, least)
