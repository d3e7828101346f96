"""Bilinear resampling of tiles, without taking them apart into cells."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridlake.grid import BlockGrid, num_blocks
from gridlake.operators.blocks import tasks_for
from gridlake.operators.shape import unique_positions, within_size

# Values that a task sends or makes before it hands on a batch.
VALUES_PER_BATCH = 1 << 20


@dataclass(frozen=True)
class Axis:
    """One axis: ``n`` source positions and ``t`` outputs, both in tiles of ``size``."""

    n: int
    t: int
    size: int

    def extent(self, tile: int) -> int:
        """Source positions of a source tile."""
        return min(self.size, self.n - tile * self.size)

    def outputs(self, tile: int) -> range:
        """The output tiles that look at a source tile."""
        if self.n == 1:
            return range(num_blocks(self.t, self.size))
        before, after = tile * self.size - 1, tile * self.size + self.extent(tile)
        first = 0 if before < 0 else before * (self.t - 1) // (self.n - 1) + 1
        last = min(-(-after * (self.t - 1) // (self.n - 1)) - 1, self.t - 1)
        return range(first // self.size, last // self.size + 1) if first <= last else range(0)


@lru_cache(maxsize=1024)
def _weights(axis: Axis, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The band of the weight matrix of an output tile.

    The source positions that it looks at; and for each output, which of these are before and after it,
    and the weight of the latter. Positions are compared as integers.
    """
    out = np.arange(tile * axis.size, min((tile + 1) * axis.size, axis.t), dtype=np.int64)
    low, rest = np.divmod(out * (axis.n - 1), axis.t - 1)
    high = low + (rest > 0)
    seen = np.union1d(low, high)
    return seen, np.searchsorted(seen, low), np.searchsorted(seen, high), rest / (axis.t - 1)


def _seen(axis: Axis, out: int, tile: int) -> tuple[int, int]:
    """Which of the positions that output tile ``out`` looks at are in a source tile: from, and up to."""
    edges = np.array([tile, tile + 1], np.int64) * axis.size
    first, last = np.searchsorted(_weights(axis, out)[0], edges)
    return int(first), int(last)


def _taken(axis: Axis, out: int, tile: int) -> np.ndarray:
    first, last = _seen(axis, out, tile)
    return _weights(axis, out)[0][first:last] - tile * axis.size


def _send(batches: Iterable[pa.RecordBatch], kept: list[str], down: Axis, along: Axis) -> Iterator[pa.RecordBatch]:
    """From each tile, to each output tile that looks at it, the rows and columns that this needs."""

    def sent(source: list[int], to: list[tuple], parts: list[np.ndarray], batch: pa.RecordBatch) -> pa.RecordBatch:
        upto = np.cumsum([0, *map(len, parts)])
        columns = [batch[name].take(pa.array(source, pa.int64())) for name in kept]
        columns += [pa.array([x[k] for x in to], pa.int32()) for k in range(4)]
        columns.append(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(np.concatenate(parts))))
        return pa.RecordBatch.from_arrays(columns, names=[*kept, "bi", "bj", "si", "sj", "vals"])

    for batch in batches:
        source, to, parts, values = [], [], [], 0
        for k in range(batch.num_rows):
            bi, bj, nr, nc = (batch[name][k].as_py() for name in ("bi", "bj", "nr", "nc"))
            vals = batch["vals"][k].values.to_numpy(zero_copy_only=False)
            if (nr, nc, len(vals)) != (down.extent(bi), along.extent(bj), nr * nc):
                raise ValueError(f"block ({bi}, {bj}) has {len(vals)} values as {nr} x {nc}")
            tile = vals.reshape((nr, nc), order="F")
            for oi in down.outputs(bi):
                strip = tile[_taken(down, oi, bi)]
                for oj in along.outputs(bj):
                    part = strip[:, _taken(along, oj, bj)].ravel(order="F")
                    source.append(k)
                    to.append((oi, oj, bi, bj))
                    parts.append(part)
                    values += len(part) + 8
                    if values >= VALUES_PER_BATCH:
                        yield sent(source, to, parts, batch)
                        source, to, parts, values = [], [], [], 0
        if parts:
            yield sent(source, to, parts, batch)


def _blend(values: np.ndarray, low: np.ndarray, high: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The rows of the band matrix times ``values``; what has weight 0 takes no part."""
    out = values[low] * (1 - weight)[:, None]
    some = np.flatnonzero(weight)
    out[some] += values[high[some]] * weight[some, None]
    return out


def _resample(batches: Iterable[pa.RecordBatch], kept: list[str], down: Axis, along: Axis) -> Iterator[pa.RecordBatch]:
    """Output tiles, from what was sent to each."""
    names = [*kept, "bi", "bj"]
    for batch in batches:
        step = max(1, VALUES_PER_BATCH // (down.size * along.size))
        for start in range(0, batch.num_rows, step):
            some = batch.slice(start, step)
            tiles = []
            for k in range(some.num_rows):
                oi, oj = some["bi"][k].as_py(), some["bj"][k].as_py()
                rows, *down_band = _weights(down, oi)
                cols, *along_band = _weights(along, oj)
                whole = np.zeros((len(rows), len(cols)))
                pieces = some["sent"][k].values
                si, sj, vals = (pieces.field(name) for name in ("si", "sj", "vals"))
                for p in range(len(pieces)):
                    r0, r1 = _seen(down, oi, si[p].as_py())
                    c0, c1 = _seen(along, oj, sj[p].as_py())
                    part = vals[p].values.to_numpy(zero_copy_only=False)
                    whole[r0:r1, c0:c1] = part.reshape((r1 - r0, c1 - c0), order="F")
                tiles.append(_blend(_blend(whole, *down_band).T, *along_band).T)
            upto = np.cumsum([0, *(tile.size for tile in tiles)])
            flat = np.concatenate([tile.ravel(order="F") for tile in tiles])
            columns = [some[name] for name in names]
            columns += [pa.array([tile.shape[axis] for tile in tiles], pa.int32()) for axis in (0, 1)]
            columns.append(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "nr", "nc", "vals"])


def resample_tiles(grid: BlockGrid, rows: int, cols: int) -> BlockGrid:
    """Bilinear resampling of a grid of known size to ``rows x cols``, in tiles of the same size.

    Each tile sends, to each output tile, the rows and columns that it looks at, as one array. An output
    tile puts together what it was sent and applies the weights along one axis and then the other; each
    looks at two source positions along an axis for an output at most, so what it gathers is bounded by
    its size. One shuffle, of pieces of tiles: about the source for a finer target, and at most four
    values for each output for a coarser one. Output tiles that look at no tile present are absent.
    """
    down, along = Axis(grid.nrows, rows, grid.rows_per_block), Axis(grid.ncols, cols, grid.cols_per_block)
    kept = list(grid.keys)
    grid = unique_positions(within_size(grid))
    types = "".join(f"`{name}` {grid.df.schema[name].dataType.simpleString()}, " for name in kept)
    sent = grid.df.select(*kept, "bi", "bj", "nr", "nc", "vals").mapInArrow(
        lambda batches: _send(batches, kept, down, along),
        types + "bi INT, bj INT, si INT, sj INT, vals ARRAY<DOUBLE>",
    )
    gathered = (
        sent.repartition(tasks_for(grid, rows * cols), *kept, "bi", "bj")
        .groupBy(*kept, "bi", "bj")
        .agg(F.collect_list(F.struct("si", "sj", "vals")).alias("sent"))
    )
    df = gathered.mapInArrow(
        lambda batches: _resample(batches, kept, down, along),
        types + "bi INT, bj INT, nr INT, nc INT, vals ARRAY<DOUBLE>",
    )
    return replace(grid, df=df, nrows=rows, ncols=cols, unique=True)
