"""The one sink that leaves Spark: a bounded dense array on the driver."""

from __future__ import annotations

import logging

import numpy as np

from gridlake.grid import BlockGrid, Grid
from gridlake.operators.blocks import to_cells
from gridlake.operators.shape import with_dims

log = logging.getLogger(__name__)

MAX_CELLS = 2**31 - 1
WARN_MB = 500


def to_local(grid: Grid) -> np.ndarray:
    """The whole grid as a numpy array; absent cells are 0.

    Refuses anything with 2^31-1 rows, columns or cells and more, and warns above 500 MB.
    Only the cells present are fetched.
    """
    cells = with_dims(to_cells(grid) if isinstance(grid, BlockGrid) else grid)
    if cells.keys:
        raise ValueError("select one batch first; a local array has no batch keys")
    nrows, ncols = cells.nrows, cells.ncols
    if max(nrows, ncols, nrows * ncols) >= MAX_CELLS:
        raise ValueError(f"{nrows} x {ncols} is too large for a local array")
    if nrows * ncols // 125000 > WARN_MB:
        log.warning("this array needs %d MB of driver memory", nrows * ncols // 125000)
    found = cells.df.select("i", "j", "v").toArrow()
    i, j, v = (found.column(name).to_numpy() for name in ("i", "j", "v"))
    if len(i) and (min(i.min(), j.min()) < 0 or i.max() >= nrows or j.max() >= ncols):
        raise ValueError("a cell lies outside the claimed size")
    at = i * ncols + j
    if not cells.unique and len(np.unique(at)) != len(at):
        raise ValueError("a cell occurs more than once")
    out = np.zeros(nrows * ncols)
    out[at] = v
    return out.reshape(nrows, ncols)
