"""Places on a space-filling curve."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _spread(c: Column) -> Column:
    """The bits of a number below 2^31 at every other place."""
    for shift in (16, 8, 4, 2, 1):
        mask = sum(((1 << shift) - 1) << place for place in range(0, 64, 2 * shift))
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask if mask < 1 << 63 else mask - (1 << 64)))
    return c


def cell_code(lat_idx: Column, lon_idx: Column) -> Column:
    """The place of a cell on the Z curve, for indices from 0: near cells have near places. Missing for a missing index."""
    return reduce(Column.bitwiseOR, (_spread(lon_idx.cast("long")), F.shiftleft(_spread(lat_idx.cast("long")), 1)))
