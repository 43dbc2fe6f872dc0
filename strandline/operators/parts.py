"""Parts of an axis: which of many sorted bounds a value lies between."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bounds_below(value: Column, bounds: list, closed: bool = False) -> Column:
    """How many of the sorted bounds lie below a value (closed: at or below it).

    Bounds are searched in two steps, about twice the root of their number being looked at for each value.
    """
    if not bounds:
        return F.lit(0)
    size = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[k : k + size] for k in range(0, len(bounds), size)]
    below = (lambda b: b <= value) if closed else (lambda b: b < value)
    listed = lambda values: F.array(*[F.lit(v) for v in values])
    whole = F.size(F.filter(listed([b[-1] for b in blocks]), below))
    inside = F.get(F.array(*[listed(b) for b in blocks]), whole)
    # the last block may be short, so beyond all blocks it isn't their number times their size
    return F.least(whole * size + F.coalesce(F.size(F.filter(inside, below)), F.lit(0)), F.lit(len(bounds)))
