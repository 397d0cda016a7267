"""Distinct ids as bitmaps of 64 neighbouring ids: a block number and a long whose bits are the ids present.

``bit_or`` unites blocks and ``bit_count`` counts them.  Blocks are never more than the ids they hold, and their
aggregation is a hash aggregation over fixed-width rows, so few ids among many cost no more than a list of them.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def block_of(id_: Column | str) -> Column:
    """The block of an id (negative ids have negative blocks)."""
    return F.shiftright(F.col(id_) if isinstance(id_, str) else id_, 6)


def bit_of(id_: Column | str) -> Column:
    """The bit of an id within its block; NULL for a NULL id."""
    id_ = F.col(id_) if isinstance(id_, str) else id_
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(id_, F.lit(64)).cast("int"))
