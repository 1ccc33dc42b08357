"""Seeded draws that any engine can recompute.

One md5 per (seed, row, step) gives a base; every further draw of that row is long
arithmetic on (base, slot). Nothing depends on partitioning, retries or evaluation order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: a prime below 2^31 on which cubing is a one-to-one map
PRIME = 2147483579
#: distance between the inputs of two neighbouring slots
STRIDE = 1103515245


def base(seed: int, *parts: Column) -> Column:
    """The starting point of all draws of one row, a long in [0, PRIME)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % PRIME


def spot(at: Column, slot: Column | int) -> Column:
    """Where a slot's draw starts from; :func:`mixed` makes the draw of it."""
    shift = (slot * STRIDE) % PRIME if isinstance(slot, int) else slot.cast("long") * STRIDE
    return (at + shift) % PRIME


def mixed(x: Column) -> Column:
    """The draw of a spot. Apart from it so that arrays of spots are evaluated once."""
    return x * ((x * x) % PRIME) % PRIME


def draw(at: Column, slot: Column | int) -> Column:
    """A long in [0, PRIME). Different slots of one base never give the same value."""
    return mixed(spot(at, slot))


def pick(at: Column, slot: Column | int, n: Column | int) -> Column:
    """An int in [0, n); 0 when n is below one."""
    most = n if isinstance(n, int) else F.greatest(n, F.lit(1))
    return (draw(at, slot) % most).cast("int")


def uniform(at: Column, slot: Column | int) -> Column:
    """A double in [0, 1)."""
    return draw(at, slot) / F.lit(float(PRIME))
