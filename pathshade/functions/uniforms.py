"""Reproducible uniforms: a hash of what a draw is for, never ``rand()``.

A task that runs again draws the same values, and SQL engines agree on them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def uniform(*parts) -> Column:
    """52 bits of an MD5 digest as a double in [0, 1)."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def normal(*parts) -> Column:
    """A standard normal by Box and Muller."""
    radius = F.sqrt(-2.0 * F.log(1.0 - uniform(*parts, "r")))
    return radius * F.cos(2.0 * math.pi * uniform(*parts, "a"))
