"""Arithmetic helpers: unrolled k-vectors, safe division, quantisation.

Class-indexed quantities are kept *wide*: one double column per class
(``{prefix}{z}``). Unrolled scalar columns stay inside whole-stage codegen,
unlike array higher-order functions, and a dot product is a fixed
left-to-right sum whose rounding is reproducible in any SQL engine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: smallest evidence used for logs and divisions (underflow guard).
EVIDENCE_FLOOR = 1e-300


def row_sum(cols: list) -> Column:
    """Left-to-right sum of columns (fixed evaluation order)."""
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    return reduce(lambda a, b: a + b, cs)


def dot(a_prefix: str, b_prefix: str, k: int) -> Column:
    """sum_z a_z * b_z, unrolled, evaluated left to right."""
    return row_sum([F.col(f"{a_prefix}{z}") * F.col(f"{b_prefix}{z}") for z in range(k)])


def safe_div(num: Column, den: Column) -> Column:
    """NULL instead of an error on 0/0 (ANSI mode raises on plain '/')."""
    return F.try_divide(num, den)


def quantise(c: Column, scale: float = 1e9) -> Column:
    """floor(x*scale + 0.5) as bigint: a comparable fingerprint of a double.

    Two engines summing the same doubles in different orders differ in the
    last bits; the fingerprint hides that while keeping 9 (or 6) digits.
    """
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("bigint")
