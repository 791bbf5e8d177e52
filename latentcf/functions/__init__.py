"""Column expressions shared by the operators (all JVM-side built-ins)."""

from latentcf.functions.hashing import keyed_bits, keyed_unit_open, keyed_unit_half_open
from latentcf.functions.numeric import (
    dot,
    quantise,
    safe_div,
    row_sum,
)

__all__ = [
    "keyed_bits",
    "keyed_unit_open",
    "keyed_unit_half_open",
    "dot",
    "quantise",
    "safe_div",
    "row_sum",
]
