"""Pixel values: validity, fill values, stretches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.attrs import FILL_VALUE

# The stretch range and its four colours.
STRETCH = (-25.0, 25.0)
PALETTE = ("001137", "01abab", "e7eb05", "620500")


def is_finite(value: Column) -> Column:
    """True for numbers other than NaN and the infinities."""
    number = value.cast("double")
    return F.coalesce(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), F.lit(False))


def to_fill(value: Column, fill: float = FILL_VALUE) -> Column:
    """Masked pixels (NULL, NaN) as the fill value."""
    return F.coalesce(F.nanvl(value.cast("double"), F.lit(None).cast("double")), F.lit(fill))


def from_fill(value: Column, fill: float = FILL_VALUE) -> Column:
    return F.nullif(value, F.lit(fill))


def stretch(value: Column, low: Column | float, high: Column | float) -> Column:
    """Linear stretch of [low, high] to [0, 1], clamped at both ends; 0 where low equals high."""
    low_, high_ = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    share = F.coalesce((value - low_) / F.nullif(high_ - low_, F.lit(0.0)), F.lit(0.0))
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def palette_class(value: Column, colours: tuple[str, ...] = PALETTE, span: tuple[float, float] = STRETCH) -> Column:
    """0-based index of the nearest colour after stretching."""
    return F.floor(stretch(value, *span) * (len(colours) - 1) + 0.5).cast("int")


def palette_colour(value: Column, colours: tuple[str, ...] = PALETTE, span: tuple[float, float] = STRETCH) -> Column:
    table = F.array(*[F.lit(colour) for colour in colours])
    return F.when(value.isNotNull(), F.element_at(table, palette_class(value, colours, span) + 1))


def quicklook_byte(value: Column, low: Column, high: Column) -> Column:
    """Grey value 0-255 of a min-max scaled pixel."""
    return F.floor(stretch(value, low, high) * 255).cast("int")


def _spread(number: Column) -> Column:
    """The low 21 bits of a number with a zero bit after each; masks halve the distance between bits step by step."""
    spread = number.cast("long").bitwiseAND(F.lit((1 << 21) - 1).cast("long"))
    for gap in (16, 8, 4, 2, 1):
        run = (1 << gap) - 1
        mask = sum(run << (2 * gap * k) for k in range(64 // (2 * gap))) & ((1 << 62) - 1)
        spread = spread.bitwiseOR(F.shiftleft(spread, gap)).bitwiseAND(F.lit(mask).cast("long"))
    return spread


def z_order(row: Column, col: Column) -> Column:
    """Z-order number of a cell: the bits of its row and column in turn. Cells 2 ** 20 from the origin or less keep their order."""
    offset = 1 << 20
    return F.shiftleft(_spread(row + offset), 1).bitwiseOR(_spread(col + offset))
