"""Number parsing and small arithmetic helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_INFINITY = r"(?i)^\s*[+-]?inf(inity)?\s*$"


def parse_number(column: Column, is_text: bool = True) -> Column:
    """Double value of a cell, null where it is no number.

    Text is checked first because a plain cast also takes Java spellings such
    as ``12d``, which are not numbers in a flow export.
    """
    if not is_text:
        return F.nanvl(column.cast("double"), F.lit(None).cast("double"))
    valid = column.rlike(_NUMBER) | column.rlike(_INFINITY)
    return F.when(valid, F.trim(column).try_cast("double"))


def number_or_zero(column: Column, is_text: bool = True) -> Column:
    return F.coalesce(parse_number(column, is_text), F.lit(0.0))


def clip(column: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        column = F.greatest(column, F.lit(low))
    if high is not None:
        column = F.least(column, F.lit(high))
    return column


def fixed_text(column: Column, digits: int = 2) -> Column:
    """``%.{digits}f`` with half-even rounding and no thousands separators.

    The exact formatter is slow, so it is left to the values it matters for:
    those next to a tie, and negative or very large ones.
    """
    unit = 10 ** digits
    scaled = column * unit
    near_tie = F.abs(scaled - F.floor(scaled) - 0.5) < 1e-4
    whole = F.floor(scaled + 0.5).cast("long")
    quick = F.concat(F.floor(whole / unit).cast("string"), F.lit("."),
                     F.lpad((whole % unit).cast("string"), digits, "0"))
    exact = F.replace(F.format_number(column, digits), F.lit(","), F.lit(""))
    return F.when((scaled >= 0) & (scaled < 1e10) & ~near_tie, quick).otherwise(exact)


def median_side(column: Column, cut: float, at_least: bool = False) -> Column:
    """Aggregates that decide on which side of ``cut`` the median lies.

    Counting is enough: if more than half of the values are above the cut so is
    the median, and only at an exact tie the two middle values matter. Every
    part combines map-side, so no task ever holds the values themselves.
    """
    above = (column >= cut) if at_least else (column > cut)
    return F.struct(
        F.count(column).alias("n"),
        F.count_if(above).alias("above"),
        F.max(F.when(~above, column)).alias("below_edge"),
        F.min(F.when(above, column)).alias("above_edge"),
    )


def median_is_above(side: Column, cut: float, at_least: bool = False) -> Column:
    """Evaluate a :func:`median_side` result; false without values."""
    middle = (side["below_edge"] + side["above_edge"]) / 2
    at_tie = middle >= cut if at_least else middle > cut
    return F.when(side["n"] == 0, False).when(2 * side["above"] != side["n"], 2 * side["above"] > side["n"]).otherwise(at_tie)
