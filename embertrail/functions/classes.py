"""Size and height classes: range joins to tiny fixed dimensions, written as CASE expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper ends of the size classes in cm2, first match wins, above the last it stays the last.
SIZES = (("XXS", 100), ("XS", 500), ("S", 1000), ("M", 2500), ("L", 5000), ("XL", 10000), ("XXL", 20000))
# The height classes in metres. Heights in the gaps fall through to the last; the lower ends hold in single precision.
HEIGHTS = (("?", None, -2.0), ("G", -1.9, 2.0), ("1f", 2.01, 5.0), ("2f", 5.01, 8.0), ("3f", 8.01, 11.0), ("4f", 11.01, 14.0), ("5f", 14.01, 17.0), ("6f+", 17.01, 99999.0))
SIZE_NAMES, HEIGHT_NAMES = [s[0] for s in SIZES], [h[0] for h in HEIGHTS]
ABANDON_HEIGHT_ERR_M = 5.0


def size_class(cm2: Column) -> Column:
    whole = cm2.cast("long")
    return reduce(lambda rest, s: F.when(whole <= s[1], F.lit(s[0])).otherwise(rest), reversed(SIZES), F.lit("XXL"))


def height_class(height: Column, err: Column, abandon: float = ABANDON_HEIGHT_ERR_M) -> Column:
    h = height.cast("float").cast("double")
    out = F.when(h < 0, F.lit("?")).otherwise(F.lit("6f+"))
    for name, low, high in reversed(HEIGHTS[1:]):
        out = F.when((h >= low) & (h <= high), F.lit(name)).otherwise(out)
    return F.when(height.isNull() | (err > abandon) | (h <= -2.0), F.lit("?")).otherwise(out)


def class_index(name: Column, names: list[str]) -> Column:
    """0-based, -1 if missing; upper and lower case are the same."""
    return F.coalesce(F.array_position(F.array(*[F.lit(n.upper()) for n in names]), F.upper(name)).cast("int") - 1, F.lit(-1))


def size_sql(c: str) -> str:
    return "case " + " ".join(f"when {c} <= {high} then '{name}'" for name, high in SIZES) + " else 'XXL' end"


def height_sql(h: str, err: str) -> str:
    f = f"cast(cast({h} as real) as double)"
    return f"case when {h} is null or {err} > 5 or {f} <= -2 then '?' " + " ".join(f"when {f} >= {low} and {f} <= {high} then '{name}'" for name, low, high in HEIGHTS[1:]) + f" when {f} < 0 then '?' else '6f+' end"
