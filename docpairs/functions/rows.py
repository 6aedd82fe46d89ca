"""Generators that keep expensive array expressions evaluated once.

For an inner ``explode``/``posexplode`` over a column computed by an earlier
projection, Catalyst infers ``size(col) > 0`` and pushes that predicate below the
projection (and below a repartition, into the scan) with the column's defining
expression inlined: cleaning and tokenising would then run twice, the first time
before the rows are spread over tasks. The outer generators infer nothing, and the
empty/null arrays they turn into a null row are dropped right after, on the
generated column, which cannot be pushed further down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A place is an (id, position) as one number, id * SPAN + position. Positions stay below SPAN;
# null ids come first, as in a struct.
SPAN, NO_ID, LEAST_ID = 1 << 32, -(1 << 63) - 1, -(1 << 63)


def explode_rows(df: DataFrame, keep: list, arr, name: str = "token", pos_name: str | None = None) -> DataFrame:
    """One row per element of ``arr`` (with its 0-based position when ``pos_name``
    is given), keeping the ``keep`` columns; rows with empty or null arrays vanish."""
    if pos_name:
        out = df.select(*keep, F.posexplode_outer(arr).alias(pos_name, name))
        return out.where(F.col(pos_name).isNotNull())
    out = df.select(*keep, F.posexplode_outer(arr).alias("_pos", name))
    return out.where(F.col("_pos").isNotNull()).drop("_pos")


def place_base(id_col) -> Column:
    """The place of a row's first element; add the position for the others. The least place
    of a group is found by a hash aggregate, while a least struct needs all rows sorted."""
    row_id = F.col(id_col) if isinstance(id_col, str) else id_col
    number = F.coalesce(row_id.cast("bigint").cast("decimal(38,0)"), F.lit(str(NO_ID)).cast("decimal(38,0)"))
    return number.cast("decimal(20,0)") * F.lit(str(SPAN)).cast("decimal(10,0)")


def place_of(base: str, pos: str) -> Column:
    return F.col(base) + F.col(pos).cast("decimal(10,0)")


def place_parts(place: str) -> tuple[Column, Column]:
    """The id and the position of a place, as bigints."""
    number, span = f"`{place}`", f"cast('{SPAN}' as decimal(10,0))"
    pos = f"pmod({number}, {span})"
    known = f"{number} >= cast('{LEAST_ID * SPAN}' as decimal(38,0))"
    return F.expr(f"CASE WHEN {known} THEN ({number} - {pos}) div {span} END"), F.expr(f"cast({pos} as bigint)")
