"""Running aggregates over a densely numbered table, without one task seeing all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

BLOCK_ROWS = 1024


def running(
    table: DataFrame,
    keys: list[str],
    index: str,
    values: dict[str, tuple[str, Column]],
    include_current: bool = True,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add running aggregates ``{out: ("sum" | "max", value)}`` in order of integer ``index``.

    Rows are aggregated inside blocks of ``block_rows`` index values and carried over between
    blocks, so the windows that span the table see one row per block.
    """
    pick = {"sum": F.sum, "max": F.max}
    rows = table.withColumns({f"_v_{out}": value for out, (_, value) in values.items()}).withColumn(
        "_block", F.floor(F.col(index) / block_rows)
    )
    group = [*keys, "_block"]
    sums = [pick[how](f"_v_{out}").alias(f"_t_{out}") for out, (how, _) in values.items()]
    totals = rows.groupBy(*group).agg(*sums)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before_block = [pick[how](f"_t_{out}").over(earlier).alias(f"_c_{out}") for out, (how, _) in values.items()]
    carried = totals.select(*group, *before_block)
    last_row = 0 if include_current else -1
    inside = Window.partitionBy(*group).orderBy(index).rowsBetween(Window.unboundedPreceding, last_row)
    merged = rows.join(carried, group)
    for out, (how, _) in values.items():
        here, before = pick[how](f"_v_{out}").over(inside), F.col(f"_c_{out}")
        if how == "sum":
            merged = merged.withColumn(out, F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0)))
        else:
            merged = merged.withColumn(out, F.greatest(here, before))
    helpers = [f"_{kind}_{out}" for out in values for kind in "vc"]
    return merged.drop("_block", *helpers)
