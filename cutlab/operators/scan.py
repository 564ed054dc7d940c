"""Running values along the rows of a clip: sums, last and next values, neighbours.

By default a clip is one window. With ``long`` its rows are dealt out by ranges
of (clip, order): each range is a window of its own, and what a range hands on
to the next ones of its clip is one row. So a clip of any length spreads over
tasks, at the price of sampling the order and writing the rows once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cutlab.sources.shared import keep

#: Folds that look ahead.
_AHEAD = ("next", "lead")


def _over(kind: str, value: str, keys: list[str], order: list[str]) -> Column:
    up = Window.partitionBy(*keys).orderBy(*order)
    down = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    seen = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    match kind:
        case "sum":
            return F.sum(value).over(seen(up))
        case "last":
            return F.last(value, ignorenulls=True).over(seen(up))
        case "next":  # looked up backwards, since a window that reaches to the end is summed anew for every row
            return F.last(value, ignorenulls=True).over(seen(down))
        case "lag":
            return F.lag(value).over(up)
        case "lead":
            return F.lead(value).over(up)
    raise ValueError(kind)


def folded(rows: DataFrame, order: list[str], folds: dict[str, tuple[str, str]], long: bool = False) -> DataFrame:
    """Rows (clip, ...) with a column for each fold (kind, column), in the order of each clip.

    sum: of the column up to this row; last and next: its nearest value that is
    not null, this row included; lag and lead: its value one row before or
    after. ``order`` has to tell rows of a clip apart.
    """
    if not long:
        return rows.select("*", *[_over(kind, value, ["clip"], order).alias(name) for name, (kind, value) in folds.items()])
    dealt = keep(rows.repartitionByRange("clip", *order).withColumn("part_", F.spark_partition_id()))
    edges = dealt.groupBy("clip", "part_").agg(*[_edge(kind, value, order).alias(name) for name, (kind, value) in folds.items()])
    carry = edges.select("clip", "part_", *[_carried(kind, name).alias(f"{name}_carry") for name, (kind, _) in folds.items()])
    own = dealt.select("*", *[_over(kind, value, ["clip", "part_"], order).alias(name) for name, (kind, value) in folds.items()])
    at = Window.partitionBy("clip", "part_").orderBy(*order)
    own = own.withColumn("first_", F.row_number().over(at) == 1).withColumn("last_", F.lead(F.lit(1)).over(at).isNull())
    both = own.join(carry, ["clip", "part_"])
    return both.select(*rows.columns, *[_joined(kind, name).alias(name) for name, (kind, _) in folds.items()])


def _edge(kind: str, value: str, order: list[str]) -> Column:
    """What a range hands on."""
    if kind == "sum":
        return F.sum(value)
    row = F.struct(*order, F.col(value).alias("value_"))
    row = row if kind in ("lag", "lead") else F.when(F.col(value).isNotNull(), row)
    return F.min(row) if kind in _AHEAD else F.max(row)


def _carried(kind: str, name: str) -> Column:
    """What comes from the other ranges of the clip: one row a range."""
    w: WindowSpec = Window.partitionBy("clip").orderBy(F.desc("part_") if kind in _AHEAD else F.col("part_"))
    w = w.rowsBetween(Window.unboundedPreceding, -1)
    return F.sum(name).over(w) if kind == "sum" else F.last(name, ignorenulls=True).over(w)


def _joined(kind: str, name: str) -> Column:
    own, carry = F.col(name), F.col(f"{name}_carry")
    if kind == "sum":
        return F.when(own.isNull(), carry).otherwise(own + F.coalesce(carry, F.lit(0)))
    if kind in ("lag", "lead"):
        return F.when(F.col("first_" if kind == "lag" else "last_"), carry["value_"]).otherwise(own)
    return F.coalesce(own, carry["value_"])
