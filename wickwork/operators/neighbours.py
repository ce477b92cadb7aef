"""Mutual information of features and classes from nearest neighbours, without comparing all pairs.

Rows are ordered by value over range partitions, so no order is made in one task. A row's nearest neighbours of its class
stand next to it in the order of the class: blocks of that order carry the few rows beyond either edge. How many rows of
any class are as near follows from two places in the order of all rows, found by sorting the ends of the row's interval in
among the values and adding up rows before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import written

#: Rows of a block of a class's order.
BLOCK_ROWS = 1 << 16


def ranked(df: DataFrame, group: list[str], order: list[str], name: str, weight: str = "1L") -> DataFrame:
    """``df``, written down, with ``rank``: the sum of ``weight`` over the group's rows before each row in ``order``.

    Ranges of (group, order) are summed up apart from each other; their totals, a row for each range and group, give the
    starts. ``order`` should tell rows apart, else equal rows share a task.
    """
    keys = [*group, *order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()).withColumn("_w", F.expr(weight))
    rows = written(rows, name)
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_part", *group).agg(F.sum("_w").alias("_t"))
    starts = totals.withColumn("_s", F.coalesce(F.sum("_t").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    rows = rows.withColumn("_before", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    return rows.join(starts, ["_part", *group]).withColumn("rank", F.col("_s") + F.col("_before")).drop("_part", "_w", "_s", "_before")


def digamma(n: Column) -> Column:
    """Of whole numbers from 1 on, to some 13 digits."""
    up = n.cast("double") + 8
    series = F.log(up) - 1 / (2 * up) - 1 / (12 * up**2) + 1 / (120 * up**4) - 1 / (252 * up**6) + 1 / (240 * up**8)
    return series - sum((1 / (n.cast("double") + k) for k in range(1, 8)), 1 / n.cast("double"))


def radii(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` (Feature, target, x, id) with ``k``, ``radius`` and ``edge``: distance and value of the k-th nearest of the class, or of the farthest of a small one; rows alone in their class go."""
    size = rows.groupBy("Feature", "target").agg(F.count(F.lit(1)).alias("size"))
    placed = ranked(rows, ["Feature", "target"], ["x", "id"], "class-order").join(size, ["Feature", "target"]).filter("size > 1")
    block = f"rank div {BLOCK_ROWS}"
    # Rows near an edge are in the next block too.
    blocks = placed.withColumn("block", F.explode(F.array_distinct(F.array(F.expr(block), F.expr(f"greatest(rank - {k}, 0) div {BLOCK_ROWS}"), F.expr(f"(rank + {k}) div {BLOCK_ROWS}")))))
    near = Window.partitionBy("Feature", "target", "block").orderBy("rank")
    gaps = F.array(*[F.struct(F.abs(f("x", j).over(near) - F.col("x")).alias("d"), f("x", j).over(near).alias("v")) for j in range(1, k + 1) for f in (F.lag, F.lead)])
    out = blocks.withColumn("k", F.least(F.lit(k).cast("long"), F.col("size") - 1)).withColumn("gaps", F.array_sort(F.filter(gaps, lambda g: g["d"].isNotNull())))
    return out.filter(f"block = {block}").select("Feature", "target", "x", "id", "size", "k", F.element_at("gaps", F.col("k").cast("int"))["d"].alias("radius"), F.element_at("gaps", F.col("k").cast("int"))["v"].alias("edge"))


def neighbour_mutual_info(df: DataFrame, features: list[str], target: str = "target", k: int = 3) -> DataFrame:
    """(Feature, MI): in nats, from how many rows of any class are nearer than a row's ``k``-th nearest of its own; never below 0.

    Rows with a null feature or class are left out for that feature, and so are classes of a single row. Equal values are
    neighbours at a distance of 0, and no noise is added. Features without rows are missing from the result.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("Feature"), F.col(f"`{c}`").cast("double").alias("x")) for c in features]))
    rows = df.select(F.col(target).alias("target"), each.alias("f")).select("f.*", "target").na.drop()
    rows = written(rows.withColumn("id", F.monotonically_increasing_id()), "values")
    found = written(radii(rows, k), "radii")
    # Rows strictly within the radius, and where it is 0 the equal ones. On the neighbour's side its own value is the end, whatever x and the radius round to.
    strict, above = F.col("radius") > 0, F.col("edge") > F.col("x")
    low, high = F.when(above, F.col("x") - F.col("radius")).otherwise(F.col("edge")), F.when(above, F.col("edge")).otherwise(F.col("x") + F.col("radius"))
    ends = F.array(
        F.struct(F.col("x").alias("v"), F.lit(1).alias("kind"), F.lit(0).alias("sign")),
        F.struct(low.alias("v"), F.when(strict, 2).otherwise(0).alias("kind"), F.lit(-1).alias("sign")),
        F.struct(high.alias("v"), F.when(strict, 0).otherwise(2).alias("kind"), F.lit(1).alias("sign")),
    )
    marks = found.select("Feature", "id", F.explode(ends).alias("e")).select("Feature", "id", "e.*")
    counted = ranked(marks, ["Feature"], ["v", "kind", "id", "sign"], "interval-ends", "CASE WHEN sign = 0 THEN 1L ELSE 0L END").filter("sign <> 0")
    inside = counted.groupBy("Feature", "id").agg(F.sum(F.col("sign") * F.col("rank")).alias("m"))
    sums = found.join(inside, ["Feature", "id"]).groupBy("Feature").agg(F.count(F.lit(1)).alias("n"), F.avg(digamma(F.col("k"))).alias("a"), F.avg(digamma(F.col("size"))).alias("b"), F.avg(digamma(F.greatest("m", F.lit(1)))).alias("c"))
    return sums.select("Feature", F.greatest(digamma(F.col("n")) + F.col("a") - F.col("b") - F.col("c"), F.lit(0.0)).alias("MI")).orderBy(F.desc("MI"), "Feature")
