"""Places in an order over any number of rows, without a window over all of them."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierweave.plans.graph import committed


def ranked(rows: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """``rows`` with their places 0, 1, 2... in ``order``.

    A range-partitioned sort is written out with each row's place in its part; the sizes of the parts (a row a part)
    are added up on the driver. Rows equal in ``order`` take their places in any order of their own.
    """
    own = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    own = committed(own, "ranked").withColumn("_part", F.shiftright("_at", 33))
    sizes = sorted(own.groupBy("_part").count().collect())
    starts = zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0), strict=False)
    before = rows.sparkSession.createDataFrame(list(starts), "_part long, _before long")
    return own.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before")


def ranked_within(rows: DataFrame, key: str, order: list[Column | str], name: str = "rank") -> DataFrame:
    """Places within each of a few values of ``key`` (a row each is broadcast)."""
    own = committed(ranked(rows, [key, *order], "_rank"), "ranked-within")
    first = own.groupBy(key).agg(F.min("_rank").alias("_first"), F.count("*").alias("_size"))
    return own.join(F.broadcast(first), key).withColumn(name, F.col("_rank") - F.col("_first")).withColumnRenamed("_size", f"{name}_of").drop("_rank", "_first")
