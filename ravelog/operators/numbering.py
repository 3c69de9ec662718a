"""Row numbers within a group of any size, without a task that holds the group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``name``: 1.. in ``order`` within ``keys``, null keys being one group.

    Rows are dealt by ranges of keys and order and written, numbered within their range,
    and moved by how many rows of their group lie in earlier ranges. What is gathered for
    a group is one row for each range that it reaches into.
    """
    dealt = cut(rows.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    inside = dealt.withColumn("__n", F.row_number().over(Window.partitionBy("__part", *keys).orderBy(*order)))
    sizes = dealt.groupBy("__part", *keys).agg(F.count("*").alias("__size"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("__part").alias("__p"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__start"))
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return inside.join(starts, same).withColumn(name, (F.col("__start") + F.col("__n")).cast("long")).drop("__part", "__n", "__p", "__start", *(f"__k{i}" for i in range(len(keys))))
