"""Row numbers and neighbours within keys of which one may hold a third of all rows.

Rows are windowed by key and block of positions; only one row per block is windowed by key alone. The position is an
integer column; rows of one position stay together in a block, in the order of ``then``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def numbered(rows: DataFrame, key: str, position: str, then: list[str], name: str = "n", block: int = BLOCK) -> DataFrame:
    """The rows with their number from 1 within the key."""
    blocked = rows.withColumn("__block", F.floor(F.col(position) / block))
    before = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocked.groupBy(key, "__block").agg(F.count("*").alias("__size")).withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0))).drop("__size")
    sizes = sizes.withColumnsRenamed({key: "__key", "__block": "__of"})
    within = F.row_number().over(Window.partitionBy(key, "__block").orderBy(position, *then))
    joined = blocked.withColumn(name, within).join(sizes, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__block") == F.col("__of")))
    return joined.withColumn(name, F.col(name) + F.col("__before")).drop("__block", "__before", "__key", "__of")


def with_previous(rows: DataFrame, key: str, position: str, then: list[str], values: list[str], block: int = BLOCK) -> DataFrame:
    """The rows with ``previous``, a struct of the values of the row before within the key, null for the first."""
    blocked = rows.withColumn("__block", F.floor(F.col(position) / block)).withColumn("__v", F.struct(*values))
    order = Window.partitionBy(key, "__block").orderBy(position, *then)
    lasts = blocked.groupBy(key, "__block").agg(F.max_by("__v", F.struct(position, *then)).alias("__last"))
    by_block = Window.partitionBy(key).orderBy("__block")
    lasts = lasts.select(F.col(key).alias("__key"), F.col("__block").alias("__of"), F.lag("__last").over(by_block).alias("__last"))
    inside = blocked.withColumn("__n", F.row_number().over(order)).withColumn("previous", F.lag("__v").over(order))
    # only the first row of a block looks at the block before
    joined = inside.join(lasts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__block") == F.col("__of")), "left")
    return joined.withColumn("previous", F.when(F.col("__n") == 1, F.col("__last")).otherwise(F.col("previous"))).drop("__block", "__v", "__n", "__key", "__of", "__last")
