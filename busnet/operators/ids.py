"""Gapless surrogate ids by range partition and prefix counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from busnet.session import keep


def numbered(df: DataFrame, key: list[str], name: str = "id") -> DataFrame:
    """df with name = 1, 2, ... in the order of key, which must tell rows apart.

    Rows are dealt by ranges of the key, so nothing is sorted in one task; only the row counts of the ranges, one
    row per partition, are summed up in order.  Equal tables get equal ids.
    """
    in_order = df.repartitionByRange(*key).sortWithinPartitions(*key)
    place = F.monotonically_increasing_id()
    table = keep(
        in_order.withColumn("_part", F.shiftright(place, 33)).withColumn("_at", place.bitwiseAND(F.lit((1 << 33) - 1))), f"numbered-{name}"
    )
    sizes = table.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return table.join(starts, "_part").withColumn(name, F.col("_start") + F.col("_at") + 1).drop("_part", "_at", "_start")
