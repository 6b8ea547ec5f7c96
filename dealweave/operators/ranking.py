"""Places over all rows of a table, without bringing them into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealweave.session import written


def placed(df: DataFrame, order: Sequence[Column], rank: str | None = None, row: str | None = None, total: str | None = None) -> DataFrame:
    """df with the rank of each row (equal ones share the least), its number from 1 and the number of rows, as far as names are given.

    Rows are cut into ranges by the first key of order, so equal ones lie together; each range adds the number of rows before it. What the driver
    gets is one count for each range.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(n, order[0]).withColumn("_p", F.spark_partition_id()), "ranges")
    counts, before, sums = dict(ranged.groupBy("_p").count().collect()), 0, []
    for p in sorted(counts):
        sums += [F.lit(p), F.lit(before)]
        before += counts[p]
    offset = F.create_map(*sums)[F.col("_p")] if sums else F.lit(0)
    w = Window.partitionBy("_p").orderBy(*order)
    out = ranged
    if rank:
        out = out.withColumn(rank, F.rank().over(w) + offset)
    if row:
        out = out.withColumn(row, F.row_number().over(w) + offset)
    if total:
        out = out.withColumn(total, F.lit(before))
    return out.drop("_p")
