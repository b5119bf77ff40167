"""Gapless numbers within groups of any size, without one task holding a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Sub-groups of a group at most, whose counts one task adds up.
SUBS = 1 << 17


def numbered(df: DataFrame, group: str, order: list[str], rows: int, out: str, each: int = 20_000) -> DataFrame:
    """Numbers 0, 1, ... within each ``group`` as ``out``, using built-in functions only.

    A group is dealt over sub-groups by a hash of ``order``, so many that the whole table has
    about ``each`` rows in one (SUBS sub-groups at most, which then have more and are sorted on
    disk): a group with a third of all rows is spread like any other.
    Where a sub-group starts follows from the counts of those before it, of which there is one
    row each. Rows equal in ``order`` get different numbers, in either order.
    """
    parts = max(16, min(SUBS, -(-rows // each)))
    sub = F.pmod(F.xxhash64(*order), F.lit(parts))
    df = df.withColumn("_sub", sub)
    counts = df.groupBy(group, "_sub").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_g"), F.col("_sub").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(group, "_sub").orderBy(*order)
    ranked = df.withColumn("_at", F.row_number().over(own) - 1)
    joined = ranked.join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_sub") == F.col("_s")), "left")
    return joined.withColumn(out, (F.col("_start") + F.col("_at")).cast("long")).drop("_sub", "_at", "_g", "_s", "_start")
