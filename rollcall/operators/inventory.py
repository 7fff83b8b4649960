"""Q1 checks on an inventory: which row a MAC resolves to.

A check-in carries no cluster, so a MAC resolves to one inventory row over
all clusters: the first in (cluster, idx) order, as a linear scan over the
inventory would find it. Later rows with the same MAC are duplicates and can
never be reported.

Both steps are aggregate + join, not a window per MAC: a MAC repeated on a
third of the inventory is combined map-side. Where the result is joined with
a log, it is written first (``split_side``), because AQE splits a hot key only
when each side of the join is a plain shuffle, not an aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions.expressions import mac_key


def first_row_per_mac(fleet: DataFrame) -> DataFrame:
    """(mac_key, cluster, idx) of the row each MAC resolves to."""
    firsts = (fleet.where(F.col("mac").isNotNull())
              .groupBy(mac_key("mac").alias("mac_key"))
              .agg(F.min(F.struct("cluster", "idx")).alias("first")))
    return firsts.select("mac_key", F.col("first.cluster").alias("cluster"),
                         F.col("first.idx").alias("idx"))


def flag_duplicate_macs(fleet: DataFrame) -> DataFrame:
    """The inventory with ``mac_duplicate``: true for a row whose MAC an
    earlier row (in cluster, idx order) already has."""
    firsts = first_row_per_mac(fleet).withColumn("_first", F.lit(True))
    joined = fleet.join(firsts, on=["cluster", "idx"], how="left")
    dup = F.col("mac").isNotNull() & F.col("_first").isNull()
    return joined.withColumn("mac_duplicate", dup).drop("_first", "mac_key")
