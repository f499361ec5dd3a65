"""Join operators that are not part of a builder: J7 (inventory vs installations
kept in two sources) and P25 (project from the distribution company)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X


def inventory_installations(inventory: DataFrame, installations: DataFrame, serial: str = "meterserialnumber",
                            date_col: str = "didate") -> DataFrame:
    """Inventory left-joined to installations on the serial, utilisation by
    normalised project and month.

    Both sides are reduced before the shuffle on the serial: installations to
    their distinct serials, inventory to (serial, project, month) counts. A
    serial shared by a large share of the rows is then a handful of rows in
    the join, and the inventory count restores the row-level totals."""
    inst = installations.select(F.col(serial).alias("_s")).distinct().withColumn("_hit", F.lit(True))
    inv = (inventory.groupBy(F.col(serial).alias("_s"), X.norm_upper("project").alias("project"),
                             F.trunc(F.col(date_col), "month").alias("period_start"))
           .agg(F.count(F.lit(1)).alias("_n")))
    j = inv.join(inst, "_s", "left")
    return (j.groupBy("project", "period_start")
            .agg(F.sum("_n").alias("total_inventory"),
                 F.coalesce(F.sum(F.when(F.col("_hit").isNotNull(), F.col("_n"))), F.lit(0)).cast("long")
                 .alias("total_installed")))


def project_from_discom(df: DataFrame, lookup: DataFrame, discom: str = "discom",
                        lookup_key: str = "discom", lookup_value: str = "project_label") -> DataFrame:
    """P25: label each row with the project of its distribution company.

    The lookup has one row per distribution company; it is broadcast:
    its size is bounded by the number of companies. Unknown companies get null."""
    lk = lookup.select(F.col(lookup_key).alias("_k"), F.col(lookup_value).alias(lookup_value)).dropDuplicates(["_k"])
    return df.join(F.broadcast(lk), df[discom] == F.col("_k"), "left").drop("_k")
