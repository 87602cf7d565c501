"""The export summary kept by signed deltas.

Every batch of inserted and deleted rows (a revised row is both) is reduced to signed counts by dimension, value and day, and committed
once under its name. Dates cannot be taken back from a minimum, so days are counted: reading sums the counts and takes the first and
last day that still has rows. The work of a batch grows with the batch, that of reading with the days and values, not with the rows.

Defined results: as ``summaries.export_summary`` over the rows that are left; values without rows vanish, so nothing is left of an empty
ledger; rows without a readable date count, on no day; a batch sent twice counts once, batches may come in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.summaries import SUMMARY_KEYS, dimension_of, summary_columns
from .batches import BatchTable

DELTAS = "dimension string, value string, day date, rows long, with_vendor long, paid decimal(38,2)"


def signed_counts(changes: DataFrame) -> DataFrame:
    """Ledger rows with __sign (1 or -1) as summed counts by dimension, value and day."""
    sets = summary_columns(changes, "__sign").groupingSets([[k, "d"] for k in SUMMARY_KEYS] + [["d"]], *SUMMARY_KEYS, "d")
    gid = F.shiftright(F.grouping_id(), 1)  # the day is in every set
    sums = [F.sum("__sign").alias("rows"), F.sum(F.when(F.col("v"), F.col("__sign")).otherwise(0)).alias("with_vendor"), F.coalesce(F.sum(F.col("paid") * F.col("__sign")), F.lit(0)).cast("decimal(38,2)").alias("paid")]
    out = sets.agg(gid.alias("gid"), *sums)
    return out.select(dimension_of("gid").alias("dimension"), F.coalesce(*SUMMARY_KEYS, F.lit("")).alias("value"), F.col("d").alias("day"), "rows", "with_vendor", "paid")


class SummaryRollup:
    def __init__(self, spark: SparkSession, path: str):
        self.table = BatchTable(spark, path, DELTAS)

    def change(self, batch: str, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> bool:
        """Commit what a batch adds and takes away; False if it was sent before."""
        parts = [rows.withColumn("__sign", F.lit(sign)) for rows, sign in ((inserted, 1), (deleted, -1)) if rows is not None]
        if not parts:
            raise ValueError("a batch inserts or deletes rows")
        changes = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
        return self.table.commit(signed_counts(changes).where("rows <> 0 OR with_vendor <> 0 OR paid <> 0"), batch)

    def read(self) -> DataFrame:
        """The columns of ``export_summary``."""
        days = self.table.read().groupBy("dimension", "value", "day").agg(F.sum("rows").alias("rows"), F.sum("with_vendor").alias("with_vendor"), F.sum("paid").alias("paid"))
        held = F.when(F.col("rows") > 0, F.col("day"))
        folded = days.groupBy("dimension", "value").agg(
            F.sum("rows").alias("rows"), F.sum("with_vendor").alias("with_vendor"), F.min(held).alias("first_date"), F.max(held).alias("last_date"), F.sum("paid").cast("decimal(28,2)").alias("paid")
        )
        return folded.where("rows > 0")
