"""A job table of committed batches in shared storage.

A batch is a folder of Parquet under ``rows``; its manifest row, which tells its number of rows, is written last. Readers take the rows
of batches that have a manifest, so a batch that broke off half-way is not seen, and sending it again writes its folder anew. A batch
that has its manifest is left as it is, so one sent twice counts once. One writer at a time is assumed; readers may read meanwhile.

Defined results: a table that has no manifest has no rows; an empty batch commits and adds none; rows are kept as they are sent, repeated
ones too; a column named batch is replaced by the batch's name.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "batch string, rows long"


class BatchTable:
    """See the module. schema: DDL of the rows."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def folder(self, batch: str) -> str:
        return f"{self.path}/rows/batch={batch}"

    def manifests(self) -> DataFrame:
        """(batch, rows) of the committed batches."""
        try:
            return self.spark.read.schema(MANIFEST).option("recursiveFileLookup", True).parquet(f"{self.path}/manifests")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def committed(self, batch: str) -> bool:
        return not self.manifests().where(F.col("batch") == batch).isEmpty()

    def commit(self, rows: DataFrame, batch: str) -> bool:
        """Write a batch, its manifest last; False if it is there already."""
        if self.committed(batch):
            return False
        self.write(rows, batch)
        self.seal(batch)
        return True

    def write(self, rows: DataFrame, batch: str) -> None:
        """The rows of a batch without its manifest, so no reader sees them yet."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch's name has letters, digits, - and _ only")
        rows.drop("batch").write.mode("overwrite").parquet(self.folder(batch))

    def seal(self, batch: str) -> None:
        """The manifest of a batch that is written."""
        n = self.spark.read.schema(self.schema).parquet(self.folder(batch)).count()
        self.spark.range(1).select(F.lit(batch).alias("batch"), F.lit(n).cast("long").alias("rows")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/{batch}")

    def read(self) -> DataFrame:
        """The rows of committed batches, with their batch. The batches' names select the folders, so others are not read."""
        known = self.manifests()
        if known.isEmpty():
            return self.spark.createDataFrame([], f"{self.schema}, batch string")
        every = self.spark.read.schema(f"{self.schema}, batch string").option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows")
        names = known.select("batch").distinct()
        return every.join(F.broadcast(names) if names.limit(100_001).count() <= 100_000 else names.hint("merge"), "batch", "left_semi")
