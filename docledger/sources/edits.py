"""A ledger with saved edits, merged on reading.

Edits (key, column, value, saved_at) arrive as committed batches beside the rows, in any order. Reading lays over each cell the edit of
the latest (saved_at, value). ``compact`` writes the rows with the edits of the batches it knows folded in as a new generation; a cell keeps
the time of its edit, so one that arrives afterwards and was saved earlier still loses. A generation counts from its manifest on, which is
written last; a compaction that broke off is done again over the same batches.

Defined results: edits without a key or value, of locked columns, of the key, of columns that begin with _ or are not there change nothing;
one without a time loses to any other; ties of the time go to the greatest value; rows that repeat a key are all edited; rows without a
key stay as they are; a batch of edits sent twice counts once; a ledger that was never created has no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookups import small
from .batches import BatchTable

AT = "__at map<string, struct<saved_at: timestamp, value: string>>"


class EditedLedger:
    """See the module. schema: DDL of the rows, text columns beside the key; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "doc_id", locked: tuple[str, ...] = ("A_seq",)):
        fields = spark.createDataFrame([], schema).schema
        self.spark, self.key, self.columns = spark, key, fields.names
        self.cells = [c for c in fields.names if c != key and c not in locked and not c.startswith("_")]
        self.base = BatchTable(spark, f"{path}/rows", f"{schema}, {AT}")
        self.edits = BatchTable(spark, f"{path}/edits", f"{key} {fields[key].dataType.simpleString()}, column string, value string, saved_at timestamp")
        self.folded = BatchTable(spark, f"{path}/folded", "edits string")

    def generation(self) -> int:
        """The number of the newest generation; -1 before ``create``."""
        newest = self.base.manifests().agg(F.max("batch")).first()[0]
        return int(newest[1:]) if newest else -1

    def name(self, generation: int) -> str:
        return f"g{generation:09d}"

    def create(self, rows: DataFrame) -> bool:
        """The first generation; False if there is one."""
        return self.base.commit(rows.select(*self.columns).withColumn("__at", F.lit(None).cast(AT.split(" ", 1)[1])), self.name(0))

    def save(self, edits: DataFrame, batch: str) -> bool:
        """Commit a batch of edits; False if it was sent before."""
        return self.edits.commit(edits.select(self.key, "column", "value", "saved_at"), batch)

    def pending(self, generation: int) -> DataFrame:
        """The edits that no generation up to this one holds."""
        done = self.folded.read().where(F.col("batch") <= self.name(generation)).select(F.col("edits").alias("batch")).distinct()
        return self.edits.read().join(small(done), "batch", "left_anti")

    def resolved(self, generation: int, edits: DataFrame) -> DataFrame:
        """The generation's rows under the edits, with the times of the edited cells in __at."""
        rows = self.base.read().where(F.col("batch") == self.name(generation)).drop("batch")
        usable = edits.where(F.col("column").isin(self.cells) & F.col("value").isNotNull() & F.col(self.key).isNotNull())
        latest = usable.groupBy(self.key, "column").agg(F.max(F.struct("saved_at", "value")).alias("edit"))  # tasks take their maximum first
        maps = latest.groupBy(self.key).agg(F.map_from_entries(F.collect_list(F.struct("column", "edit"))).alias("__new"))  # one entry a column
        joined = rows.hint("merge").join(maps.hint("merge"), self.key, "left")
        held = F.coalesce("__at", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<saved_at:timestamp,value:string>>")))
        newer = F.map_filter("__new", lambda c, e: F.coalesce(e > F.try_element_at("__at", c), F.lit(True)))
        kept = joined.withColumn("__newer", newer)
        merged = F.when(F.col("__newer").isNull(), F.col("__at")).otherwise(F.map_concat(F.map_filter(held, lambda c, _: ~F.map_contains_key("__newer", c)), "__newer"))
        cells = [F.coalesce(F.try_element_at("__newer", F.lit(c))["value"], F.col(c)).alias(c) if c in self.cells else F.col(c) for c in self.columns]
        return kept.select(*cells, merged.alias("__at"))

    def read(self) -> DataFrame:
        """The rows with all committed edits."""
        now = self.generation()
        if now < 0:
            return self.base.read().select(*self.columns)
        return self.resolved(now, self.pending(now)).select(*self.columns)

    def compact(self) -> int:
        """Fold the committed edits into a new generation; its number. The older one stays for those who read it."""
        now = self.generation()
        if now < 0:
            raise ValueError("create the ledger first")
        to = self.name(now + 1)
        self.folded.commit(self.pending(now).select(F.col("batch").alias("edits")).distinct(), to)
        mine = self.folded.read().where(F.col("batch") == to).select(F.col("edits").alias("batch")).distinct()
        self.base.commit(self.resolved(now, self.edits.read().join(small(mine), "batch", "left_semi")), to)
        return now + 1
