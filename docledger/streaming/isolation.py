"""Ingestion that keeps going past broken documents.

Every micro-batch is committed once, under its number, to two tables: ledger rows and dead letters (the document with its reason). A document
that comes again within the watermark is left out, whether in the same micro-batch or a later one; one that had no text does not stand in
the way of its mended copy. A batch is written as it is tried. Where its extraction fails, it is cut in four by a hash of the document and each part is
tried, until the documents that fail are alone: those are dead letters too, with the error's name, and the rows of all parts that did not
fail are kept and land in one commit. A broken document costs four tries for each two binary digits of the number of documents, those of a
level over a quarter as many as the ones before; a fault that is not a document's own does not return on the parts, and no document is put
aside for it.

Defined results: documents without an id are dead letters (``no_id``), those with null or blank text too (``no_text``); equal ids that arrive
later than the watermark's delay are taken again; a null time counts as the time of arrival. A stream that is restarted sends its last
micro-batch again, which is then in the tables already.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.text import text
from ..sources.batches import BatchTable
from ..sources.shared import staged, work_folder

DEAD = "doc_id long, filename string, text string, received_at timestamp, reason string"
DEPTH = 40
#: A part that fails is cut in as many, told by so many bits of the hash.
STEP = 2
FAN = 1 << STEP


def once_each(docs: DataFrame, at: str, late: str) -> DataFrame:
    """Documents with their reason, without those that came before within the delay."""
    reason = F.when(F.col("doc_id").isNull(), "no_id").when(F.trim(text("text")) == "", "no_text")
    named = docs.withColumns({"received_at": F.coalesce(F.col(at).cast("timestamp"), F.current_timestamp()), "reason": reason})
    content = F.when(F.col("doc_id").isNull(), F.sha2(F.concat_ws("\n", text("filename"), text("text")), 256))
    keyed = named.withColumns({"__content": F.coalesce(content, F.lit("")), "__broken": F.coalesce("reason", F.lit(""))}).withWatermark("received_at", late)
    return keyed.dropDuplicatesWithinWatermark(["doc_id", "__content", "__broken"]).drop("__content", "__broken")


def isolated(docs: DataFrame, rows_of: Callable[[DataFrame], DataFrame]) -> tuple[list[str], list[tuple[int, int, str]]]:
    """Documents that fail together taken apart: the folders of the rows of those parts that do not, and (bits, which, error) of the parts
    by hash that hold a document that fails and, but for its own copies, no other."""
    good, bad = [], []

    def seek(within: DataFrame, bits: int, which: int) -> None:
        """Each part is written where it alone is read, so a level reads and tries its documents once."""
        to = work_folder(within.sparkSession)
        within.withColumn("part__", F.shiftright("__part", bits).bitwiseAND(F.lit(FAN - 1))).write.partitionBy("part__").parquet(f"{to}/docs")
        parts = sorted(int(r["part__"]) for r in within.sparkSession.read.parquet(f"{to}/docs").select("part__").distinct().collect())
        for n in parts:
            mine = within.sparkSession.read.schema(within.schema).parquet(f"{to}/docs/part__={n}")
            own = which | n << bits
            try:
                rows_of(mine.drop("__part", "reason")).write.parquet(f"{to}/rows/{n}")
                good.append(f"{to}/rows/{n}")
            except PySparkException as broken:
                if bits + STEP >= DEPTH or mine.select("__part").distinct().limit(2).count() < 2:
                    bad.append((bits + STEP, own, broken.getCondition() or type(broken).__name__))
                else:
                    seek(mine, bits + STEP, own)

    seek(docs, 0, 0)
    return good, bad


def land(docs: DataFrame, number: str, rows_of: Callable[[DataFrame], DataFrame], rows: BatchTable, dead: BatchTable) -> None:
    """Commit one micro-batch to both tables, its rows last."""
    if rows.committed(number):
        return
    part = F.xxhash64("doc_id", "filename", "text").bitwiseAND(F.lit((1 << DEPTH) - 1))
    kept = staged(docs.withColumn("__part", part))
    fine, reason = kept.where(F.col("reason").isNull()), F.col("reason")
    try:
        rows.write(rows_of(fine.drop("__part", "reason")), number)
    except PySparkException:
        good, bad = isolated(fine, rows_of)
        rows.write(docs.sparkSession.read.schema(rows.schema).parquet(*good) if good else docs.sparkSession.createDataFrame([], rows.schema), number)
        reason = F.coalesce("reason", *(F.when(F.col("__part") % (1 << bits) == which, f"failed: {error}") for bits, which, error in bad))
    told = kept.withColumn("reason", reason).where(F.col("reason").isNotNull())
    dead.commit(told.select("doc_id", "filename", "text", "received_at", "reason"), number)
    rows.seal(number)


def ingest_isolated(docs: DataFrame, rows_of: Callable[[DataFrame], DataFrame], rows: BatchTable, dead: BatchTable, checkpoint: str, at: str = "received_at", late: str = "7 days", stream: str = "ingest") -> StreamingQuery:
    """docs: a stream with doc_id, filename, text and the time ``at``; rows_of: documents to ledger rows of the table's columns."""
    write = lambda batch, number: land(batch, f"{stream}-{number:012d}", rows_of, rows, dead)
    return once_each(docs, at, late).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
