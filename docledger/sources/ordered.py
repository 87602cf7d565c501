"""Export files in order: every job's rows by number, one heading with the byte order mark for a job, and a manifest of the parts.

Rows are dealt by ranges of (job, order), so a large job is several parts and a task holds a range only. A job's heading is a row that
sorts before the others. Parts are named in the order of the ranges; the manifest (job, part, path, bytes) is written last, and a folder
without one is not a finished export. Put together in the order of ``part``, a job's parts are its file.

Defined results: a row without a job is in the job ''; rows that tie stand in any order next to each other; null order values come first;
an empty ledger writes an empty manifest; a former export in the folder is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import TEMPLATE
from .sinks import AS_IS, csv_rows

MANIFEST = "job string, part int, path string, bytes long"
FILES = "path string, modificationTime timestamp, length long, content binary, job string"


def write_ordered_csv(df: DataFrame, path: str, order: tuple[str, ...], job: str = "job_id", review: bool = False, headings: tuple[str, ...] = TEMPLATE, rows_per_part: int = 1_000_000) -> DataFrame:
    """Write the import file (or the review file) of every job; the manifest."""
    spark = df.sparkSession
    own = F.coalesce(F.col(job).cast("string"), F.lit(""))
    keys = [f"__k{i}" for i in range(len(order))]
    kept = df.withColumns({"__job": own, "__body": F.lit(1), **{k: F.col(c) for k, c in zip(keys, order, strict=True)}})
    shown = csv_rows(kept, review, headings)
    names = shown.columns
    cells = [f"c{i}" for i in range(len(names))]
    lines = csv_rows(kept, review, headings, keep=("__job", "__body", *keys)).toDF(*cells, "__job", "__body", *keys)
    jobs = df.select(own.alias("__job")).distinct()
    nothing = [F.lit(None).cast(lines.schema[k].dataType).alias(k) for k in keys]
    heads = jobs.select(*(F.lit(n).alias(c) for n, c in zip(names, cells, strict=True)), "__job", F.lit(0).alias("__body"), *nothing)
    every = lines.unionByName(heads)
    by = [F.col("__job"), F.col("__body"), *(F.col(k).asc_nulls_first() for k in keys)]
    ordered = every.repartitionByRange(*by).sortWithinPartitions(*by).select(*cells, F.coalesce("__job", F.lit("")).alias("job"))
    end = "\r\n" if review else "\n"
    folder = path.rstrip("/")
    writer = ordered.write.mode("overwrite").partitionBy("job").option("header", False).option("emptyValue", "").option("escape", '"').option("lineSep", end)
    writer.option("maxRecordsPerFile", rows_per_part).options(**AS_IS).csv(f"{folder}/parts")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*")
    if found.option("recursiveFileLookup", True).load(f"{folder}/parts").select("path").isEmpty():
        parts = spark.createDataFrame([], MANIFEST)  # there is no folder of a job to read
    else:
        files = found.option("recursiveFileLookup", False).schema(FILES).load(f"{folder}/parts").select(F.coalesce("job", F.lit("")).alias("job"), "path", F.col("length").alias("bytes"))
        of_job = Window.partitionBy("job").orderBy("path")  # over files, each of up to a million rows
        parts = files.select("job", (F.row_number().over(of_job) - 1).cast("int").alias("part"), "path", "bytes")
    parts.write.mode("overwrite").parquet(f"{folder}/manifest")
    return ordered_parts(spark, folder)


def ordered_parts(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of a finished export."""
    return spark.read.schema(MANIFEST).parquet(f"{path.rstrip('/')}/manifest")
