"""Aggregates, windows, rankings and set operations over documents and ledger rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.text import filled, text
from ..functions.values import parse_date, parse_money
from ..schema import GROUPS
from .lookups import small


SUMMARY_KEYS = ["platform", "grp", "vendor", "client", "method"]


def summary_columns(df: DataFrame, *more: str) -> DataFrame:
    """What a summary reads of the ledger: its keys, the day, the paid amount and whether there is a vendor."""
    return df.select(
        F.coalesce(filled("_platform"), F.lit("Unknown")).alias("platform"), F.coalesce(filled("U_group"), F.lit("Unknown")).alias("grp"), F.coalesce(filled("D_vendor_code"), F.lit("Unknown")).alias("vendor"),
        F.coalesce(filled("A_company_name"), F.lit("Unknown")).alias("client"), F.coalesce(filled("_extraction_method"), F.lit("Unknown")).alias("method"),
        parse_date("B_doc_date").alias("d"), parse_money("R_paid_amount").alias("paid"), (~text("D_vendor_code").isin("", "Unknown")).alias("v"), *more,
    )


def dimension_of(gid: str) -> Column:
    """The key that a grouping id over the summary's keys leaves, or all."""
    full = (1 << len(SUMMARY_KEYS)) - 1
    return F.coalesce(*(F.when(F.col(gid) == full - (1 << (len(SUMMARY_KEYS) - 1 - i)), k) for i, k in enumerate(SUMMARY_KEYS)), F.lit("all"))


def export_summary(df: DataFrame) -> DataFrame:
    """One pass over the ledger: (dimension, value, rows, with_vendor, first_date, last_date, paid) by platform, group, vendor,
    client, method and in all."""
    sets = summary_columns(df).groupingSets([[k] for k in SUMMARY_KEYS] + [[]], *SUMMARY_KEYS)
    out = sets.agg(F.grouping_id().alias("gid"), F.count("*").alias("rows"), F.count_if("v").alias("with_vendor"), F.min("d").alias("first_date"), F.max("d").alias("last_date"), F.coalesce(F.sum("paid"), F.lit(0)).cast("decimal(28,2)").alias("paid"))
    return out.select(dimension_of("gid").alias("dimension"), F.coalesce(*SUMMARY_KEYS, F.lit("")).alias("value"), "rows", "with_vendor", "first_date", "last_date", "paid")


def sample_warnings(df: DataFrame, per_row: int = 3, most: int = 10) -> DataFrame:
    """The most frequent warnings among the first few of each row (a report)."""
    first = df.select(F.explode(F.slice("_validation_warnings", 1, per_row)).alias("warning"))
    return first.groupBy("warning").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "warning").limit(most)


def job_summary(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Per job: files by state, rows, and the job's state."""
    counts = files.groupBy("job_id").agg(F.count("*").alias("files"), *(F.count_if(F.col("state") == s).alias(f"{s}_files") for s in ("done", "needs_review", "error", "processing", "queued")))
    made = rows.groupBy("job_id").agg(F.count("*").alias("total_rows"))
    state = F.when(F.col("processing_files") + F.col("queued_files") > 0, "processing").when(F.col("error_files") > 0, "error").otherwise("done")
    return counts.join(made, "job_id", "left").withColumns({"total_rows": F.coalesce("total_rows", F.lit(0)), "state": state})


def platform_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce(filled("_platform"), filled("U_group"), F.lit("UNKNOWN")).alias("platform"), F.coalesce(filled("_extraction_method"), F.lit("unknown")).alias("method")).agg(F.count("*").alias("rows"))


def platform_group_rollup(rows: DataFrame) -> DataFrame:
    """Counts by expense group and platform, with totals of groups and of all (null keys)."""
    groups = F.create_map(*(F.lit(x) for kv in GROUPS.items() for x in kv))
    named = rows.select(F.coalesce(F.try_element_at(groups, text("_platform")), F.lit("Other Expense")).alias("grp"), F.coalesce(filled("_platform"), F.lit("UNKNOWN")).alias("platform"))
    return named.rollup("grp", "platform").agg(F.count("*").alias("rows"))


def processing_stats(docs: DataFrame) -> DataFrame:
    return docs.groupBy("method", "platform").agg(F.count("*").alias("calls"), F.round(F.avg("seconds"), 6).alias("avg_seconds"))


def intake_report(files: DataFrame) -> DataFrame:
    """added, skipped, megabytes, and the reasons with their numbers."""
    by_reason = files.groupBy(F.coalesce("reject_reason", F.lit("")).alias("reason")).agg(F.count("*").alias("files"), F.sum("n_bytes").alias("bytes"))
    return by_reason.select(F.when(F.col("reason") == "", "added").otherwise("skipped").alias("outcome"), "reason", "files", F.round(F.col("bytes") / 1e6, 3).alias("megabytes"))


def progress(summary: DataFrame) -> DataFrame:
    done = F.col("done_files") + F.col("needs_review_files") + F.col("error_files")
    return summary.select("job_id", F.greatest(F.lit(0), F.least(F.lit(100), F.round(done * 100 / F.greatest("files", F.lit(1))).cast("int"))).alias("percent"), F.col("processing_files").alias("in_work"), F.col("done_files").alias("ok"), F.col("needs_review_files").alias("review"))


SPAN = 65_536


def running_count(df: DataFrame, counted: Column, job: str, order: tuple[str, ...], out: str) -> DataFrame:
    """How many rows of the job up to this one, in order, satisfy ``counted``. Where the first order column is a number, rows are counted
    by spans of 65,536 of its values and then inside each span, so that a large job is many tasks; the spans' counts are summed in a
    small table. The rows are read twice."""
    upto = lambda *keys: F.count_if(counted).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    if not isinstance(df.schema[order[0]].dataType, NumericType):
        return df.withColumn(out, upto(job))
    span = F.coalesce(F.floor(F.col(order[0]) / SPAN), F.lit(-(1 << 62))).cast("long")
    counts = df.groupBy(F.col(job).alias("__job"), span.alias("__at")).agg(F.count_if(counted).alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy("__job").orderBy("__at")) - F.col("__n")).drop("__n")
    spanned = df.withColumn("__span", span)
    joined = spanned.join(small(before), spanned[job].eqNullSafe(before["__job"]) & (F.col("__span") == F.col("__at")))
    return joined.withColumn(out, upto(job, "__span") + F.col("__before")).drop("__job", "__at", "__before", "__span")


def sequence(df: DataFrame, job: str = "job_id", order: tuple[str, ...] = ("file_index", "doc_id")) -> DataFrame:
    """A_seq: 1 to n in file order inside each job."""
    return running_count(df, F.lit(True), job, order, "__nth").withColumn("A_seq", F.col("__nth").cast("string")).drop("__nth")


def top_n_per(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def latest(df: DataFrame, keys: list[str], when: str, tie: str) -> DataFrame:
    """The newest row of each key."""
    return top_n_per(df, keys, [F.desc(when), F.desc(tie)], 1, "__rank").drop("__rank")


def history(jobs: DataFrame, limit: int = 50, when: str = "saved_at", tie: str = "job_id") -> DataFrame:
    return jobs.orderBy(F.desc(when), F.desc(tie)).limit(limit)


def longest_first(keys: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """Keys with their place when longer ones go first, in table order among equals (one row per key of a code table)."""
    return keys.withColumn("place", F.row_number().over(Window.orderBy(F.length(key).desc(), order)))


def majority(df: DataFrame, keys: list[str], value: str, unknown: str = "UNKNOWN") -> DataFrame:
    """The most frequent value of each key: known ones first, then the count, then the name."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct((F.col(value) == unknown).alias("u"), -F.col("n"), F.col(value))).alias(value), F.max("n").alias("most"))


def union_routes(*parts: DataFrame) -> DataFrame:
    """Rows of all routes in one shape."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
