"""Queries of what is kept and maintained: rule tables, edits, rollups, ordered files, isolated ingestion and expiry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import fixtures as fx
from .queries import ORACLE, ROWS, query
from .schema import LEDGER
from .sources.shared import work_folder

DOCS = f"({fx.duck(fx.RECEIPTS)})"

# Rules by hand, and one for every customer's user name; every fifth of those asks for the whole name by a pattern.
HAND = (
    ("meta", "META", 165, "text", "ireland", "meta\\s*platforms?\\s*ireland"), ("google", "GOOGLE", 165, "text", "google", "google\\s*asia\\s*pacific"), ("shop", "SHOPEE", 22, "text", "shopee", None),
    ("shop", "SHOPEE", 22, "text", "seller id", None), ("file", "FILE", 40, "name", "file", None), ("file", "FILE", 40, "name", "scan", None), ("sevens", "FILE", 3, "file", "77", "7{2,}\\.pdf"),
)


@query(f"""
WITH d AS (SELECT doc_id, lower(text) AS t, filename AS f FROM {DOCS}),
u AS (SELECT doc_id, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS p, c_custkey % 7 + 1 AS w FROM d JOIN customer ON contains(t, 'user_' || c_custkey) AND (c_custkey % 5 <> 0 OR regexp_matches(t, 'user_' || c_custkey || '\\b')))
SELECT doc_id, coalesce(e.even, 0) AS even, coalesce(e.odd, 0) AS odd, CASE WHEN regexp_matches(t, 'meta\\s*platforms?\\s*ireland') THEN 165 ELSE 0 END AS meta, CASE WHEN regexp_matches(t, 'google\\s*asia\\s*pacific') THEN 165 ELSE 0 END AS google,
  CASE WHEN contains(t, 'shopee') OR contains(t, 'seller id') THEN 22 ELSE 0 END AS shopee, 40 + CASE WHEN regexp_matches(f, '77\\.pdf') THEN 3 ELSE 0 END AS file
FROM d LEFT JOIN (SELECT doc_id, CAST(sum(w) FILTER (p = 'even') AS BIGINT) AS even, CAST(sum(w) FILTER (p = 'odd') AS BIGINT) AS odd FROM u GROUP BY doc_id) e USING (doc_id)""")
def c_rules(spark, d):
    """Scores by a table of rules: one for each customer beside those by hand."""
    from .operators.rules import RULE, rule_scores

    key = F.col("c_custkey")
    name = F.concat(F.lit("user_"), key.cast("string"))
    pattern = F.when(key % 5 == 0, F.concat(name, F.lit("\\b")))
    users = spark.read.parquet(f"{d}/customer.parquet").select(name.alias("rule"), F.when(key % 2 == 0, "even").otherwise("odd").alias("platform"), (key % 7 + 1).cast("int").alias("weight"), F.lit("text").alias("place"), name.alias("term"), pattern.alias("pattern"))
    scored = rule_scores(fx.load(spark, d, fx.RECEIPTS).select("doc_id", "text", "filename"), users.union(spark.createDataFrame(HAND, RULE)), "text", "filename")
    return scored.select("doc_id", *(F.coalesce(F.try_element_at("scores", F.lit(p)), F.lit(0).cast("long")).alias(p.lower()) for p in ("even", "odd", "META", "GOOGLE", "SHOPEE", "FILE")))


@query(ORACLE["j_edits"])
def j_edit_store(spark, d):
    """The edits in three batches out of order, one sent twice, with a compaction before the late ones and another before the last is read."""
    from .sources.edits import EditedLedger

    shown = ("doc_id", "L_description", "T_note", "K_account")
    ledger = EditedLedger(spark, work_folder(spark), "doc_id long, A_seq string, L_description string, T_note string, K_account string")
    ledger.create(fx.load(spark, d, fx.LEDGER).select("doc_id", F.lit("1").alias("A_seq"), *shown[1:]))
    edits = fx.load(spark, d, fx.EDITS)
    for third in (2, 0, 2, 1):
        ledger.save(edits.where(F.col("event_id") % 3 == third), f"edits-{third}")
        if third == 0:
            ledger.compact()
    return ledger.read().select(*shown)


@query(ORACLE["a_export_summary"])
def a_rollup_store(spark, d):
    """The summary kept by deltas: rows inserted wrong, revised, sent twice, and others inserted and deleted."""
    from .sources.rollups import SummaryRollup

    rows = fx.load(spark, d, fx.LEDGER)
    rollup = SummaryRollup(spark, work_folder(spark))
    even, odd = rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1")
    wrong = even.withColumns({"B_doc_date": F.lit("19990101"), "R_paid_amount": F.lit("1.00"), "D_vendor_code": F.lit("")})
    rollup.change("wrong", inserted=wrong)
    rollup.change("revised", inserted=even, deleted=wrong)
    rollup.change("wrong", inserted=wrong)
    extra = odd.withColumn("B_doc_date", F.lit("29991231"))
    rollup.change("gone", deleted=extra)  # taken away before it comes
    rollup.change("odd", inserted=odd.unionByName(extra))
    return rollup.read().withColumns({"paid": F.col("paid").cast("string"), "first_date": F.date_format("first_date", "yyyyMMdd"), "last_date": F.date_format("last_date", "yyyyMMdd")})


@query(f"SELECT job_id AS job, 1 AS headings, TRUE AS heading_first, count(*) AS rows, 0 AS out_of_order, sum(file_index) AS total FROM {ROWS} GROUP BY job_id")
def snk_ordered(spark, d):
    """The import files of all jobs read back line by line in the manifest's order."""
    from .sources.ordered import write_ordered_csv

    rows = fx.load(spark, d, fx.LEDGER).withColumn("A_seq", F.col("file_index").cast("string"))
    parts = write_ordered_csv(rows, work_folder(spark), ("file_index",), rows_per_part=20_000)
    to = parts.select("path").first()[0].rsplit("/parts/", 1)[0]
    schema = ", ".join(f"{c} string" for c in LEDGER) + ", job string"
    lines = spark.read.schema(schema).option("basePath", f"{to}/parts").option("escape", '"').option("pathGlobFilter", "part-*").csv(f"{to}/parts")
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    placed = lines.select("job", F.col("_metadata.file_name").alias("file"), place.alias("place"), F.col("A_seq").try_cast("long").alias("n"))
    before = F.lag("n").over(Window.partitionBy("job", "file").orderBy("place"))
    seen = placed.withColumn("wrong", F.coalesce(before > F.col("n"), F.lit(False)).cast("int"))
    of_file = seen.groupBy("job", "file").agg(F.count_if(F.col("n").isNull()).alias("headings"), F.min_by(F.col("n").isNull(), "place").alias("begins"), F.count("n").alias("rows"), F.sum("wrong").alias("wrong"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("total"))
    known = parts.select("job", F.element_at(F.split("path", "/"), -1).alias("file"), "part")
    told = of_file.hint("merge").join(known.hint("merge"), ["job", "file"])
    step = (F.coalesce(F.lag("most").over(Window.partitionBy("job").orderBy("part")) > F.col("least"), F.lit(False))).cast("int")
    each = told.withColumn("step", step)
    return each.groupBy("job").agg(
        F.sum("headings").cast("int").alias("headings"), F.min_by("begins", "part").alias("heading_first"), F.sum("rows").alias("rows"), F.sum(F.col("wrong") + F.col("step")).cast("int").alias("out_of_order"), F.sum("total").alias("total")
    )


@query(f"""
SELECT CASE WHEN k % 10 = 3 THEN -k ELSE doc_id END AS doc_id, CASE k % 10 WHEN 3 THEN 'no_id' WHEN 5 THEN 'no_text' ELSE 'failed: USER_RAISED_EXCEPTION' END AS outcome, 1 AS n FROM {DOCS} WHERE k % 10 IN (3, 5) OR k IN (8, 1032)
UNION ALL SELECT doc_id, platform, 1 FROM {DOCS} WHERE k % 10 <> 3 AND k NOT IN (8, 1032)""")
def st_isolated(spark, d):
    """Documents in two micro-batches: some without an id or text, some that break the extraction, most sent again in the second. A document
    that came without its text comes again with it."""
    from .functions.classify import with_platform
    from .sources.batches import BatchTable
    from .streaming.isolation import DEAD, ingest_isolated

    to = work_folder(spark)
    k = F.col("k")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + k % 1000)
    body = F.when(k.isin(8, 1032), F.concat(F.lit("BROKEN "), "text")).otherwise(F.col("text"))
    docs = fx.load(spark, d, fx.RECEIPTS).select(F.when(k % 10 != 3, F.col("doc_id")).alias("doc_id"), F.concat(k.cast("string"), F.lit(".pdf")).alias("filename"), body.alias("text"), at.alias("received_at"))
    lost = docs.withColumn("text", F.when(F.expr("int(split_part(filename, '.', 1)) % 10 <> 5"), F.col("text")))

    def rows_of(batch):
        checked = batch.withColumn("text", F.when(F.col("text").startswith("BROKEN"), F.raise_error(F.lit("a broken document"))).otherwise(F.col("text")))
        return with_platform(checked, "text", "filename", (), "platform").select("doc_id", "platform")

    rows, dead = BatchTable(spark, f"{to}/rows", "doc_id long, platform string"), BatchTable(spark, f"{to}/dead", DEAD)
    for arrived in (lost, docs):  # the stream goes on from its checkpoint, with all files that came since as one micro-batch
        arrived.write.mode("append").parquet(f"{to}/in")
        ingest_isolated(spark.readStream.schema(docs.schema).parquet(f"{to}/in"), rows_of, rows, dead, f"{to}/state", late="1 day").awaitTermination()
    number = -F.expr("bigint(split_part(filename, '.', 1))")  # letters without an id are told by their file
    letters = dead.read().select(F.coalesce("doc_id", number).alias("doc_id"), F.col("reason").alias("outcome"))
    return rows.read().select("doc_id", F.col("platform").alias("outcome")).union(letters).groupBy("doc_id", "outcome").agg(F.count("*").cast("int").alias("n"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS events FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)""")
def st_expiry(spark, d):
    """Users idle for 12 hours, by the clock of the events of all, in two micro-batches."""
    from .streaming.jobs import expired_jobs, start_expiry

    to = work_folder(spark)
    events = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.col("ts").alias("updated_at"))
    middle = F.timestamp_micros(((F.unix_micros(F.min(F.col("updated_at").cast("timestamp"))) + F.unix_micros(F.max(F.col("updated_at").cast("timestamp")))) / 2).cast("long"))
    half = events.agg(middle.alias("m")).first()["m"]
    early = F.col("updated_at").cast("timestamp") <= F.lit(half)
    for arrived in (early, ~early):  # the stream goes on from its checkpoint, with all files that came since as one micro-batch
        events.where(arrived).write.mode("append").parquet(f"{to}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{to}/in")
        start_expiry(expired_jobs(stream, 12 * 3600, job="user_id"), f"{to}/expired", f"{to}/state").awaitTermination()
    return spark.read.schema("user_id long, first_at timestamp, last_at timestamp, events long").parquet(f"{to}/expired").select("user_id", F.col("first_at").cast("timestamp_ntz").alias("first_at"), F.col("last_at").cast("timestamp_ntz").alias("last_at"), "events")
