"""Queries over documents of every platform, whole jobs with code tables, streams and sinks, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import classify as C
from .functions import udfs as U
from .operators import lookups as J
from .operators import summaries as A
from .operators import validate as E
from .operators.ledger import clamp_choice
from .plans.extract import JobConfig, extract, extract_platform
from .plans.jobs import run_job
from .queries import INV, RAW, ROWS, query
from .schema import LABELS, LEDGER, TEMPLATE
from .sources.documents import load_dims, read_documents
from .sources.shared import work_folder

DOCS = f"({fx.duck(fx.RECEIPTS)})"
OWN = {f"client{i}": f"{i:013d}" for i in range(25)}
DAY = "yyyy || mm || dd"


def blanks(columns: str) -> str:
    return ", ".join(f"'' AS {c}" for c in columns.split())


def market(label: str) -> str:
    return f"'Record Marketplace Expense - {label} - Seller ID ' || CAST(cust + 100000 AS VARCHAR) || ' - user_' || CAST(cust AS VARCHAR) || ' - ' || filename"


def platform_sql(platform: str, **columns: str) -> str:
    """The 22 columns that the documents of a platform must give."""
    fixed = {
        "A_seq": "'1'", "A_company_name": "''", "B_doc_date": DAY, "H_invoice_date": DAY, "I_tax_purchase_date": DAY, "C_reference": "doc_no", "E_tax_id_13": "vendor_tax", "F_branch_5": "'00000'", "J_price_type": "'1'", "K_account": "''",
        "M_qty": "'1'", "N_unit_price": "CAST(amt AS VARCHAR)", "R_paid_amount": "CAST(amt AS VARCHAR)", "O_vat_rate": "'7%'", "P_wht": "''", "Q_payment_method": "'หักจากยอดขาย'", "S_pnd": "''", "T_note": "''", "U_group": "'Marketplace Expense'",
    } | columns
    fixed["G_invoice_no"] = fixed["C_reference"]
    return f"SELECT doc_id AS _doc_id, {', '.join(f'{fixed[c]} AS {c}' for c in LEDGER)} FROM {DOCS} WHERE platform = '{platform}'"


def rows_of(spark, d, platform: str):
    return extract_platform(fx.load(spark, d, fx.RECEIPTS), platform, JobConfig(own=OWN)).select("_doc_id", *LEDGER)


@query(platform_sql(
    "SHOPEE", D_vendor_code="'Shopee'", E_tax_id_13="CASE WHEN q % 5 = 0 THEN '0105558019581' ELSE vendor_tax END", F_branch_5="lpad(CAST(k % 100 AS VARCHAR), 5, '0')",
    S_pnd="CASE WHEN q % 3 = 0 THEN '53' ELSE '' END", L_description=market("Shopee"),
))
def jb_shopee(spark, d):
    return rows_of(spark, d, "SHOPEE")


@query(platform_sql("LAZADA", D_vendor_code="'Lazada'", L_description=market("Lazada")))
def jb_lazada(spark, d):
    return rows_of(spark, d, "LAZADA")


@query(platform_sql(
    "TIKTOK", D_vendor_code="'TikTok'", F_branch_5="'00007'", Q_payment_method="''", U_group="CASE WHEN q % 2 = 0 THEN 'Advertising Expense' ELSE 'Marketplace Expense' END",
    L_description=f"CASE WHEN q % 2 = 0 THEN 'Record Ads - TikTok - UNKNOWN - Contract No. UNKNOWN - ' || filename ELSE {market('TikTok')} END",
))
def jb_tiktok(spark, d):
    return rows_of(spark, d, "TIKTOK")


@query(platform_sql("SPX", D_vendor_code="'Shopee Express'", U_group="'Delivery/Logistics Expense'", L_description=market("SPX")))
def jb_spx(spark, d):
    return rows_of(spark, d, "SPX")


@query(platform_sql(
    "GOOGLE", D_vendor_code="'Google Asia Pacific'", E_tax_id_13="''", C_reference="CASE WHEN q % 2 = 0 THEN doc_no ELSE billing END", I_tax_purchase_date="''", J_price_type="'3'", O_vat_rate="'NO'", Q_payment_method="''", U_group="'Advertising Expense'",
    L_description="'Record Ads - Google - ' || CASE WHEN q % 5 = 0 THEN 'UNKNOWN' ELSE 'Brand ' || CAST(k % 9 AS VARCHAR) END || ' - Payment number ' || CASE WHEN q % 2 = 0 THEN doc_no ELSE billing END || ' - Payment method Visa 1234 - ' || filename",
))
def jb_google(spark, d):
    return rows_of(spark, d, "GOOGLE")


@query(platform_sql(
    "META", D_vendor_code="'Meta Platforms Ireland'", E_tax_id_13="'0993000454995'", C_reference="CASE WHEN q % 2 = 0 THEN doc_no ELSE billing END", I_tax_purchase_date="''", J_price_type="'3'", O_vat_rate="'NO'", Q_payment_method="''", U_group="'Advertising Expense'",
    L_description="'Record Ads - Meta - Shop ' || CAST(k % 9 AS VARCHAR) || ' - Account ID 1234567 - Transaction ID ' || billing || ' - ' || filename",
))
def jb_meta(spark, d):
    return rows_of(spark, d, "META")


@query(f"""
SELECT doc_id, CASE WHEN platform = 'LAZADA' AND q % 3 = 0 THEN '53' WHEN platform IN ('SHOPEE', 'LAZADA', 'TIKTOK', 'SPX', 'META', 'GOOGLE', 'THAI_TAX') AND NOT (platform = 'SHOPEE' AND q % 3 = 0) THEN '1' ELSE '53' END AS pnd, '3%' AS rate,
  CAST(CAST(CASE WHEN platform IN ('META', 'GOOGLE') THEN (CAST(amt * 100 AS BIGINT) * 6 + 100) // 200 ELSE (CAST(amt * 100 AS BIGINT) * 6 + 107) // 214 END AS DECIMAL(18,2)) * 0.01 AS DECIMAL(18,2))::VARCHAR AS withheld FROM {DOCS}""")
def job_withholding(spark, d):
    """A job that computes the withholding of every document."""
    rows = extract(fx.load(spark, d, fx.RECEIPTS), JobConfig(own=OWN, compute_wht=True, lazada_rate=True))
    return rows.select("doc_id", F.col("S_pnd").alias("pnd"), F.col("P_wht").alias("rate"), F.col("_wht_amount").cast("string").alias("withheld"))


def code_tables(spark, d):
    """All code tables of a job, written to the shared folder and loaded again."""
    to = work_folder(spark)
    nation = spark.read.parquet(f"{d}/nation.parquet")
    made = {
        "vendor_name_dim": spark.createDataFrame([("google", "0105500000001", 1), ("google asia", "0105500000002", 2), ("meta", "0105500000003", 3), ("broken id", "12", 4)], "name string, vendor_tax_id string, ord int"),
        "vendor_dim": fx.load(spark, d, fx.VENDORS), "gl_dim": fx.load(spark, d, fx.ACCOUNTS), "wallet_dim": fx.load(spark, d, fx.WALLETS),
        "shop_keyword_dim": spark.createDataFrame([("account id", "EWL777", 1), ("billing id", "EWL778", 2)], "keyword string, wallet_code string, ord int"),
        "client_dim": nation.select(F.lpad(F.col("n_nationkey").cast("string"), 13, "0").alias("client_tax_id"), F.col("n_name").alias("tag")),
    }
    for name, table in made.items():
        table.write.parquet(f"{to}/{name}")
    return load_dims(spark, to, list(made))


@query(f"""
WITH r AS (SELECT *, CASE platform WHEN 'GOOGLE' THEN '0105500000002' WHEN 'META' THEN '0993000454995' WHEN 'SHOPEE' THEN CASE WHEN q % 5 = 0 THEN '0105558019581' ELSE vendor_tax END ELSE vendor_tax END AS tax,
  CASE platform WHEN 'SHOPEE' THEN 'marketplace_shopee' WHEN 'META' THEN 'ads_meta' WHEN 'LAZADA' THEN 'marketplace_lazada' ELSE 'x' END AS rk,
  CASE platform WHEN 'SHOPEE' THEN 'Shopee' WHEN 'LAZADA' THEN 'Lazada' WHEN 'TIKTOK' THEN 'TikTok' WHEN 'SPX' THEN 'Shopee Express' WHEN 'GOOGLE' THEN 'Google Asia Pacific' WHEN 'META' THEN 'Meta Platforms Ireland' ELSE 'Unknown' END AS label,
  CASE WHEN platform IN ('SHOPEE', 'LAZADA', 'TIKTOK', 'SPX') THEN CAST(cust + 100000 AS VARCHAR) ELSE coalesce(list_filter(regexp_extract_all(text, '\\b[0-9]{{6,20}}\\b'), lambda x: length(x) <> 13)[1], nullif(regexp_extract(filename, '[0-9]{{6,20}}'), '')) END AS seller_no FROM {DOCS})
SELECT r.doc_id, coalesce(n.n_name, '') AS company, r.tax AS tax_id, coalesce(CASE WHEN regexp_matches(v.vendor_code, '^C\\d{{5}}$') THEN v.vendor_code END, r.label) AS vendor, coalesce(CASE WHEN a.account <> 'na' THEN a.account END, '') AS account,
  coalesce(w.wallet_code, CASE WHEN r.platform = 'META' THEN 'EWL777' WHEN r.platform = 'GOOGLE' THEN 'EWL778' WHEN r.platform IN ('SHOPEE', 'LAZADA', 'SPX') THEN 'หักจากยอดขาย' ELSE '' END) AS wallet, 'OK' AS status,
  CAST(row_number() OVER (PARTITION BY r.job_id ORDER BY r.file_index, r.doc_id) AS VARCHAR) AS seq
FROM r LEFT JOIN ({fx.duck(fx.VENDORS)}) v ON v.client_tax_id = r.client_tax AND v.vendor_tax_id = r.tax LEFT JOIN ({fx.duck(fx.ACCOUNTS)}) a ON a.client_tax_id = r.client_tax AND a.rule_key = r.rk LEFT JOIN nation n ON lpad(CAST(n.n_nationkey AS VARCHAR), 13, '0') = r.client_tax
LEFT JOIN ({fx.duck(fx.WALLETS)}) w ON w.client_tax_id = r.client_tax AND w.seller_id = r.seller_no""")
def job_full(spark, d):
    """A whole job with vendors, vendor names, accounts, wallets, shop words and clients. The wallet of a document without a labelled seller
    is looked up by the first run of 6 to 20 digits that is no tax id in its text, else in its file name (``loose_seller_id``)."""
    docs = fx.load(spark, d, fx.RECEIPTS).select("job_id", "file_index", "doc_id", "filename", "text")
    rows = run_job(docs, JobConfig(own=OWN), code_tables(spark, d))[0]
    return rows.select("doc_id", F.col("A_company_name").alias("company"), F.col("E_tax_id_13").alias("tax_id"), F.col("D_vendor_code").alias("vendor"), F.col("K_account").alias("account"), F.col("Q_payment_method").alias("wallet"), F.col("_status").alias("status"), F.col("A_seq").alias("seq"))


@query(f"""
SELECT doc_id, CASE WHEN k % 2 = 0 THEN '0105561164871' WHEN k % 3 = 0 THEN '0105558019581' ELSE '' END AS tax_id FROM {RAW}""")
def j_vendor_names(spark, d):
    """Vendor ids by names inside other text, the longest name first; more names than go along as one array."""
    r = fx.load(spark, d, fx.LEDGER_RAW)
    few = spark.createDataFrame([("shopee", "0105558019581", 1), ("shopee express", "0105561164871", 2)], "name string, vendor_tax_id string, ord int")
    many = r.select(F.concat(F.lit("never "), F.col("k").cast("string")).alias("name"), F.lit("0").alias("vendor_tax_id"), F.lit(9).alias("ord"))
    vendor = F.when(F.col("k") % 2 == 0, 'The "Shopee  Express" (Thailand)').when(F.col("k") % 3 == 0, "Shopee Ltd.").otherwise("Other")
    rows = r.select("doc_id", vendor.alias("D_vendor_code"), F.lit(" ").alias("E_tax_id_13"))
    return J.vendor_tax_from_name(rows, few.unionByName(many)).select("doc_id", F.col("E_tax_id_13").alias("tax_id"))


@query("""
SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'Shipping Expense' WHEN 1 THEN 'Selling Expense' WHEN 2 THEN 'Advertising Expense' WHEN 3 THEN 'Inventory / COGS' WHEN 4 THEN 'Shipping Expense' WHEN 5 THEN 'Marketplace Expense' ELSE 'Marketplace Expense' END AS category,
  CASE WHEN p_partkey % 3 = 0 THEN '53' ELSE '' END AS pnd, CASE p_partkey % 2 WHEN 0 THEN 'Selling Expense' ELSE 'Other Expense' END AS grp FROM part""")
def c_category(spark, d):
    k = F.col("p_partkey") % 7
    text = F.when(k == 0, "DELIVERY of goods").when(k == 1, "ค่าคอม for ads").when(k == 2, "Sponsored goods").when(k == 3, "inventory").when(k == 4, "fee").when(k == 5, "service fee").otherwise("product")
    platform = F.when(k == 4, "SPX Express").when(k == 5, "Lazada").otherwise("")
    choice = clamp_choice(F.when(F.col("p_partkey") % 3 == 0, "53").otherwise("77"), ("", "1", "2", "3", "53"), "")
    grp = clamp_choice(F.when(F.col("p_partkey") % 2 == 0, "Selling Expense").otherwise("COGS"), ("Marketplace Expense", "Selling Expense"), "Other Expense")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", C.expense_category(text, platform).alias("category"), choice.alias("pnd"), grp.alias("grp"))


# --- checks, reports ------------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, CASE WHEN k % 10 = 0 THEN 'ERROR' ELSE 'NEEDS_REVIEW' END AS status, CASE WHEN k % 10 = 0 THEN 'exception' WHEN k % 10 = 1 THEN 'no_text' ELSE 'validation_or_missing' END AS reason FROM {RAW}")
def e_quarantine(spark, d):
    """Rows that a step could not read are kept and told as errors; those without text as such."""
    rows = fx.load(spark, d, fx.LEDGER_RAW).withColumns({"B_doc_date": F.lit(""), "R_paid_amount": F.lit("0"), "_errors": F.array().cast("array<string>"), "body": F.when(F.col("k") % 10 == 1, " ").otherwise("x")})
    return E.status(E.quarantine(rows, F.col("k") % 10 == 0, "broken"), "body").select("doc_id", F.col("_status").alias("status"), F.col("_status_reason").alias("reason"))


@query(f"SELECT count(*) AS rows, CASE WHEN count(*) > 1000 THEN 'too_many' ELSE '' END AS problem FROM {ROWS}")
def e_too_many(spark, d):
    return E.validate_export(fx.load(spark, d, fx.LEDGER).withColumns({c: F.lit("x") for c in ("A_seq",)}).select(*LEDGER), 1000).select("rows", "problem")


@query(f"""
WITH w AS (SELECT unnest(list_filter([CASE WHEN _platform = 'META' AND O_vat_rate <> 'NO' THEN 'ads_vat_must_be_NO' END, CASE WHEN _platform NOT IN ('META', 'UNKNOWN') AND O_vat_rate <> '7%' THEN 'marketplace_vat_must_be_7%' END, CASE WHEN NOT (doc_id % 2 = 0 AND doc_id % 6 < 4) THEN 'missing_paid_amount' END], lambda x: x IS NOT NULL)) AS warning FROM {ROWS})
SELECT warning, count(*) AS rows FROM w GROUP BY warning""")
def a_warnings(spark, d):
    return A.sample_warnings(E.warnings(fx.load(spark, d, fx.LEDGER)))


# --- sources, sinks, streams ----------------------------------------------------------------------------------------
@query(f"SELECT doc_id, CASE WHEN k % 3 = 0 THEN 'unknown' ELSE filename END AS filename, 'application/octet-stream' AS content_type FROM {DOCS}")
def src_read(spark, d):
    """Documents written to the shared folder and read as a source; blank names and types get their defaults."""
    to = work_folder(spark)
    docs = fx.load(spark, d, fx.RECEIPTS).withColumn("filename", F.when(F.col("k") % 3 == 0, " ").otherwise(F.col("filename")))
    docs.select("doc_id", "filename", F.lit("").alias("content_type"), "text").write.parquet(to)
    return read_documents(spark, to).select("doc_id", "filename", "content_type")


@query(f"SELECT {', '.join(f'{c} AS {c}' if c != 'A_seq' else chr(39) * 2 + ' AS A_seq' for c in LEDGER)} FROM {ROWS}")
def snk_csv(spark, d):
    """The whole import file written and read back, all columns."""
    from .sources.sinks import write_ledger_csv

    to = work_folder(spark)
    write_ledger_csv(fx.load(spark, d, fx.LEDGER), to)
    back = spark.read.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).csv(to)
    return back.select(*(F.coalesce(F.col(f"`{label}`"), F.lit("")).alias(c) for c, label in zip(LEDGER, TEMPLATE, strict=True)))


@query(f"SELECT 'ref ' || CAST(doc_id AS VARCHAR) AS reference, CASE WHEN doc_id % 2 = 0 THEN '''=1+' || CAST(doc_id AS VARCHAR) ELSE 'a \"q\", b' END AS description, CASE WHEN doc_id % 3 = 0 THEN 'OK' ELSE 'NEEDS_REVIEW' END AS status, _source_file AS file FROM {ROWS}")
def snk_review(spark, d):
    """The review file written and read back; cells that begin like formulas are escaped."""
    from .sources.sinks import write_review_csv

    to = work_folder(spark)
    described = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("=1+"), F.col("doc_id").cast("string"))).otherwise('a "q", b')
    write_review_csv(fx.load(spark, d, fx.LEDGER).withColumns({"L_description": described, "_status": F.when(F.col("doc_id") % 3 == 0, "OK").otherwise("NEEDS_REVIEW")}), to, LABELS)
    back = spark.read.option("header", True).option("escape", '"').option("lineSep", "\r\n").csv(to)
    return back.select(F.col("Reference").alias("reference"), F.col("Description").alias("description"), F.col("Status").alias("status"), F.col("Source file").alias("file"))


@query(f"SELECT job_id, count(*) AS rows, count(DISTINCT doc_id) AS documents FROM {ROWS} GROUP BY job_id")
def snk_append(spark, d):
    """Rows appended to the ledger table in two writes, then read job by job."""
    from .sources.sinks import append_rows

    to, rows = work_folder(spark), fx.load(spark, d, fx.LEDGER)
    append_rows(rows.where("doc_id % 2 = 0"), to)
    append_rows(rows.where("doc_id % 2 = 1"), to)
    return spark.read.parquet(to).groupBy("job_id").agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("documents"))


@query(f"SELECT job_id, count(*) FILTER (doc_id % 2 = 0) AS seen_before, count(*) AS rows, count(DISTINCT doc_id) AS documents, sum(doc_id) AS total FROM {ROWS} GROUP BY job_id")
def snk_batches(spark, d):
    """Two batches: the first is sent twice, the second breaks off after half of its rows, is read meanwhile, and is sent again."""
    from .sources.batches import BatchTable

    rows = fx.load(spark, d, fx.LEDGER).select("job_id", "doc_id")
    table = BatchTable(spark, work_folder(spark), "job_id string, doc_id long")
    even, odd = rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1")
    table.commit(even, "even")
    odd.where("doc_id % 4 = 1").write.parquet(table.folder("odd"))  # no manifest: the writer was lost here
    before = table.read().groupBy("job_id").agg(F.count("*").alias("seen_before"))
    before.write.parquet(f"{table.path}/before")
    table.commit(odd, "odd")
    table.commit(even, "even")
    after = table.read().groupBy("job_id").agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("documents"), F.sum("doc_id").alias("total"))
    return after.join(spark.read.parquet(f"{table.path}/before"), "job_id", "left").select("job_id", F.coalesce("seen_before", F.lit(0)).alias("seen_before"), "rows", "documents", "total")


def landed(spark, d) -> tuple[str, str, int]:
    """The documents in two lots, as they arrive one after the other, their schema, and the files of the larger lot. All cores write a lot:
    as one file it would be one task's work."""
    to, docs = work_folder(spark), fx.load(spark, d, fx.RECEIPTS).select("job_id", "doc_id", "file_index", "filename", "text")
    files = [0]
    for half in (0, 1):
        docs.where(F.col("doc_id") % 2 == half).write.mode("append").parquet(to)
        files.append(len(spark.read.parquet(to).inputFiles()))
    return to, "job_id string, doc_id long, file_index long, filename string, text string", max(files[1], files[2] - files[1])


@query(f"SELECT doc_id, platform, CAST(amt AS VARCHAR) AS paid, {DAY} AS day FROM {DOCS}")
def st_ingest(spark, d):
    """The documents ingested as a stream in two micro-batches, one row each."""
    from .streaming.jobs import ingest_stream

    source, schema, files = landed(spark, d)
    to = work_folder(spark)
    ingest_stream(spark, source, schema, f"{to}/rows", f"{to}/state", JobConfig(own=OWN), files_per_batch=files).awaitTermination()
    return spark.read.parquet(f"{to}/rows").select("doc_id", F.col("_platform").alias("platform"), F.col("R_paid_amount").alias("paid"), F.col("B_doc_date").alias("day"))


@query(f"SELECT job_id, platform, CASE WHEN platform = 'THAI_TAX' THEN 'generic' ELSE 'rule_based_' || lower(platform) END AS method, count(*) AS rows FROM {DOCS} GROUP BY ALL")
def st_progress(spark, d):
    """Running counts by job, platform and method over two micro-batches; the last state is the result."""
    from .streaming.jobs import progress_counts, spread

    source, schema, files = landed(spark, d)
    to = work_folder(spark)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    counts = progress_counts(extract(spread(stream), JobConfig(own=OWN)))
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{to}/counts")
    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{to}/counts")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def st_watermark(spark, d):
    """Windowed counts of a stream under a watermark as late as the events, the last count of each window taken."""
    from .streaming.jobs import windowed_counts

    to = work_folder(spark)
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    counts = windowed_counts(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d), late="3650 days")
    write = lambda batch, number: batch.write.mode("append").parquet(f"{to}/counts")
    counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{to}/counts").groupBy("start", "event_type").agg(F.max("n").alias("n"))


@query(f"SELECT doc_id, n_lines AS lines FROM {INV} WHERE n_lines > 0")
def udf_fee_lines(spark, d):
    """Fee lines by the SQL table function over a view of the documents."""
    U.register_fee_lines(spark)
    U.register_views(ledger_documents=fx.load(spark, d, fx.INVOICES))
    return spark.sql("SELECT doc_id, count(*) AS lines FROM ledger_documents, LATERAL fee_lines(text) GROUP BY doc_id")
