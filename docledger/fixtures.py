"""Ledger rows, invoice texts, page texts and code tables derived from the given tables.

Each is one SQL text that Spark and DuckDB both read, so a query and its oracle start from the same rows. ``{orders}`` and the like
stand for tables; ``{list}`` stands for the ordered joining of strings, which the two spell differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "benchmark", "labels", "embeddings")

BASE = """
SELECT o_orderkey AS k, o_orderkey AS doc_id, CAST(o_orderkey AS BIGINT) AS file_index, 'job' || CAST(o_orderkey % 16 AS STRING) AS job_id,
  CAST(o_totalprice AS DECIMAL(18,2)) AS amt, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS amt_s, o_orderstatus AS st,
  lpad(CAST(year(o_orderdate) AS STRING), 4, '0') AS yyyy, lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS mm, lpad(CAST(day(o_orderdate) AS STRING), 2, '0') AS dd,
  CAST(month(o_orderdate) AS STRING) AS m1, CAST(day(o_orderdate) AS STRING) AS d1, CAST(year(o_orderdate) + 543 AS STRING) AS by4,
  CASE month(o_orderdate) WHEN 1 THEN 'Jan' WHEN 2 THEN 'Feb' WHEN 3 THEN 'Mar' WHEN 4 THEN 'Apr' WHEN 5 THEN 'May' WHEN 6 THEN 'Jun' WHEN 7 THEN 'Jul' WHEN 8 THEN 'Aug' WHEN 9 THEN 'Sep' WHEN 10 THEN 'Oct' WHEN 11 THEN 'Nov' ELSE 'Dec' END AS mon,
  lpad(CAST(o_orderkey AS STRING), 7, '0') AS k7, lpad(CAST(o_orderkey AS STRING), 16, '0') AS k16, o_custkey AS cust,
  lpad(CAST(o_custkey % 25 AS STRING), 13, '0') AS client_tax, '0' || lpad(CAST(o_orderkey % 97 + 1000 AS STRING), 12, '9') AS vendor_tax
FROM {orders}
"""

LEDGER_RAW = f"""
SELECT job_id, doc_id, file_index, k, amt, yyyy, mm, dd,
  CASE k % 6 WHEN 0 THEN 'in/Shopee-TIV-TRSPEMKP00-00000-' || substr(yyyy, 3, 2) || mm || dd || '-' || k7 || '.pdf' WHEN 1 THEN 'SPX Express-RCT-RCSPXSPR00-00000-' || substr(yyyy, 3, 2) || mm || dd || '-' || k7 || '.pdf'
    WHEN 2 THEN 'TTSTH' || yyyy || lpad(CAST(k AS STRING), 10, '0') || '.PDF' WHEN 3 THEN 'THMPTI' || k16 || '.pdf' WHEN 4 THEN 'facebook_receipt-' || CAST(k AS STRING) || '.png' ELSE 'scan_' || CAST(k AS STRING) || '.jpg' END AS filename,
  CASE k % 7 WHEN 0 THEN yyyy || mm || dd WHEN 1 THEN d1 || '/' || m1 || '/' || yyyy WHEN 2 THEN d1 || '-' || m1 || '-' || yyyy WHEN 3 THEN yyyy || '-' || m1 || '-' || d1 WHEN 4 THEN mon || ' ' || d1 || ', ' || yyyy WHEN 5 THEN '99/99/2020' ELSE d1 || '/' || m1 || '/' || by4 END AS date_text,
  CASE k % 6 WHEN 0 THEN amt_s WHEN 1 THEN CAST(CAST(floor(amt / 1000) AS BIGINT) AS STRING) || ',' || lpad(CAST(CAST(floor(amt) AS BIGINT) % 1000 AS STRING), 3, '0') || substr(amt_s, length(amt_s) - 2, 3) WHEN 2 THEN '฿' || amt_s WHEN 3 THEN 'THB ' || amt_s WHEN 4 THEN '(' || amt_s || ')' ELSE 'n/a' END AS amount_text,
  CASE k % 5 WHEN 0 THEN '7%' WHEN 1 THEN 'NO' WHEN 2 THEN '7' WHEN 3 THEN '0.07' ELSE 'exempt' END AS vat_text, CASE k % 4 WHEN 0 THEN '3%' WHEN 1 THEN '0.03' WHEN 2 THEN '' ELSE '5' END AS wht_text,
  CASE k % 4 WHEN 0 THEN '1' WHEN 1 THEN '2.00' WHEN 2 THEN '' ELSE '1.5' END AS qty_text, CASE k % 3 WHEN 0 THEN client_tax WHEN 1 THEN '12-3' ELSE ' ' || vendor_tax END AS tax_text, CAST(k % 1000 AS STRING) AS branch_text,
  CASE k % 6 WHEN 0 THEN 'SHOPEE' WHEN 1 THEN 'SPX' WHEN 2 THEN 'TIKTOK' WHEN 3 THEN 'LAZADA' WHEN 4 THEN 'META' ELSE 'UNKNOWN' END AS platform, client_tax, vendor_tax, st
FROM ({BASE})
"""

#: Ledger rows with the columns' names; a row is blank, invalid or complete by its key.
LEDGER = f"""
SELECT job_id, doc_id, file_index, filename AS _source_file, platform AS _platform, client_tax AS _client_tax_id, CASE k % 11 WHEN 0 THEN 'Client ' || CAST(k % 3 AS STRING) ELSE '' END AS A_company_name,
  date_text AS B_doc_date, 'ref ' || CAST(k AS STRING) AS C_reference, CASE k % 9 WHEN 0 THEN '' ELSE 'C' || lpad(CAST(k % 100000 AS STRING), 5, '0') END AS D_vendor_code, tax_text AS E_tax_id_13, branch_text AS F_branch_5, '' AS G_invoice_no,
  CASE k % 3 WHEN 0 THEN '1' WHEN 1 THEN '' ELSE '9' END AS J_price_type, CASE k % 8 WHEN 0 THEN 'Marketplace Expense' ELSE '' END AS K_account, CASE k % 2 WHEN 0 THEN 'desc ' || CAST(k % 10 AS STRING) ELSE '' END AS L_description, qty_text AS M_qty,
  amount_text AS N_unit_price, vat_text AS O_vat_rate, wht_text AS P_wht, CASE k % 2 WHEN 0 THEN amount_text ELSE '' END AS R_paid_amount, '' AS H_invoice_date, '' AS I_tax_purchase_date, '' AS Q_payment_method, '' AS S_pnd, '' AS T_note, '' AS U_group, CASE k % 4 WHEN 0 THEN 'generic' ELSE 'rule_based' END AS _extraction_method
FROM ({LEDGER_RAW})
"""

INVOICES = f"""
SELECT b.job_id, b.doc_id, b.file_index, b.k, b.amt, b.yyyy, b.mm, b.dd, b.k7, b.vendor_tax, b.client_tax, coalesce(l.n_lines, 0) AS n_lines,
  CASE b.k % 5 WHEN 0 THEN 'SHOPEE' WHEN 1 THEN 'LAZADA' WHEN 2 THEN 'TIKTOK' WHEN 3 THEN 'META' ELSE 'THAI_TAX' END AS platform,
  CASE b.k % 5 WHEN 0 THEN 'TRSPEMKP00-00000-' || substr(b.yyyy, 3, 2) || b.mm || b.dd || '-' || b.k7 WHEN 1 THEN 'THMPTI' || b.k16 WHEN 2 THEN 'TTSTH' || lpad(CAST(b.k AS STRING), 14, '1') WHEN 3 THEN 'RCMETA-' || b.k7 ELSE 'INV-' || b.k7 END AS doc_no,
  'file_' || CAST(b.k AS STRING) || '.pdf' AS filename,
  CASE b.k % 5 WHEN 0 THEN 'Shopee (Thailand) Co., Ltd.' WHEN 1 THEN 'Lazada Ltd.' WHEN 2 THEN 'TikTok Shop' WHEN 3 THEN 'Meta Platforms Ireland Limited' ELSE 'Acme Trading' END || chr(10) || 'Tax ID ' || b.vendor_tax || ' Branch No. ' || CAST(b.k % 100 AS STRING)
  || chr(10) || 'Tax Invoice No: ' || CASE b.k % 5 WHEN 0 THEN 'TRSPEMKP00-00000-' || substr(b.yyyy, 3, 2) || b.mm || b.dd || '-' || b.k7 WHEN 1 THEN 'THMPTI' || b.k16 WHEN 2 THEN 'TTSTH' || lpad(CAST(b.k AS STRING), 14, '1') WHEN 3 THEN 'RCMETA-' || b.k7 ELSE 'INV-' || b.k7 END
  || chr(10) || 'Invoice Date: ' || b.d1 || '/' || b.m1 || '/' || b.yyyy || chr(10) || 'Seller ID: ' || CAST(b.cust + 100000 AS STRING) || chr(10) || 'Username: user_' || CAST(b.cust AS STRING) || chr(10) || 'Customer: Client ' || b.client_tax || ' (Head Office' || ')' || chr(10)
  || coalesce(l.fees, '') || chr(10) || 'Total (Including VAT) ' || b.amt_s || chr(10) || CASE WHEN b.k % 3 = 0 THEN 'Withholding Tax at the rate of 3% amounting to ' || CAST(CAST(b.amt * 0.03 AS DECIMAL(18,2)) AS STRING) ELSE 'Thank you' END AS text
FROM ({BASE}) b LEFT JOIN (
  SELECT l_orderkey, count(*) AS n_lines, {{list}} AS fees FROM (
    SELECT l_orderkey, l_linenumber, l_partkey, '- Commission fee ' || CAST(l_partkey AS STRING) || ' THB ' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) AS fee FROM {{lineitem}}
  ) GROUP BY l_orderkey
) l ON l.l_orderkey = b.k
"""

PAGES = """
SELECT conv_id AS doc_id, CAST(turn AS INT) AS page_index, 'scan_' || CAST(conv_id AS STRING) || '.pdf' AS filename, (conv_id + turn) % 5 = 4 AS blank, CAST(floor(turn / 3) AS BIGINT) AS part,
  CASE WHEN (conv_id + turn) % 5 = 4 THEN ' ' ELSE 'Tax Invoice' || chr(10) || 'Invoice No: INV' || lpad(CAST(conv_id * 10 + CAST(floor(turn / 3) AS BIGINT) AS STRING), 8, '0') || chr(10) || 'Page ' || CAST(turn % 3 + 1 AS STRING) || ' of 3'
    || chr(10) || 'Customer copy of the document' || chr(10) || 'Terms of the seller apply' || chr(10) || CAST(length(text) AS STRING) END AS text
FROM {conversations}
"""

#: What each platform's documents look like; q tells the variants of one platform apart. Documents of k % 7 = 6 have no platform.
RECEIPTS = f"""
SELECT *, 'file_' || CAST(k AS STRING) || '.pdf' AS filename, 'Customer Tax ID: ' || client_tax || chr(10) || CASE platform
  WHEN 'SHOPEE' THEN 'Shopee (Thailand) Co., Ltd.' || chr(10) || CASE WHEN q % 5 = 0 THEN '' ELSE 'Tax ID ' || vendor_tax || chr(10) END
    || 'Branch No. ' || CAST(k % 100 AS STRING) || chr(10) || 'Tax Invoice No: ' || doc_no || chr(10) || 'Issue date: ' || d1 || '/' || m1 || '/' || yyyy || chr(10) || seller
    || 'Total Value of Services (Excluded VAT) ' || ex || chr(10) || 'VAT 7% ' || vat || chr(10) || CASE WHEN q % 2 = 0 THEN 'Total Value of Services (Included VAT) ' || amt_s || chr(10) ELSE '' END
    || CASE WHEN q % 3 = 0 THEN 'Withholding tax 3% at ' || wht || ' THB' ELSE 'Thank you' END
  WHEN 'LAZADA' THEN 'Lazada Limited' || chr(10) || 'Tax ID ' || vendor_tax || ' Head Office' || chr(10) || 'Invoice No. ' || doc_no || chr(10) || 'Invoice Date: ' || yyyy || '-' || mm || '-' || dd || chr(10) || seller
    || 'Total ' || ex || chr(10) || '7% (VAT) ' || vat || chr(10) || CASE WHEN q % 2 = 0 THEN 'Total (Including Tax) ' || amt_s || chr(10) ELSE '' END
    || CASE WHEN q % 3 = 0 THEN 'Withholding tax 3% amounting to ' || wht ELSE 'Thank you' END
  WHEN 'TIKTOK' THEN 'TikTok Shop (Thailand)' || chr(10) || 'Tax Registration Number: ' || vendor_tax || chr(10) || 'Branch: 7' || chr(10) || 'Invoice number: ' || doc_no || chr(10) || 'Invoice date: ' || mon || ' ' || d1 || ', ' || yyyy || chr(10) || seller
    || CASE WHEN q % 2 = 0 THEN 'Advertising service' || chr(10) ELSE '' END || 'Subtotal (excluding VAT) ' || ex || chr(10) || 'Total VAT ' || vat || chr(10) || 'Total amount (including VAT) THB ' || amt_s || chr(10)
    || CASE WHEN q % 3 = 0 THEN 'Withholding tax at the rate of 3% amounting to ' || wht ELSE 'Thank you' END
  WHEN 'SPX' THEN 'SPX Express (Thailand) Co., Ltd.' || chr(10) || 'Tax ID ' || vendor_tax || chr(10) || 'No. ' || doc_no || chr(10) || 'Date ' || d1 || '/' || m1 || '/' || yyyy || chr(10)
    || CASE WHEN q % 3 = 0 THEN 'Withholding tax 3% at ' || wht || ' THB' || chr(10) ELSE '' END || seller || 'Parcels of the month, as agreed with the customer of the courier service' || chr(10)
    || 'Subtotal (excluding VAT) ' || ex || chr(10) || 'VAT 7% ' || vat || chr(10) || CASE WHEN q % 2 = 0 THEN 'Total amount (including VAT) ' || amt_s ELSE '' END
  WHEN 'GOOGLE' THEN 'Google Asia Pacific Pte. Ltd.' || chr(10) || 'Payment receipt' || chr(10) || 'Payment date: ' || mon || ' ' || d1 || ', ' || yyyy || chr(10) || 'Billing ID: ' || billing || chr(10)
    || CASE WHEN q % 2 = 0 THEN 'Payment number: ' || doc_no || chr(10) ELSE '' END || CASE WHEN q % 5 = 0 THEN '' ELSE 'Account name: Brand ' || CAST(k % 9 AS STRING) || chr(10) END || 'Payment method: Visa 1234' || chr(10)
    || CASE WHEN q % 3 = 0 THEN 'Charge THB 1.00' || chr(10) || 'Balance THB ' || amt_s ELSE 'Payment amount: THB ' || amt_s END
  WHEN 'META' THEN 'Meta Platforms Ireland Limited' || chr(10) || 'Receipt for Shop ' || CAST(k % 9 AS STRING) || chr(10) || 'Account ID: 1234567' || chr(10) || 'Invoice/Payment Date' || chr(10) || mon || ' ' || d1 || ', ' || yyyy || ', 11:42 AM' || chr(10)
    || 'Payment method: Visa 1234' || chr(10) || CASE WHEN q % 2 = 0 THEN 'Reference Number: ' || doc_no || chr(10) ELSE '' END || 'Transaction ID: ' || billing || chr(10)
    || CASE WHEN q % 3 = 0 THEN 'Total ฿1.00 THB' || chr(10) || '฿' || amt_s || ' THB' ELSE 'Paid ฿' || amt_s || ' THB' END
  ELSE 'Acme Trading' || chr(10) || 'Tax Invoice No: ' || doc_no || chr(10) || 'Date: ' || d1 || '/' || m1 || '/' || yyyy || chr(10) || 'Tax ID ' || vendor_tax || chr(10) || 'Grand Total ' || amt_s END AS text
FROM (
  SELECT *, CASE k % 7 WHEN 0 THEN 'SHOPEE' WHEN 1 THEN 'LAZADA' WHEN 2 THEN 'TIKTOK' WHEN 3 THEN 'SPX' WHEN 4 THEN 'GOOGLE' WHEN 5 THEN 'META' ELSE 'THAI_TAX' END AS platform, CAST(floor(k / 7) AS BIGINT) AS q,
    CASE k % 7 WHEN 0 THEN 'TRSPEMKP00-00000-' || substr(yyyy, 3, 2) || mm || dd || '-' || k7 WHEN 1 THEN 'THMPTI' || lpad(CAST(k AS STRING), 16, '8') WHEN 2 THEN 'TTSTH' || lpad(CAST(k AS STRING), 14, '8')
      WHEN 3 THEN 'RCSPXSPR00-00000-' || substr(yyyy, 3, 2) || mm || dd || '-' || k7 WHEN 4 THEN 'V' || lpad(CAST(k AS STRING), 16, '8') WHEN 5 THEN 'REF' || k7 ELSE 'INV-' || k7 END AS doc_no,
    '1234-' || lpad(CAST(k % 10000 AS STRING), 4, '8') || '-5678' AS billing, 'Seller ID: ' || CAST(cust + 100000 AS STRING) || chr(10) || 'Username: user_' || CAST(cust AS STRING) || chr(10) AS seller,
    CAST(CAST(amt * 0.07 AS DECIMAL(18,2)) AS STRING) AS vat, CAST(CAST(amt - CAST(amt * 0.07 AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS STRING) AS ex, CAST(CAST(amt * 0.03 AS DECIMAL(18,2)) AS STRING) AS wht
  FROM ({BASE})
)
"""

VENDORS = """
SELECT lpad(CAST(s_nationkey AS STRING), 13, '0') AS client_tax_id, '0' || lpad(CAST(s_suppkey % 97 + 1000 AS STRING), 12, '9') AS vendor_tax_id,
  CASE WHEN min(s_suppkey) % 10 = 9 THEN 'bad' ELSE 'C' || lpad(CAST(min(s_suppkey) % 100000 AS STRING), 5, '0') END AS vendor_code
FROM {supplier} GROUP BY s_nationkey, s_suppkey % 97
"""

#: A product of 25 nations and three rules: code tables of this kind have a row for each client and rule.
ACCOUNTS = """
SELECT k.rule_key, lpad(CAST(n_nationkey AS STRING), 13, '0') AS client_tax_id, CASE WHEN n_nationkey % 7 = 0 THEN 'na' ELSE '5' || lpad(CAST(n_nationkey * 10 + length(k.rule_key) AS STRING), 5, '0') END AS account
FROM {nation} CROSS JOIN (SELECT 'marketplace_shopee' AS rule_key UNION ALL SELECT 'ads_meta' UNION ALL SELECT 'marketplace_lazada') k
"""

WALLETS = """
SELECT lpad(CAST(c_custkey % 25 AS STRING), 13, '0') AS client_tax_id, CAST(c_custkey + 100000 AS STRING) AS seller_id, 'EWL' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') AS wallet_code FROM {customer}
"""

EDITS = "SELECT CAST(user_id AS BIGINT) AS doc_id, CASE event_type WHEN 'click' THEN 'L_description' WHEN 'view' THEN 'T_note' WHEN 'error' THEN 'A_seq' ELSE 'K_account' END AS `column`, CAST(value AS STRING) AS value, ts AS saved_at, event_id FROM {events}"

LIST = {"spark": "array_join(transform(array_sort(collect_list(struct(l_linenumber, l_partkey, fee))), x -> x.fee), chr(10))", "duckdb": "string_agg(fee, chr(10) ORDER BY l_linenumber, l_partkey, fee)"}


def duck(sql: str) -> str:
    return sql.format(list=LIST["duckdb"], **{t: t for t in TABLES}).replace("`", '"')


def load(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of one of the texts above. Documents cost far more work than their tables have bytes, so they are spread over the cores;
    where one row of orders is a document, before its text is made, which is ten times its size."""
    cores = spark.sparkContext.defaultParallelism
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    if sql == RECEIPTS:
        frames["orders"] = frames["orders"].repartition(cores, "o_orderkey")
    rows = spark.sql(sql.replace("{list}", LIST["spark"]), **frames)
    return rows.repartition(cores, "doc_id") if sql == INVOICES else rows
