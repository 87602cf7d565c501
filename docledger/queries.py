"""The registered queries over the given tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import classify as C
from .functions import fields as X
from .functions import text as S
from .functions import values as V
from .functions.candidates import find_all, keyword_positions, nearest
from .operators import ledger as L
from .operators import lookups as J
from .operators import segments as G
from .operators import summaries as A
from .operators import validate as E
from .plans.extract import JobConfig, extract
from .plans.jobs import apply_enrichment, enrichment_requests, prepare_export, route_segments, run_job
from .sources.documents import admit, choose_text, to_pages, with_names
from .sources.shared import work_folder
from .sources.sinks import typed_export

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def day(c):
    return F.coalesce(F.date_format(c, "yyyyMMdd"), F.lit(""))


def cash(c):
    return V.money_text(c)


RAW, ROWS, INV, PAGES = (f"({fx.duck(s)})" for s in (fx.LEDGER_RAW, fx.LEDGER, fx.INVOICES, fx.PAGES))
ZW = "\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}\\x{FEFF}"
MESSY = "concat('  ๑๒๓–ＡＢ\t\tx​ ', coalesce({0}, ''), chr(10), chr(10), chr(10), chr(10), 'end  ')"


# --- text functions -------------------------------------------------------------------------------------------------
@query(f"""
WITH m AS (SELECT doc_id, regexp_replace(translate(translate({MESSY.format('text')}, '๑๒๓ＡＢ', '123AB'), '–', '-'), '[{ZW}]', '', 'g') AS t FROM documents)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '(?m)^ | $', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10))) AS normal,
  md5(trim(regexp_replace(trim(regexp_replace(t, '[ \t]+', ' ', 'g'), ' ' || chr(9) || chr(10)), '\\s+', ' ', 'g'))) AS line FROM m""")
def s_normalize(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    m = F.expr(MESSY.format("text"))
    folded = F.translate(F.translate(m, "๑๒๓ＡＢ", "123AB"), "–", "-")
    return docs.select("doc_id", F.md5(S.normalize_text(m).cast("binary")).alias("normal"), F.md5(S.one_line(folded).cast("binary")).alias("line"))


@query("""
SELECT p_partkey, replace(p_name, ' ', '') || replace(p_brand, ' ', '') AS squashed, regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits, lower(replace(p_brand, '#', '#')) AS name,
  CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS number, 'ref ' || regexp_replace(p_brand, '[^0-9]', '', 'g') || '01' AS fixed, 'part no ' || CAST(p_partkey AS VARCHAR) AS token,
  p_name || '-' || p_type AS described, '''=' || p_name AS escaped, 'a | ' || p_name AS note, p_type || ': ' || p_name AS rendered, 'กขค งจ' AS script, true AS is_script,
  CASE WHEN length(p_name) <= 8 THEN p_name ELSE substr(p_name, 1, 5) || '~' || right(p_name, 3) END AS shorter FROM part""")
def s_words(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    price = F.concat(F.lit("฿ "), F.col("p_retailprice").cast("decimal(18,2)").cast("string"))
    return p.select(
        "p_partkey", S.squash_ws(F.concat("p_name", F.lit(" "), "p_brand")).alias("squashed"), S.digits_only("p_brand").alias("digits"), S.norm_name(F.concat(F.lit(' "'), "p_brand", F.lit('"'))).alias("name"), S.clean_number(price).alias("number"),
        S.fix_ocr_digits(F.concat(F.lit("ref "), V.digits_only("p_brand"), F.lit("O1"))).alias("fixed"), S.normalize_token(F.concat(F.lit("Part_No."), F.col("p_partkey").cast("string"))).alias("token"), F.replace(S.short_description("p_name", F.lit(" "), "p_type"), F.lit(" - "), F.lit("-")).alias("described"),
        S.escape_formula(F.concat(F.lit("="), "p_name")).alias("escaped"), S.append_note(S.append_note(F.lit("a"), "p_name"), "p_name").alias("note"), S.render_template(F.lit("{kind}: {name}{none}"), {"kind": F.col("p_type"), "name": F.col("p_name"), "none": F.lit(None)}).alias("rendered"),
        S.extract_script(F.concat(F.lit("กขค "), "p_name", F.lit("งจ"))).alias("script"), S.is_script(F.lit("กขคง abc")).alias("is_script"), S.truncate_middle("p_name", 8, marker="~").alias("shorter"),
    )


@query(f"""
SELECT doc_id, CASE k % 6 WHEN 0 THEN 'TRSPEMKP00-00000-' || substr(yyyy, 3, 2) || mm || dd || '-' || lpad(CAST(k AS VARCHAR), 7, '0') WHEN 1 THEN 'RCSPXSPR00-00000-' || substr(yyyy, 3, 2) || mm || dd || '-' || lpad(CAST(k AS VARCHAR), 7, '0') ELSE regexp_replace(filename, '\\.(pdf|PDF|png|jpg)$', '') END AS core,
  CASE WHEN k % 6 < 2 AND (mm || dd <> '0229' OR CAST(substr(yyyy, 3, 2) AS INT) % 4 = 0) THEN '20' || substr(yyyy, 3, 2) || mm || dd ELSE '' END AS named_date, regexp_replace(replace(filename, 'in/', ''), '\\.(pdf|PDF|png|jpg)$', '') AS stem, CASE k % 6 WHEN 0 THEN 'SHOPEE' WHEN 1 THEN 'SPX' WHEN 2 THEN 'TIKTOK' WHEN 3 THEN 'LAZADA' WHEN 4 THEN 'META' ELSE 'UNKNOWN' END AS platform,
  'ref' || CAST(k AS VARCHAR) AS clean FROM {RAW}""")
def s_references(spark, d):
    r = fx.load(spark, d, fx.LEDGER_RAW)
    return r.select("doc_id", S.reference_core("filename").alias("core"), day(V.date_from_reference("filename")).alias("named_date"), S.stem("filename").alias("stem"), C.platform_from_filename("filename").alias("platform"), S.normalize_reference(F.concat(F.lit(' "ref '), F.col("k").cast("string"), F.lit('",;'))).alias("clean"))


# --- values ---------------------------------------------------------------------------------------------------------
@query(f"""
SELECT doc_id, CASE WHEN k % 7 < 4 THEN yyyy || mm || dd WHEN k % 7 = 6 AND mm || dd <> '0229' THEN CAST(CAST(yyyy AS INT) + 543 AS VARCHAR) || mm || dd ELSE '' END AS strict_date, CASE WHEN k % 7 < 4 OR k % 7 = 6 THEN yyyy || mm || dd ELSE '' END AS lenient, CASE WHEN k % 7 = 4 THEN yyyy || mm || dd ELSE '' END AS english,
  CASE WHEN k % 6 < 2 AND yyyy >= '2000' THEN '' ELSE yyyy || mm || dd END AS guarded, yyyy || mm || dd AS first_day, yyyy || mm || '28' AS last_day FROM {RAW}""")
def v_dates(spark, d):
    r = fx.load(spark, d, fx.LEDGER_RAW)
    true_date = F.to_date(F.concat("yyyy", "mm", "dd"), "yyyyMMdd")
    period = V.service_period(F.concat(F.lit("Service period: "), "dd", F.lit("/"), "mm", F.lit("/"), "yyyy", F.lit(" - 28/"), "mm", F.lit("/"), "yyyy"))
    return r.select("doc_id", day(V.parse_date("date_text")).alias("strict_date"), day(V.parse_date_lenient("date_text")).alias("lenient"), day(V.parse_en_date("date_text")).alias("english"), day(V.guard_filename_date(true_date, "filename", F.lit("no date"))).alias("guarded"), day(period["start"]).alias("first_day"), day(period["end"]).alias("last_day"))


@query(f"""
WITH a AS (SELECT *, CASE WHEN k % 6 < 4 THEN amt END AS money FROM {RAW}), b AS (SELECT *, CASE WHEN k % 5 IN (1, 4) THEN 0 ELSE 0.07 END AS rate FROM a)
SELECT doc_id, coalesce(CAST(money AS VARCHAR), '') AS money, coalesce(CAST(money AS VARCHAR), '0.00') AS paid, CASE k % 4 WHEN 1 THEN '2' WHEN 3 THEN '1.50' ELSE '1' END AS qty, CAST(rate AS DOUBLE) AS vat, CASE k % 4 WHEN 3 THEN '5%' WHEN 2 THEN '0' ELSE '3%' END AS wht,
  CAST(CAST(amt * 0.03 AS DECIMAL(18,2)) AS VARCHAR) AS withheld, CAST(amt + 7 AS VARCHAR) AS total, CASE k % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 ELSE 0.5 END AS confidence FROM b""")
def v_amounts(spark, d):
    r = fx.load(spark, d, fx.LEDGER_RAW)
    money, amt = V.parse_amount("amount_text"), F.col("amt")
    return r.select(
        "doc_id", cash(money).alias("money"), cash(V.sync_amounts(F.lit(None).cast("decimal(18,2)"), money)[0]).alias("paid"), V.normalize_qty("qty_text").alias("qty"), V.parse_vat_rate("vat_text").cast("double").alias("vat"), V.format_rate(V.parse_wht_rate("wht_text")).alias("wht"),
        cash(V.compute_wht(amt, F.lit(0), F.lit("0.03").cast("decimal(5,4)"))).alias("withheld"), cash(V.derive_amounts(amt, F.lit(7).cast("decimal(18,2)"), F.lit(None).cast("decimal(18,2)"))["total"]).alias("total"),
        V.clamp_confidence(F.when(F.col("k") % 3 == 0, "x").when(F.col("k") % 3 == 1, "7.5").otherwise("0.5")).alias("confidence"),
    )


@query(f"""
SELECT doc_id, CASE k % 3 WHEN 1 THEN '' WHEN 0 THEN client_tax ELSE vendor_tax END AS exact, CASE k % 3 WHEN 1 THEN '' WHEN 0 THEN client_tax ELSE vendor_tax END AS inside, lpad(branch_text, 5, '0') AS padded, CASE WHEN k % 1000 = 0 THEN '00000' ELSE '' END AS strict_branch,
  CASE k % 5 WHEN 1 THEN 'NO' WHEN 4 THEN 'NO' ELSE '7%' END AS vat, CASE WHEN k % 10 IN (1, 2, 3) THEN CAST(k % 10 AS VARCHAR) ELSE '' END AS price, k % 2 = 0 AS flag, k % 4 = 0 AS code_ok FROM {RAW}""")
def v_identifiers(spark, d):
    r = fx.load(spark, d, fx.LEDGER_RAW)
    word = F.when(F.col("k") % 2 == 0, " Yes").otherwise("off")
    code = F.when(F.col("k") % 4 == 0, "C00012").otherwise("C12")
    return r.select("doc_id", V.tax13("tax_text").alias("exact"), V.tax13("tax_text", "embedded").alias("inside"), V.branch5("branch_text").alias("padded"), V.branch5("branch_text", "strict").alias("strict_branch"), V.vat_code("vat_text").alias("vat"), V.price_type((F.col("k") % 10).cast("string")).alias("price"), V.parse_bool(word).alias("flag"), V.code_format(code, "vendor").alias("code_ok"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def v_json(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    answer = F.when(F.col("event_id") % 3 == 0, "no object { here").otherwise(F.concat(F.lit("Sure: "), "props", F.lit(" done")))
    return e.select("event_id", V.first_json_object(answer, "k long")["k"].alias("k"))


@query("SELECT event_id, list_distinct([upper(event_type)]) AS one, ['A', 'B'] AS two, CASE WHEN event_type = 'view' THEN 'UNKNOWN' ELSE '' END AS platform FROM events")
def f_lists(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    pair = F.when(F.col("event_id") % 2 == 0, '["a", " b", "A", ""]').otherwise("a, b,,a")
    return e.select("event_id", L.normalize_list(F.concat("event_type", F.lit(", "), "event_type"), True).alias("one"), L.normalize_list(pair, True).alias("two"), C.valid_platform(F.when(F.col("event_type") == "view", "other").otherwise("invalid")).alias("platform"))


# --- fields out of invoice texts ------------------------------------------------------------------------------------
@query(f"""
SELECT doc_id, CAST(amt AS VARCHAR) AS total, CAST(amt AS VARCHAR) AS block_total, upper(doc_no) AS number, yyyy || mm || dd AS day, vendor_tax AS tax_id, lpad(CAST(k % 100 AS VARCHAR), 5, '0') AS branch, 'user_' || split_part(split_part(text, 'user_', 2), chr(10), 1) AS username, split_part(split_part(text, 'Seller ID: ', 2), chr(10), 1) AS seller_id,
  CASE WHEN k % 3 = 0 THEN '3%' ELSE '' END AS wht_rate, CASE WHEN k % 3 = 0 THEN CAST(CAST(amt * 0.03 AS DECIMAL(18,2)) AS VARCHAR) ELSE '' END AS wht, 'Client ' || client_tax AS client, least(n_lines, 8) AS fees, CASE WHEN k % 3 = 0 THEN '53' ELSE '' END AS pnd FROM (SELECT replace(text, 'No. ' || CAST(k % 100 AS VARCHAR) || chr(10), '') AS text, * EXCLUDE text FROM {INV})""")
def x_fields(spark, d):
    r = fx.load(spark, d, fx.INVOICES).withColumn("text", F.replace("text", F.lit("(Head Office)"), F.lit("(สำนักงานใหญ่)")))
    x = F.col("text")
    plain = F.replace(x, F.lit("(สำนักงานใหญ่)"), F.lit(""))
    seller, wht = X.seller_info(x), F.col("wht_said")
    return r.withColumn("wht_said", X.withholding(x)).select(
        "doc_id", cash(X.total_amount(x)).alias("total"), cash(X.totals_block(x)["total"]).alias("block_total"), F.upper(X.invoice_no(x, "platform")).alias("number"), day(X.best_date(x)).alias("day"), X.vendor_tax_id(x, F.array(F.lit("0000000000000"))).alias("tax_id"), X.branch(plain).alias("branch"),
        seller["username"].alias("username"), seller["seller_id"].alias("seller_id"), F.coalesce(wht["rate"], F.lit("")).alias("wht_rate"), cash(wht["amount"]).alias("wht"), X.client_identity(x, F.col("vendor_tax"))["name"].alias("client"), F.size(X.fee_lines(x)).cast("long").alias("fees"), X.guess_pnd(x).alias("pnd"),
    )


@query(f"""
SELECT doc_id, CAST(amt AS VARCHAR) AS total, CASE WHEN k % 3 = 0 THEN '3%' ELSE '' END AS rate, CASE WHEN k % 3 = 0 THEN CAST(CAST(amt * 0.03 AS DECIMAL(18,2)) AS VARCHAR) ELSE '' END AS wht, CASE WHEN k % 5 = 0 THEN doc_no WHEN k % 5 < 4 THEN upper(doc_no) ELSE doc_no END AS reference, strpos(lower(text), 'invoice') - 1 AS first_invoice FROM {INV}""")
def x_ranked(spark, d):
    r = fx.load(spark, d, fx.INVOICES)
    r = r.withColumn("a", X.amounts("text"))
    a = F.col("a")
    glued = F.replace("text", F.substring("doc_no", 1, 19), F.concat(F.substring("doc_no", 1, 19), F.lit("\n")))
    return r.select("doc_id", cash(a["total"]).alias("total"), F.coalesce(a["wht_rate"], F.lit("")).alias("rate"), cash(a["wht_amount"]).alias("wht"), F.when(F.col("k") % 5 == 0, X.full_reference(glued, "filename")).otherwise(X.full_reference("text", "filename")).alias("reference"), F.element_at(keyword_positions("text", ["invoice"]), 1).cast("long").alias("first_invoice"))


@query(f"""
WITH f AS (SELECT l_orderkey AS doc_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, 'fee ' || l_partkey || ' THB ' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)) AS i FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))
SELECT doc_id, count(*) AS lines, CAST(sum(p) AS VARCHAR) AS paid FROM f WHERE i <= 8 GROUP BY doc_id""")
def x_fee_lines(spark, d):
    r = fx.load(spark, d, fx.INVOICES)
    lines = r.select("doc_id", F.explode(X.fee_lines("text")).alias("f"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum("f.inc_vat").cast("string").alias("paid"))


@query("SELECT doc_id, CAST(length(text) - length(replace(lower(text), 'the', '')) AS BIGINT) // 3 AS hits, CASE WHEN strpos(lower(text), 'the') > 0 THEN strpos(lower(text), 'the') - 1 ELSE -1 END AS first_hit, CASE WHEN length(regexp_extract(text, '[0-9]+', 0)) > 0 THEN regexp_extract(text, '[0-9]+', 0) ELSE '' END AS number FROM documents")
def x_positions(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    found = keyword_positions("text", ["the"])
    numbers = find_all("text", "[0-9]+")
    first = nearest(numbers, F.array(F.lit(0)), lambda m: F.lit(0))
    return docs.select("doc_id", F.size(found).cast("long").alias("hits"), F.coalesce(F.get(found, 0), F.lit(-1)).cast("long").alias("first_hit"), F.coalesce(first, F.lit("")).alias("number"))


@query(f"SELECT doc_id, 'V' || lpad(CAST(k AS VARCHAR), 16, '1') AS payment_no, '1234-' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') || '-0001' AS billing_id, lpad(CAST(k AS VARCHAR), 10, 'Q') AS reference, CAST(amt AS VARCHAR) AS paid, 'CARD' AS method, 'NO' AS vat, 'ads_receipt' AS kind, CAST(k % 3 + 1 AS INT) AS page FROM {RAW}")
def x_ads(spark, d):
    r = fx.load(spark, d, fx.LEDGER_RAW)
    k = F.col("k").cast("string")
    x = F.concat(F.lit("Google Ads payment receipt page "), (F.col("k") % 3 + 1).cast("string"), F.lit(" of 3 Payment V"), F.lpad(k, 16, "1"), F.lit(" Billing ID: 1234-"), F.lpad((F.col("k") % 10000).cast("string"), 4, "0"), F.lit("-0001 Reference number: "), F.lpad(k, 10, "Q"), F.lit(" visa THB 0.01 THB "), F.col("amt").cast("string"))
    ads = X.ads_fields(x)
    return r.select("doc_id", ads["payment_no"].alias("payment_no"), ads["billing_id"].alias("billing_id"), ads["reference"].alias("reference"), cash(X.max_amount(x, "amount paid")).alias("paid"), X.payment_method(x, F.lit("GOOGLE")).alias("method"), X.guess_vat(F.lit("GOOGLE"), x).alias("vat"), C.doc_kind(F.lit("GOOGLE"), x).alias("kind"), X.segment_ids(x)["page_x"].alias("page"))


# --- classification -------------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, platform AS label, CASE platform WHEN 'THAI_TAX' THEN '' WHEN 'SHOPEE' THEN 'Shopee' WHEN 'LAZADA' THEN 'Lazada' WHEN 'META' THEN 'Meta' ELSE 'TikTok' END AS vendor, CASE platform WHEN 'META' THEN 'meta_ads' WHEN 'THAI_TAX' THEN 'generic' ELSE 'marketplace' END AS route, CASE platform WHEN 'META' THEN 'ads_meta' WHEN 'THAI_TAX' THEN 'online_other' ELSE 'marketplace_' || lower(platform) END AS rule FROM {INV}")
def c_classify(spark, d):
    r = fx.load(spark, d, fx.INVOICES)
    own = F.array(F.lit("0000000000000"))
    labelled = C.with_platform(r, "text", "filename", own, "label")
    return labelled.select("doc_id", "label", C.detect_vendor("text").alias("vendor"), C.route_segment(F.col("label"), F.lit("UNKNOWN")).alias("route"), C.rule_key(F.col("label")).alias("rule"))


def score_sql() -> str:
    """The rules as SQL over a column of words made of each document's text and a platform's words."""
    t = "lower(t)"
    parts = {p: ["0"] for p in C.PLATFORMS}
    for p, pattern, w in C.REGEX_RULES:
        parts[p].append(f"CASE WHEN regexp_matches({t}, '(?i){pattern}') THEN {w} ELSE 0 END")
    for p, w, words in C.WORD_RULES:
        parts[p] += [f"CASE WHEN contains({t}, '{x}') THEN {w} ELSE 0 END" for x in words]
    parts["SHOPEE"].append(f"CASE WHEN contains({t}, 'trs') AND (contains({t}, 'shopee') OR contains({t}, 'tiv') OR contains({t}, 'tir')) THEN 18 ELSE 0 END")
    for pattern, w in C.THAI_RULES:
        parts["THAI_TAX"].append(f"CASE WHEN regexp_matches({t}, '(?i){pattern}') THEN {w} ELSE 0 END")
    parts["THAI_TAX"].append(f"CASE WHEN regexp_matches({t}, '\\b\\d{{13}}\\b') THEN 70 ELSE 0 END")
    sums = ", ".join(f"{' + '.join(v)} AS {p}" for p, v in parts.items())
    return f"""
WITH w AS (SELECT doc_id, text || ' ' || CASE doc_id % 6 WHEN 0 THEN 'facebook ads receipt' WHEN 1 THEN 'google adwords' WHEN 2 THEN 'Lazada invoice' WHEN 3 THEN 'shopee tiv-abc trs' WHEN 4 THEN 'tax invoice 1234567890123 branch 00001' ELSE '' END AS t FROM documents), s AS (SELECT doc_id, {sums} FROM w),
a AS (SELECT * EXCLUDE THAI_TAX, CAST(floor(THAI_TAX * CASE WHEN greatest(META, GOOGLE, SPX) >= 70 THEN 0.25 WHEN greatest(SHOPEE, LAZADA, TIKTOK) >= 55 THEN 0.45 ELSE 1.0 END) AS INT) AS THAI_TAX FROM s)
SELECT doc_id, META AS meta, GOOGLE AS google, SHOPEE AS shopee, LAZADA AS lazada, TIKTOK AS tiktok, SPX AS spx, THAI_TAX AS thai_tax, greatest(META, GOOGLE, SHOPEE, LAZADA, TIKTOK, SPX, THAI_TAX) AS best FROM a"""


@query(score_sql())
def c_scores(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    k = F.col("doc_id") % 6
    more = F.when(k == 0, "facebook ads receipt").when(k == 1, "google adwords").when(k == 2, "Lazada invoice").when(k == 3, "shopee tiv-abc trs").when(k == 4, "tax invoice 1234567890123 branch 00001").otherwise("")
    scored = C.with_scores(docs.withColumn("t", F.concat("text", F.lit(" "), more)), "t", F.lit(""), F.array().cast("array<string>"), "s")
    return scored.select("doc_id", *(F.col(f"s.{p}").alias(p.lower()) for p in C.PLATFORMS), C.argmax_label(F.col("s"))["score"].alias("best"))


@query("""
SELECT page_id, CASE WHEN url LIKE '%/en/%' THEN 'META' ELSE 'UNKNOWN' END AS hint, CASE WHEN page_id % 3 = 0 THEN 'receipt' WHEN page_id % 3 = 1 THEN 'other' ELSE 'tax_invoice' END AS kind, CASE WHEN page_id % 2 = 0 THEN 'Shipping Expense' ELSE 'Marketplace Expense' END AS category, CASE WHEN page_id % 2 = 0 THEN ['lazada', 'spx'] ELSE ['spx'] END AS hits, page_id % 2 = 1 AS ads,
  CASE WHEN page_id % 2 = 0 THEN 'LAZADA' ELSE 'SHOPEE' END AS refined, CASE WHEN page_id % 2 = 0 THEN 'THAI_TAX' ELSE 'SPX' END AS of_row FROM pages""")
def c_hints(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    even = F.col("page_id") % 2 == 0
    kind = F.when(F.col("page_id") % 3 == 0, "Official RECEIPT").when(F.col("page_id") % 3 == 1, "nothing").otherwise("Tax  Invoice")
    body = F.when(F.col("url").contains("/en/"), "paid to Meta Platforms Ireland").otherwise("plain page")
    return p.select(
        "page_id", C.platform_hint(body, F.lit("scan.pdf")).alias("hint"), C.doc_kind(F.lit("UNKNOWN"), kind).alias("kind"), C.expense_category(F.when(even, "Delivery fee").otherwise("misc")).alias("category"), C.keyword_hits(F.when(even, "Lazada by SPX").otherwise("spx"), ("lazada", "tiktok", "spx")).alias("hits"), C.ads_hint(F.when(even, "address").otherwise("my ads")).alias("ads"),
        C.refine_hint(F.when(even, "lazada lzd lazada invoice seller center").otherwise("hello"), F.lit("SHOPEE")).alias("refined"), C.platform_of_row(F.lit(""), F.lit(""), F.when(even, "").otherwise("Shopee Express"), F.lit("1234567890123")).alias("of_row"),
    )


# --- lookups --------------------------------------------------------------------------------------------------------
@query(f"""
SELECT r.doc_id, coalesce(CASE WHEN regexp_matches(v.vendor_code, '^C\\d{{5}}$') THEN v.vendor_code END, nullif(trim(r.D_vendor_code), ''), 'Unknown') AS vendor, coalesce(CASE WHEN a.account <> 'na' AND r.K_account = '' THEN a.account END, r.K_account) AS account, coalesce(n.n_name, r.A_company_name) AS company
FROM (SELECT *, '0' || lpad(CAST(doc_id % 97 + 1000 AS VARCHAR), 12, '9') AS vt, CASE _platform WHEN 'SHOPEE' THEN 'marketplace_shopee' WHEN 'META' THEN 'ads_meta' WHEN 'LAZADA' THEN 'marketplace_lazada' ELSE 'x' END AS rk FROM {ROWS}) r
LEFT JOIN ({fx.duck(fx.VENDORS)}) v ON v.client_tax_id = r._client_tax_id AND v.vendor_tax_id = r.vt LEFT JOIN ({fx.duck(fx.ACCOUNTS)}) a ON a.client_tax_id = r._client_tax_id AND a.rule_key = r.rk LEFT JOIN nation n ON lpad(CAST(n.n_nationkey AS VARCHAR), 13, '0') = r._client_tax_id""")
def j_codes(spark, d):
    rows = fx.load(spark, d, fx.LEDGER).withColumn("E_tax_id_13", F.concat(F.lit("0"), F.lpad((F.col("doc_id") % 97 + 1000).cast("string"), 12, "9")))
    out = J.vendor_code(rows, fx.load(spark, d, fx.VENDORS))
    out = J.gl_account(out, fx.load(spark, d, fx.ACCOUNTS), C.rule_key(F.col("_platform")))
    clients = spark.read.parquet(f"{d}/nation.parquet").select(F.lpad(F.col("n_nationkey").cast("string"), 13, "0").alias("client_tax_id"), F.col("n_name").alias("tag"))
    return J.company_name(out, clients).select("doc_id", F.col("D_vendor_code").alias("vendor"), F.col("K_account").alias("account"), F.col("A_company_name").alias("company"))


@query("""
WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS w FROM part UNION SELECT DISTINCT p_name FROM part), o AS (SELECT w, row_number() OVER (ORDER BY length(w) DESC, w) AS i FROM w WHERE w <> '')
SELECT p_partkey, (SELECT 'EWL' || lpad(CAST(i AS VARCHAR), 3, '0') FROM o WHERE contains(p.p_name, w) ORDER BY i LIMIT 1) AS wallet, right(lpad(CAST(p_partkey AS VARCHAR), 4, '0'), 4) AS last4 FROM part p""")
def j_contains(spark, d):
    from pyspark.sql import Window

    p = spark.read.parquet(f"{d}/part.parquet")
    words = p.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("keyword")).union(p.select("p_name")).distinct().where("keyword <> ''")
    dim = words.withColumn("ord", F.row_number().over(Window.orderBy(F.length("keyword").desc(), "keyword"))).withColumn("wallet_code", F.concat(F.lit("EWL"), F.lpad(F.col("ord").cast("string"), 3, "0")))
    out = J.contains_longest_first(p, F.col("p_name"), dim, "keyword", "wallet_code", "wallet")
    return out.select("p_partkey", "wallet", J.last4(F.concat(F.lit("visa **** "), F.lpad(F.col("p_partkey").cast("string"), 4, "0"))).alias("last4"))


@query(f"""
WITH s AS (SELECT DISTINCT lpad(CAST(s_suppkey AS VARCHAR), 13, '0') AS id, s_suppkey FROM supplier)
SELECT r.doc_id, CASE WHEN r.k % 3 = 0 THEN r.client_tax ELSE '' END AS own_inside, n.n_nationkey IS NULL AS foreign_id, coalesce('ADV' || lpad(CAST(r.k % 25 AS VARCHAR), 3, '0'), '') AS card FROM {RAW} r LEFT JOIN nation n ON n.n_nationkey = r.k % 30 """)
def j_sets(spark, d):
    r = fx.load(spark, d, fx.LEDGER_RAW).withColumn("nk", (F.col("k") % 30).cast("int"))
    nations = spark.read.parquet(f"{d}/nation.parquet")
    ids = [f"{i:013d}" for i in range(25)]
    keyed = r.withColumn("_client_tax_id", F.lit("c")).withColumn("l4", F.lpad((F.col("k") % 25).cast("string"), 4, "0"))
    cards = nations.select(F.lit("c").alias("client_tax_id"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0").alias("last4"), F.concat(F.lit("ADV"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("card_id"))
    known = J.only_listed(keyed, nations.select("n_nationkey"), "nk", "n_nationkey").withColumn("foreign_id", F.lit(False))
    foreign = J.exclude_own(keyed, nations.select("n_nationkey"), "nk", "n_nationkey").withColumn("foreign_id", F.lit(True))
    both = J.card_id(A.union_routes(known, foreign), cards, F.col("l4"))
    body = F.when(F.col("k") % 3 == 0, F.concat(F.lit("our id "), "client_tax")).otherwise("none")
    return both.select("doc_id", J.detect_client(body, F.lit("x.pdf"), ids, {}, []).alias("own_inside"), "foreign_id", F.col("_card_id").alias("card"))


@query(f"""
WITH e AS (SELECT user_id AS doc_id, CASE event_type WHEN 'click' THEN 'L_description' WHEN 'view' THEN 'T_note' WHEN 'error' THEN 'A_seq' ELSE 'K_account' END AS c, arg_max(CAST(value AS VARCHAR), (ts, CAST(value AS VARCHAR))) AS v FROM events GROUP BY ALL)
SELECT r.doc_id, coalesce(l.v, r.L_description) AS L_description, coalesce(t.v, r.T_note) AS T_note, coalesce(a.v, r.K_account) AS K_account FROM {ROWS} r LEFT JOIN e l ON l.doc_id = r.doc_id AND l.c = 'L_description' LEFT JOIN e t ON t.doc_id = r.doc_id AND t.c = 'T_note' LEFT JOIN e a ON a.doc_id = r.doc_id AND a.c = 'K_account'""")
def j_edits(spark, d):
    return J.apply_edits(fx.load(spark, d, fx.LEDGER).withColumn("A_seq", F.lit("1")), fx.load(spark, d, fx.EDITS)).select("doc_id", "L_description", "T_note", "K_account")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'new ' || n_name ELSE n_name END AS tag FROM nation UNION ALL SELECT 100 + r_regionkey, r_name FROM region")
def j_overrides(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.col("n_name").alias("tag"))
    r = spark.read.parquet(f"{d}/region.parquet").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("tag"))
    changed = n.where("n_nationkey % 2 = 0").withColumn("tag", F.concat(F.lit("new "), "tag")).union(r)
    return J.with_overrides(n, changed, ["n_nationkey"])


# --- ledger rows ----------------------------------------------------------------------------------------------------
GRP = "CASE _platform WHEN 'META' THEN 'Advertising Expense' WHEN 'SPX' THEN 'Delivery/Logistics Expense' WHEN 'UNKNOWN' THEN 'Other Expense' ELSE 'Marketplace Expense' END"


@query(f"""
SELECT doc_id, {GRP} AS U_group, coalesce(nullif(trim(L_description), ''), {GRP}) AS L_description, coalesce(nullif(J_price_type, ''), CASE WHEN _platform = 'META' THEN '3' WHEN _platform = 'UNKNOWN' THEN '1' ELSE '1' END) AS J_price_type, CASE WHEN K_account = {GRP} THEN '' ELSE K_account END AS K_account FROM {ROWS}""")
def p_defaults(spark, d):
    return L.platform_defaults(fx.load(spark, d, fx.LEDGER)).select("doc_id", "U_group", "L_description", "J_price_type", "K_account")


@query(f"""
SELECT doc_id, regexp_replace(E_tax_id_13, '[^0-9]', '', 'g') AS E_tax_id_13, lpad(F_branch_5, 5, '0') AS F_branch_5, CASE WHEN upper(O_vat_rate) IN ('NO', 'EXEMPT') THEN 'NO' ELSE '7%' END AS O_vat_rate, coalesce(nullif(M_qty, ''), '1') AS M_qty, coalesce(nullif(R_paid_amount, ''), '0') AS R_paid_amount, replace(C_reference, ' ', '') AS C_reference, substr(regexp_replace(B_doc_date, '[^0-9]', '', 'g'), 1, 8) AS B_doc_date, 22 AS n_columns FROM {ROWS}""")
def p_normalize(spark, d):
    out = L.normalize_row(fx.load(spark, d, fx.LEDGER))
    locked = L.lock_schema(out.withColumnRenamed("doc_id", "_doc_id"))
    width = len([c for c in locked.columns if not c.startswith("_")])
    return locked.select(F.col("_doc_id").alias("doc_id"), "E_tax_id_13", "F_branch_5", "O_vat_rate", "M_qty", "R_paid_amount", "C_reference", "B_doc_date", F.lit(width).alias("n_columns"))


@query(f"""
SELECT b.doc_id, CASE WHEN b.R_paid_amount = '' THEN '5.00' ELSE b.R_paid_amount END AS R_paid_amount, b.K_account, CASE WHEN b.L_description = '' AND b.doc_id % 2 = 1 THEN 'patched' ELSE b.L_description END AS L_description FROM {ROWS} b""")
def p_merge(spark, d):
    rows = fx.load(spark, d, fx.LEDGER)
    patch = rows.select("doc_id", F.lit("5.00").alias("R_paid_amount"), F.lit("x").alias("K_account"), F.when(F.col("doc_id") % 2 == 1, "patched").otherwise(" ").alias("L_description"))
    return L.merge_patch(rows, patch).select("doc_id", "R_paid_amount", "K_account", "L_description")


@query(f"""
WITH t AS (SELECT *, CASE WHEN k % 6 = 4 THEN 'Client A' WHEN k % 6 = 5 THEN 'Client B' ELSE 'UNKNOWN' END AS client FROM {RAW})
SELECT doc_id, client, CASE WHEN client = 'Client B' OR platform NOT IN ('UNKNOWN', 'SHOPEE', 'META') THEN 'SKIP' ELSE 'KEEP' END AS keep, CASE WHEN k % 6 = 0 THEN '' WHEN k % 6 = 5 THEN 'platform:mismatch' WHEN platform = 'META' THEN '' ELSE 'platform:mismatch' END AS mismatch FROM t""")
def f_prefilter(spark, d):
    r = fx.load(spark, d, fx.LEDGER_RAW).withColumn("_platform", F.col("platform"))
    out = L.prefilter_files(r, {"Client A": ("facebook",), "Client B": ("scan",)}, ("Client A",), ("SHOPEE", "META"), False)
    out = L.filter_mismatch(out.withColumn("A_company_name", F.lit("")), (), ("SHOPEE", "META"), True)
    return out.select("doc_id", F.col("_client").alias("client"), "keep", F.col("_mismatch").alias("mismatch"))


@query(f"SELECT count(*) AS n, min(doc_id) AS first_id FROM {ROWS} WHERE _platform = 'META' AND contains(lower(L_description), 'desc 4')")
def f_search(spark, d):
    rows = fx.load(spark, d, fx.LEDGER).withColumn("_status", F.when(F.col("_platform") == "META", "ok").otherwise("x"))
    return L.search(rows, "OK", "DESC 4", ("L_description", "T_note")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


# --- checks and status ----------------------------------------------------------------------------------------------
BAD = """list_filter([CASE WHEN NOT (doc_id % 7 = 0) THEN 'B_doc_date:invalid_date' END, CASE WHEN NOT regexp_matches(F_branch_5, '^[0-9]{5}$') THEN 'F_branch_5:invalid_branch' END, CASE WHEN NOT regexp_matches(E_tax_id_13, '^[0-9]{13}$') THEN 'E_tax_id_13:invalid_tax_id' END,
  CASE WHEN J_price_type = '9' THEN 'J_price_type:invalid_price_type' END, CASE WHEN O_vat_rate NOT IN ('7%', 'NO') THEN 'O_vat_rate:invalid_vat_rate' END], lambda x: x IS NOT NULL)"""


@query(f"""
WITH v AS (SELECT *, {BAD} AS bad FROM {ROWS})
SELECT doc_id, array_to_string(bad, ',') AS errors, CASE WHEN len(bad) > 0 OR NOT (doc_id % 2 = 0 AND doc_id % 6 < 4) THEN 'NEEDS_REVIEW' ELSE 'OK' END AS status FROM v""")
def e_validate(spark, d):
    out = E.status(E.validate(fx.load(spark, d, fx.LEDGER)))
    return out.select("doc_id", F.array_join("_errors", ",").alias("errors"), F.col("_status").alias("status"))


@query(f"""
SELECT doc_id, array_to_string(list_filter([CASE WHEN _platform = 'META' AND O_vat_rate <> 'NO' THEN 'ads_vat_must_be_NO' END, CASE WHEN _platform NOT IN ('META', 'UNKNOWN') AND O_vat_rate <> '7%' THEN 'marketplace_vat_must_be_7%' END, CASE WHEN NOT (doc_id % 2 = 0 AND doc_id % 6 < 4) THEN 'missing_paid_amount' END], lambda x: x IS NOT NULL), ',') AS warnings FROM {ROWS}""")
def e_warnings(spark, d):
    return E.warnings(fx.load(spark, d, fx.LEDGER)).select("doc_id", F.array_join("_validation_warnings", ",").alias("warnings"))


@query(f"""
SELECT doc_id, CASE WHEN doc_id % 7 < 4 THEN split_part(k, '|', 1) WHEN doc_id % 7 = 6 AND NOT leap THEN split_part(k, '|', 2) ELSE '' END AS B_doc_date, CASE WHEN doc_id % 6 < 4 THEN split_part(k, '|', 3) ELSE '0' END AS N_unit_price, CASE doc_id % 4 WHEN 3 THEN '5%' WHEN 2 THEN '0' ELSE '3%' END AS P_wht, CASE WHEN doc_id % 4 = 2 THEN '' ELSE '53' END AS S_pnd, lpad(F_branch_5, 5, '0') AS F_branch_5, C_reference AS G_invoice_no
FROM (SELECT r.*, q.yyyy || q.mm || q.dd || '|' || CAST(CAST(q.yyyy AS INT) + 543 AS VARCHAR) || q.mm || q.dd || '|' || CAST(q.amt AS VARCHAR) AS k, q.mm || q.dd = '0229' AS leap FROM {ROWS} r JOIN {RAW} q USING (doc_id))""")
def e_format(spark, d):
    rows = fx.load(spark, d, fx.LEDGER).withColumn("S_pnd", F.lit("")).withColumn("H_invoice_date", F.lit("")).withColumn("I_tax_purchase_date", F.lit(""))
    return E.format_row(rows).select("doc_id", "B_doc_date", "N_unit_price", "P_wht", "S_pnd", "F_branch_5", "G_invoice_no")


@query(f"SELECT count(*) AS rows, count(*) FILTER (doc_id % 10 = 0) AS blank_rows, '' AS problem FROM {ROWS}")
def e_export_set(spark, d):
    rows = fx.load(spark, d, fx.LEDGER)
    from .schema import LEDGER

    blanked = rows.select(*(F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.concat(F.lit("v"), F.col("doc_id").cast("string"))).alias(c) for c in LEDGER))
    return E.validate_export(blanked)


# --- summaries and windows ------------------------------------------------------------------------------------------
def summary_sql() -> str:
    base = f"""SELECT *, CASE WHEN doc_id % 6 < 4 AND doc_id % 2 = 0 THEN amt END AS paid, CASE WHEN doc_id % 7 < 4 THEN strptime(q, '%Y%m%d')::DATE WHEN doc_id % 7 = 6 AND right(q, 4) <> '0229' THEN strptime(CAST(CAST(left(q, 4) AS INT) + 543 AS VARCHAR) || right(q, 4), '%Y%m%d')::DATE END AS d, CASE doc_id % 9 WHEN 0 THEN 'Unknown' ELSE D_vendor_code END AS vendor, coalesce(nullif(A_company_name, ''), 'Unknown') AS client
      FROM (SELECT r.*, s.amt, s.yyyy || s.mm || s.dd AS q FROM {ROWS} r JOIN {RAW} s USING (doc_id))"""
    one = lambda dim, value: f"SELECT '{dim}' AS dimension, {value} AS value, count(*) AS rows, count(*) FILTER (vendor <> 'Unknown') AS with_vendor, strftime(min(d), '%Y%m%d') AS first_date, strftime(max(d), '%Y%m%d') AS last_date, CAST(coalesce(sum(paid), 0) AS VARCHAR) AS paid FROM b GROUP BY ALL"
    return f"WITH b AS ({base}) " + " UNION ALL ".join([one("platform", "_platform"), one("grp", "'Unknown'"), one("vendor", "vendor"), one("client", "client"), one("method", "_extraction_method"), one("all", "''")])


@query(summary_sql().replace("CAST(coalesce(sum(paid), 0) AS VARCHAR)", "CAST(CAST(coalesce(sum(paid), 0) AS DECIMAL(28,2)) AS VARCHAR)"))
def a_export_summary(spark, d):
    return A.export_summary(fx.load(spark, d, fx.LEDGER)).withColumns({"paid": F.col("paid").cast("string"), "first_date": F.date_format("first_date", "yyyyMMdd"), "last_date": F.date_format("last_date", "yyyyMMdd")})


@query(f"""
SELECT job_id, count(*) AS files, count(*) FILTER (st = 'F') AS done_files, count(*) FILTER (st = 'O') AS needs_review_files, count(*) FILTER (st NOT IN ('F', 'O')) AS error_files, CAST(100 AS INT) AS percent, CASE WHEN count(*) FILTER (st NOT IN ('F', 'O')) > 0 THEN 'error' ELSE 'done' END AS state FROM {RAW} GROUP BY job_id""")
def a_jobs(spark, d):
    r = fx.load(spark, d, fx.LEDGER_RAW)
    files = r.withColumn("state", F.when(F.col("st") == "F", "done").when(F.col("st") == "O", "needs_review").otherwise("error"))
    s = A.job_summary(files, files)
    return s.join(A.progress(s).select("job_id", "percent"), "job_id").select("job_id", "files", "done_files", "needs_review_files", "error_files", "percent", "state")


@query(f"SELECT {GRP.replace('_platform', 'platform')} AS grp, platform, count(*) AS rows FROM {RAW} GROUP BY ROLLUP (1, 2)")
def a_rollup(spark, d):
    return A.platform_group_rollup(fx.load(spark, d, fx.LEDGER_RAW).withColumn("_platform", F.col("platform")))


@query(f"SELECT platform, 'unknown' AS method, count(*) AS rows FROM {RAW} GROUP BY platform")
def a_platform_stats(spark, d):
    return A.platform_stats(fx.load(spark, d, fx.LEDGER_RAW).select(F.col("platform").alias("_platform"), F.lit("").alias("U_group"), F.lit("").alias("_extraction_method")))


@query("SELECT event_type AS method, CAST(user_id % 5 AS VARCHAR) AS platform, count(*) AS calls, round(avg(value), 6) AS avg_seconds FROM events GROUP BY ALL")
def a_processing(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("method"), (F.col("user_id") % 5).cast("string").alias("platform"), F.col("value").alias("seconds"))
    return A.processing_stats(e)


@query(f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY file_index, doc_id) AS VARCHAR) AS A_seq, first_value(nullif(D_vendor_code, '') IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY file_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_vendor FROM {ROWS}")
def w_sequence(spark, d):
    out = A.sequence(fx.load(spark, d, fx.LEDGER))
    return G.first_filled_in_order(out, "D_vendor_code", ["job_id"], "file_index").select("doc_id", "A_seq", F.col("first_D_vendor_code").alias("first_vendor"))


@query("SELECT user_id AS doc_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def w_latest(spark, d):
    return A.latest(fx.load(spark, d, fx.EDITS), ["doc_id"], "saved_at", "event_id").select("doc_id", "event_id")


@query("SELECT event_id, ts AS saved_at FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def t_history(spark, d):
    return A.history(spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").alias("saved_at")), 50, "saved_at", "event_id")


@query("SELECT w AS keyword, row_number() OVER (ORDER BY length(w) DESC, i) AS place FROM (SELECT p_type AS w, min(p_partkey) AS i FROM part GROUP BY p_type)")
def t_longest_first(spark, d):
    dim = spark.read.parquet(f"{d}/part.parquet").groupBy(F.col("p_type").alias("keyword")).agg(F.min("p_partkey").alias("ord"))
    return A.longest_first(dim, "keyword").select("keyword", F.col("place").cast("long").alias("place"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'view', n DESC, event_type) AS i FROM c) SELECT user_id, max(event_type) FILTER (i = 1) AS event_type, max(n) AS most FROM m GROUP BY user_id")
def t_majority(spark, d):
    return A.majority(spark.read.parquet(f"{d}/events.parquet"), ["user_id"], "event_type", "view")


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN ['a', 'view'] ELSE ['a', 'b', event_type] END AS errors, CASE WHEN event_type = 'view' THEN 1.0 / 2 ELSE 1.0 / 3 END AS near FROM events")
def t_sets(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    old = F.when(F.col("event_type") == "view", F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    merged = E.merge_errors(old, F.array(F.lit("a"), F.col("event_type")))
    return e.select("event_id", merged.alias("errors"), G.jaccard(F.array(F.lit("a")), merged).alias("near"))


# --- segments -------------------------------------------------------------------------------------------------------
SEG = f"""
WITH p AS (SELECT *, lag(blank) OVER w AS lb, lag(part) OVER w AS lp FROM {PAGES} WINDOW w AS (PARTITION BY doc_id ORDER BY page_index)), b AS (SELECT *, CASE WHEN NOT blank AND lb = false AND part <> lp THEN 1 ELSE 0 END AS br FROM p),
s AS (SELECT *, CAST(sum(br) OVER (PARTITION BY doc_id ORDER BY page_index) AS INT) AS segment_index FROM b)"""


@query(SEG + " SELECT doc_id, page_index, br AS breaks, segment_index FROM s")
def g_split(spark, d):
    pages = fx.load(spark, d, fx.PAGES)
    return G.split_segments(G.profile_pages(pages)).select("doc_id", "page_index", "breaks", "segment_index")


@query(SEG + """ SELECT doc_id, segment_index, list(page_index ORDER BY page_index) AS page_indices, coalesce('INV' || lpad(CAST(doc_id * 10 + arg_min(part, page_index) FILTER (NOT blank) AS VARCHAR), 8, '0'), '') AS invoice_no, CASE WHEN count(*) FILTER (NOT blank) >= count(*) FILTER (blank) + CASE WHEN 'tax_invoice' < 'blank' THEN 0 ELSE 1 END THEN 'tax_invoice' ELSE 'blank' END AS doc_kind,
  length(trim(string_agg(text, chr(10) || chr(10) ORDER BY page_index), ' ' || chr(10) || chr(9))) AS merged_text_len FROM s GROUP BY doc_id, segment_index""")
def g_segments(spark, d):
    return G.segment_documents(fx.load(spark, d, fx.PAGES)).select("doc_id", "segment_index", "page_indices", "invoice_no", "doc_kind", "merged_text_len")


@query(SEG + " SELECT doc_id, count(*) AS pages, count(DISTINCT segment_index) AS segments FROM s GROUP BY doc_id")
def g_summary(spark, d):
    return G.segment_summary(G.segment_documents(fx.load(spark, d, fx.PAGES))).select("doc_id", "pages", "segments")


@query(SEG + """ SELECT doc_id, segment_index, CASE WHEN NOT bool_or(NOT blank) OR doc_id % 4 = 0 THEN 'generic' WHEN doc_id % 4 = 1 THEN 'meta_ads' WHEN doc_id % 4 = 2 THEN 'google_ads' ELSE 'marketplace' END AS route,
  CASE WHEN NOT bool_or(NOT blank) OR doc_id % 4 = 0 THEN 'enrichment' ELSE 'none' END AS queue FROM s GROUP BY doc_id, segment_index""")
def g_routes(spark, d):
    """Pages of a quarter of the documents name no platform, the others Meta, Google or Lazada."""
    k = F.col("doc_id") % 4
    named = F.when(k == 1, "\nMeta Platforms Ireland").when(k == 2, "\nGoogle Asia Pacific").when(k == 3, "\nTHMPTI1234567890").otherwise("")
    pages = fx.load(spark, d, fx.PAGES).withColumn("text", F.when(F.col("blank"), F.col("text")).otherwise(F.concat("text", named)))
    out = route_segments(G.segment_documents(pages), JobConfig())
    return out.select("doc_id", "segment_index", "route", F.col("_queue").alias("queue"))


# --- sources --------------------------------------------------------------------------------------------------------
@query("""
WITH d AS (SELECT doc_id, doc_id % 10 AS j, CASE doc_id % 8 WHEN 7 THEN 'skip:unknown:unsupported_content_type:text/html' WHEN 6 THEN 'skip:unknown:empty' END AS own FROM documents), n AS (SELECT *, count(*) FILTER (own IS NULL) OVER (PARTITION BY j ORDER BY doc_id) AS nth FROM d)
SELECT doc_id, coalesce(own, CASE WHEN nth > 10 THEN 'skip:unknown:too_many_files' END) AS reject_reason FROM n""")
def src_admit(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    k = F.col("doc_id") % 8
    rows = docs.select("doc_id", (F.col("doc_id") % 10).alias("job_id"), F.col("doc_id").alias("file_index"), F.lit("  ").alias("filename"), F.when(k == 7, "text/html").when(k == 5, " ").otherwise("application/pdf").alias("content_type"), F.when(k == 6, 0).otherwise(F.col("n_chars")).alias("n_bytes"))
    return admit(with_names(rows), max_files=10).select("doc_id", "reject_reason")


@query("SELECT doc_id, CAST(i - 1 AS INT) AS page_index, md5(list_extract(string_split(text, chr(10)), i)) AS page FROM (SELECT doc_id, text, unnest(range(1, least(15, len(string_split(text, chr(10)))) + 1)) AS i FROM documents)")
def src_pages(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\f")).alias("text"))
    return to_pages(docs, 15).select("doc_id", "page_index", F.md5(F.col("text").cast("binary")).alias("page"))


@query("SELECT doc_id, md5(text) AS whole FROM documents")
def src_assemble(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\f")).alias("text"))
    return G.assemble_text(to_pages(docs, 1 << 30), ["doc_id"], "\n").select("doc_id", F.md5(F.col("text").cast("binary")).alias("whole"))


@query("SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'ocr_empty' WHEN doc_id % 2 = 0 AND length(trim(text)) >= 120 THEN 'scan' WHEN length(trim(text)) >= 120 THEN 'layer' ELSE CASE WHEN doc_id % 2 = 0 THEN 'scan' ELSE 'layer' END END AS method, CAST(coalesce(length(text), 0) AS INT) AS text_length FROM documents")
def src_choose_text(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    even = F.col("doc_id") % 2 == 0
    return choose_text(docs.select("doc_id", F.when(~even, F.col("text")).alias("layer"), F.when(even, F.col("text")).alias("scan")), "layer", ["scan"]).select("doc_id", "method", "text_length")


@query("WITH d AS (SELECT CASE doc_id % 8 WHEN 7 THEN 'type' WHEN 6 THEN 'empty' ELSE '' END AS reason, n_chars FROM documents) SELECT CASE WHEN reason = '' THEN 'added' ELSE 'skipped' END AS outcome, reason, count(*) AS files, round(sum(n_chars) / 1e6, 3) AS megabytes FROM d GROUP BY ALL")
def src_intake(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return A.intake_report(docs.select(F.when(F.col("doc_id") % 8 == 7, "type").when(F.col("doc_id") % 8 == 6, "empty").alias("reject_reason"), F.col("n_chars").alias("n_bytes")))


@query(f"SELECT doc_id, CASE WHEN k % 7 < 4 THEN yyyy || mm || dd WHEN k % 7 = 6 AND mm || dd <> '0229' THEN CAST(CAST(yyyy AS INT) + 543 AS VARCHAR) || mm || dd ELSE '' END AS day, CASE WHEN k % 6 < 4 THEN CAST(amt AS VARCHAR) ELSE '' END AS price, CASE WHEN k % 6 < 4 THEN '' ELSE amount_text END AS raw_price FROM {RAW}")
def snk_typed(spark, d):
    rows = fx.load(spark, d, fx.LEDGER).withColumns({"H_invoice_date": F.lit(""), "I_tax_purchase_date": F.lit("")})
    accounting = rows.withColumn("N_unit_price", F.when(F.col("N_unit_price").startswith("("), F.col("N_unit_price")).otherwise(F.col("N_unit_price")))
    return typed_export(accounting).select("doc_id", day(F.col("B_doc_date")).alias("day"), cash(F.col("N_unit_price")).alias("price"), F.coalesce("N_unit_price_raw", F.lit("")).alias("raw_price"))


# --- whole jobs -----------------------------------------------------------------------------------------------------
@query(f"""
SELECT doc_id, platform, upper(doc_no) AS reference, yyyy || mm || dd AS day, CAST(amt AS VARCHAR) AS paid, CASE WHEN platform = 'META' THEN '0993000454995' ELSE vendor_tax END AS tax_id, CASE WHEN platform = 'META' THEN 'NO' ELSE '7%' END AS vat, CASE WHEN platform = 'META' THEN '3' ELSE '1' END AS price_type, CASE WHEN platform IN ('THAI_TAX') THEN 'generic' ELSE 'rule_based_' || lower(platform) END AS method FROM {INV}""")
def job_extract(spark, d):
    rows = extract(fx.load(spark, d, fx.INVOICES), JobConfig())
    return rows.select("doc_id", F.col("_platform").alias("platform"), F.upper("C_reference").alias("reference"), F.col("B_doc_date").alias("day"), F.col("R_paid_amount").alias("paid"), F.col("E_tax_id_13").alias("tax_id"), F.col("O_vat_rate").alias("vat"), F.col("J_price_type").alias("price_type"), F.col("_extraction_method").alias("method"))


@query(f"SELECT job_id, count(*) AS files, count(*) FILTER (platform <> 'META') AS done_files, count(*) FILTER (platform = 'META') AS needs_review_files, count(*) AS total_rows, 'done' AS state FROM {INV} GROUP BY job_id")
def job_run(spark, d):
    cfg = JobConfig(platforms=("SHOPEE", "LAZADA", "TIKTOK", "THAI_TAX"))
    docs = fx.load(spark, d, fx.INVOICES).select("job_id", "file_index", "doc_id", "filename", "text")
    return run_job(docs, cfg)[2].select("job_id", "files", "done_files", "needs_review_files", "total_rows", "state")


@query(f"""
SELECT file_index, job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY file_index) AS VARCHAR) AS A_seq, CASE WHEN doc_id % 6 < 4 THEN CAST(amt AS VARCHAR) ELSE '0.00' END AS R_paid_amount, CASE doc_id % 4 WHEN 1 THEN '2' WHEN 3 THEN '1.50' ELSE '1' END AS M_qty, {GRP} AS U_group FROM (SELECT r.*, q.amt FROM {ROWS} r JOIN {RAW} q USING (doc_id))""")
def job_export(spark, d):
    rows = fx.load(spark, d, fx.LEDGER).withColumn("_file_index", F.col("file_index"))
    return prepare_export(rows).select(F.col("_file_index").alias("file_index"), F.col("_job_id").alias("job_id"), "A_seq", "R_paid_amount", "M_qty", "U_group")


@query(f"SELECT doc_id, _platform AS platform, CASE WHEN length(text) <= 22000 THEN length(text) ELSE 22005 END AS chars FROM (SELECT r.*, coalesce(d.text, '') AS text FROM {ROWS} r LEFT JOIN documents d USING (doc_id)) WHERE NOT (doc_id % 7 = 0 AND regexp_matches(F_branch_5, '^[0-9]{{5}}$')) OR L_description = '' OR R_paid_amount = ''")
def job_requests(spark, d):
    rows = E.validate(L.base_row(fx.load(spark, d, fx.LEDGER)).withColumns({c: F.lit("") for c in ("H_invoice_date", "I_tax_purchase_date")}))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return enrichment_requests(rows, docs).select("doc_id", "platform", F.length("text").alias("chars"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 1 AND (R_paid_amount = '') THEN '9.50' WHEN R_paid_amount = '' THEN '0' ELSE R_paid_amount END AS paid, CASE WHEN doc_id % 3 = 1 AND L_description = '' THEN 'from model' ELSE L_description END AS description FROM {ROWS}")
def job_enrich(spark, d):
    rows = fx.load(spark, d, fx.LEDGER).withColumns({c: F.lit("") for c in ("H_invoice_date", "I_tax_purchase_date")})
    answer = F.when(F.col("doc_id") % 3 == 1, 'text {"R_paid_amount": "9.50", "L_description": "from model", "T_note": "x", "confidence": "0.9"} end').otherwise("{broken")
    return apply_enrichment(rows, rows.select("doc_id", answer.alias("response"))).select("doc_id", F.col("R_paid_amount").alias("paid"), F.col("L_description").alias("description"))


# --- streaming and sinks --------------------------------------------------------------------------------------------
@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def st_windows(spark, d):
    """A stream over the events' files appended to a table, then counted by window as a batch."""
    from .streaming.jobs import windowed_counts

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    to = work_folder(spark)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    stream.writeStream.format("parquet").option("path", f"{to}/out").option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start().awaitTermination()
    return windowed_counts(spark.read.parquet(f"{to}/out"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00'")
def st_expire(spark, d):
    from .streaming.jobs import expire_jobs

    e = spark.read.parquet(f"{d}/events.parquet").withColumnRenamed("ts", "updated_at")
    return expire_jobs(e, "2024-01-06 00:00:00", 86_400).select("event_id")


from . import platform_queries, store_queries  # noqa: E402, F401  their queries register themselves
