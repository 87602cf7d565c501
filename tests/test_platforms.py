"""Rows of one platform: which documents are read for it, and with what."""

import itertools

from pyspark.sql import functions as F

from docledger import fixtures as fx
from docledger.functions import classify as C
from docledger.functions import text as T
from docledger.plans.extract import JobConfig, extract, extract_platform
from docledger.schema import LEDGER

WORDS = sorted({w for rules in (C.WORD_RULES, C.FILENAME_RULES) for _, _, words in rules for w in words}) + [
    "TTSTH", "ttsth12345678901234", "THMPTI 1234567890123456", "V 1234567890123456", "RC META-ABC123456", "RCS PX ABC123456", "TIV - ABC1", "tir-abc", "trs shopee", "FB  Ads", "ＴｉｋＴｏｋ", "tik​tok", "Tax Invoice 1234567890123", "tt_shop", "plain",
]
PARTS = (
    "Grand Total 12.50", "Total VAT 1.00", "Invoice number: ABC1234567", "Invoice date: Dec 9, 2025", "2025-12-09", "Advertising service", "Branch: 7", "Tax Registration Number: 1234567890123", "Seller ID: 77", "Withholding tax 3% at 5.00 THB", "Total (Including Tax) 9.00",
    "7% (VAT) 3.00", "Paid ฿9.99 THB", "ค่าโฆษณา", "๑๒๓", "  ", "–", "ํา",
)


def documents(spark):
    names = [w.replace(" ", "_") + ".pdf" for w in WORDS]
    rows = [(f"{w}\n{PARTS[i % len(PARTS)]}\n{PARTS[i * 7 % len(PARTS)]}", "scan.pdf") for i, w in enumerate(WORDS)] + [("plain\n" + PARTS[i % len(PARTS)], n) for i, n in enumerate(names)]
    rows += [(f"{a} {b}", n) for (a, b), n in zip(itertools.combinations(WORDS, 2), itertools.cycle(["x.pdf", *names]))] + [(None, None), ("", ""), (None, "tiktok.pdf"), ("tiktok shop", None)]
    return spark.createDataFrame([(i, name, body) for i, (body, name) in enumerate(rows)], "doc_id long, filename string, text string")


def test_only_documents_that_can_not_be_a_platform_s_are_left_out(spark):
    low = documents(spark).withColumn("text", T.normalize_text("text")).withColumn("low", F.lower("text"))
    told = C.with_platform(low, "text", "filename", ())
    got = told.agg(*(F.count_if((F.col("_platform") == p) & ~C.may_be(p, F.col("low"), "filename")).alias(f"lost_{p}") for p in C.PLATFORMS), *(F.count_if(~C.may_be(p, F.col("low"), "filename")).alias(f"out_{p}") for p in C.PLATFORMS)).first()
    assert all(got[f"lost_{p}"] == 0 for p in C.PLATFORMS)
    assert all((got[f"out_{p}"] > 0) == (p != "THAI_TAX") for p in C.PLATFORMS)


def test_rows_of_one_platform_are_those_of_the_whole_job(spark):
    docs, cfg = documents(spark).where("doc_id % 5 = 0 or doc_id > 2000 or doc_id < 200"), JobConfig()
    whole = extract(docs, cfg).select("doc_id", "_platform", *LEDGER).collect()
    for platform in ("TIKTOK", "LAZADA"):
        want = sorted(tuple(r[c] for c in ("doc_id", *LEDGER)) for r in whole if r["_platform"] == platform)
        got = sorted(tuple(r) for r in extract_platform(docs, platform, cfg).select("_doc_id", *LEDGER).collect())
        assert want and got == want


def test_a_platform_s_plan_holds_only_its_own_patterns(spark):
    plan = extract_platform(documents(spark), "TIKTOK", JobConfig())._jdf.queryExecution().optimizedPlan().toString()
    assert "tax\\s*registration\\s*number" in plan and "Total\\s*Value\\s*of\\s*Services" not in plan


def test_orders_are_dealt_before_their_texts_are_made(spark):
    plan = fx.load(spark, "/root/testdata/sf0.001", fx.RECEIPTS).select("doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Customer Tax ID") < plan.index("RepartitionByExpression [o_orderkey")


def test_what_is_folded(spark):
    """Texts with signs that nothing folds are left as they are, others are folded."""
    texts = ["฿ 5", "ภาษี", "a ๑", "Ａ～", "a–b", "x y", "นํา", "é ﹣", "é　"]
    got = [r["x"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.normalize_text("t").alias("x")).collect()]
    assert got == ["฿ 5", "ภาษี", "a 1", "A~", "a-b", "x y", "นำ", "é -", "é"]
