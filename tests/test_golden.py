"""Cases with known results."""

import datetime

import pytest
from pyspark.sql import functions as F

from docledger.functions import classify as C
from docledger.functions import fields as X
from docledger.functions import text as S
from docledger.functions import values as V
from docledger.operators.ledger import base_row, lock_schema
from docledger.operators.validate import status, validate
from docledger.schema import LEDGER

CASES = [
    (lambda: S.reference_core(F.lit("Shopee-TIV-TRSPEMKP00-00000-251203-0012589.pdf")), "TRSPEMKP00-00000-251203-0012589"),
    (lambda: S.reference_core(F.lit("SPX Express-RCT-RCSPXSPR00-00000-251220-0001652.pdf")), "RCSPXSPR00-00000-251220-0001652"),
    (lambda: S.reference_core(F.lit("TTSTH20250008665805.pdf")), "TTSTH20250008665805"),
    (lambda: S.squash_ws(F.lit("TRSPEMKP00 - 00000 - 251203 - 0012589")), "TRSPEMKP00-00000-251203-0012589"),
    (lambda: S.fix_ocr_digits(F.lit("Seller ID 16464655O5")), "Seller ID 1646465505"),
    (lambda: V.parse_en_date(F.lit("Dec 9, 2025")), datetime.date(2025, 12, 9)),
    (lambda: V.date_from_reference(F.lit("TRSPE-251203-0012589")), datetime.date(2025, 12, 3)),
    (lambda: V.parse_date(F.lit("31/2/2025")), None),
    (lambda: V.parse_date_lenient(F.lit("9/12/2568")), datetime.date(2025, 12, 9)),
    (lambda: V.parse_vat_rate(F.lit("7%")).cast("double"), 0.07),
    (lambda: V.parse_vat_rate(F.lit("NO")).cast("double"), 0.0),
    (lambda: V.parse_vat_rate(F.lit("0.07")).cast("double"), 0.07),
    (lambda: V.parse_money(F.lit("฿1,234.5")).cast("string"), "1234.50"),
    (lambda: V.parse_money(F.lit("-5")), None),
    (lambda: V.parse_amount(F.lit("(5.00)")), None),
    (lambda: C.valid_platform(F.lit("shopee")), "SHOPEE"),
    (lambda: C.valid_platform(F.lit("ads")), "UNKNOWN"),
    (lambda: C.valid_platform(F.lit("invalid")), ""),
    (lambda: S.digits_only(F.lit(" 628,286,975 ")), "628286975"),
    (lambda: X.full_reference(F.lit("No. TRSPEMKP00-00000-25\n1203-0012589"), F.lit("x.pdf")), "TRSPEMKP00-00000-251203-0012589"),
    (lambda: X.invoice_no(F.lit("No. TRSPEMKP00-00000-25 of the month, ref 1203-0012589"), F.lit("SHOPEE")), "TRSPEMKP00-00000-251203-0012589"),
    (lambda: X.invoice_no(F.lit("No. RCSPXSPR00-00000-25 1220-0001652"), F.lit("SPX")), "RCSPXSPR00-00000-251220-0001652"),
    (lambda: S.normalize_text(F.lit("a​  ๑\n\n\n\nb – ฿5")), "a 1\n\nb - ฿5"),
    (lambda: S.escape_formula(F.lit("=1+1")), "'=1+1"),
    (lambda: V.branch5(F.lit("")), "00000"),
]


@pytest.mark.parametrize("n", range(len(CASES)))
def test_case(spark, n):
    make, expected = CASES[n]
    assert spark.range(1).select(make().alias("x")).first()["x"] == expected


def test_no_row_is_lost_and_the_schema_is_locked(spark):
    rows = spark.createDataFrame([("20251203", "12"), ("x", "0"), (None, None)], "B_doc_date string, R_paid_amount string")
    out = status(validate(base_row(rows)))
    locked = lock_schema(out)
    assert tuple(c for c in locked.columns if not c.startswith("_")) == LEDGER
    assert {r["_status"] for r in locked.collect()} == {"OK", "NEEDS_REVIEW"} and locked.count() == 3


# Scores added up by hand from the rules: (text, file name, own ids, platform, score).
SCORES = [
    ("Meta Platforms Ireland invoice", "x.pdf", [], "META", 165 + 16 + 10),
    ("shopee tiv-abc trs", "x.pdf", [], "SHOPEE", 110 + 22 + 10 + 10 + 18),
    ("shopee tiv-abc trs", "Shopee 1.pdf", [], "SHOPEE", 110 + 22 + 10 + 10 + 18 + 24),
    ("Tax Invoice 1234567890123 branch 00001", "x.pdf", [], "THAI_TAX", 10 + 55 + 35 + 70),
    ("Tax Invoice 1234567890123 branch 00001", "x.pdf", ["1234567890123"], "THAI_TAX", 10 + 55 + 35),
    ("rcspx awb", "SPX-waybill.pdf", [], "SPX", 145 + 10 + 10 + 10 + 55),
    ("Meta Platforms Ireland tax invoice 1234567890123", "", [], "THAI_TAX", 33),
    ("Lazada seller center", "lzd_1.pdf", [], "LAZADA", 10 + 10 + 30),
    ("a plain text", "scan.pdf", [], "META", 0),
]


def test_scores_added_by_hand(spark):
    for body, name, own, platform, score in SCORES:
        df = spark.createDataFrame([(body, name)], "t string, f string")
        got = C.with_scores(df, "t", "f", F.array(*map(F.lit, own)).cast("array<string>"), "s").first()["s"]
        assert got[platform] == score, (body, name)


def test_an_extractor_of_a_further_platform(spark):
    from docledger.plans import extract as X

    docs = spark.createDataFrame([(1, "a.pdf", "Shopee (Thailand) tiv-abcd trs1234 Grand Total 12.00"), (2, "b.pdf", "nothing here")], "doc_id long, filename string, text string")
    X.register_extractor("SHOPEE", lambda df: df.withColumn("K_account", F.when(F.col("_platform") == "SHOPEE", "610000").otherwise(F.lit(""))))
    try:
        got = {r["doc_id"]: r["K_account"] for r in X.extract(docs, X.JobConfig()).collect()}
    finally:
        X.EXTRACTORS.clear()
    assert got == {1: "610000", 2: ""}


def test_full_unicode_folding(spark):
    from docledger.functions.udfs import nfkc

    df = spark.createDataFrame([("ﬁ １ สํานัก",), (None,)], "t string")
    assert [r["x"] for r in df.select(nfkc()("t").alias("x")).collect()] == ["fi 1 สำนัก", None]


def test_large_jobs_are_numbered_in_spans(spark):
    from docledger.operators import summaries as A

    rows = [(f"j{i % 2}", (i * 7919) % 300_000, i) for i in range(500)] + [("j0", None, 900), (None, 5, 901), (None, 4, 902)]
    df = spark.createDataFrame(rows, "job_id string, file_index long, doc_id long")
    got = {r["doc_id"]: int(r["A_seq"]) for r in A.sequence(df).collect()}
    for job in ("j0", "j1", None):
        mine = sorted((r for r in rows if r[0] == job), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in mine] == list(range(1, len(mine) + 1))


def test_the_first_amount_of_a_text_of_another_platform_s_labels(spark):
    from docledger.plans.extract import JobConfig, extract

    docs = spark.createDataFrame([(1, "a.pdf", "Google Asia Pacific Grand Total 12.50"), (2, "b.pdf", "TTSTH12345678901234 Amount Due: 1,234.50 wht 99.00"), (3, None, None)], "doc_id long, filename string, text string")
    assert {r["doc_id"]: r["R_paid_amount"] for r in extract(docs, JobConfig()).collect()} == {1: "12.50", 2: "1234.50", 3: "0.00"}
