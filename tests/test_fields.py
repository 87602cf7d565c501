"""Field functions whose patterns stand behind gates, against the patterns themselves."""

import random

from pyspark.sql import functions as F

from docledger.functions import candidates as K
from docledger.functions import fields as X
from docledger.functions import text as T

PARTS = (
    "Total (Including VAT) 1,234.50", "Grand  Total: 12.5", "Amount Due 7", "Subtotal 100", "Total (excl. VAT) 3", "ยอดที่ชำระ: ฿ 5.25", "ยอดรวมทั้งสิ้น 9", "รวมเงินก่อนภาษี 44", "VAT 7% 7.00", "ภาษีมูลค่าเพิ่ม 8", "Withholding\ttax", "WHT",
    "หักภาษี", "ณ ที่จ่าย", "RCSPXSPR00-00000-950101-0000001", "Shopee-TIV-AB1-00000-950101-1234567", "TIR-AB1-00000-950101-1234567", "trsabcd12345", "THMPTI1234567890123456", "LZD12345678", "INV-0000012", "ttsth12345678901234", "Head Office", "本社", "\n", " ", "İ", "ſ",
    "T R S ABCD12-00000-950101-1234567", "1/2/2024", "Dec 9, 2025", "20240105", "Invoice date", "\x07", "\n\n\n", "  ",
)


def texts(spark):
    rng = random.Random(8)
    every = [*PARTS, *(" ".join(rng.choice(PARTS) for _ in range(rng.randint(2, 6))) for _ in range(400))]
    return spark.createDataFrame([(t,) for t in every], "text string")


def test_a_text_that_a_pattern_matches_holds_one_of_its_words(spark):
    x = F.col("text")
    gates = [(X.TOTAL_INC, X.INC_WORDS), (X.TOTAL_EX, X.EX_WORDS), (X.VAT_AMOUNT, X.VAT_WORDS), (X.WHT_HINT, X.HINTED), *((X.DOCUMENT_NUMBERS[p], words) for p, words in X.NUMBER_WORDS.items())]
    wrong = [F.count_if(x.rlike(p) & ~T.holds(F.lower(x), *words)).alias(f"w{i}") for i, (p, words) in enumerate(gates)]
    seen = [F.count_if(x.rlike(p)).alias(f"s{i}") for i, (p, _) in enumerate(gates)]
    got = texts(spark).agg(*wrong, *seen, F.count_if(x.rlike(X.HEAD_OFFICE) != X.head_office(x)).alias("office")).first()
    assert all(got[f"w{i}"] == 0 and got[f"s{i}"] > 0 for i in range(len(gates))) and got["office"] == 0


def test_one_amount_or_date_needs_no_places(spark):
    """The short way and the one through all places agree."""
    x = F.col("text")
    number = F.regexp_extract(T.squash_ws(x), "(?i)((?:TRS|RCS)[A-Z0-9]{3,20}-\\d{5}-\\d{6}-\\d{7})", 1)
    got = texts(spark).select(
        X.best_date(x).alias("day"), K.find_all(x, "(\\d{1,2}/\\d{1,2}/\\d{4}|Dec 9, 2025|\\b\\d{8}\\b)", 1).alias("days"), number.alias("split"), T.squash_ws(F.regexp_extract(x, X.SPLIT_NUMBER, 1)).alias("found"), X.full_reference(x, F.lit("")).alias("reference"),
    ).collect()
    assert all((r["day"] is None) == (not r["days"]) for r in got)
    assert all(r["split"] == r["found"] and (not r["split"] or r["reference"] == r["split"]) for r in got) and any(r["split"] for r in got)
