"""Checks, warnings and status of ledger rows. Every row keeps its place: what is wrong is told, nothing is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.candidates import let, once
from ..functions.text import filled, text
from ..functions.values import branch5, format_rate, money_text, parse_date, parse_money, parse_wht_rate, tax13
from ..schema import DATES, LEDGER


def messages(*checks: tuple[Column, str]) -> Column:
    """array<string> of the messages whose condition holds."""
    return F.filter(F.array(*(F.when(hit, m) for hit, m in checks)), lambda x: x.isNotNull())


def validate(df: DataFrame) -> DataFrame:
    """_errors: dates, branch, tax id, price type and VAT; blanks are allowed."""
    return df.withColumn("_errors", once(("errors",), errors))


def errors() -> Column:
    bad_date = lambda c: (text(c) != "") & (~text(c).rlike("^\\d{8}$") | parse_date(c).isNull())
    checks = [(bad_date(c), f"{c}:invalid_date") for c in DATES]
    checks += [
        ((text("F_branch_5") != "") & ~text("F_branch_5").rlike("^\\d{5}$"), "F_branch_5:invalid_branch"), ((text("E_tax_id_13") != "") & ~text("E_tax_id_13").rlike("^\\d{13}$"), "E_tax_id_13:invalid_tax_id"),
        (~text("J_price_type").isin("", "1", "2", "3"), "J_price_type:invalid_price_type"), (~text("O_vat_rate").isin("", "7%", "NO"), "O_vat_rate:invalid_vat_rate"),
    ]
    return messages(*checks)


def warnings(df: DataFrame, platform: str = "_platform") -> DataFrame:
    """_validation_warnings, at most 20."""
    p = text(platform)
    checks = [
        (text("C_reference") == "", "missing_reference"), (text("T_note") != "", "note_not_empty"), (p.isin("META", "GOOGLE") & (text("O_vat_rate") != "NO"), "ads_vat_must_be_NO"),
        (p.isin("SHOPEE", "LAZADA", "TIKTOK", "SPX") & (text("O_vat_rate") != "7%"), "marketplace_vat_must_be_7%"), (F.coalesce(parse_money("R_paid_amount"), F.lit(0)) == 0, "missing_paid_amount"),
        ((p == "THAI_TAX") & (text("E_tax_id_13") == ""), "thai_tax_missing_tax_id"), ((p == "THAI_TAX") & (text("G_invoice_no") == ""), "thai_tax_missing_invoice"),
    ]
    return df.withColumn("_validation_warnings", F.slice(messages(*checks), 1, 20))


def status(df: DataFrame, body: str | None = None) -> DataFrame:
    """_status and _status_reason: ERROR for rows that failed, NEEDS_REVIEW for no text, invalid or missing values or a mismatch, else OK."""
    missing = (text("B_doc_date") == "") | (F.coalesce(parse_money("R_paid_amount"), F.lit(0)) == 0)
    failed = text("_extractor_error") != "" if "_extractor_error" in df.columns else F.lit(False)
    empty = F.trim(text(body)) == "" if body else F.lit(False)
    mismatch = text("_mismatch") != "" if "_mismatch" in df.columns else F.lit(False)
    reason = F.when(failed, "exception").when(empty, "no_text").when((F.size("_errors") > 0) | missing, "validation_or_missing").when(mismatch, "filter_mismatch").otherwise("")
    return df.withColumn("_status_reason", reason).withColumn("_status", F.when(F.col("_status_reason") == "exception", "ERROR").when(F.col("_status_reason") == "", "OK").otherwise("NEEDS_REVIEW"))


def validate_export(df: DataFrame, most: int | None = None) -> DataFrame:
    """One row: rows, blank_rows, problem ('' if the set may be exported). All rows are checked."""
    blank = F.concat_ws("", *(F.trim(text(c)) for c in LEDGER)) == ""
    out = df.agg(F.count("*").alias("rows"), F.count_if(blank).alias("blank_rows"))
    return out.withColumn("problem", F.when(F.col("rows") == 0, "empty").when(F.col("blank_rows") == F.col("rows"), "all_blank").when(F.lit(most is not None) & (F.col("rows") > (most or 0)), "too_many").otherwise(""))


def format_row(df: DataFrame) -> DataFrame:
    """Final canonical form: money with two decimals or 0, the withholding as a rate, invalid dates and ids blanked, C and G alike, branch."""
    return df.withColumns(once(("format",), format_columns))


def format_columns() -> dict[str, Column]:
    wht = format_rate(parse_wht_rate("P_wht"))
    ref = F.coalesce(filled("C_reference"), filled("G_invoice_no"), F.lit(""))
    dates = {c: F.coalesce(F.date_format(parse_date(c), "yyyyMMdd"), F.lit("")) for c in DATES}
    return dates | {
        "N_unit_price": money_text(parse_money("N_unit_price"), "0"), "R_paid_amount": money_text(parse_money("R_paid_amount"), "0"),
        "P_wht": wht, "S_pnd": let(wht, lambda w: F.when(w != "0", F.coalesce(filled("S_pnd"), F.lit("53"))).otherwise(text("S_pnd"))),
        "E_tax_id_13": tax13("E_tax_id_13"), "F_branch_5": branch5("F_branch_5"), "C_reference": ref, "G_invoice_no": ref,
    }


def quarantine(df: DataFrame, broken: Column, reason: str) -> DataFrame:
    """Mark rows that a step could not read; they stay in the set as error rows."""
    return df.withColumn("_extractor_error", F.when(broken, reason).otherwise(F.lit("")))


def merge_errors(a: Column, b: Column) -> Column:
    return F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))
