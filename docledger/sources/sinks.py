"""Writing ledgers: import file, review file, typed table, job table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_formula, text
from ..functions.values import MONEY, normalize_qty, parse_date, parse_money
from ..schema import LEDGER, TEMPLATE

BOM, CELL = "﻿", 32_767
AS_IS = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def csv_rows(df: DataFrame, review: bool = False, headings: tuple[str, ...] = TEMPLATE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns under the headings (the import template's, if none are given), cells escaped and cut at the spreadsheet's limit; the first
    heading carries the byte order mark. ``keep``: columns to add as they are."""
    columns = [*LEDGER, *(("_status", "_source_file") if review else ())]
    labels = [*headings, *(("Status", "Source file") if review else ())]
    cells = [F.substring(escape_formula(c) if c in df.columns else F.lit(""), 1, CELL).alias((BOM if i == 0 else "") + label) for i, (c, label) in enumerate(zip(columns, labels, strict=True))]
    return df.select(*cells, *keep)


def write_ledger_csv(df: DataFrame, path: str, headings: tuple[str, ...] = TEMPLATE) -> None:
    csv_rows(df, headings=headings).write.mode("overwrite").option("header", True).option("emptyValue", "").option("quoteAll", False).option("escape", '"').options(**AS_IS).csv(path)


def write_review_csv(df: DataFrame, path: str, headings: tuple[str, ...] = TEMPLATE) -> None:
    csv_rows(df, True, headings).write.mode("overwrite").option("header", True).option("emptyValue", "").option("lineSep", "\r\n").option("escape", '"').options(**AS_IS).csv(path)


def typed_export(df: DataFrame) -> DataFrame:
    """Dates, quantity and money typed; the text of a cell that can't be read stays in its _raw column."""
    typed = {
        "B_doc_date": parse_date("B_doc_date"), "H_invoice_date": parse_date("H_invoice_date"), "I_tax_purchase_date": parse_date("I_tax_purchase_date"),
        "M_qty": F.regexp_replace(normalize_qty("M_qty"), ",", "").try_cast(MONEY), "N_unit_price": parse_money("N_unit_price"), "R_paid_amount": parse_money("R_paid_amount"),
    }
    raw = {f"{c}_raw": F.when(v.isNull() & (F.trim(text(c)) != ""), text(c)) for c, v in typed.items()}
    return df.withColumns(raw).withColumns(typed)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("job_id").parquet(path)
