"""Projections and filters on ledger rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.candidates import let, once
from ..functions.text import filled, squash_ws, text
from ..functions.values import branch5, digits_only, parse_bool, vat_code
from ..schema import DEFAULTS, GROUPS, LEDGER, VENDOR_LABELS

ENRICH_ZERO = ("", "0", "0.0", "0.00")


def lock_schema(df: DataFrame) -> DataFrame:
    """Exactly the 22 columns, '' where missing, then every column that begins with an underscore."""
    own = [text(c).alias(c) if c in df.columns else F.lit("").alias(c) for c in LEDGER]
    return df.select(*own, *(F.col(c) for c in df.columns if c.startswith("_")))


def base_row(df: DataFrame) -> DataFrame:
    """Default values where a column is missing or blank."""
    have = tuple(c for c in LEDGER if c in df.columns)
    return df.withColumns(once(("base", have), lambda: {c: F.coalesce(filled(c), F.lit(DEFAULTS.get(c, ""))) if c in have else F.lit(DEFAULTS.get(c, "")) for c in LEDGER}))


def merge_patch(base: DataFrame, patch: DataFrame, key: str = "doc_id", fill_missing: bool = True, blocked: tuple[str, ...] = ("T_note", "U_group", "K_account", "P_wht")) -> DataFrame:
    """A second source's fields over the first's: blank and blocked ones dropped; fill_missing: only where the first has none, unless
    the row has errors."""
    use = [c for c in patch.columns if c in LEDGER and c in base.columns and c not in blocked]
    over = patch.select(key, *(filled(c).alias(f"__p_{c}") for c in use))
    joined = base.join(over, key, "left")
    broken = F.size("_errors") > 0 if "_errors" in base.columns else F.lit(False)
    take = lambda c: F.col(f"__p_{c}").isNotNull() & (broken | text(c).isin(*ENRICH_ZERO) if fill_missing else F.lit(True))
    return joined.withColumns({c: F.when(take(c), F.col(f"__p_{c}")).otherwise(F.col(c)) for c in use}).drop(*(f"__p_{c}" for c in use))


def platform_dim(spark) -> DataFrame:
    rows = [(p, g, VENDOR_LABELS[p], "3" if p in ("META", "GOOGLE") else "1", "NO" if p in ("META", "GOOGLE") else "7%", i) for i, (p, g) in enumerate(GROUPS.items())]
    return spark.createDataFrame(rows, "platform string, grp string, vendor_label string, price_type string, vat_rate string, ord int")


def platform_defaults(df: DataFrame, platform: str = "_platform") -> DataFrame:
    """Group, description, VAT and price type where blank; marketplaces force their group (but for TikTok's advertising); an account
    equal to the group is cleared. The eight platforms' values are a literal map: a join here would make the optimizer slow."""
    df = df.withColumns(once(("defaults", platform), lambda: default_columns(F.col(platform))))
    return df.withColumn("K_account", F.when(text("K_account") == F.col("U_group"), "").otherwise(text("K_account")))


def default_columns(p: Column) -> dict[str, Column]:
    grp, known, ads = F.create_map(*(F.lit(v) for kv in GROUPS.items() for v in kv))[p], p.isin(*GROUPS), p.isin("META", "GOOGLE")
    market = (grp == "Marketplace Expense") & ~((p == "TIKTOK") & (text("U_group") == "Advertising Expense"))
    vat, price = F.when(ads, "NO").when(known, "7%"), F.when(ads, "3").when(known, "1")
    return {
        "U_group": F.when(market, grp).otherwise(F.coalesce(filled("U_group"), grp, F.lit(""))), "L_description": F.coalesce(filled("L_description"), grp, F.lit("")),
        "O_vat_rate": F.coalesce(filled("O_vat_rate"), vat, F.lit("")), "J_price_type": F.coalesce(filled("J_price_type"), price, F.lit("")),
    }


def clamp_choice(c: Column | str, allowed: tuple[str, ...], fallback: str) -> Column:
    return F.when(text(c).isin(*allowed), text(c)).otherwise(F.lit(fallback))


def normalize_row(df: DataFrame) -> DataFrame:
    """Dates to 8 digits, tax id to 13, branch to 5, VAT code, references without blanks, amounts and quantity with defaults."""
    have = tuple(c for c in LEDGER if c in df.columns)

    def columns() -> dict[str, Column]:
        dates = {c: F.substring(digits_only(c), 1, 8) for c in ("B_doc_date", "H_invoice_date", "I_tax_purchase_date")}
        refs = {c: squash_ws(c) for c in ("C_reference", "G_invoice_no")}
        zero = {c: F.coalesce(filled(c), F.lit("0")) for c in ("N_unit_price", "R_paid_amount", "P_wht")}
        vat = F.coalesce(filled("O_vat_rate"), F.lit("7%"))
        rest = {
            "E_tax_id_13": F.substring(digits_only("E_tax_id_13"), 1, 13), "F_branch_5": branch5("F_branch_5"), "O_vat_rate": F.coalesce(F.nullif(vat_code(vat), F.lit("")), F.trim(text("O_vat_rate"))),
            "M_qty": F.coalesce(filled("M_qty"), F.lit("1")), "J_price_type": F.coalesce(filled("J_price_type"), F.lit("1")),
        }
        done = dates | refs | zero | rest
        return done | {c: F.trim(text(c)) for c in have if c not in done}

    return df.withColumns(once(("normalize", have), columns))


def prefilter_files(df: DataFrame, clients: dict[str, tuple[str, ...]], wanted_clients: tuple[str, ...], wanted_platforms: tuple[str, ...], strict: bool, filename: str = "filename") -> DataFrame:
    """_client and _platform_hint from the file name, keep and reason; what is unknown passes unless strict."""
    from ..functions.classify import has_word, platform_from_filename
    from ..functions.text import normalize_token, stem

    tokens = normalize_token(stem(filename))
    cases = [F.when(reduce(lambda a, b: a | b, [has_word(tokens, w) for w in words]), tag) for tag, words in clients.items()]
    out = df.withColumns({"_client": F.coalesce(*cases, F.lit("UNKNOWN")), "_platform_hint": platform_from_filename(filename)})
    bad = lambda c, wanted: F.lit(False) if not wanted else F.when(F.col(c) == "UNKNOWN", F.lit(strict)).otherwise(~F.col(c).isin(*wanted))
    reasons = [F.when(bad("_client", wanted_clients), F.concat(F.lit("client:"), "_client")), F.when(bad("_platform_hint", wanted_platforms), F.concat(F.lit("platform:"), "_platform_hint"))]
    return out.withColumn("reason", F.concat_ws(", ", *reasons)).withColumn("keep", F.when(F.col("reason") == "", "KEEP").otherwise("SKIP"))


def filter_mismatch(df: DataFrame, companies: tuple[str, ...], platforms: tuple[str, ...], strict: bool, company: str = "A_company_name", platform: str = "_platform") -> DataFrame:
    """Rows outside the allowed lists stay, with _mismatch telling why ('' if none)."""
    bad = lambda c, allowed, name: F.when(F.lit(bool(allowed)) & F.when(text(c).isin("", "UNKNOWN", "Unknown"), F.lit(strict)).otherwise(~text(c).isin(*allowed) if allowed else F.lit(False)), f"{name}:mismatch")
    return df.withColumn("_mismatch", F.concat_ws(",", bad(company, companies, "company"), bad(platform, platforms, "platform")))


def search(df: DataFrame, status: str = "", query: str = "", columns: tuple[str, ...] = LEDGER) -> DataFrame:
    """Status equal and the query inside any of the columns, case ignored."""
    out = df.where(F.upper(text("_status")) == status.upper()) if status else df
    return out.where(F.lower(F.concat_ws("\u0001", *(text(c) for c in columns))).contains(query.lower())) if query else out


def needs_enrichment(df: DataFrame) -> DataFrame:
    blank = (F.size("_errors") > 0) | (F.trim(text("B_doc_date")) == "") | (F.trim(text("L_description")) == "") | F.trim(text("R_paid_amount")).isin(*ENRICH_ZERO)
    return df.where(blank)


def normalize_list(c: Column | str, upper: bool = False) -> Column:
    """A JSON list, a comma list or one value as a trimmed array, first occurrences only."""
    x = F.trim(text(c))
    parts = F.when(x.startswith("["), F.from_json(x, "array<string>")).otherwise(F.split(x, ",", -1))
    clean = F.filter(F.transform(F.coalesce(parts, F.array().cast("array<string>")), lambda v: F.trim(F.upper(v) if upper else v)), lambda v: v != "")
    return F.array_distinct(clean)


def lock_references(df: DataFrame, filename: str = "_source_file") -> DataFrame:
    """C and G are the same core: of the file name, else of C, else of G."""
    from ..functions.text import reference_core

    def core() -> Column:
        own = lambda v: F.when(v.rlike("(?i)^(TRS|RCS|TTSTH|THMPTI|LAZ|LZD|INV)"), v)
        return F.coalesce(let(reference_core(filename), own), F.nullif(reference_core("C_reference"), F.lit("")), reference_core("G_invoice_no"))

    return df.withColumn("__core", once(("core", filename), core)).withColumns({"C_reference": F.col("__core"), "G_invoice_no": F.col("__core")}).drop("__core")


__all__ = ["base_row", "clamp_choice", "filter_mismatch", "lock_references", "lock_schema", "merge_patch", "needs_enrichment", "normalize_list", "normalize_row", "parse_bool", "platform_defaults", "platform_dim", "prefilter_files", "search"]
