"""Dates, money, rates, identifiers, booleans and JSON out of dirty text. Nothing raises: what can't be read is null or ''."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .candidates import let
from .text import arabic_digits, digits_only, filled, group, squash_ws, text

MONEY = "decimal(18,2)"
DATE_FORMATS = ("yyyyMMdd", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "d/M/yy", "d-M-yy", "d.M.yy")


def try_date(x: Column, shape: str, formats: tuple[str, ...]) -> Column:
    return F.when(x.rlike(shape), F.coalesce(*(F.try_to_timestamp(x, F.lit(f)).cast("date") for f in formats)))


DATE_SHAPES = "^(?:\\d{8}|\\d{4}([-/.])\\d{1,2}\\1\\d{1,2}|\\d{1,2}([-/.])\\d{1,2}\\2(?:\\d{4}|\\d{2}))$"


def parse_date(c: Column | str) -> Column:
    """Eight digits, or year first or day first between like signs, two or four digits for the year. A real calendar date or null."""

    def built(x: Column) -> Column:
        parts = F.split(F.translate(x, "/.", "--"), "-")
        first, last = F.get(parts, 0), F.get(parts, 2)
        turned = F.concat_ws("-", F.when(F.length(last) == 2, F.concat(F.lit("20"), last)).otherwise(last), F.get(parts, 1), first)
        whole = F.concat_ws("-", F.substring(x, 1, 4), F.substring(x, 5, 2), F.substring(x, 7, 2))
        iso = F.when(last.isNull(), whole).when(F.length(first) == 4, F.array_join(parts, "-")).otherwise(turned)
        return F.when(x.rlike(DATE_SHAPES), iso.try_cast("date"))

    return let(F.trim(arabic_digits(c)), built)


def parse_date_lenient(c: Column | str) -> Column:
    """As parse_date, on what is left of other text, with years of the Buddhist calendar (2400 and later) turned back."""
    x = text(arabic_digits(c))
    ymd, dmy = "(\\d{4})[-/. ]?(\\d{1,2})[-/. ]?(\\d{1,2})", "(\\d{1,2})[-/. ](\\d{1,2})[-/. ](\\d{4})"

    def built(y: Column, m: Column, d: Column) -> Column:
        year = y.try_cast("int")
        return F.try_to_timestamp(F.concat_ws("-", F.when(year >= 2400, year - 543).otherwise(year).cast("string"), m, d), F.lit("yyyy-M-d")).cast("date")

    return F.coalesce(*(F.when(x.rlike(p), built(*(F.regexp_extract(x, p, i) for i in order))) for p, order in ((f"^\\s*{dmy}\\b", (3, 2, 1)), (f"^\\s*{ymd}\\b", (1, 2, 3)))))


def parse_en_date(c: Column | str) -> Column:
    """Dec 9, 2025 or 9 December 2025."""
    month = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
    a, b = f"\\b{month} (\\d{{1,2}}) (\\d{{4}})\\b", f"\\b(\\d{{1,2}}) {month} (\\d{{4}})\\b"

    def built(x: Column) -> Column:
        made = lambda p, m, d: F.try_to_timestamp(F.concat_ws(" ", F.regexp_extract(x, p, d), F.regexp_extract(x, p, m), F.regexp_extract(x, p, 3)), F.lit("d MMM yyyy")).cast("date")
        return F.coalesce(F.when(x.rlike(a), made(a, 1, 2)), F.when(x.rlike(b), made(b, 2, 1)))

    return let(F.initcap(F.regexp_replace(F.regexp_replace(text(c), "[,.]", " "), "\\s+", " ")), built)


def date_from_reference(c: Column | str) -> Column:
    """-YYMMDD- inside a document number."""
    x = group(text(c), "-(\\d{6})-")
    return F.try_to_timestamp(F.concat(F.lit("20"), x), F.lit("yyyyMMdd")).cast("date")


def guard_filename_date(date: Column, filename: Column | str, body: Column | str) -> Column:
    """The date, unless it is only the file name's and no spelling of it is in the text."""
    spelled = F.lit(False)
    for pattern in ("yyyyMMdd", "yyyy-MM-dd", "dd/MM/yyyy", "d/M/yyyy"):
        spelled = spelled | (F.instr(text(body), F.date_format(date, pattern)) > 0)
    return F.when((date == date_from_reference(filename)) & ~spelled, F.lit(None).cast("date")).otherwise(date)


def service_period(c: Column | str) -> Column:
    """struct(start, end) of 'start - end' or 'start to end'."""
    one = "(\\d{1,2}[-/.]\\d{1,2}[-/.]\\d{4}|\\d{4}-\\d{1,2}-\\d{1,2})"
    p = f"(?i)period\\s*:?\\s*{one}\\s*(?:-|–|to)\\s*{one}"
    return F.struct(parse_date(F.regexp_extract(text(c), p, 1)).alias("start"), parse_date(F.regexp_extract(text(c), p, 2)).alias("end"))


def parse_money(c: Column | str) -> Column:
    """Money of two decimals, half to even; negatives are null."""
    cleaned = lambda x: F.when(x.rlike("^[0-9.,]*\\z"), F.replace(x, F.lit(","), F.lit(""))).otherwise(F.regexp_replace(arabic_digits(x), "(?i)[,\\s$+]|฿|THB|บาท|Baht", ""))

    def read(x: Column) -> Column:
        value = let(let(x, cleaned), lambda x: F.bround(F.when(x.rlike("^-?\\d{1,14}([.]\\d*)?$|^-?[.]\\d+$"), x.try_cast("decimal(20,6)")), 2).cast(MONEY))
        return let(value, lambda v: F.when(v >= 0, v))

    # most are empty or plain already
    return let(text(c), lambda x: F.when(x == "", F.lit(None).cast(MONEY)).when(x.rlike("^[0-9]{1,14}[.][0-9]{2}\\z"), x.try_cast(MONEY)).otherwise(read(x)))


def parse_amount(c: Column | str) -> Column:
    """As parse_money; accounting brackets mean a negative, so null."""
    return F.when(~F.trim(text(c)).rlike("^\\(.*\\)$"), parse_money(c))


def money_text(value: Column, blank: str = "") -> Column:
    return F.coalesce(value.cast(MONEY).cast("string"), F.lit(blank))


def sync_amounts(price: Column, paid: Column) -> tuple[Column, Column]:
    """Unit price and paid amount, each filled from the other; both missing: zero. The paid amount wins."""
    best = F.coalesce(paid, price, F.lit(0).cast(MONEY)).cast(MONEY)
    return best, best


def normalize_qty(c: Column | str) -> Column:
    """Whole numbers without decimals, others with two; blank is 1; what can't be read stays."""
    x = filled(c)
    q = F.regexp_replace(x, ",", "").try_cast(MONEY)
    return F.when(x.isNull(), "1").when(q.isNull(), x).when(q % 1 == 0, q.cast("long").cast("string")).otherwise(q.cast("string"))


def parse_vat_rate(c: Column | str) -> Column:

    def built(x: Column) -> Column:
        number = F.regexp_replace(x, "%", "").try_cast("decimal(10,4)")
        return F.when(x.isin("NO", "NONE", "0", "EXEMPT", "0%"), F.lit(0).cast("decimal(5,4)")).otherwise(F.when(number >= 1, number / 100).otherwise(number).try_cast("decimal(5,4)"))

    return let(F.upper(squash_ws(c)), built)


def parse_wht_rate(c: Column | str) -> Column:
    """Percent; values under one are shares."""
    number = F.regexp_replace(squash_ws(c), "%", "").try_cast("decimal(10,4)")
    return let(number, lambda n: F.when(n.between(0, 100), F.when((n > 0) & (n < 1), n * 100).otherwise(n)).cast("decimal(7,2)"))


def format_rate(rate: Column) -> Column:
    short = lambda r: F.regexp_replace(F.regexp_replace(r.cast("string"), "(\\.\\d*?)0+$", "$1"), "\\.$", "")
    return let(rate, lambda r: F.when(F.coalesce(r, F.lit(0)) <= 0, "0").otherwise(F.concat(short(r), F.lit("%"))))


def compute_wht(paid: Column, vat_rate: Column, rate: Column, enabled: bool = True, on_net: bool = True) -> Column:
    """Withheld amount of a paid amount; null where off."""
    if not enabled:
        return F.lit(None).cast(MONEY)
    base = paid / (1 + F.coalesce(vat_rate, F.lit(0))) if on_net else paid
    return F.round(base * rate, 2).cast(MONEY)


def derive_amounts(subtotal: Column, vat: Column, total: Column, wht: Column | None = None) -> Column:
    """struct(subtotal, vat, total): a total equal to the withheld amount is none; then what the others give; else VAT is 7 %."""
    none = F.lit(None).cast(MONEY)
    given = F.struct(subtotal.cast(MONEY).alias("s"), vat.cast(MONEY).alias("v"), total.cast(MONEY).alias("t"), (wht if wht is not None else none).cast(MONEY).alias("w"))
    given = let(given, lambda g: F.struct(g["s"].alias("s"), g["v"].alias("v"), F.coalesce(F.when(g["t"].eqNullSafe(g["w"]), none).otherwise(g["t"]), g["s"] + g["v"]).cast(MONEY).alias("t")))
    given = let(given, lambda g: F.struct(F.coalesce(g["s"], F.when(g["t"] >= g["v"], g["t"] - g["v"])).cast(MONEY).alias("s"), g["v"].alias("v"), g["t"].alias("t")))
    given = let(given, lambda g: F.struct(g["s"].alias("s"), F.coalesce(g["v"], F.bround(g["s"] * F.lit("0.07").cast("decimal(3,2)"), 2)).cast(MONEY).alias("v"), g["t"].alias("t")))
    return let(given, lambda g: F.struct(g["s"].alias("subtotal"), g["v"].alias("vat"), F.coalesce(g["t"], g["s"] + g["v"]).cast(MONEY).alias("total")))


def clamp_confidence(c: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(text(c).try_cast("double"), F.lit(0.0))))


def tax13(c: Column | str, mode: str = "exact", alias: dict[str, str] | None = None) -> Column:
    """13 digits: exact (nothing else), first (the first 13 of all digits) or embedded (a run of 13); aliases stand for their id."""
    if mode != "embedded" and not alias:
        return let(digits_only(c), lambda d: F.when(F.length(d) == 13 if mode == "exact" else F.length(d) >= 13, F.substring(d, 1, 13)).otherwise(""))
    d = digits_only(c)
    found = {"exact": F.when(F.length(d) == 13, d), "first": F.when(F.length(d) >= 13, F.substring(d, 1, 13)), "embedded": group(arabic_digits(c), "(?<!\\d)(\\d{13})(?!\\d)")}[mode]
    found = F.coalesce(found, F.lit(""))
    if alias:
        found = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in alias.items() for x in kv)), found), found)
    return found


def branch5(c: Column | str, mode: str = "pad") -> Column:
    """pad: digits padded to five, blank is the head office; strict: the last five, a short one that is not zero is ''."""
    if mode == "pad":
        return let(digits_only(c), lambda d: F.when(d == "", "00000").otherwise(F.lpad(F.substring(d, 1, 5), 5, "0")))
    return let(digits_only(c), lambda d: F.when(d == "", "").when(F.length(d) >= 5, F.right(d, F.lit(5))).when(d.rlike("^0+$"), "00000").otherwise(""))


def vat_code(c: Column | str) -> Column:
    return let(F.upper(squash_ws(c)), lambda x: F.when(x.isin("NO", "NONE", "0", "0%", "EXEMPT", "NOVAT"), "NO").when(x.contains("7"), "7%").otherwise(""))


def price_type(c: Column | str) -> Column:
    return F.coalesce(group(digits_only(c), "^([123])"), F.lit(""))


def code_format(c: Column | str, kind: str) -> Column:
    return text(c).rlike({"vendor": "^C\\d{5}$", "wallet": "^EWL\\d{3}$", "card": "^ADV\\d{3}$"}[kind])


def parse_bool(c: Column | str) -> Column:
    x = F.lower(F.trim(text(c)))
    return F.when(x.isin("1", "true", "yes", "y", "on", "t", "✅"), True).when(x.isin("0", "false", "no", "n", "off", "f", "❌"), False)


def first_json_object(c: Column | str, schema: str) -> Column:
    """The outermost {...} of a text, read by a schema; null where there is none or it is broken."""
    return F.from_json(group(text(c), "(?s)(\\{.*\\})"), schema)
