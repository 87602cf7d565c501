"""Field extraction from document text: one regex family each, candidates ranked where several match."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .candidates import CUT, find_all, keyword_positions, let, nearest
from .text import WHITE_SPACE, group, holds, led, normalize_reference, reference_core, squash_ws, text
from .values import branch5, derive_amounts, parse_date, parse_en_date, parse_money

# The label words of invoices and receipts, and the number formats that follow them.
AMOUNT = "\\s*[:#：]?\\s*(?:฿|THB)?\\s*([0-9,]+(?:\\.[0-9]{1,2})?)"
TOTAL_INC = led("tgaย", "(?i)(?:Total\\s*(?:amount)?\\s*\\(?(?:Including|incl\\.?|รวม)\\s*(?:VAT|Tax|ภาษี)\\)?|Grand\\s*Total|Amount\\s*Due|Total\\s*Due|ยอด(?:ที่)?ชำระ|ยอดรวมทั้งสิ้น)" + AMOUNT)
TOTAL_EX = led("tsร", "(?i)(?:Total\\s*(?:amount)?\\s*\\(?(?:Excluding|excl\\.?|ก่อน|ไม่รวม)\\s*(?:VAT|Tax|ภาษี)\\)?|Subtotal|รวม(?:เงิน)?ก่อน(?:VAT|ภาษี))" + AMOUNT)
VAT_AMOUNT = led("tvภ", "(?i)(?:Total\\s*VAT|VAT|ภาษีมูลค่าเพิ่ม)\\s*(?:7%)?" + AMOUNT)
#: Words of which a text must hold one for these patterns to match.
INC_WORDS, EX_WORDS, VAT_WORDS = ("inc", "รวม", "grand", "due", "ยอดชำระ", "ยอดที่ชำระ"), ("exc", "ก่อน", "ไม่รวม", "subtotal"), ("vat", "ภาษีมูลค่าเพิ่ม")
ANY_TOTAL = led("tรจ", "(?i)(?:Total|รวม|จำนวนเงิน)" + AMOUNT)
ANY_AMOUNT = "(?:฿|THB)\\s*([0-9,]+\\.[0-9]{2})"
#: Words, lower case, of which a text must hold one for the patterns below to match.
HINTED = ("withholding", "wht", "หักภาษี", "ที่จ่าย")
WHT_HINT = led("wหณ", "(?i)withholding\\s+tax|หักภาษี|ณ\\s*ที่จ่าย|\\bwht\\b")
#: A withholding clause as the words that stand one after the other, at any distance: heads, then the rate, then the amount.
WHT = (((led("wห", "(?i)withholding\\s+tax|หักภาษี\\s*ณ\\s*ที่จ่าย|wht"),), "(?i)(?:อัตรา|rate|ร้อยละ)(?:\\s+of)?\\s*([0-9]{1,2})\\s*%", "(?i)(?:จำนวน(?:เงิน)?|amounting\\s*to|เป็นจำนวน)\\s*(?:฿|THB)?\\s*([0-9,]+(?:\\.[0-9]{1,2})?)"),)
DATE_ANCHORS = ["invoice date", "tax invoice", "invoice", "receipt", "issue date", "date", "วันที่", "วันที่ออก"]
TOTAL_ANCHORS = ["total", "grand total", "amount due", "ยอดชำระ", "ยอดรวม", "including"]
HEAD_OFFICE = "(?i)สำนักงานใหญ่|Head\\s*Office|HeadOffice|本社"
BRANCH = "(?i)(?:สาขา(?:ที่)?\\s*|Branch\\s*(?:No\\.?|Number)?\\s*:?\\s*)(\\d{1,5})"
PAYMENT = "(?iU)\\b(EWL\\d{2,6}|TRF\\d{2,6}|CSH\\d{2,6}|QR|CASH|CARD|TRANSFER|BANK\\s*TRANSFER|CREDIT\\s*CARD|หักจาก(?:ยอด)?ขาย|โอน|เงินสด)\\b"
# An INV number needs a digit, or the word INVOICE itself would be one.
DOCUMENT_NUMBERS = {
    "SPX": led("r", "(?i)\\b(RCS[A-Z0-9\\-/]{10,})\\b"),
    "SHOPEE": led("st", "(?i)\\b((?:Shopee-)?TI[VR]-[A-Z0-9]+-\\d{5}-\\d{6}-\\d{7,}|TRS[A-Z0-9\\-_/]{8,})\\b"),
    "LAZADA": led("tli", "(?i)\\b(THMPTI\\d{16}|(?:LAZ|LZD)[A-Z0-9\\-_/.]{6,}|INV(?=[A-Z\\-_/.]*[0-9])[A-Z0-9\\-_/.]{6,})\\b"),
    "TIKTOK": led("t", "(?i)\\b(TTSTH\\d{14,})\\b"),
}
#: Words of which a text must hold one for the pattern above to match.
NUMBER_WORDS = {"SPX": ("rcs",), "SHOPEE": ("tiv-", "tir-", "trs"), "LAZADA": ("thmpti", "laz", "lzd", "inv"), "TIKTOK": ("ttsth",)}
GENERIC_NUMBER = "(?i)(?:ใบกำกับ(?:ภาษี)?|Tax\\s*Invoice|Invoice|เลขที่(?:เอกสาร)?|Document\\s*(?:No\\.?|Number)|Receipt\\s*No\\.?)(?:\\s*No\\.?)?\\s*[:#：]?\\s*[\"']?([A-Za-z0-9/_.-]*[0-9][A-Za-z0-9/_.-]*)"
#: A number of Shopee or SPX with white space anywhere inside.
SPLIT_NUMBER = "(?i)(?=[tr])((?:T@R@S|R@C@S)(?:@[A-Z0-9]){3,20}@-(?:@\\d){5}@-(?:@\\d){6}@-(?:@\\d){7})".replace("@", f"[{WHITE_SPACE}]*")
REFERENCE_CODE = "\\b(\\d{4})\\s*-\\s*(\\d{6,9})\\b"
FEE_LINE = "(?m)^- (.{1,160}?) (?:฿|THB)\\s?([0-9,]+\\.[0-9]{2})(?: (?:฿|THB)\\s?([0-9,]+\\.[0-9]{2}))?(?: (?:฿|THB)\\s?([0-9,]+\\.[0-9]{2}))?$"


def positive(c: Column) -> Column:
    return let(parse_money(c), lambda v: F.when(v > 0, v))


def amounts(c: Column | str) -> Column:
    """struct(subtotal, vat, total, wht_rate, wht_amount): labelled amounts nearest to their words, then what they give each other."""
    x = text(c)

    near_hint = lambda before: F.substring(x, F.greatest(before - 79, F.lit(1)), F.lit(80)).rlike(WHT_HINT)

    def pick(low: Column, pattern: str, anchors: list[str], *words: str) -> Column:
        """Of several amounts the nearest; a single one needs no place but its own."""
        read = F.transform(find_all(x, pattern, 1), lambda m: F.struct(m["pos"].alias("pos"), parse_money(m["value"]).alias("value")))
        found = F.filter(read, lambda m: (m["value"] > 0) & ~near_hint(m["pos"]))
        several = let(found, lambda f: F.when(F.size(f) > 0, nearest(f, keyword_positions(x, anchors), lambda m: m["value"])))
        single = lambda v: F.when(~near_hint(F.regexp_instr(x, F.lit(pattern)) - 1), positive(v[0]))
        values = F.when(holds(low, *words), F.regexp_extract_all(x, F.lit(pattern), F.lit(1)))
        return let(values, lambda v: F.when(F.size(v) == 1, single(v)).when(F.size(v) > 1, several))

    picked = let(F.lower(x), lambda low: F.struct(
        pick(low, TOTAL_EX, ["subtotal", "excluding", "ก่อน", "ไม่รวม"], *EX_WORDS).alias("s"), pick(low, VAT_AMOUNT, ["vat", "ภาษีมูลค่าเพิ่ม", "total vat"], *VAT_WORDS).alias("v"), pick(low, TOTAL_INC, TOTAL_ANCHORS, *INC_WORDS).alias("t"),
        F.when(holds(low, *HINTED), withheld(x, WHT)).alias("h"),
    ))
    known = let(picked, lambda p: F.struct(p["s"].alias("s"), p["v"].alias("v"), p["t"].alias("t"), p["h"]["rate"].alias("r"), parse_money(p["h"]["amount"]).alias("w")))
    known = let(known, lambda p: F.struct(derive_amounts(p["s"], p["v"], p["t"], p["w"]).alias("d"), p["r"].alias("r"), p["w"].alias("w")))
    return let(known, lambda p: F.struct(p["d"]["subtotal"].alias("subtotal"), p["d"]["vat"].alias("vat"), p["d"]["total"].alias("total"), F.concat(p["r"], F.lit("%")).alias("wht_rate"), p["w"].alias("wht_amount")))


def total_amount(c: Column | str) -> Column:
    x = text(c)
    labelled = [F.when(holds(F.lower(x), *words), positive(F.regexp_extract(x, p, 1))) for p, words in ((TOTAL_INC, INC_WORDS), (TOTAL_EX, EX_WORDS))]
    return F.coalesce(*labelled, *(positive(F.regexp_extract(x, p, 1)) for p in (ANY_TOTAL, ANY_AMOUNT)))


def near_keyword(c: Column | str, pattern: str, before: int = 80, after: int = 240) -> Column:
    """The last amount, as it is written, in the window round the first keyword (a pattern), which a withholding hint cuts."""
    x = text(c)

    def seen(at: Column) -> Column:
        start = F.greatest(at["at"] - before, F.lit(1))
        window = F.regexp_replace(F.substring(x, start, at["at"] - start + at["size"] + after), f"(?s)(?:{WHT_HINT}).*", "")
        return F.when(at["at"] > 0, F.try_element_at(F.regexp_extract_all(window, F.lit("([0-9,]+\\.[0-9]{2})"), F.lit(1)), F.lit(-1)))

    return let(F.struct(F.regexp_instr(x, F.lit(pattern)).alias("at"), F.length(F.regexp_substr(x, F.lit(pattern))).alias("size")), seen)


def amount_near_keyword(c: Column | str, pattern: str, before: int = 80, after: int = 240) -> Column:
    return parse_money(near_keyword(c, pattern, before, after))


def max_amount(c: Column | str, label: str) -> Column:
    """The labelled amount, else the largest currency amount."""
    x = text(c)
    every = F.transform(F.regexp_extract_all(x, F.lit(ANY_AMOUNT), F.lit(1)), parse_money)
    return F.coalesce(positive(group(x, f"(?i)(?:{label})" + AMOUNT)), F.array_max(every))


def totals_block(c: Column | str) -> Column:
    """struct(subtotal, vat, total): whole lines first, inline labels as fallback."""
    x = text(c)
    line = lambda label: parse_money(group(x, f"(?im)^\\s*{label}{AMOUNT}\\s*$"))
    return F.struct(
        F.coalesce(line("Subtotal"), parse_money(group(x, TOTAL_EX))).alias("subtotal"), F.coalesce(line("Total\\s*VAT(?:\\s*7%)?"), parse_money(group(x, VAT_AMOUNT))).alias("vat"),
        F.coalesce(line("Total\\s*\\(Including\\s*VAT\\)"), parse_money(group(x, TOTAL_INC))).alias("total"),
    )


def withheld(c: Column | str, forms: tuple) -> Column:
    """struct(rate, amount), as written, of the first form whose words stand in the text one after the other, however far apart; nulls
    where none does. Each word is searched once in what follows the one before it, so the work is linear in the text."""
    after = lambda rest, pattern: F.regexp_extract(rest, f"(?s)(?:{pattern})(.*)", re.compile(pattern).groups + 1)
    nothing = F.struct(F.lit(None).cast("string").alias("rate"), F.lit(None).cast("string").alias("amount"))

    def read(heads: tuple[str, ...], rate: str, amount: str) -> Column:
        rest = text(c)
        for head in heads:
            rest = after(rest, head)
        rated = let(rest, lambda r: F.struct(F.regexp_extract(r, rate, 1).alias("rate"), after(r, rate).alias("rest")))
        paired = let(rated, lambda r: F.struct(r["rate"].alias("rate"), F.regexp_extract(r["rest"], amount, 1).alias("amount")))
        return let(paired, lambda r: F.when(r["amount"] != "", r))

    return F.coalesce(*(read(*form) for form in forms), nothing)


def withholding(c: Column | str) -> Column:
    """struct(rate, amount); null where nothing is said of it."""
    found = let(withheld(c, WHT), lambda h: F.struct(F.concat(h["rate"], F.lit("%")).alias("rate"), parse_money(h["amount"]).alias("amount")))
    return F.when(holds(F.lower(text(c)), *HINTED), found)


def reference_code_near(c: Column | str, number: Column, distance: int = 140) -> Column:
    x = text(c)

    def code(place: Column) -> Column:
        nearby = F.substring(x, F.greatest(place - distance, F.lit(1)), F.length(number) + 2 * distance)
        return F.when(place > 0, F.regexp_extract(nearby, REFERENCE_CODE, 0))

    return let(let(F.position(number, x), code), lambda v: F.when(v != "", F.regexp_replace(v, "\\s+", "")))


def invoice_no(c: Column | str, platform: Column | str | None = None) -> Column:
    """The platform's number glued with the reference code that follows it, else a number with a code nearby or alone: the platform's
    own, another platform's, or a labelled one of six or more characters."""
    x = text(c)
    coded = {name: f"{p}\\s+(\\d{{4}})\\s*-\\s*(\\d{{7}})\\b" for name, p in DOCUMENT_NUMBERS.items()}

    def any_of(low: Column, patterns: dict[str, str], index: int) -> Column:
        read = {name: F.when(holds(low, *NUMBER_WORDS[name]), group(x, p, index)) for name, p in patterns.items()}
        own = [] if platform is None else [F.when(text(platform) == name, v) for name, v in read.items()]
        return F.coalesce(*own, *read.values())

    labelled = let(F.regexp_extract(x, GENERIC_NUMBER, 1), lambda v: F.when(F.length(v) >= 6, v))
    with_code = let(let(F.lower(x), lambda low: F.coalesce(any_of(low, DOCUMENT_NUMBERS, 1), labelled)), lambda n: F.concat(n, F.coalesce(reference_code_near(x, n), F.lit(""))))
    glued = F.when(x.rlike("\\s\\d{4}\\s*-\\s*\\d{7}\\b"), any_of(F.lower(x), coded, 0))
    return normalize_reference(F.coalesce(glued, with_code, F.lit("")))


def full_reference(c: Column | str, filename: Column | str) -> Column:
    """The document number even across line breaks, else the file name's core."""
    split_number = let(group(text(c), SPLIT_NUMBER), squash_ws)
    return F.coalesce(let(split_number, lambda v: F.when(v != "", v)), let(invoice_no(c), lambda v: F.when(v != "", v)), reference_core(filename))


def vendor_tax_id(c: Column | str, own: Column) -> Column:
    """The labelled 13-digit id, else the first, that is not one of our own (array of ids)."""
    x = text(c)
    labelled = F.regexp_extract_all(x, F.lit("(?i)(?:Tax\\s*(?:ID|Registration)(?:\\s*No\\.?)?|เลขประจำตัวผู้เสียภาษี)\\s*[:#：]?\\s*(\\d{13})(?!\\d)"), F.lit(1))
    every = F.regexp_extract_all(x, F.lit("(?<!\\d)(\\d{13})(?!\\d)"), F.lit(1))
    return F.coalesce(F.get(F.array_except(labelled, own), 0), F.get(F.array_except(every, own), 0), F.lit(""))


def head_office(c: Column | str) -> Column:
    x = text(c)
    return x.contains("สำนักงานใหญ่") | x.contains("本社") | (F.lower(x).contains("head") & x.rlike(HEAD_OFFICE))


def branch_found(c: Column | str) -> Column:
    """Whether the text names a branch or the head office; without it ``branch`` is the head office by default."""
    return head_office(c) | text(c).rlike(BRANCH)


def branch(c: Column | str) -> Column:
    x = text(c)
    return F.when(head_office(x), "00000").otherwise(branch5(F.regexp_extract(x, BRANCH, 1)))


def best_date(c: Column | str) -> Column:
    """Of the dates in four formats the one nearest to a date word; ties go to the latest."""
    x = text(c)
    forms = (
        (led("jfmasond", "(?i)\\b((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\\s+\\d{1,2},?\\s+\\d{4})\\b"), parse_en_date),
        *((led("0-9", p), parse_date) for p in ("\\b(\\d{4}[-/.]\\d{1,2}[-/.]\\d{1,2})\\b", "\\b(\\d{1,2}[-/.]\\d{1,2}[-/.]\\d{4})\\b", "\\b(\\d{8})\\b")),
    )

    def dates(pattern: str, read) -> Column:
        return F.transform(find_all(x, pattern, 1), lambda m: F.struct(m["pos"].alias("pos"), read(m["value"]).alias("value")))

    dated = F.concat(*(dates(p, read) for p, read in forms))
    several = nearest(F.filter(dated, lambda m: m["value"].isNotNull()), keyword_positions(x, DATE_ANCHORS), lambda m: F.unix_date(m["value"]))
    # one date, as most texts have, needs no places
    plain = F.concat(*(F.transform(F.regexp_extract_all(x, F.lit(p), F.lit(1)), read) for p, read in forms))
    return let(F.filter(plain, lambda v: v.isNotNull()), lambda v: F.when(F.size(v) <= 1, F.get(v, 0)).otherwise(several))


def seller_id(c: Column | str) -> Column:
    return F.regexp_extract(text(c), "(?i)(?:Seller\\s*ID|Shop\\s*ID|Store\\s*ID|รหัสร้านค้า)\\s*[:#：]?\\s*([A-Z0-9_\\-]+)", 1)


def username(c: Column | str) -> Column:
    return F.regexp_extract(text(c), "(?i)(?:Username|User\\s*name|ชื่อผู้ใช้)\\s*[:#：]?\\s*([A-Za-z0-9_\\-]+)", 1)


def seller_info(c: Column | str) -> Column:
    """struct(seller_id, username, seller_code): labelled ones; the code is a mixed run of letters and digits."""
    codes = F.filter(F.regexp_extract_all(text(c), F.lit("\\b([A-Z0-9]{8,15})\\b"), F.lit(1)), lambda v: ~v.rlike("^\\d+$"))
    return F.struct(seller_id(c).alias("seller_id"), username(c).alias("username"), F.coalesce(F.get(codes, 0), F.lit("")).alias("seller_code"))


def loose_seller_id(c: Column | str, filename: Column | str) -> Column:
    """A labelled seller number, else the first run of 6 to 20 digits that is no tax id in the text, else in the file name; null if none."""
    x = text(c)
    labelled = group(x, "(?i)\\b(?:seller_id|seller\\s*id|shop_id|shop\\s*id|merchant_id|merchant\\s*id)\\b\\D{0,20}(\\d{5,20})")
    thai = group(x, "(?:รหัสร้าน|ไอดีร้าน|รหัสผู้ขาย|ร้านค้า)\\D{0,20}(\\d{5,20})")
    loose = F.get(F.filter(F.regexp_extract_all(x, F.lit("\\b(\\d{6,20})\\b"), F.lit(1)), lambda v: F.length(v) != 13), 0)
    return F.coalesce(labelled, thai, loose, group(text(filename), "(\\d{6,20})"))


def payment_method(c: Column | str, platform: Column | str) -> Column:
    x, p = text(c), text(platform)
    marketplace = p.isin("SHOPEE", "LAZADA", "TIKTOK") & (x.contains("หักจาก") | F.lower(x).contains("deduct"))
    return F.when(marketplace, "หักจากยอดขาย").when(p.isin("META", "GOOGLE"), "CARD").otherwise(squash_ws(F.upper(F.regexp_extract(x, PAYMENT, 1))))


def segment_ids(c: Column | str) -> Column:
    """struct(transaction_id, invoice_no, page_x, page_y) that tell documents of one file apart."""
    x = text(c)
    page = "(?i)\\bpage\\s*(\\d{1,3})\\s*(?:of|/)\\s*(\\d{1,3})\\b"
    return F.struct(
        F.coalesce(group(x, "\\b(\\d{16,20}-\\d{16,20})\\b"), group(x, "(?i)(?:transaction|payment)\\s*(?:id|no\\.?|number)\\s*[:#]?\\s*([A-Z0-9-]{6,})"), F.lit("")).alias("transaction_id"),
        F.coalesce(F.nullif(invoice_no(x), F.lit("")), F.lit("")).alias("invoice_no"), group(x, page, 1).try_cast("int").alias("page_x"), group(x, page, 2).try_cast("int").alias("page_y"),
    )


def fee_lines(c: Column | str, most: int = 8) -> Column:
    """array<struct<name, ex_vat, vat, inc_vat>> of the first fee lines; totals and zero lines are left out, names cut at 60."""
    x = text(c)
    lines = F.when(x.contains("- "), F.regexp_extract_all(x, F.lit(FEE_LINE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    cells = F.transform(lines, lambda m: F.split(F.regexp_replace(m, FEE_LINE, f"$2{CUT}$3{CUT}$4{CUT}$1"), CUT, 4))  # the name last: it may hold anything
    names = F.transform(cells, lambda m: F.struct(F.substring(F.trim(m[3]), 1, 60).alias("name"), parse_money(m[0]).alias("ex_vat"), parse_money(m[1]).alias("vat"), parse_money(m[2]).alias("last")))
    rows = F.transform(names, lambda r: F.struct(r["name"].alias("name"), r["ex_vat"].alias("ex_vat"), r["vat"].alias("vat"), F.coalesce(r["last"], r["ex_vat"]).alias("inc_vat")))
    return F.slice(F.filter(rows, lambda r: ~r["name"].rlike("(?i)total") & (r["inc_vat"] > 0)), 1, most)


def fee_summary(lines: Column) -> Column:
    names = F.transform(F.slice(lines, 1, 3), lambda r: r["name"])
    more = F.size(lines) - 3
    return F.concat(F.array_join(names, ", "), F.when(more > 0, F.format_string(" (+%d more)", more)).otherwise(""))


def ads_fields(c: Column | str) -> Column:
    x = text(c)
    pick = lambda p: F.coalesce(group(x, p), F.lit(""))
    return F.struct(
        pick("(?i)\\b([VW]\\s*\\d{15,20})\\b").alias("payment_no"), pick("(?i)billing\\s*id\\s*[:#]?\\s*(\\d{4}-\\d{4}-\\d{4})").alias("billing_id"), pick("(?i)reference(?:\\s*(?:number|no\\.?))?\\s*[:#]?\\s*([A-Z0-9]{8,12})\\b").alias("reference"),
        pick("\\b(\\d{16,20}-\\d{16,20})\\b").alias("transaction_id"), pick("(?i)account\\s*(?:id|no\\.?)\\s*[:#]?\\s*([0-9-]{6,})").alias("account_id"), pick("(?i)\\b(visa|mastercard|amex|jcb)\\b").alias("brand"),
    )


def guess_vat(platform: Column | str, c: Column | str) -> Column:
    return F.when(text(platform).isin("META", "GOOGLE"), "NO").when(text(c).rlike("(?i)no\\s*vat|vat\\s*exempt|ไม่มีภาษี"), "NO").otherwise("7%")


def guess_pnd(c: Column | str) -> Column:
    return F.when(holds(F.lower(text(c)), *HINTED) & text(c).rlike(WHT_HINT), "53").otherwise("")


def client_identity(c: Column | str, vendor_tax: Column) -> Column:
    """struct(name, tax_id): the customer line without an office suffix; its id only if it is not the vendor's."""
    x = text(c)
    tax = group(x, "(?i)Customer\\s*Tax\\s*ID\\s*[:#]?\\s*(\\d{13})")
    name = F.regexp_replace(F.coalesce(group(x, "(?im)^Customer(?:\\s*Name)?\\s*:\\s*(.+)$"), F.lit("")), "(?i)\\s*\\((?:Head Office|สำนักงานใหญ่)\\)\\s*$", "")
    return F.struct(F.trim(name).alias("name"), F.coalesce(F.when(~tax.eqNullSafe(vendor_tax), tax), F.lit("")).alias("tax_id"))

