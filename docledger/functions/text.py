"""Text functions: Columns in, Columns out, inside code generation. A blank is '' or null; results are '' where nothing is left."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits, dash and invisible characters that normalisation folds.
THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2212\uFE63"
FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F)))
ASCII = "".join(map(chr, range(0x21, 0x7F)))
#: What ``normalize_text`` may change; most texts hold none of it, and one search tells.
FOLDED = "(?=[^\\x00-\\x7F])(?:[" + THAI_DIGITS + DASHES + "\uFF01-\uFF5E\u00A0\u3000]|\u0E4D\u0E32)"
UNTIDY = "(?=[^!-~])(?: [ \\n]| \\z|\\A |\\n |\\n\\n\\n|[\\x00-\\x09\\x0B-\\x1F\\x85\\u200B-\\u200F\\u2028-\\u202E\\u2060\\uFEFF])"
CONTROL = "[\\x00-\\x09\\x0B-\\x1F]"
EXTENSIONS = "pdf|png|jpg|jpeg|webp|tif|tiff|bmp|xlsx|xls|csv|txt"


#: What Unicode calls white space.
WHITE_SPACE = "\\t-\\r \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def filled(c: Column | str) -> Column:
    """Trimmed, null where blank."""
    return F.nullif(F.trim(text(c)), F.lit(""))


def group(c: Column, pattern: str, index: int = 1) -> Column:
    """A group of the first match, null where there is none."""
    return F.nullif(F.regexp_extract(c, pattern, index), F.lit(""))


def holds(low: Column, *words: str) -> Column:
    """Whether a lower-cased text holds one of the words: a gate that costs far less than a pattern."""
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def led(first: str, pattern: str) -> str:
    """The pattern, looked for only at the characters with which it can begin (the inside of a class), which a text has few of."""
    flags, rest = re.match(r"(\(\?[a-zA-Z]+\))?(.*)", pattern, re.S).groups()
    if not first.isascii():  # single ASCII characters are looked up in one table, others are compared one by one: all of those are let in
        first = "^" + "".join(f"\\x{i:02x}" for i in range(128) if chr(i).lower() not in first)
    return f"{flags or ''}(?=[{first}])(?:{rest})"


def arabic_digits(c: Column | str) -> Column:
    return F.translate(text(c), THAI_DIGITS, "0123456789")


def normalize_text(c: Column | str) -> Column:
    """Digits, full-width characters and dashes folded, control and zero-width characters dropped, blanks collapsed line by line, at
    most one empty line in a row. The currency sign stays; a split SARA AM is composed again."""

    def folded(x: Column) -> Column:
        x = F.translate(x, THAI_DIGITS + FULL_WIDTH, "0123456789" + ASCII)
        return F.replace(F.translate(x, DASHES + "\u00A0\u3000", "-" * len(DASHES) + "  "), F.lit("ํา"), F.lit("ำ"))

    def tidied(x: Column) -> Column:
        x = F.regexp_replace(F.regexp_replace(x, "\r\n?", "\n"), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\u200B-\\u200F\\u202A-\\u202E\\u2060\\uFEFF]", "")
        x = F.regexp_replace(F.regexp_replace(x, "[ \\t]+", " "), "(?m)^ | $", "")
        return F.regexp_replace(x, "\n{3,}", "\n\n")

    own = lambda x, pattern, mended: F.get(F.transform(F.array(x), lambda v: F.when(v.rlike(pattern), mended(v)).otherwise(v)), 0)
    x = text(c)
    untidy = reduce(lambda a, b: a | b, [x.contains(w) for w in ("  ", " \n", "\n ", "\n\n\n")])
    plain = (F.octet_length(x) == F.length(x)) & ~untidy & ~x.rlike(CONTROL)  # most texts; blanks at their ends are trimmed
    return F.when(plain, F.btrim(x, F.lit(" \n\t"))).otherwise(F.btrim(own(own(x, FOLDED, folded), UNTIDY, tidied), F.lit(" \n\t")))


def light_normalize(c: Column | str) -> Column:
    """Line ends unified, zero-width characters dropped, inline blanks collapsed; lines stay."""
    x = F.regexp_replace(F.regexp_replace(text(c), "\r\n?", "\n"), "[\\x00\\u200B-\\u200F\\uFEFF]", "")
    return F.btrim(F.regexp_replace(x, "[ \\t]+", " "), F.lit(" \n\t"))


def one_line(c: Column | str) -> Column:
    return F.btrim(F.regexp_replace(light_normalize(c), "\\s+", " "), F.lit(" "))


def squash_ws(c: Column | str) -> Column:
    return F.regexp_replace(text(c), f"[{WHITE_SPACE}]+", "")


def digits_only(c: Column | str) -> Column:
    return F.regexp_replace(arabic_digits(c), "[^0-9]", "")


def norm_name(c: Column | str) -> Column:
    """Lower case, blanks collapsed, quotes and brackets dropped."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(arabic_digits(c)), "[\"'`()\\[\\]{}]", ""), "\\s+", " "))


def clean_number(c: Column | str) -> Column:
    """Digits with the first point and a leading minus."""
    x = F.regexp_replace(arabic_digits(c), "(?i)[,\\s]|฿|THB|บาท|Baht", "")
    sign = F.when(F.startswith(x, F.lit("-")), "-").otherwise("")
    x = F.regexp_replace(x, "[^0-9.]", "")
    whole = F.substring_index(x, ".", 1)
    rest = F.regexp_replace(F.substring(x, F.length(whole) + 1, F.lit(1 << 20)), "[.]", "")
    return F.concat(sign, whole, F.when(F.instr(x, ".") > 0, F.concat(F.lit("."), rest)).otherwise(""))


def extract_script(c: Column | str, chars: str = "฀-๿") -> Column:
    """Runs of a script, joined by spaces."""
    return F.array_join(F.regexp_extract_all(text(c), F.lit(f"[{chars}]+"), F.lit(0)), " ")


def is_script(c: Column | str, threshold: float = 0.3, chars: str = "฀-๿", least: int = 3) -> Column:
    dense = F.regexp_replace(text(c), "\\s+", "")
    own = F.length(F.regexp_replace(dense, f"[^{chars}]", ""))
    return (F.length(dense) >= least) & (own / F.greatest(F.length(dense), F.lit(1)) >= threshold)


def fix_ocr_digits(c: Column | str) -> Column:
    """Letters that scans confuse with digits, between digits only."""
    return F.regexp_replace(F.regexp_replace(text(c), "(?<=\\d)[Oo](?=\\d)", "0"), "(?<=\\d)[Il](?=\\d)", "1")


def basename(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(text(c), "^.*[/\\\\]", ""))


def strip_ext(c: Column | str) -> Column:
    return F.regexp_replace(text(c), f"(?i)\\.({EXTENSIONS})$", "")


def stem(c: Column | str) -> Column:
    return strip_ext(basename(c))


def reference_core(c: Column | str) -> Column:
    """The document number inside a file name or reference, without blanks and noise; an INV number needs a digit."""
    forms = (
        "(?i)(TRS[A-Z0-9]{3,}[A-Z0-9/_-]{5,})", "(?i)(RCS[A-Z0-9]{3,}[A-Z0-9/_-]{5,})", "(?i)(TTSTH[0-9]{6,})",
        "(?i)(THMPTI[0-9]{6,})", "(?i)((?:LAZ|LZD)[A-Z0-9/_.-]{6,})", "(?i)(INV[A-Z/_.-]*[0-9][A-Z0-9/_.-]{5,})",
    )
    rest = lambda x: F.regexp_replace(x, "(?i)^(?:Shopee-TI[VR]-|ShopeeTI[VR]|SPXExpress-RCT-|Lazada-|TikTok-)", "")
    once = lambda x, form: F.get(F.transform(F.array(F.regexp_extract(x, form, 1)), lambda v: F.nullif(v, F.lit(""))), 0)
    known = lambda x: F.when(x.rlike("(?i)TRS|RCS|TTSTH|THMPTI|LAZ|LZD|INV"), F.coalesce(*(once(x, form) for form in forms)))
    core = F.get(F.transform(F.array(squash_ws(stem(c))), lambda x: F.coalesce(known(x), rest(x))), 0)
    return F.regexp_replace(core, "[,.;:]+$", "")


def normalize_reference(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(squash_ws(c), "[\"']", ""), "[,.;:]+$", "")


def truncate_middle(c: Column | str, most: int = 140_000, head: float = 0.65, marker: str = "\n...\n") -> Column:
    x, front = text(c), int(most * head)
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.substring(x, 1, front), F.lit(marker), F.right(x, F.lit(most - front))))


def escape_formula(c: Column | str) -> Column:
    x = text(c)
    return F.when(F.substring(x, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), x)).otherwise(x)


def render_template(template: Column, fields: dict[str, Column]) -> Column:
    """{name} places of a template column filled; blanks as '' and left-over double blanks collapsed."""
    out = template
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), text(value))
    return F.trim(F.regexp_replace(out, " {2,}", " "))


def append_note(note: Column | str, more: Column | str, separator: str = " | ") -> Column:
    """Add text once."""
    a, b = text(note), text(more)
    return F.when((b == "") | ((a != "") & (F.instr(a, b) > 0)), a).when(a == "", b).otherwise(F.concat(a, F.lit(separator), b))


def short_description(platform: Column | str, fee: Column | str, seller: Column | str) -> Column:
    return F.coalesce(F.nullif(F.concat_ws(" - ", filled(platform), filled(fee), filled(seller)), F.lit("")), F.lit("Marketplace Expense"))


def normalize_token(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text(c)), "[_.-]+", " "), "\\s+", " "))
