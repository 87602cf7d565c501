"""Platform classification by rules held as data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .candidates import let, once
from .text import basename, holds, norm_name, normalize_token, text

# Platforms in order of decision, the rules (platform, where, kind, pattern, weight) and thresholds.
PLATFORMS = ("META", "GOOGLE", "SHOPEE", "LAZADA", "TIKTOK", "SPX", "THAI_TAX")
FAST = (("META", "\\bRC\\s*META\\s*[A-Z0-9\\-/]{6,}\\b|meta\\s*platforms?\\s*ireland"), ("GOOGLE", "(?=[vw])\\b[VW]\\s*\\d{15,20}\\b|google\\s*asia\\s*pacific"), ("SPX", "\\bRCS\\s*PX\\s*[A-Z0-9\\-/]{6,}\\b|rcspx"), ("LAZADA", "\\bTHMPTI\\s*\\d{10,20}\\b"), ("TIKTOK", "\\bTTSTH[0-9A-Z\\-/]*\\b"))
REGEX_RULES = (
    ("META", "\\bRC\\s*META\\s*[A-Z0-9\\-/]{6,}\\b", 170), ("META", "meta\\s*platforms?\\s*ireland", 165), ("META", "\\b(?:facebook|fb\\s*ads|instagram\\s*ads)\\b", 90),
    ("GOOGLE", "\\b[VW]\\s*\\d{15,20}\\b", 170), ("GOOGLE", "google\\s*asia\\s*pacific", 165), ("GOOGLE", "\\b(?:google\\s*ad(?:s|words)?|google\\s*advertising)\\b", 90),
    ("SPX", "\\bRCS\\s*PX\\s*[A-Z0-9\\-/]{6,}\\b", 145), ("SPX", "rcspx", 145), ("LAZADA", "\\bTHMPTI\\s*\\d{10,20}\\b", 120), ("TIKTOK", "\\bTTSTH[0-9A-Z\\-/]*\\b", 120), ("TIKTOK", "\\btiktok\\b", 25),
    ("SHOPEE", "\\bTIV\\s*-\\s*[A-Z0-9]{3,}\\b", 110), ("SHOPEE", "\\bTIR\\s*-\\s*[A-Z0-9]{3,}\\b", 110), ("SHOPEE", "\\bshopee\\b", 22),
)
WORD_RULES = (
    ("META", 16, ("meta platforms ireland", "facebook ireland", "rcmeta", "meta ads receipt", "facebook ads receipt", "instagram ads")),
    ("META", 10, ("meta", "facebook", "fb ads", "meta ads", "reverse charge", "vat reverse")),
    ("GOOGLE", 16, ("google asia pacific", "google advertising", "google ads payment", "google adwords")), ("GOOGLE", 10, ("google ads", "google payment", "adwords")),
    ("SPX", 10, ("spx", "spx express", "standard express", "rcs", "rcspx", "spx (thailand)", "spx express (thailand)", "shopee express")),
    ("LAZADA", 10, ("lazada", "lazada invoice", "lzd", "ลาซาด้า", "seller center")), ("TIKTOK", 10, ("tiktok", "tiktok shop", "tt shop", "tiktok commerce", "ติ๊กต็อก")),
    ("SHOPEE", 10, ("shopee", "shopee-ti", "shopee-tiv", "shopee-tir", "tiv-", "tir-", "ช้อปปี้", "shopee (thailand)")),
    ("THAI_TAX", 10, ("ใบกำกับภาษี", "ใบเสร็จรับเงิน", "tax invoice", "เลขประจำตัวผู้เสียภาษี", "เลขทะเบียน", "สำนักงานใหญ่")),
)
FILENAME_RULES = (
    ("SPX", 55, ("spx", "rcspx", "shopee express", "standard express", "waybill", "awb")), ("META", 40, ("meta", "facebook", "fb", "instagram", "ig")), ("GOOGLE", 40, ("google", "adwords", "googleads", "gads")),
    ("LAZADA", 30, ("lazada", "lzd", "laz", "thmpti")), ("TIKTOK", 26, ("tiktok", "ttsth", "tt shop", "tiktokshop")), ("SHOPEE", 24, ("shopee", "tiv", "tir")),
)
#: Words of which a text must hold one for a pattern above, or for the ones below, to be tried.
GATES = {
    "\\bRC\\s*META\\s*[A-Z0-9\\-/]{6,}\\b": ("meta",), "meta\\s*platforms?\\s*ireland": ("ireland",), "\\b(?:facebook|fb\\s*ads|instagram\\s*ads)\\b": ("facebook", "fb", "instagram"),
    "google\\s*asia\\s*pacific": ("google",), "\\b(?:google\\s*ad(?:s|words)?|google\\s*advertising)\\b": ("google",), "\\bRCS\\s*PX\\s*[A-Z0-9\\-/]{6,}\\b": ("rcs",), "rcspx": ("rcspx",),
    "\\bTHMPTI\\s*\\d{10,20}\\b": ("thmpti",), "\\bTTSTH[0-9A-Z\\-/]*\\b": ("ttsth",), "\\btiktok\\b": ("tiktok",), "\\bTIV\\s*-\\s*[A-Z0-9]{3,}\\b": ("tiv",), "\\bTIR\\s*-\\s*[A-Z0-9]{3,}\\b": ("tir",), "\\bshopee\\b": ("shopee",),
    "ใบกำกับภาษี|ใบเสร็จรับเงิน|tax\\s*invoice": ("ใบกำกับภาษี", "ใบเสร็จรับเงิน", "invoice"), "(?:branch|สาขา)\\s*[:#]?\\s*\\d{5}": ("branch", "สาขา"),
}
THAI_RULES = (("ใบกำกับภาษี|ใบเสร็จรับเงิน|tax\\s*invoice", 55), ("(?:branch|สาขา)\\s*[:#]?\\s*\\d{5}", 35))
THRESHOLDS = (("META", 55), ("GOOGLE", 55), ("SPX", 45), ("LAZADA", 42), ("TIKTOK", 34), ("SHOPEE", 34), ("THAI_TAX", 70))
INVOICE_WORDS = "ใบกำกับภาษี|tax invoice|receipt|ใบเสร็จ|invoice"
KINDS = (("credit_note", "credit\\s*note|ใบลดหนี้"), ("tax_invoice", "tax\\s*invoice|ใบกำกับภาษี"), ("receipt", "receipt|ใบเสร็จ"), ("statement", "statement"), ("invoice", "invoice|ใบแจ้งหนี้"), ("payment", "payment"), ("waybill", "waybill|ใบส่งของ"), ("quotation", "quotation"))
CATEGORIES = (("Shipping Expense", ("shipping", "delivery", "ขนส่ง", "จัดส่ง", "spx")), ("Selling Expense", ("commission", "คอมมิชชั่น", "ค่าคอม")), ("Advertising Expense", ("advertising", "โฆษณา", "ads", "sponsored")), ("Inventory / COGS", ("goods", "สินค้า", "inventory", "cogs", "cost of goods")))
SHIPPERS = ("spx", "spx express")
VENDORS = (("SPX", "(?i)SPX\\s*Express|Shopee\\s*Express|Standard\\s*Express"), ("Shopee", "(?i)Shopee|ช็อปปี้|ช้อปปี้"), ("Lazada", "(?i)Lazada|ลาซาด้า"), ("TikTok", "(?i)TikTok|ติ๊กต๊อก"), ("Meta", "(?i)Meta\\s*Platforms|Facebook"), ("Google", "(?i)Google"))
LEGACY = {"ADS": "UNKNOWN", "OTHER": "UNKNOWN"}


def has_word(tokens: Column, word: str) -> Column:
    """A word or phrase among blank-separated tokens, not inside a longer word."""
    return F.instr(F.concat(F.lit(" "), tokens, F.lit(" ")), f" {word} ") > 0


def matches(low: Column, pattern: str) -> Column:
    """Whether a lower-cased text matches, case ignored; the pattern is tried only where one of its words is there."""
    words = [low.contains(w) for w in GATES.get(pattern, ())]
    return reduce(lambda a, b: a | b, words) & low.rlike(f"(?i){pattern}") if words else low.rlike(f"(?i){pattern}")


def has_foreign_tax_id(x: Column, own: Column) -> Column:
    return x.rlike("\\d{13}") & (F.size(F.array_except(F.regexp_extract_all(x, F.lit("\\b(\\d{13})\\b"), F.lit(1)), own)) > 0)


def name_tokens(filename: Column | str) -> Column:
    return normalize_token(F.regexp_replace(basename(filename), "\\.[A-Za-z]{2,4}$", ""))


def raw_scores(low: Column, filename: Column | str, own: Column, tokens: Column | None = None) -> dict[str, Column]:
    """Sum of the weights of the rules that hit, by platform. low: the text, lower-cased; own: array of our own tax ids; tokens: the file
    name's, if they are a column already."""
    x, f = low, F.lower(text(filename))
    tokens = name_tokens(filename) if tokens is None else tokens
    total = {p: F.lit(0) for p in PLATFORMS}
    add = lambda p, hit, w: total.__setitem__(p, total[p] + F.when(hit, w).otherwise(0))
    for p, w, words in FILENAME_RULES:
        hit = F.lit(False)
        for word in words:
            hit = hit | has_word(tokens, word)
        add(p, hit | (f.contains("rcspx") if p == "SPX" else F.lit(False)), w)
    for p, pattern, w in REGEX_RULES:
        add(p, matches(x, pattern) | matches(f, pattern), w)
    for p, w, words in WORD_RULES:
        for word in words:
            add(p, x.contains(word), w)
    context = x.contains("shopee") | x.contains("tiv") | x.contains("tir") | f.contains("shopee")
    add("SHOPEE", x.contains("trs") & context, 18)
    for pattern, w in THAI_RULES:
        add("THAI_TAX", matches(x, pattern), w)
    add("THAI_TAX", has_foreign_tax_id(x, own), 70)
    return total


def weighed(total: dict[str, Column]) -> Column:
    """struct of the scores; tax invoices count less beside a strong platform."""
    strong = F.greatest(total["META"], total["GOOGLE"], total["SPX"]) >= 70
    market = F.greatest(total["SHOPEE"], total["LAZADA"], total["TIKTOK"]) >= 55
    thai = F.floor(total["THAI_TAX"] * F.when(strong, 0.25).when(market, 0.45).otherwise(1.0))
    return F.struct(*((thai if p == "THAI_TAX" else v).cast("int").alias(p) for p, v in total.items()))


def own_array(own: tuple[str, ...] | Column) -> Column:
    return own if isinstance(own, Column) else F.array(*map(F.lit, own)).cast("array<string>")


def keyed(key: tuple, own: tuple[str, ...] | Column, build):
    """``build()``, once for a key where own ids are given as text."""
    return build() if isinstance(own, Column) else once((*key, own), build)


def with_scores(df: DataFrame, body: str, filename: str, own: tuple[str, ...] | Column, out: str, unless: str | None = None) -> DataFrame:
    """The scores as a struct column. The lower-cased text and each platform's sum are columns of their own first, so that none is
    computed twice; they are left null where the column ``unless`` is filled."""
    bound = lambda c: c if unless is None else F.when(F.col(unless).isNull(), c)
    df = df.withColumns({"__low": bound(F.lower(text(body))), "__tokens": bound(name_tokens(filename))})
    raw = keyed(("scores", filename, unless), own, lambda: {f"__s_{p}": bound(v) for p, v in raw_scores(F.col("__low"), filename, own_array(own), F.col("__tokens")).items()})
    return df.withColumns(raw).withColumn(out, once(("weighed",), lambda: weighed({p: F.col(f"__s_{p}") for p in PLATFORMS}))).drop(*raw, "__low", "__tokens")


def argmax_label(score: Column) -> Column:
    """struct(label, score) of the greatest score; ties by declaration order."""
    best = F.array_max(F.array(*(F.struct(score[p].alias("score"), F.lit(-i).alias("ord"), F.lit(p).alias("label")) for i, p in enumerate(PLATFORMS))))
    return F.struct(best["label"].alias("label"), best["score"].alias("score"))


def fast_path(low: Column, filename: Column | str) -> Column:
    """The platform of a strong id in the lower-cased text or the file name."""
    f = F.lower(text(filename))
    each = lambda p: [matches(low, one) | matches(f, one) for one in p.split("|")]
    return F.coalesce(*(F.when(reduce(lambda a, b: a | b, each(p)), label) for label, p in FAST))


def may_be(platform: str, low: Column, filename: Column | str) -> Column:
    """False only where no rule of the platform can hit, so that its score is zero and it is not the document's: a gate that is far
    cheaper than the rules of all platforms. low: the text, lower-cased. The last resort for tax invoices and UNKNOWN need no rule's hit."""
    if platform not in dict(THRESHOLDS) or platform == "THAI_TAX":
        return F.lit(True)
    patterns = [pattern for p, pattern, _ in REGEX_RULES if p == platform] + [one for p, either in FAST if p == platform for one in either.split("|")]
    gates = {w for pattern in patterns for w in GATES.get(pattern, ())}
    said = gates | {w for p, _, words in WORD_RULES if p == platform for w in words} | ({"shopee", "tiv", "tir"} if platform == "SHOPEE" else set())
    # a phrase of a file name may have other signs between its words
    named = gates | {w.split(" ")[0] for p, _, words in FILENAME_RULES if p == platform for w in words} | {"SPX": {"rcspx"}, "SHOPEE": {"shopee"}}.get(platform, set())
    f = F.lower(text(filename))
    shortest = lambda words: sorted(w for w in words if not any(v in w for v in words - {w}))
    free = [x.rlike(f"(?i){pattern}") for pattern in dict.fromkeys(patterns) if pattern not in GATES for x in (low, f)]
    return reduce(lambda a, b: a | b, [holds(low, *shortest(said)), holds(f, *shortest(named)), *free])


def by_score(own: Column) -> Column:
    """The label that the scores give: the first over its threshold, the best of at least 28, a tax invoice of another company."""
    x, score = F.col("__lower"), F.col("__scores")
    invoice = x.rlike(INVOICE_WORDS) & has_foreign_tax_id(x, own)
    return F.coalesce(*(F.when(score[p] >= t, p) for p, t in THRESHOLDS), F.when(F.col("__best.score") >= 28, F.col("__best.label")), F.when(invoice, "THAI_TAX"), F.lit("UNKNOWN"))


def with_platform(df: DataFrame, body: str, filename: str, own: tuple[str, ...] | Column, out: str = "_platform") -> DataFrame:
    """The platform of every document: a strong id decides, else the scores, which are built for the rest only."""
    df = df.withColumn("__lower", F.lower(text(body))).withColumn("__fast", once(("fast", filename), lambda: fast_path(F.col("__lower"), filename)))
    df = with_scores(df, "__lower", filename, own, "__scores", "__fast").withColumn("__best", once(("best",), lambda: argmax_label(F.col("__scores"))))
    return df.withColumn(out, F.coalesce("__fast", keyed(("by_score",), own, lambda: by_score(own_array(own))))).drop("__fast", "__scores", "__best", "__lower")


def detect_vendor(body: Column | str) -> Column:
    return F.coalesce(*(F.when(text(body).rlike(p), v) for v, p in VENDORS), F.lit(""))


def platform_from_filename(filename: Column | str) -> Column:
    tokens = normalize_token(F.regexp_replace(basename(filename), "\\.[A-Za-z]{2,4}$", ""))
    hit = lambda words: [has_word(tokens, w) for w in words]
    cases = []
    for p, _, words in FILENAME_RULES:
        any_of = F.lit(False)
        for h in hit(words):
            any_of = any_of | h
        cases.append(F.when(any_of, p))
    by_core = [F.when(F.upper(text(filename)).rlike(p), label) for label, p in (("SPX", "RCSPX"), ("SHOPEE", "TRS[A-Z]+\\d|SHOPEE-TI[VR]"), ("TIKTOK", "TTSTH\\d"), ("LAZADA", "THMPTI\\d"))]
    return F.coalesce(*by_core, *cases, F.lit("UNKNOWN"))


def keyword_hits(body: Column | str, words: tuple[str, ...], most: int = 30) -> Column:
    """Words found in the text, unique, in list order, the first ``most``."""
    x = F.lower(text(body))
    return F.slice(F.array_distinct(F.filter(F.array(*map(F.lit, words)), lambda w: F.instr(x, w) > 0)), 1, most)


def platform_hint(body: Column | str, filename: Column | str) -> Column:
    """A page's platform: an ads file name wins, then strong keywords, then the file name."""
    x, named = F.lower(text(body)), platform_from_filename(filename)
    strong = {p: words for p, w, words in WORD_RULES if w == 16}
    any_word = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.instr(x, w) > 0)
    return F.coalesce(
        F.when(named.isin("META", "GOOGLE"), named), F.when(any_word(strong["META"]), "META"), F.when(any_word(strong["GOOGLE"]), "GOOGLE"), F.when(x.rlike("ใบกำกับภาษี|tax\\s*invoice") & x.rlike("\\b\\d{13}\\b"), "THAI_TAX"),
        F.when(x.contains("spx") | x.contains("rcspx"), "SPX"), F.when(x.contains("shopee"), "SHOPEE"), F.when(x.contains("lazada"), "LAZADA"), F.when(x.contains("tiktok"), "TIKTOK"), named,
    )


def refine_hint(body: Column | str, hint: Column) -> Column:
    """An UNKNOWN hint gives way to the best text score; a known one only to a clear winner (40 or more) of another platform."""
    none = F.array().cast("array<string>")
    raw = let(F.lower(text(body)), lambda low: F.struct(*(v.alias(p) for p, v in raw_scores(low, F.lit(""), none).items())))
    best = let(let(raw, lambda r: weighed({p: r[p] for p in PLATFORMS})), argmax_label)
    return let(best, lambda b: F.when((hint == "UNKNOWN") & (b["score"] > 0), b["label"]).when((hint != "UNKNOWN") & (b["score"] >= 40), b["label"]).otherwise(hint))


def platform_of_row(route: Column, grp: Column, vendor: Column, tax: Column) -> Column:
    """Platform of a ledger row: route, then group with vendor, then vendor, then a 13-digit id."""
    known = F.upper(text(route))
    from_vendor = F.upper(detect_vendor(vendor))
    return F.coalesce(F.when(known.isin(*PLATFORMS), known), F.when(from_vendor.isin(*PLATFORMS), from_vendor), F.when(text(grp).isin("Advertising Expense") & text(vendor).contains("Ireland"), "META"), F.when(text(tax).rlike("^\\d{13}$"), "THAI_TAX"), F.lit("UNKNOWN"))


def doc_kind(platform: Column | str, body: Column | str) -> Column:
    x = text(body)
    ads = F.when(text(platform).isin("META", "GOOGLE") & x.rlike("(?i)receipt|payment"), "ads_receipt")
    return F.coalesce(ads, *(F.when(x.rlike(f"(?i){p}"), k) for k, p in KINDS), F.when(F.trim(x) == "", "blank").otherwise("other"))


def rule_key(platform: Column, grp: Column | str = "") -> Column:
    p = text(platform)
    return F.when(p.isin("SHOPEE", "LAZADA", "TIKTOK", "SPX"), F.concat(F.lit("marketplace_"), F.lower(p))).when(p.isin("META", "GOOGLE"), F.concat(F.lit("ads_"), F.lower(p))).otherwise("online_other")


def expense_category(description: Column | str, platform: Column | str = "") -> Column:
    """Shipping, selling, advertising or goods by words of the description, shipping also by the platform; else marketplace."""
    d, p = norm_name(description), norm_name(F.lit("") if isinstance(platform, str) and not platform else platform)
    hit = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.instr(d, w) > 0)
    cases = [F.when(hit(words) | p.isin(*SHIPPERS) if name == "Shipping Expense" else hit(words), name) for name, words in CATEGORIES]
    return F.coalesce(*cases, F.lit("Marketplace Expense"))


def ads_hint(body: Column | str) -> Column:
    return text(body).rlike("(?i)\\b(?:ads|advertising|promotion)\\b|โฆษณา")


def valid_platform(c: Column | str) -> Column:
    """Exact upper-case name, or an old name's platform; '' where invalid."""
    x = F.upper(F.trim(text(c)))
    return F.when(x.isin(*PLATFORMS, "UNKNOWN"), x).when(x.isin(*LEGACY), "UNKNOWN").otherwise("")


def route_segment(label: Column, hint: Column) -> Column:
    """meta_ads, google_ads, marketplace or generic, by the classifier, else by the segment's profile."""
    p = F.when(text(label).isin("", "UNKNOWN"), text(hint)).otherwise(text(label))
    return F.when(p == "META", "meta_ads").when(p == "GOOGLE", "google_ads").when(p.isin("SHOPEE", "LAZADA", "TIKTOK", "SPX"), "marketplace").otherwise("generic")
