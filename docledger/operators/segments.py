"""Splitting documents of many pages into segments: page profiles, breaks between neighbours, and merged segments.

A break depends on the page before only, so ``lag`` over (document, page) is exact; segments are gaps and islands of running sums.
One shuffle by document serves the windows and the grouping.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import WORD_RULES, doc_kind, keyword_hits, platform_hint
from ..functions.fields import segment_ids, seller_info
from ..functions.text import text
from ..functions.values import tax13
from .lookups import small

HEADER_JACCARD, TITLE_JACCARD, TITLE_CHARS, MAX_SEGMENTS = 0.25, 0.60, 400, 60
TITLE = "(?i)tax\\s*invoice|receipt|invoice|statement|ใบกำกับภาษี|ใบเสร็จ"
KEYWORDS = tuple(dict.fromkeys(w for _, _, words in WORD_RULES for w in words))


def header_signature(body: Column | str) -> Column:
    """Tokens of the first five filled lines, without numbers of three or more digits, at most 60."""
    lines = F.slice(F.filter(F.split(F.lower(text(body)), "\n", -1), lambda x: F.trim(x) != ""), 1, 5)
    return F.slice(F.array_distinct(F.filter(F.split(F.regexp_replace(F.array_join(lines, " "), "\\d{3,}", " "), "[^\\p{L}\\p{M}\\p{N}]+", -1), lambda x: x != "")), 1, 60)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def profile_pages(pages: DataFrame) -> DataFrame:
    """Per page: text length, platform hint, kind, ids, page x of y, seller, keywords."""
    x = text("text")
    base = pages.withColumns({"__ids": segment_ids(x), "platform_hint": platform_hint(x, "filename")})
    return base.withColumns({
        "text_len": F.length(F.trim(x)), "doc_kind": doc_kind("platform_hint", x), "tax_id_13": tax13(x, "embedded"), "seller_id": seller_info(x)["seller_id"], "transaction_id": F.col("__ids.transaction_id"), "invoice_no": F.col("__ids.invoice_no"),
        "page_x": F.col("__ids.page_x"), "page_y": F.col("__ids.page_y"), "keywords": keyword_hits(x, KEYWORDS),
    }).drop("__ids")


def consecutive_blanks(df: DataFrame, blank: Column, doc: str = "doc_id", page: str = "page_index") -> DataFrame:
    """blank_run: blank pages up to and with this one since the last filled page."""
    w = Window.partitionBy(doc).orderBy(page)
    place = F.row_number().over(w)
    last = F.max(F.when(~blank, F.col("__place"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__place", place).withColumn("blank_run", F.when(blank, F.col("__place") - F.coalesce(last, F.lit(0))).otherwise(0)).drop("__place")


def split_segments(profiles: DataFrame, max_segments: int = MAX_SEGMENTS) -> DataFrame:
    """breaks, reason and segment_index of every page: nine ordered rules against the page before."""
    w = Window.partitionBy("doc_id").orderBy("page_index")
    blank = F.trim(text("text")) == ""
    df = consecutive_blanks(profiles.withColumn("__sig", header_signature("text")), blank)
    prev = lambda c: F.lag(c).over(w)
    df = df.withColumns({f"__b_{c}": prev(c) for c in ("doc_kind", "platform_hint", "transaction_id", "invoice_no", "tax_id_13", "seller_id", "page_x", "blank_run", "text")} | {"__b_sig": prev("__sig")})
    both = lambda c: (text(c) != "") & (text(f"__b_{c}") != "") & (F.col(c) != F.col(f"__b_{c}"))
    kinds = ~F.col("doc_kind").isin("other", "blank") & ~F.col("__b_doc_kind").isin("other", "blank")
    known = (F.col("platform_hint") != "UNKNOWN") & (F.col("__b_platform_hint") != "UNKNOWN")
    near = jaccard(F.col("__sig"), F.col("__b_sig"))
    unknown = (F.col("platform_hint") == "UNKNOWN") & (F.col("__b_platform_hint") == "UNKNOWN")
    title = F.substring(text("text"), 1, TITLE_CHARS).rlike(TITLE)
    reason = (
        F.when(F.col("__b_text").isNull() & (F.row_number().over(w) == 1), "").when(blank | (F.trim(text("__b_text")) == ""), "").when(kinds & (F.col("doc_kind") != F.col("__b_doc_kind")), "doc_kind").when(known & (F.col("platform_hint") != F.col("__b_platform_hint")), "platform")
        .when(both("transaction_id"), "transaction_id").when(both("invoice_no"), "invoice_no").when(both("tax_id_13"), "tax_id").when((F.col("page_x") == 1) & (F.col("__b_page_x") >= 1), "page_reset").when(both("seller_id"), "seller_id")
        .when(unknown & (near <= HEADER_JACCARD), "header").when(title & (near < TITLE_JACCARD), "title").otherwise("")
    )
    df = df.withColumn("reason", reason).withColumn("breaks", (F.col("reason") != "").cast("int"))
    running = F.sum("breaks").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("segment_index", F.least(running, F.lit(max_segments - 1)).cast("int")).drop("__sig", *(c for c in df.columns if c.startswith("__b_")))


def assemble_text(pages: DataFrame, keys: list[str], separator: str) -> DataFrame:
    """Texts of the pages of a key in page order, joined."""
    ordered = F.array_sort(F.collect_list(F.struct("page_index", text("text").alias("t"))))
    return pages.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda p: p["t"]), separator).alias("text"))


def merge_segment(pages: DataFrame) -> DataFrame:
    """One row per segment: pages, text, majority platform (known ones first) and kind, first filled ids in page order, reasons."""
    keys = ["doc_id", "segment_index"]
    first = lambda c: F.coalesce(F.min_by(c, F.when(text(c) != "", F.col("page_index"))), F.lit("")).alias(c)
    counts = lambda c: F.collect_list(c)
    ordered = F.array_sort(F.collect_list(F.struct("page_index", text("text").alias("t"), "reason")))
    grouped = pages.groupBy(*keys).agg(
        F.array_sort(F.collect_list("page_index")).alias("page_indices"), ordered.alias("__pages"), counts("platform_hint").alias("__p"), counts("doc_kind").alias("__k"),
        *(first(c) for c in ("tax_id_13", "seller_id", "transaction_id", "invoice_no")),
    )

    def mode(values: str, unknown: str) -> Column:
        v = F.col(values)
        rated = F.transform(F.array_distinct(v), lambda x: F.struct((x == unknown).cast("int").alias("u"), (-F.size(F.filter(v, lambda y: y == x))).alias("n"), x.alias("v")))
        return F.array_min(rated)["v"]

    merged = F.array_join(F.transform("__pages", lambda p: p["t"]), "\n\n")
    out = grouped.withColumns({"text": F.btrim(merged, F.lit(" \n\t")), "platform_hint": mode("__p", "UNKNOWN"), "doc_kind": mode("__k", ""), "reasons": F.filter(F.transform("__pages", lambda p: p["reason"]), lambda r: r != "")})
    return out.withColumn("merged_text_len", F.length("text")).drop("__pages", "__p", "__k")


def segment_documents(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page_index, filename, text) as segments. A document without text still gives one segment."""
    return merge_segment(split_segments(profile_pages(pages)))


def segment_summary(segments: DataFrame) -> DataFrame:
    return segments.groupBy("doc_id").agg(F.sum(F.size("page_indices")).alias("pages"), F.count("*").alias("segments"), F.sort_array(F.collect_set("platform_hint")).alias("platforms"))


def first_filled_in_order(df: DataFrame, column: str, keys: list[str], order: str) -> DataFrame:
    """The first filled value of each group in its order, beside every row: a minimum that each task takes of its own rows first, joined back
    by a broadcast where the groups are few. So a group may hold any share of the rows. Null keys are a group."""
    first = df.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.min_by(column, F.when(text(column) != "", F.col(order))).alias(f"first_{column}"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return df.join(small(first), same, "left").drop(*(f"__{k}" for k in keys))
