"""Scores by a table of rules, of any number.

A row of the table is (rule, platform, weight, place, term, pattern). A rule of several rows hits where one of them does, and counts once.
Places: ``text``, the term is anywhere in the lower-cased text; ``file``, anywhere in the lower-cased file name; ``name``, it is a word or
phrase among the words of the file name. A row with a pattern hits where the pattern is found too, case ignored, in the text or the
file name of that place; it is tried only where the term is.

The terms are looked up by one filter over all of them (``lookups.key_hits``), so a further rule is a row and no further expression.
Documents are known by two hashes of text and file name, 128 bits, so they are neither numbered nor written: what is shuffled is a hash and a
term for each term that a document holds, and the documents once, to meet their hits. A document's hits are at most as many as there are rules.

Defined results: rows without a term or platform never hit, a null weight counts 0; a document without a hit, or null in text and file
name, has an empty map; no rules give empty maps; repeated rules and documents are as one rule and as they come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions.text import basename, normalize_token, text
from .lookups import key_hits

RULE = "rule string, platform string, weight int, place string, term string, pattern string"


def built_in_rules(spark: SparkSession) -> DataFrame:
    """The fixed rules of ``classify`` that need a word, as rows to change or add to. Two are left to ``raw_scores``: billing numbers, which
    have no word, and tax ids that are not one's own."""
    rows = [(f"name {p}", p, w, "name", word, None) for p, w, words in C.FILENAME_RULES for word in words]
    rows += [("name SPX", p, w, "file", "rcspx", None) for p, w, _ in C.FILENAME_RULES if p == "SPX"]
    rows += [(pattern, p, w, place, word, pattern) for p, pattern, w in C.REGEX_RULES for word in C.GATES.get(pattern, ("tiv",) if "TIV" in pattern else ()) for place in ("text", "file")]
    rows += [(f"word {p} {word}", p, w, "text", word, None) for p, w, words in C.WORD_RULES for word in words]
    rows += [(pattern, "THAI_TAX", w, "text", word, pattern) for pattern, w in C.THAI_RULES for word in C.GATES[pattern]]
    return spark.createDataFrame(rows, RULE)


def rule_scores(df: DataFrame, rules: DataFrame, body: str, filename: str, out: str = "scores") -> DataFrame:
    """The rows with ``out``: map of platform to the sum of its rules' weights."""
    low, file = F.lower(text(body)), F.lower(text(filename))
    tokens = normalize_token(F.regexp_replace(basename(filename), "\\.[A-Za-z]{2,4}$", ""))
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    place = lambda name, hay: F.struct(F.lit(name).alias("place"), hay.alias("__hay"))
    content = {"__h1": F.xxhash64(text(body), text(filename)), "__h2": F.xxhash64(F.lit("rules"), text(filename), text(body))}
    usable = rules.where("length(term) > 0 AND platform IS NOT NULL").withColumn("weight", F.coalesce("weight", F.lit(0)))
    term = F.when(F.col("place") == "name", padded(normalize_token("term"))).otherwise(F.lower("term"))
    keys = usable.where(F.col("place").isin("text", "file", "name")).select(term.alias("__key"), "rule", "platform", "weight", "place", "pattern").distinct()
    hays = df.select(*(v.alias(k) for k, v in content.items()), F.explode(F.array(place("text", low), place("file", file), place("name", padded(tokens)))).alias("__s")).select(*content, "__s.place", "__s.__hay")
    found = key_hits(hays, keys, "place")
    of_row = found.groupBy(*content).agg(F.collect_set(F.struct("platform", "rule", "weight", "place", "pattern")).alias("__hits"))
    joined = df.drop(out).withColumns(content).hint("merge").join(of_row.hint("merge"), list(content), "left")

    def holds(h: Column) -> Column:
        pattern = F.concat(F.lit("(?i)"), h["pattern"])
        return h["pattern"].isNull() | F.when(h["place"] == "text", F.rlike(low, pattern)).otherwise(F.rlike(file, pattern))

    counted = F.array_distinct(F.transform(F.filter("__hits", holds), lambda h: F.struct(h["platform"].alias("platform"), h["rule"].alias("rule"), h["weight"].alias("weight"))))
    kept = joined.withColumn("__kept", F.coalesce(counted, F.array().cast("array<struct<platform:string,rule:string,weight:int>>")))
    named = kept.withColumn("__named", F.array_sort(F.array_distinct("__kept.platform")))
    total = lambda p: F.aggregate(F.filter("__kept", lambda h: h["platform"] == p), F.lit(0).cast("long"), lambda n, h: n + h["weight"])
    return named.withColumn(out, F.map_from_arrays("__named", F.transform("__named", total))).drop(*content, "__hits", "__kept", "__named")
