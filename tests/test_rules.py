"""Scores by a table of rules against plain sums and against the built-in expressions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docledger.functions import classify as C
from docledger.operators import lookups as J
from docledger.operators.rules import RULE, built_in_rules, rule_scores


@pytest.mark.parametrize("few", [J.BROADCAST_ROWS, 10])
def test_many_rules_against_plain_sums(spark, monkeypatch, few):
    monkeypatch.setattr(J, "BROADCAST_ROWS", few)  # an index beyond this is met by the hashes of its grams
    rng = random.Random(11)
    word = lambda a, b: "".join(rng.choice("abcde") for _ in range(rng.randint(a, b)))
    rules = [(f"r{i % 900}", f"P{i % 900 % 4}", i % 900 % 7, "text", word(3, 6), None) for i in range(1000)]
    rules += [(f"x{i}", "X", 2, "text", t := word(2, 3), f"\\b{t}\\b") for i in range(60)] + [(f"f{i}", "F", 3, "file", word(2, 3), None) for i in range(40)]
    rules += [("n", "N", 5, "name", "big one", None), ("n", "N", 5, "name", "abc", None), ("none", None, 9, "text", "a", None), ("blank", "B", 9, "text", "", None), ("null", "Z", None, "text", "zz", None)]
    rules += [rules[0], rules[1002]]
    docs = [(i, " ".join(word(1, 9) for _ in range(rng.randint(0, 60))), f"in/{word(3, 5)}_{word(2, 4)}.pdf") for i in range(150)]
    docs += [(900, "ZZ top", "big_one.pdf"), (901, None, None), (902, "", "abc.PDF"), (903, "x" * 50_000 + " abcde", "bigone.pdf"), (904, "zz", "abc-1.pdf"), (904, "zz", "abc-1.pdf")]

    def plain(t, f):
        low, name = (t or "").lower(), (f or "").lower()
        words = " " + re.sub(r"\s+", " ", re.sub(r"[_.-]+", " ", re.sub(r"\.[A-Za-z]{2,4}$", "", name.rsplit("/", 1)[-1]))).strip() + " "
        hit = set()
        for rule, p, w, place, term, pattern in rules:
            hay = {"text": low, "file": name, "name": words}[place]
            if p and term and (f" {term} " if place == "name" else term) in hay and (pattern is None or re.search(pattern, low)):
                hit.add((p, rule, w or 0))
        return {p: sum(w for q, _, w in hit if q == p) for p in {q for q, _, _ in hit}}

    got = rule_scores(spark.createDataFrame(docs, "id long, t string, f string"), spark.createDataFrame(rules, RULE), "t", "f").collect()
    assert sorted((r["id"], sorted(r["scores"].items())) for r in got) == sorted((i, sorted(plain(t, f).items())) for i, t, f in docs)


def test_texts_are_not_written_and_few_of_their_grams_meet_the_rules(spark, monkeypatch):
    """Rules that differ in their last characters only stand each under a gram of their own."""
    keys = spark.range(200).selectExpr("concat('user_', 100000 + id * 4321) AS __key")
    assert J.rarest_grams(keys).groupBy("__gram").count().agg(F.max("count")).first()[0] <= 2
    staged = []
    monkeypatch.setattr(J, "staged", lambda df: staged.append(df.columns) or df)
    rules = spark.createDataFrame([("a", "A", 1, "text", "abc", None)], RULE)
    assert rule_scores(spark.createDataFrame([("xabcx", "f")], "t string, f string"), rules, "t", "f").first()["scores"] == {"A": 1}
    assert staged and not any("t" in columns or "__low" in columns for columns in staged)


def test_no_rules_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a", "b.pdf")], "id long, t string, f string")
    assert rule_scores(docs, spark.createDataFrame([], RULE), "t", "f").first()["scores"] == {}
    assert rule_scores(docs.limit(0), built_in_rules(spark), "t", "f").count() == 0


def test_built_in_rules_as_a_table(spark):
    texts = [("Meta Platforms Ireland receipt", "fb_1.pdf"), ("Google AdWords via google ads", "gads.pdf"), ("lazada lzd thmpti 123456789012", "THMPTI1.pdf"), ("rcspx abc", "x-RCSPX1.pdf"), ("TikTok Shop", "tt shop.png"), ("ใบกำกับภาษี สาขา 00001", "a.pdf"), ("TIV - ABC shopee", "Shopee-TIV.pdf"), ("", "")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(texts)], "id long, t string, f string")
    want = docs.select("id", *(v.alias(p) for p, v in C.raw_scores(F.lower("t"), "f", F.array().cast("array<string>")).items())).collect()
    got = {r["id"]: r["scores"] for r in rule_scores(docs, built_in_rules(spark), "t", "f").collect()}
    for row in want:
        assert got[row["id"]] == {p: row[p] for p in C.PLATFORMS if row[p]}, row


def test_only_keys_leave_a_text(spark, monkeypatch):
    """Texts of many bytes a character and across the stretches that are looked at; digits that are grams of keys, but no keys, stay."""
    import numpy as np
    import pyarrow as pa

    from docledger.operators import key_search as K

    rng = random.Random(3)
    keys = [(f"user_{i}", "text") for i in (1, 12, 123, *range(100_000, 101_000))] + [("ใบกำกับภาษี", "text"), ("กำ", "text"), ("ab", "file"), ("x" * 40, "text")]
    index = J.rarest_grams(spark.createDataFrame(keys, "__key string, place string"))
    held, bits = K.bloom(index, len(keys), "place", ["file", "text"])
    forms = [tuple(r) for r in index.selectExpr("octet_length(__gram)", "octet_length(left(__key, __off))", "octet_length(__key)").distinct().collect()]
    digits = "".join(rng.choice("0123456789") for _ in range(3000))
    hays = [("text", f"{digits} user_1234567 ใบกำกับภาษีab"), ("file", "ab user_1"), ("text", ""), ("text", "ก" * 50 + "x" * 41 + " user_100777 user_100777"), ("text", None)]
    before = [("text", "user_1"), *hays]  # a batch may begin inside its columns
    batch = pa.RecordBatch.from_arrays([pa.array(range(-1, len(hays))), pa.array([p for p, _ in before]), pa.array([t for _, t in before])], ["id", "place", "__hay"]).slice(1)
    want = {(i, k) for i, (p, t) in enumerate(hays) for k, place in keys if place == p and k in (t or "")}
    for step in (7, 64, K.STEP):
        monkeypatch.setattr(K, "STEP", step)
        find = K.finder(["id", "place"], "place", ["file", "text"], forms, type("Held", (), {"value": held}), bits)
        got = [(r["id"], r["__found"].decode()) for b in find(iter([batch])) for r in b.to_pylist()]
        assert len(got) == len(set(got)) and want <= set(got) and len(got) <= len(want) + 3
    assert np.unpackbits(np.frombuffer(held, np.uint8)).sum() > len(keys)
