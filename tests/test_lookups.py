"""Lookups with many keys against brute force, and the job table of committed batches."""

import random

import pytest
from pyspark.sql import functions as F

from docledger.functions.candidates import keyword_positions
from docledger.functions.fields import withheld, withholding
from docledger.operators import lookups as J
from docledger.sources.batches import BatchTable


def brute(texts, keys):
    """The value of the longest key inside, then of the least ord."""
    order = sorted(keys, key=lambda k: (-len(k[0]), k[2]))
    return {i: next((v for k, v, _ in order if k in t), None) for i, t in texts}


def test_many_keys_in_long_texts(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefg ") for _ in range(n)).strip() or "ab"
    keys = [(word(rng.randint(4, 14)), f"v{i}", i) for i in range(10_000)] + [("q", "one", 20_000), ("zz", "two", 20_001), ("qq", "pair", 20_002)]
    texts = [(i, " ".join(word(rng.randint(2, 9)) for _ in range(20_000))) for i in range(3)]
    texts += [(10 + i, word(rng.randint(1, 30))) for i in range(300)] + [(1000, ""), (1001, "xqx"), (1002, "xzzx"), (1003, "wqqw"), (1004, "y")]
    texts = [(i, " ".join(t.split())) for i, t in texts]
    dim = spark.createDataFrame(keys, "keyword string, code string, ord int")
    df = spark.createDataFrame(texts, "id long, body string").repartition(4)
    got = {r["id"]: r["code_found"] for r in J.contains_longest_first(df, F.col("body"), dim, "keyword", "code", "code_found").collect()}
    assert got == brute(texts, keys)


def test_index_holds_every_key_once(spark):
    keys = spark.createDataFrame([("abcd", 1), ("abce", 2), ("ab", 3), ("x", 4)], "__key string, ord int")
    rows = {r["__key"]: (r["__gram"], r["__off"]) for r in J.rarest_grams(keys).collect()}
    assert rows == {"abcd": ("bcd", 1), "abce": ("bce", 1), "ab": ("ab", 0), "x": ("x", 0)}


def test_keyword_positions_with_words_that_overlap_themselves(spark):
    row = spark.createDataFrame([("aXaxaxa date Update, TAX invoice invoice date",)], "t string").select(keyword_positions("t", ["axa", "date", "invoice", "tax invoice"]).alias("p")).first()
    text = "axaxaxa date update, tax invoice invoice date"
    assert row["p"] == sorted({i for w in ("axa", "date", "invoice", "tax invoice") for i in range(len(text)) if text.startswith(w, i)})


@pytest.mark.parametrize("gap", [0, 500, 20_000])
def test_withholding_words_at_any_distance(spark, gap):
    far = " x" * gap
    texts = [f"Withholding tax{far} at the rate of 3 %{far} amounting to 12.50", f"หักภาษี ณ ที่จ่าย{far} อัตรา 5%{far} จำนวน 1,000.00", f"rate 3% amounting to 5.00{far} wht"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", withholding("t").alias("w")).collect()
    got = {r["i"]: (r["w"]["rate"], r["w"]["amount"] and str(r["w"]["amount"])) for r in rows}
    assert got == {0: ("3%", "12.50"), 1: ("5%", "1000.00"), 2: (None, None)}


def test_batches(spark, tmp_path):
    table = BatchTable(spark, f"{tmp_path}/jobs", "n long")
    assert table.read().count() == 0 and not table.committed("a")
    assert table.commit(spark.range(5).selectExpr("id n"), "a") and not table.commit(spark.range(9).selectExpr("id n"), "a")
    spark.range(100).selectExpr("id n").write.parquet(table.folder("b"))
    assert table.read().count() == 5
    assert table.commit(spark.range(3).selectExpr("id n"), "b") and table.commit(spark.range(0).selectExpr("id n"), "c")
    assert sorted((r["batch"], r["count"]) for r in table.read().groupBy("batch").count().collect()) == [("a", 5), ("b", 3)]
    assert {r["batch"]: r["rows"] for r in table.manifests().collect()} == {"a": 5, "b": 3, "c": 0}
    with pytest.raises(ValueError, match="batch's name"):
        table.commit(spark.range(1).selectExpr("id n"), "../x")


def test_gated_patterns_find_what_the_bare_ones_do(spark):
    """Look-ahead gates, one search before the work and lazy choices change no result."""
    from docledger.functions.text import led, normalize_text, squash_ws

    assert led("ab", "(?i)apple|bee") == "(?i)(?=[ab])(?:apple|bee)"
    bare, gated = "(?i)รวม|Total", led("tร", "(?i)รวม|Total")
    texts = ["a tOTAL", "xรวมx", "\u0130otal", "", "to tal", "T", "Total"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.regexp_instr("t", F.lit(bare)).alias("a"), F.regexp_instr("t", F.lit(gated)).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and [r["a"] > 0 for r in got] == [True, True, False, False, False, False, True]
    messy = {"plain text\nline": "plain text\nline", " a  b\t c \r\n\r\n\r\n d ": "a b c\n\nd", "๑２–x\u200b\u00a0y": "12-x y", "a \u0085 b": "a\u0085b", "a\x01b": "ab", "\n\n x": "x"}
    assert [r[0] for r in spark.createDataFrame([(t,) for t in messy], "t string").select(normalize_text("t")).collect()] == list(messy.values())
    assert spark.createDataFrame([("a\u2003b\u0085c\u200bd \u3000e",)], "t string").select(squash_ws("t")).first()[0] == "abc\u200bde"


def test_texts_stay_out_of_the_shuffle_for_wallets(spark, monkeypatch):
    """A table of wallets that is too large to go along is met without the texts, and the rows are written as columns."""
    from docledger.plans import jobs
    from docledger.plans.extract import JobConfig
    from docledger.sources.shared import written

    seen = []
    monkeypatch.setattr(jobs, "written", lambda df: seen.append(df) or written(df))
    monkeypatch.setattr(J.small, "__defaults__", (1,))
    docs = spark.createDataFrame([("j", 1, 1, "a.pdf", "Shopee (Thailand) 1234567"), ("j", 2, 2, "b.pdf", " "), ("j", 3, 3, "c.pdf", "the Corner account")], "job_id string, file_index long, doc_id long, filename string, text string")
    wallets = spark.createDataFrame([("0000000000001", "1234567", "EWL001"), ("0000000000001", "9", "EWL002")], "client_tax_id string, seller_id string, wallet_code string")
    shops = spark.createDataFrame([("corner", "EWL003", 1)], "keyword string, wallet_code string, ord int")
    rows = jobs.run_job(docs, JobConfig(own={"a": "0000000000001"}, configured=("0000000000001",)), {"wallet_dim": wallets, "shop_keyword_dim": shops})[0]
    got = {r["doc_id"]: (r["Q_payment_method"], r["_status_reason"]) for r in rows.collect()}
    assert got[1][0] == "EWL001" and got[2] == ("", "no_text") and got[3][0] == "EWL003"
    plan, met = seen[0]._jdf.queryExecution().optimizedPlan(), []
    while plan.children().size() == 2 or not plan.nodeName().endswith("Relation") and plan.children().size():
        if plan.nodeName() == "Join" and "__number" in plan.condition().toString():
            met.append(plan.left().output().mkString(" "))
        plan = plan.children().apply(0)
    assert len(met) == 1 and "__inside#" in met[0] and " text#" not in " " + met[0]


def test_written_rows_are_as_they_were(spark, tmp_path):
    from docledger.sources.shared import written

    df = spark.range(5).selectExpr("id", "cast(id as decimal(18,2)) m", "array(cast(id as string)) a", "map('k', id) o", "cast(null as string) s", "timestamp_seconds(id) t")
    back = written(df)
    assert back.inputFiles() and back.columns == df.columns and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert written(df.selectExpr("id", "null AS nothing")).count() == 5
