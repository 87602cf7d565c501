"""Edits, rollups, ordered files and isolated ingestion against plain versions."""

import random

from pyspark.sql import functions as F

from docledger.operators.summaries import export_summary
from docledger.sources.batches import BatchTable
from docledger.sources.edits import EditedLedger
from docledger.sources.ordered import write_ordered_csv
from docledger.sources.rollups import SummaryRollup
from docledger.streaming.isolation import DEAD, land
from docledger.streaming.jobs import expired_jobs, without_expired


def test_edits_out_of_order_with_compactions(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i % 40, "1", f"a{i}", f"b{i}") for i in range(45)] + [(None, "1", "x", "y")]
    edits = [(rng.choice([*range(45), None]), rng.choice(["A_seq", "L", "T", "doc_id", "none"]), rng.choice([None, "v1", "v2", f"w{i}"]), rng.choice([None, *range(9)])) for i in range(300)]
    frame = lambda part: spark.createDataFrame(part, "doc_id long, `column` string, value string, t long").withColumn("saved_at", F.timestamp_seconds("t"))
    ledger = EditedLedger(spark, f"{tmp_path}/l", "doc_id long, A_seq string, L string, T string")
    assert ledger.read().count() == 0
    assert ledger.create(spark.createDataFrame(rows, "doc_id long, A_seq string, L string, T string")) and not ledger.create(ledger.read())

    def plain(sent):
        best = {}
        for k, c, v, t in sent:
            if k is not None and v is not None and c in ("L", "T"):
                best[k, c] = max(best.get((k, c), (-2, "")), (-1 if t is None else t, v))
        return sorted(((k, s, best.get((k, "L"), (0, a))[1], best.get((k, "T"), (0, b))[1]) for k, s, a, b in rows), key=str)

    seen, sent = lambda: sorted((tuple(r) for r in ledger.read().collect()), key=str), []
    for n, part in enumerate([edits[:100], edits[100:220], edits[220:]]):
        assert ledger.save(frame(part), f"e{n}") and not ledger.save(frame(edits), f"e{n}")
        sent += part
        assert seen() == plain(sent)
        if n < 2:
            ledger.compact()
    assert seen() == plain(sent)
    assert ledger.generation() == 2


def test_a_compaction_that_broke_off_folds_the_same_batches(spark, tmp_path):
    ledger = EditedLedger(spark, f"{tmp_path}/l", "doc_id long, L string")
    ledger.create(spark.createDataFrame([(1, "a")], "doc_id long, L string"))
    at = lambda v, t: spark.createDataFrame([(1, "L", v, t)], "doc_id long, `column` string, value string, t long").withColumn("saved_at", F.timestamp_seconds("t"))
    ledger.save(at("b", 5), "one")
    ledger.folded.commit(spark.createDataFrame([("one",)], "edits string"), ledger.name(1))  # the writer was lost before the rows
    ledger.save(at("late", 4), "two")
    assert ledger.read().first()["L"] == "b" and ledger.compact() == 1 and ledger.read().first()["L"] == "b"
    assert [r["batch"] for r in ledger.pending(1).collect()] == ["two"]


def test_rollup_equals_the_summary_of_what_is_left(spark, tmp_path):
    rng = random.Random(4)
    schema = "_platform string, U_group string, D_vendor_code string, A_company_name string, _extraction_method string, B_doc_date string, R_paid_amount string"
    row = lambda: (rng.choice(["META", "SPX", None]), "", rng.choice(["C1", "Unknown", None]), rng.choice(["x", ""]), "m", rng.choice(["20240101", "20240305", "20250101", "?", None]), rng.choice(["1.50", "-2", "n/a", None]))
    first, more = [row() for _ in range(60)], [row() for _ in range(40)]
    frame = lambda rows: spark.createDataFrame(rows, schema)
    rollup = SummaryRollup(spark, f"{tmp_path}/r")
    assert rollup.read().count() == 0
    rollup.change("a", inserted=frame(first))
    rollup.change("b", inserted=frame(more), deleted=frame(first[:50]))
    assert not rollup.change("b", inserted=frame(more))
    key = lambda df: sorted(tuple(r) for r in df.select(*map(lambda c: F.col(c).cast("string"), rollup.read().columns)).fillna("-").collect())
    assert key(rollup.read()) == key(export_summary(frame(first[50:] + more)))
    rollup.change("c", deleted=frame(first[50:] + more))
    assert rollup.read().count() == 0


def test_files_in_order(spark, tmp_path):
    rows = [(f"j{i % 3}" if i % 7 else None, i * 37 % 500, f"d{i * 37 % 500}, \"q\"") for i in range(500)] + [("007", None, "=1"), ("a/b", 1, "x")]
    df = spark.createDataFrame(rows, "job_id string, n int, L_description string")
    parts = write_ordered_csv(df, f"{tmp_path}/out", ("n",), rows_per_part=40).collect()
    files = {}
    for p in sorted(parts, key=lambda p: (p["job"], p["part"])):
        body = open(p["path"].removeprefix("file:").replace("%25", "%"), "rb").read()
        assert len(body) == p["bytes"]
        files[p["job"]] = files.get(p["job"], b"") + body
    assert set(files) == {"", "j0", "j1", "j2", "007", "a/b"}
    for job, body in files.items():
        lines = body.decode().splitlines()
        assert lines[0].startswith("﻿") and sum(x.startswith("﻿") for x in lines) == 1
        mine = sorted((r for r in rows if (r[0] or "") == job), key=lambda r: (r[1] is not None, r[1]))
        assert len(lines) == len(mine) + 1
        for line, r in zip(lines[1:], mine, strict=True):
            assert (r[2].split(",")[0] if r[2] != "=1" else "'=1") in line
    assert len([p for p in parts if p["job"] == "j1"]) > 1
    assert write_ordered_csv(df.limit(0), f"{tmp_path}/none", ("n",)).count() == 0


def test_a_batch_with_broken_documents_is_landed_once(spark, tmp_path):
    rows, dead = BatchTable(spark, f"{tmp_path}/rows", "doc_id long, n int"), BatchTable(spark, f"{tmp_path}/dead", DEAD)
    docs = [(i, f"{i}.pdf", "bad" if i in (7, 60) else "fine", None if i % 20 else "no_text") for i in range(100)] + [(7, "7.pdf", "bad", None)]
    batch = spark.createDataFrame(docs, "doc_id long, filename string, text string, reason string").withColumn("received_at", F.timestamp_seconds(F.lit(0)))
    tries = []

    def rows_of(d):
        tries.append(1)
        return d.select("doc_id", F.when(F.col("text") == "bad", F.raise_error(F.lit("x")).cast("int")).otherwise(F.length("text")).alias("n"))

    land(batch, "b1", rows_of, rows, dead)
    n = len(tries)
    land(batch, "b1", rows_of, rows, dead)
    assert len(tries) == n < 40
    assert sorted(r["doc_id"] for r in rows.read().collect()) == [i for i in range(100) if i % 20 and i != 7]
    assert sorted((r["doc_id"], r["reason"].split(":")[0]) for r in dead.read().collect()) == sorted([(i, "no_text") for i in range(0, 100, 20)] + [(7, "failed")] * 2)


def test_rows_of_expired_jobs_go(spark):
    events = spark.createDataFrame([("a", 0), ("a", 50), ("a", 200), ("b", 10), (None, 3), ("b", None)], "job_id string, t long").select("job_id", F.timestamp_seconds("t").alias("updated_at"))
    got = expired_jobs(events, 60)
    assert sorted((r["job_id"], r["events"]) for r in got.collect()) == [("a", 1), ("a", 2), ("b", 1)]
    rows = spark.createDataFrame([("a", 200), ("a", 201), ("b", None), ("c", 1), (None, 1)], "job_id string, t long").select("job_id", "t", F.timestamp_seconds("t").alias("at"))
    assert sorted(((r["job_id"], r["t"]) for r in without_expired(rows, got, "at").collect()), key=str) == sorted([("a", 201), ("b", None), ("c", 1), (None, 1)], key=str)


def test_micro_batches_of_one_file_are_dealt_to_all_cores(spark, tmp_path):
    from docledger.plans.extract import JobConfig
    from docledger.streaming.jobs import ingest_stream

    spark.range(400).selectExpr("'j' job_id", "id doc_id", "id file_index", "concat(id, '.pdf') filename", "'Total 5.00' text").coalesce(1).write.parquet(f"{tmp_path}/in")
    ingest_stream(spark, f"{tmp_path}/in", "job_id string, doc_id long, file_index long, filename string, text string", f"{tmp_path}/rows", f"{tmp_path}/state", JobConfig(), 1).awaitTermination()
    back = spark.read.parquet(f"{tmp_path}/rows")
    assert back.count() == 400 and back.select("_metadata.file_name").distinct().count() == spark.sparkContext.defaultParallelism


def test_a_sound_batch_is_tried_once_and_a_broken_one_keeps_what_did_not_fail(spark, tmp_path):
    rows, dead = BatchTable(spark, f"{tmp_path}/rows", "doc_id long"), BatchTable(spark, f"{tmp_path}/dead", DEAD)
    frame = lambda bad: spark.range(64).selectExpr("id doc_id", "concat(id, '.pdf') filename", f"if(id = {bad}, 'bad', 'fine') text", "timestamp_seconds(0) received_at", "string(null) reason")
    tries = []

    def rows_of(d):
        tries.append(1)
        return d.select("doc_id", F.when(F.col("text") == "bad", F.raise_error(F.lit("x"))).alias("x")).where(F.col("x").isNull()).drop("x")

    land(frame(-1), "sound", rows_of, rows, dead)
    assert len(tries) == 1 and rows.read().count() == 64 and dead.read().count() == 0
    land(frame(9), "broken", rows_of, rows, dead)
    assert sorted(r["doc_id"] for r in rows.read().where("batch = 'broken'").collect()) == [i for i in range(64) if i != 9]
    assert [r["doc_id"] for r in dead.read().collect()] == [9]


def test_events_of_one_file_are_sorted_by_all_cores(spark, tmp_path):
    spark.range(10).selectExpr("'a' job_id", "timestamp_seconds(id) updated_at").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("job_id string, updated_at timestamp").parquet(f"{tmp_path}/in")
    assert "RepartitionByExpression [job_id" in expired_jobs(stream, 60)._jdf.queryExecution().analyzed().toString()


def test_documents_land_in_lots_that_all_cores_write(spark, tmp_path):
    """Two lots of several files each, which arrive as two micro-batches of one row a document."""
    from docledger.plans.extract import JobConfig
    from docledger.platform_queries import landed
    from docledger.streaming.jobs import ingest_stream

    source, schema, files = landed(spark, "/root/testdata/sf0.001")
    assert files == spark.sparkContext.defaultParallelism and len(spark.read.parquet(source).inputFiles()) == 2 * files
    stream = ingest_stream(spark, source, schema, f"{tmp_path}/rows", f"{tmp_path}/state", JobConfig(), files_per_batch=files)
    stream.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in stream.recentProgress) == 2
    assert spark.read.parquet(f"{tmp_path}/rows").select("doc_id").distinct().count() == spark.read.schema(schema).parquet(source).count()
