"""Line deduplication with two Bloom filters.

A line's key is the line stripped and lower-cased (A-Z). Keys of at least ``least_chars`` code points that at least ``least_docs``
documents hold lose all their lines except in the largest doc_id that holds them. A first pass sends the 64-bit hashes of the keys,
distinct inside a task, to the partition that they hash to. There two Bloom filters, of hashes seen once and of hashes seen again,
tell the suspected repeats: a hash that the first filter knows is reported, and not again once the second knows it. Each partition has
filters of its own of ``filter_bits``, and there are as many partitions as documents need at ``doc_bits`` each, so filters never fill
up, are never merged and never leave their task. A filter errs only towards suspicion, so no repeated key is missed.

Only suspected lines are shuffled, for an exact count of their documents under the key's SHA-256 and the choice of the document that
keeps them. Suspects are told by a broadcast of at most ``most_suspects`` hashes, beyond that by a shuffle on the hash. Keys of more
than one in 1,024 repeated lines (so fewer than 1,024 keys) get their keeper by a broadcast, without a shuffle.

Defined results: null or empty text is one empty line; rows of one doc_id are one document, so repeated rows count once and keep or
lose lines alike; rows of null doc_id do not count and never keep a repeated line; ties do not occur; documents that lose all lines
keep an empty text. Columns named n_lines and n_dropped are replaced, other columns kept; names with two leading underscores are not
allowed. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, durable, join_counted, lower_ascii, partitions, table


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE_CHARS)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keys_of(text: Column, least_chars: int) -> Column:
    long_lines = F.filter(F.transform(lines_of(text), lambda x: F.btrim(x, F.lit(SPACE_CHARS))), lambda x: F.char_length(x) >= least_chars)
    return F.array_distinct(F.transform(long_lines, lower_ascii))


def digest(key: str) -> Column:
    return F.unhex(F.sha2(key, 256))


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    h = hashes.view(np.uint64)
    return np.stack([h & np.uint64(bits - 1), (h >> np.uint64(33)) & np.uint64(bits - 1)]).astype(np.int64)


def task_hashes(frames):
    """Per task: its hashes, each once or a few times."""
    import pandas as pd

    for frame in frames:
        arrays = [a for a in frame["hashes"] if a is not None and len(a)]
        if arrays:
            hashes, n = np.unique(np.concatenate(arrays), return_counts=True)
            yield pd.DataFrame({"hash": np.r_[hashes, hashes[n > 1]]})


def repeated(bits: int):
    """Per partition: the hashes that its filters suspect to be there more than once."""

    def run(frames):
        import pandas as pd

        once, again = np.zeros(bits, bool), np.zeros(bits, bool)
        for frame in frames:
            hashes, n = np.unique(frame["hash"].to_numpy(np.int64), return_counts=True)
            at = positions(hashes, bits)
            seen = (n > 1) | once[at].all(axis=0)
            new = seen & ~again[at].all(axis=0)
            once[at.ravel()] = True
            again[at[:, seen].ravel()] = True
            if new.any():
                yield pd.DataFrame({"hash": hashes[new]})

    return run


def suspects(docs: DataFrame, least_chars: int, doc_bits: int, filter_bits: int, most_suspects: int) -> DataFrame:
    """(doc_id, key) of the lines, distinct in a row, that may be in more than one document."""
    spark = docs.sparkSession
    keyed = docs.select("doc_id", keys_of(F.col("text"), least_chars).alias("keys"))
    hashes = keyed.select(F.transform("keys", lambda k: F.xxhash64(k)).alias("hashes")).mapInPandas(task_hashes, "hash long")
    tasks = max(partitions(spark), -(-docs.count() * doc_bits // filter_bits))
    found = durable(hashes.repartition(tasks, "hash").mapInPandas(repeated(filter_bits), "hash long").distinct())
    few = found.limit(most_suspects + 1).count() <= most_suspects
    lines = keyed.select("doc_id", F.explode("keys").alias("key")).withColumn("hash", F.xxhash64("key"))
    return lines.join(F.broadcast(found) if few else found.hint("merge"), "hash", "left_semi").select("doc_id", "key")


def drop_lists(docs: DataFrame, least_chars: int, least_docs: int, **filters: int) -> DataFrame:
    """(doc_id, drop): the keys whose lines a document loses."""
    lines = durable(suspects(docs, least_chars, **filters).withColumn("digest", digest("key")))
    holders = lines.groupBy("digest", "doc_id").agg(F.count("*").alias("rows"))
    known = holders.groupBy("digest").agg(F.count("doc_id").alias("docs"), F.max("doc_id").alias("keeper"), F.sum("rows").alias("__rows")).where(F.col("docs") >= least_docs)
    lost = join_counted(lines, durable(known.select("digest", "keeper", "__rows")), "digest").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id").agg(F.collect_set("key").alias("drop"))


def dedup_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, doc_bits: int = 64, filter_bits: int = 1 << 24, most_suspects: int = 1_000_000) -> DataFrame:
    """Rows of ``docs`` with the kept text in place of text, n_lines (before) and n_dropped."""
    docs = docs.drop("n_lines", "n_dropped")
    lists = drop_lists(docs, least_chars, least_docs, doc_bits=doc_bits, filter_bits=filter_bits, most_suspects=most_suspects).select(F.col("doc_id").alias("__doc"), F.col("drop").alias("__drop"))
    joined = docs.hint("merge").join(lists.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__doc")), "left")
    lines = lines_of(F.col("text"))
    kept = F.when(F.col("__drop").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col("__drop"), line_key(x))))
    out = joined.withColumns({"n_lines": F.size(lines).cast("long"), "__kept": kept})
    out = out.withColumns({"text": F.array_join("__kept", "\n"), "n_dropped": F.col("n_lines") - F.size("__kept")})
    return out.drop("__kept", "__doc", "__drop")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.r, k.doc_id, k.i, k.line, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.keeper AS lost FROM k LEFT JOIN c USING (key)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY r
"""
