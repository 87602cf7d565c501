"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every text gives a 64-bit majority fingerprint of its word shingles' XXH64. Cut into three blocks, two fingerprints with at most three
differing bits have one in some block, or none at all, so that on the other two blocks (42 or 43 bits) they differ in at most two bits.
There they meet in the middle: every distinct fingerprint emits, without each block in turn, all variants within one bit, half of those
two, 132 or 133 keys in all; the keys are shuffled, and fingerprints under one key are verified on all 64 bits and deduplicated. (Balls
round all 64 bits would be of radius two and one: 2,081 and 65 keys, over 30 KB for a fingerprint, or fifteen times a text of 2 KB.
Halves with balls of one bit would be 68 keys, but of 32 bits only, under which unlike fingerprints meet a hundred times as often as
under these.) Exact copies collapse before anything is emitted, so keys do not grow with their number; a distinct fingerprint has a
bounded number of others within three bits. Fingerprints and components that hold more than one in 1,024 rows get their component by
a broadcast of at most as many rows, so a large group of copies is no single task.

``keep_one`` is the form for a pipeline: one row of each group of texts with a Jaccard similarity of shingles of at least ``similarity``.
Fingerprints within three bits are candidates, and so are texts that share a MinHash band (``shingle_dedup``), because at a similarity
of 0.8 texts differ in about ten of 64 bits, where balls meet nearly everything; all are verified on their whole shingle sets.

Defined results: null or empty texts, and texts without words, have fingerprint zero and link like any other; a text with fewer
words than a shingle is one shingle; repeated rows link with each other; a null doc_id is never a component's id unless no member
has one; ties do not occur. Columns other than doc_id and text are kept by ``keep_one`` and ignored elsewhere, so they may clash
unless they begin with two underscores. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, durable, join_counted, strings, table

RADIUS, BLOCKS = 3, ((0, 21), (21, 42), (42, 64))


def shingle_hashes(text, words: int) -> np.ndarray:
    """XXH64 of each word shingle, repeated ones too; none for a text without words, one for a text shorter than a shingle."""
    import xxhash

    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(tokens) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The majority fingerprint of shingle hashes as a signed 64-bit integer."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) for every row of ``docs``."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "fp": [fingerprint_of(shingle_hashes(t, words)) for t in strings(frame["text"])]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, fp long")


def bits(low: int, high: int) -> int:
    """Bits low to high - 1 as a signed 64-bit mask."""
    mask = (1 << high) - (1 << low)
    return mask - (1 << 64) if mask >> 63 else mask


def met(frames):
    """Rows sorted by key: pairs of fingerprints under one key with at most RADIUS differing bits. Only a key's rows are held."""
    import pandas as pd

    key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def pairs(key, fp):
        found, gap = [], 1
        at = np.flatnonzero(key[1:] == key[:-1]) if len(key) else key
        while len(at):
            a, b = fp[at], fp[at + gap]
            near = (np.bitwise_count((a ^ b).view(np.uint64)) <= RADIUS) & (a != b)
            found.append(pd.DataFrame({"a": np.minimum(a, b)[near], "b": np.maximum(a, b)[near]}))
            gap += 1
            at = at[at + gap < len(key)]
            at = at[key[at + gap] == key[at]]
        return pd.concat(found).drop_duplicates() if found else None

    for frame in frames:
        key, fp = np.r_[key, frame["key"].to_numpy(np.int64)], np.r_[fp, frame["fp"].to_numpy(np.int64)]
        whole = np.searchsorted(key, key[-1]) if len(key) else 0
        out = pairs(key[:whole], fp[:whole])
        key, fp = key[whole:], fp[whole:]
        if out is not None:
            yield out
    out = pairs(key, fp)
    if out is not None:
        yield out


def keys_of(distinct: DataFrame) -> DataFrame:
    """(fp, key): without each block in turn, the variants of a fingerprint within one bit."""

    def ball(low: int, high: int):
        rest = F.col("fp").bitwiseAND(F.lit(bits(0, 64) ^ bits(low, high)).cast("long"))
        flips = [0, *(bits(i, i + 1) for i in range(64) if not low <= i < high)]
        return F.transform(F.array(*map(F.lit, flips)).cast("array<long>"), lambda m: rest.bitwiseXOR(m))

    return distinct.select("fp", F.explode(F.concat(*(ball(*block) for block in BLOCKS))).alias("key"))


def linked(distinct: DataFrame) -> DataFrame:
    """Pairs a < b of fingerprints (column fp, distinct) with at most three differing bits."""
    return keys_of(distinct).repartition("key").sortWithinPartitions("key").mapInPandas(met, "a long, b long").distinct()


def grouped(prints: DataFrame) -> DataFrame:
    """(fp, component_id, n) for every distinct fingerprint of (doc_id, fp), n its number of rows."""
    classes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = components(linked(classes.select("fp"))).withColumnRenamed("node", "fp")
    rooted = durable(classes.hint("merge").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = durable(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("__rows")))
    return join_counted(rooted, least, "root").select("fp", "component_id", "n")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    prints = durable(fingerprints(docs, words))
    groups = durable(grouped(prints)).withColumnRenamed("n", "__rows")
    return join_counted(prints, groups, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each component of texts that are at least so similar: the smallest doc_id, null last."""
    from .shingle_dedup import keep_one_similar

    return keep_one_similar(docs, words, similarity, linked)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
