"""Verified near-duplicate texts: components of texts by the exact Jaccard similarity of their sets of word shingles.

Candidates are the fingerprints that SimHash ball hashing links, and texts that share one of 24 bands of 5 MinHash values: a pair of
similarity s meets in a band with probability 1 - (1 - s^5)^24, that is 0.99993 at 0.8 and more above. Candidates are verified on the
whole sets of shingle hashes. Exact copies collapse before anything is emitted. First each text of a bucket is compared with the
bucket's leader, its least text hash, which the buckets of one group mostly share. Where a bucket's texts are then still in several
components, those outside its largest one (the outsiders) are compared with all its texts, in tasks of a block of outsiders and a block
of texts; no pair leaves a task but a link between components. So every candidate pair is verified or already linked, and a group of
near copies costs the square of its size only as far as its members are unlike each other: comparisons inside tasks, and the movement
of n texts to as many tasks as there are blocks of outsiders.

Defined results: null texts and texts without words have no shingles and are alike; a text with fewer words than a shingle is one
shingle; a null doc_id is kept only where no member of the component has one; repeated rows are one. Texts and shingles are told apart
by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, durable, join_counted, runs_of, strings, within
from .simhash_dedup import fingerprint_of, shingle_hashes

BANDS, ROWS, BLOCK = 24, 5, 512
_FACTORS = np.random.default_rng(20240229).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The bucket of each band, as signed 64-bit integers; one common bucket for a text without shingles."""
    import xxhash

    if not len(hashes):
        return np.zeros(1, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[i : i + 1024, None] * _FACTORS).min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[b].tobytes(), b + 1) for b in range(BANDS)], np.uint64).view(np.int64)


def text_key():
    return F.xxhash64("text")


def sketched(words: int):
    def run(frames):
        import pandas as pd

        for frame in frames:
            hashes = [shingle_hashes(t, words) for t in strings(frame["text"])]
            yield pd.DataFrame({"tid": frame["tid"], "fp": [fingerprint_of(h) for h in hashes], "bands": [band_keys(h) for h in hashes]})

    return run


def shingled(words: int):
    def run(frames):
        import pandas as pd

        for frame in frames:
            yield pd.DataFrame({"tid": frame["tid"], "shingles": [np.unique(shingle_hashes(t, words)).tobytes() for t in strings(frame["text"])]})

    return run


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) and not len(y):
        return 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def verified(similarity: float):
    def run(frames):
        import pandas as pd

        for frame in frames:
            alike = [jaccard(x, y) >= similarity for x, y in zip(frame["sa"], frame["sb"], strict=True)]
            yield frame.loc[alike, ["a", "b"]] if len(frame) else pd.DataFrame({"a": [], "b": []})

    return run


def compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of texts that are alike."""
    left = pairs.hint("merge").join(sets.selectExpr("tid as a", "shingles as sa").hint("merge"), "a")
    both = left.hint("merge").join(sets.selectExpr("tid as b", "shingles as sb").hint("merge"), "b")
    return both.select("a", "b", "sa", "sb").mapInPandas(verified(similarity), "a long, b long")


def bridged(similarity: float):
    """Per task (a block of outsiders and one of texts): links between the components that meet there."""

    def links_of(group):
        tid, label = group["tid"].to_numpy(), group["root"].to_numpy().copy()
        outside = np.flatnonzero(group["outsider"].to_numpy(bool))
        inside = np.flatnonzero(~group["outsider"].to_numpy(bool))
        if not len(outside) or not len(inside):
            return
        sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
        sizes = np.array([len(s) for s in sets])
        distinct, codes = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.r_[0, np.cumsum(sizes)]
        owner = np.repeat(np.arange(len(inside)), sizes[inside])
        members = np.concatenate([codes[starts[i] : starts[i + 1]] for i in inside])
        flags = np.zeros(len(distinct), bool)
        for i in outside:
            if (label[inside] == label[i]).all():
                continue
            mine = codes[starts[i] : starts[i + 1]]
            flags[mine] = True
            both = np.bincount(owner[flags[members]], minlength=len(inside))
            flags[mine] = False
            union = sizes[i] + sizes[inside] - both
            near = inside[(both >= similarity * union) & (label[inside] != label[i])]
            for j in near:
                if label[j] != label[i]:
                    yield tid[i], tid[j]
                    label[label == label[j]] = label[i]

    def run(frames):
        import pandas as pd

        for group in runs_of(frames, "task"):
            found = list(links_of(group))
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    return run


def similar_texts(docs: DataFrame, words: int, similarity: float, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(tid, root) for the texts that are linked to others; their components are those of all candidate pairs so similar.

    ``linked`` gives pairs (a, b) of near fingerprints of distinct ones (fp)."""
    texts = docs.select(text_key().alias("tid"), "text")
    facts = durable(texts.mapInPandas(sketched(words), "tid long, fp long, bands array<long>").groupBy("tid").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    buckets = facts.select("tid", F.explode(F.array_append("bands", F.xxhash64("fp"))).alias("bucket"))
    leaders = durable(buckets.groupBy("bucket").agg(F.min("tid").alias("leader"), F.count("*").alias("__rows")).where("__rows > 1"))
    led = durable(join_counted(buckets, leaders, "bucket"))
    prints = facts.groupBy("fp").agg(F.min("tid").alias("tid"))
    balls = durable(linked(prints.select("fp")))
    near = balls.hint("merge").join(prints.select(F.col("fp").alias("a"), F.col("tid").alias("ta")).hint("merge"), "a").hint("merge").join(prints.select(F.col("fp").alias("b"), F.col("tid").alias("tb")).hint("merge"), "b")
    pairs = led.where("tid <> leader").select(F.col("leader").alias("a"), F.col("tid").alias("b")).unionByName(near.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")))
    pairs = durable(pairs.distinct())
    nodes = pairs.selectExpr("a as tid").unionByName(pairs.selectExpr("b as tid")).distinct()
    sets = durable(within(texts, nodes, ["tid"]).groupBy("tid").agg(F.first("text").alias("text")).mapInPandas(shingled(words), "tid long, shingles binary"))
    links = durable(compared(pairs, sets, similarity))
    roots = components(links)

    rooted = durable(led.select("bucket", "tid").hint("merge").join(roots.withColumnRenamed("node", "tid").hint("merge"), "tid", "left").select("bucket", "tid", F.coalesce("root", "tid").alias("root")))
    sizes = rooted.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("__rows"), F.count("*").alias("roots"))
    split = durable(sizes.where("roots > 1").select("bucket", F.col("m.root").alias("main"), (F.col("__rows") - F.col("m.n")).alias("others"), F.col("__rows"), F.col("__rows").alias("all")))
    live = join_counted(rooted, split, "bucket")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = lambda n: F.pmod(F.xxhash64("tid", "bucket"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    texts_in = live.select("bucket", "tid", "root", F.lit(False).alias("outsider"), every("others").alias("i"), own("all").alias("j"))
    outsiders = live.where("root <> main").select("bucket", "tid", "root", F.lit(True).alias("outsider"), own("others").alias("i"), every("all").alias("j"))
    dealt = durable(texts_in.unionByName(outsiders).select(F.xxhash64("bucket", "i", "j").alias("task"), "tid", "root", "outsider"))
    full = dealt.hint("merge").join(sets.hint("merge"), "tid")
    bridges = durable(full.repartition("task").sortWithinPartitions("task").mapInPandas(bridged(similarity), "a long, b long"))
    if not bridges.isEmpty():
        roots = components(links.unionByName(bridges))
    return roots.withColumnRenamed("node", "tid")


def keep_one_similar(docs: DataFrame, words: int, similarity: float, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``docs`` with one row of each component of texts that are at least so similar: the smallest doc_id."""
    keyed = docs.withColumn("__tid", text_key())
    ids = durable(keyed.groupBy("__tid", "doc_id").agg(F.count("*").alias("copies")).withColumnRenamed("__tid", "tid"))
    roots = similar_texts(docs, words, similarity, linked)
    rooted = durable(ids.hint("merge").join(roots.hint("merge"), "tid", "left").withColumn("root", F.coalesce("root", "tid")))
    least = durable(rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid")).alias("m"), F.count("*").alias("__rows")))
    kept = F.col("doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("tid") == F.col("m.tid"))
    told = durable(join_counted(rooted, least, "root").select(F.col("tid").alias("__tid"), "doc_id", "copies", kept.alias("kept")).where("not kept or copies > 1"))
    key = ["__tid", "doc_id"]
    single = within(keyed, told.select(*key), key, keep=False)
    repeated = told.where("kept").select(*key)
    rows = single if repeated.isEmpty() else single.unionByName(within(keyed, repeated, key).dropDuplicates(key))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))
