"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations.

A unit vector is rotated three times by random signs and a fast Hadamard transform; the nearest signed axis is its hash. A bucket
is the pair of two such hashes, with the label; ``tables`` independent pairs are drawn and each vector enters the ``probes``
buckets nearest to it in every table (multiprobe). Two vectors are candidates where any of their buckets meet, and are verified by
cosine in double precision. At cosine 0.93 and 64 dimensions 5 tables with 4 probes meet in over 99.9 % of pairs.

Equal vectors of a label are one class with a count, so a group of exact copies costs one row. Buckets that hold one class are
dropped before any vector moves; copies of a vector get their class's result by a broadcast where they are more than one in 1,024 of
all rows. A bucket of more than ``block`` classes is dealt into blocks, and every pair of blocks is a task
of its own: links are counted inside the tasks (a pair only in the first bucket that it shares, which the codes carried along
tell), and a task returns one row per vector, a count and one forest link, never the pairs.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows with null label or vec_id, link with
nothing and are their own component; vectors of different length do not link; rows of one vec_id with several
vectors are vectors of their own, a component being named by the smallest vec_id in it; repeated rows are copies of each other and share the
component id; ties do not occur. Columns other than vec_id, embedding and label are not read, so they may clash. An empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, durable, forest, join_counted, partitions, runs_of, table

SEED = 20_240_501


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal fast Hadamard transform of rows whose length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        pairs = x.reshape(n, d // (2 * step), 2, step)
        x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def polytope_codes(x: np.ndarray, tables: int, probes: int) -> np.ndarray:
    """Bucket codes (rows, tables, probes) of unit vectors."""
    n, d = x.shape
    wide = 1 << max(1, (d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, wide - d)))
    rng, few = np.random.default_rng(SEED), min(probes, wide)
    out = np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        picks = []
        for _ in range(2):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], wide))
            order = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :few]
            value = np.take_along_axis(y, order, 1)
            picks.append((2 * order + (value < 0), (np.abs(value[:, :1]) - np.abs(value)) ** 2))
        codes = (picks[0][0][:, :, None] * (2 * wide) + picks[1][0][:, None, :]).reshape(n, -1)
        loss = (picks[0][1][:, :, None] + picks[1][1][:, None, :]).reshape(n, -1)
        out[:, t] = np.take_along_axis(codes, np.argsort(loss, axis=1, kind="stable")[:, :probes], 1)
    return out


def hashed(tables: int, probes: int):
    def run(frames):
        import pandas as pd

        for frame in frames:
            sizes = frame["embedding"].map(len)
            for d, part in frame.groupby(sizes.to_numpy()):
                x = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
                codes = polytope_codes(unit, tables, probes) + (np.int64(d) << 40)
                yield pd.DataFrame({"rep": part["rep"], "label": part["label"], "m": part["m"], "unit": [r.tobytes() for r in unit], "codes": [r.tobytes() for r in codes.reshape(len(part), -1)], "buckets": list(codes.reshape(len(part), -1))})

    return run


def verified(threshold: float, tables: int, probes: int):
    """Per bucket (or pair of its blocks): each member's number of links first met here, and a forest link to a member it reaches."""

    def run(frames):
        import pandas as pd

        rows: list[tuple] = []
        for group in runs_of(frames, "task"):
            ids, weight = group["rep"].to_numpy(), group["m"].to_numpy()
            order = np.argsort(ids)
            ids, weight, block = ids[order], weight[order], group["block"].to_numpy()[order]
            unit = np.stack([np.frombuffer(v) for v in group["unit"]])[order]
            codes = np.stack([np.frombuffer(v, np.int64) for v in group["codes"]]).reshape(-1, tables, probes)[order]
            low, high, t, bucket = block == group["low"].iloc[0], block == group["high"].iloc[0], group["t"].iloc[0], group["bucket"].iloc[0]
            rows_at, cols_at = np.flatnonzero(low), np.flatnonzero(high)
            n, a_all, b_all = np.zeros(len(ids), np.int64), [], []
            for s in range(0, len(rows_at), 256):
                at = rows_at[s : s + 256]
                a, b = np.nonzero(unit[at] @ unit[cols_at].T >= threshold)
                a, b = at[a], cols_at[b]
                keep = a < b if group["low"].iloc[0] == group["high"].iloc[0] else a != b
                a, b = a[keep], b[keep]
                first = np.ones(len(a), bool)
                for earlier in range(t):
                    first &= ~(codes[a, earlier][:, :, None] == codes[b, earlier][:, None, :]).any(axis=(1, 2))
                same = codes[a, t][:, :, None] == codes[b, t][:, None, :]
                first &= ~(same & (codes[a, t] < bucket)[:, :, None]).any(axis=(1, 2))
                a, b = a[first], b[first]
                np.add.at(n, a, weight[b])
                np.add.at(n, b, weight[a])
                a_all.append(a)
                b_all.append(b)
            if n.any():
                root = forest(len(ids), np.concatenate(a_all), np.concatenate(b_all))
                hit = np.flatnonzero(n)
                rows.append((ids[hit], ids[root[hit]], n[hit]))
            if len(rows) >= 256:
                yield pd.DataFrame({c: np.concatenate([r[i] for r in rows]) for i, c in enumerate(("a", "b", "n"))})
                rows = []
        if rows:
            yield pd.DataFrame({c: np.concatenate([r[i] for r in rows]) for i, c in enumerate(("a", "b", "n"))})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, tables: int = 5, probes: int = 4, block: int = 512) -> DataFrame:
    """Every row of (vec_id, embedding, label) with n_links and component_id."""
    spark = vectors.sparkSession
    base = vectors.select("vec_id", "embedding", "label")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0)
    classes = durable(base.where(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")))
    # a vec_id with several vectors stands for several classes, which then need numbers of their own
    repeated = not classes.groupBy("rep").count().where("count > 1").isEmpty()
    if repeated:
        classes = durable(classes.withColumn("least", F.col("rep")).withColumn("rep", F.monotonically_increasing_id()))
    label = classes.schema["label"].dataType.simpleString()
    hashes = durable(classes.mapInPandas(hashed(tables, probes), f"rep long, label {label}, m long, unit binary, codes binary, buckets array<long>"))

    light = hashes.select("rep", "label", F.posexplode("buckets").alias("p", "bucket")).select("rep", "label", (F.col("p") / probes).cast("int").alias("t"), "bucket")
    sizes = light.groupBy("t", "label", "bucket").agg(F.count("*").alias("size")).where("size > 1")
    met = light.hint("merge").join(sizes.hint("merge"), ["t", "label", "bucket"])
    blocks = met.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    dealt = dealt.select("rep", "t", "bucket", "block", "low", "high", F.xxhash64("t", "label", "bucket", "low", "high").alias("task"))
    full = dealt.hint("merge").join(hashes.select("rep", "m", "unit", "codes"), "rep")
    tasks = full.repartition(partitions(spark), "task").sortWithinPartitions("task")
    links = durable(tasks.mapInPandas(verified(threshold, tables, probes), "a long, b long, n long"))

    counts = links.groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "rep")
    roots = components(links.select("a", "b")).withColumnRenamed("node", "rep")
    found = classes.hint("merge").join(counts, "rep", "left").join(roots.hint("merge"), "rep", "left")
    if repeated:
        found = durable(found.withColumn("root", F.coalesce("root", "rep")))
        found = join_counted(found.drop("n"), durable(found.groupBy("root").agg(F.min("least").alias("low"), F.count("*").alias("__rows"))), "root").withColumn("root", F.col("low"))
    same = F.struct("label", "embedding").alias("__same")
    facts = durable(found.select(same, (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"), F.col("m").alias("__rows")))
    told = F.coalesce(usable, F.lit(False))
    out = join_counted(base.where(told).select("vec_id", "label", same), facts, "__same").select("vec_id", "n_links", "component_id", "label")
    alone = base.where(~told).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), "label")
    return out.unionByName(alone)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93
), r AS (
  SELECT vec_id AS n, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.n
), c AS (
  SELECT n, min(root) AS root FROM r GROUP BY n
), k AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, coalesce(c.root, e.vec_id) AS component_id, coalesce(e.vec_id = coalesce(c.root, e.vec_id), false) AS kept
FROM embeddings e LEFT JOIN c ON c.n = e.vec_id LEFT JOIN k ON k.a = e.vec_id
"""
