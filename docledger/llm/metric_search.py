"""Exact top-k inner-product search on integer vectors by M-tree best-first search.

Inner products become distances: with M the largest squared norm, each vector x gets one more coordinate sqrt(M - |x|^2) and each
query a zero, so that the squared Euclidean distance is |q|^2 + M - 2 q.x, least where the product is greatest. In that metric space
Spark builds an M-tree: routing pivots (a bounded sample, by hash order, of at most 256 rows) split all rows; a pivot's rows are cut
by their distance from it into at most 16 rings of about equal size, and a ring by hash into shards of about ``shard_rows`` rows, so
that a dense pivot is no task of its own; each shard is cut into leaf pages round local pivots. A page keeps its pivot, covering
radius, distance to the shard's pivot (the parent) and, of each entry, the distance to the page's pivot. Every row is indexed.

A query first searches the shard that would hold it, which bounds its k-th distance. Then it goes to the rings that can hold something
nearer. Inside a shard pages are taken best first; a page's distance is computed only if the stored parent distances can't rule it out,
and an entry's only if its stored distance can't. Bounds carry a slack for rounding; scores are exact integers. Queries are dealt in
blocks, so no task holds them all, and a page moves only to the blocks with a query that goes there.

Defined results: rows whose vector is null or empty or holds null or non-finite components, or whose vec_id is null, take no part; vectors of
another length than the most frequent one are compared as if padded by zeros; a query repeated as rows is one query; repeated
candidate rows each count; all rows with the query's vec_id are its own. Ties go to the smaller vec_id. Columns other than vec_id,
embedding and what ``is_query`` names are not read, so they may clash. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table

MAX_PIVOTS, RINGS, SLACK, MAX_ROUTES = 256, 16, 1e-6, 1_000_000


def unpacked(blobs, width: int) -> np.ndarray:
    return np.stack([np.frombuffer(b, np.int64) for b in blobs]) if len(blobs) else np.zeros((0, width), np.int64)


def lifted(x: np.ndarray, top: int) -> np.ndarray:
    """Points of the metric space for integer vectors."""
    return np.c_[x.astype(float), np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0).astype(float))]


def gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
    return np.sqrt(np.maximum(square, 0))


def nearest(pivots, top: int, width: int):
    """Per row: its nearest pivot and the distance to it."""

    def run(frames):
        centre = pivots.value
        for frame in frames:
            far = gaps(lifted(unpacked(frame["x"], width), top), centre) if len(frame) else np.zeros((0, 1))
            at = far.argmin(axis=1)
            yield frame.assign(pivot=at.astype(np.int32), gap=far[np.arange(len(at)), at])

    return run


def pages_of(pivots, top: int, width: int, page_rows: int):
    """One shard's rows as leaf pages."""

    def run(frame):
        import pandas as pd

        frame = frame.sort_values("vec_id", kind="stable")
        x = unpacked(frame["x"].to_numpy(), width)
        points, parent = lifted(x, top), pivots.value[int(frame["pivot"].iloc[0])][None, :]
        count = -(-len(x) // page_rows)
        local = points[np.linspace(0, len(x) - 1, count).astype(int)]
        at, out = gaps(points, local).argmin(axis=1), []
        for k in range(count):
            mine = np.flatnonzero(at == k)
            for part in np.array_split(mine, -(-len(mine) // (2 * page_rows))) if len(mine) else []:
                far = gaps(points[part], local[k : k + 1])[:, 0]
                order = np.argsort(far, kind="stable")
                part, far = part[order], far[order]
                out.append({"pivot": frame["pivot"].iloc[0], "ring": frame["ring"].iloc[0], "sub": frame["sub"].iloc[0], "centre": local[k].tobytes(), "radius": float(far[-1]), "from_parent": float(gaps(local[k : k + 1], parent)[0, 0]), "ids": frame["vec_id"].to_numpy(dtype=np.int64)[part].tobytes(), "xs": x[part].tobytes(), "gaps": far.tobytes()})
        return pd.DataFrame(out)

    return run


def searched(pivots, top: int, width: int, k: int):
    """Best-first search of one shard's pages for a block of queries."""

    def run(pages, queries):
        import pandas as pd

        out: list[tuple] = []
        if len(pages) and len(queries):
            parent = pivots.value[int(pages["pivot"].iloc[0])][None, :]
            centres = np.stack([np.frombuffer(b) for b in pages["centre"]])
            radius, from_parent = pages["radius"].to_numpy(), pages["from_parent"].to_numpy()
            ids = [np.frombuffer(b, np.int64) for b in pages["ids"]]
            xs = [np.frombuffer(b, np.int64).reshape(-1, width).astype(float) for b in pages["xs"]]
            far = [np.frombuffer(b) for b in pages["gaps"]]
            q = unpacked(queries["x"].to_numpy(), width)
            points = np.c_[q.astype(float), np.zeros(len(q))]
            square, to_parent = (q * q).sum(1), gaps(points, parent)[:, 0]
            for i, (qid, bound) in enumerate(zip(queries["query_id"], queries["bound"], strict=True)):
                limit = np.inf if bound is None or bound != bound else bound + SLACK
                best: list[tuple[int, int]] = []  # (score, -vec_id), least first
                loose = np.maximum(np.abs(to_parent[i] - from_parent) - radius, 0)  # from stored distances alone
                near = np.flatnonzero(loose <= limit)
                gap = gaps(points[i : i + 1], centres[near])[0]
                low = np.maximum(gap - radius[near], 0)
                for j in np.argsort(low, kind="stable"):
                    if low[j] > limit:
                        break
                    page = near[j]
                    open_ = (np.abs(gap[j] - far[page]) <= limit) & (ids[page] != qid)
                    if not open_.any():
                        continue
                    score, who = np.rint(xs[page][open_] @ q[i]).astype(np.int64), ids[page][open_]
                    if len(best) == k:
                        some = score >= best[0][0]
                        score, who = score[some], who[some]
                    if len(score) > k:
                        some = score >= np.partition(score, -k)[-k]
                        score, who = score[some], who[some]
                    for s, v in zip(score.tolist(), who.tolist(), strict=True):
                        if len(best) < k:
                            heapq.heappush(best, (s, -v))
                        elif (s, -v) > best[0]:
                            heapq.heapreplace(best, (s, -v))
                    if len(best) == k:
                        limit = min(limit, float(np.sqrt(max(0, int(square[i]) + top - 2 * best[0][0]))) + SLACK)
                out += [(qid, -v, s) for s, v in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def routed(pivots, rings, top: int, width: int):
    """Per query: the ring that would hold it (kth is null), or the rings that may hold something within its k-th distance.

    rings: pivot, ring, least and greatest distance from the pivot, of each ring."""
    pivot, ring, low, high = rings

    def run(frames):
        import pandas as pd

        for frame in frames:
            q = unpacked(frame["x"], width)
            if "kth" in frame:
                gap = gaps(np.c_[q.astype(float), np.zeros(len(q))], pivots.value)[:, pivot]
                bound = np.sqrt(np.maximum((q * q).sum(1) + top - 2 * frame["kth"].to_numpy(dtype=float), 0))
                limit = np.where(np.isnan(bound), np.inf, bound)
                row, col = np.nonzero(np.maximum(gap - high, low - gap) <= limit[:, None] + SLACK)
            else:
                own = gaps(lifted(q, top), pivots.value)
                home = own.argmin(axis=1)
                off = np.where(pivot[None, :] == home[:, None], np.maximum(own[:, pivot] - high, low - own[:, pivot]), np.inf)
                row, col, limit = np.arange(len(q)), off.argmin(axis=1), np.full(len(q), np.nan)
            yield pd.DataFrame({"query_id": frame["query_id"].to_numpy()[row], "x": frame["x"].to_numpy()[row], "pivot": pivot[col].astype(np.int32), "ring": ring[col].astype(np.int32), "bound": limit[row]})

    return run


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, shard_rows: int = 4096, page_rows: int = 256, query_block: int = 2048) -> DataFrame:
    """For every row of (vec_id, embedding) that ``is_query`` selects: query_id, rank (from 1), vec_id, score of its k best others."""
    spark = vectors.sparkSession
    sc = spark.sparkContext
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = vectors.where("vec_id is not null and size(embedding) > 0").where(~F.exists("embedding", bad))
    whole = good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    facts = whole.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)).alias("top"), F.count_if("asks").alias("asks")).first()
    n, width, top = facts["n"], facts["width"] or 1, facts["top"] or 0

    def packed(frames):
        import pandas as pd

        for frame in frames:
            yield pd.DataFrame({"vec_id": frame["vec_id"], "asks": frame["asks"], "x": [np.pad(np.asarray(v, np.int64), (0, width - len(v))).tobytes() for v in frame["v"]]})

    rows = whole.mapInPandas(packed, "vec_id long, asks boolean, x binary")
    count = int(min(MAX_PIVOTS, max(1, n // shard_rows)))
    sample = rows.orderBy(F.xxhash64("vec_id"), "x").limit(count).select("x").collect()
    pivots = sc.broadcast(lifted(unpacked([r["x"] for r in sample], width), top) if sample else np.zeros((1, width + 1)))
    placed = durable(rows.mapInPandas(nearest(pivots, top, width), "vec_id long, asks boolean, x binary, pivot int, gap double"))
    sizes = {r["pivot"]: r for r in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("gap", [i / RINGS for i in range(1, RINGS)], 1000).alias("cuts")).collect()}
    cuts, subs = [], []
    for i in range(max(1, len(sample))):
        shards = max(1, -(-(sizes[i]["n"] if i in sizes else 0) // shard_rows))
        step = -(-RINGS // min(RINGS, shards))
        cuts.append(sorted(sizes[i]["cuts"][step - 1 :: step]) if i in sizes else [])
        subs.append(max(1, -(-shards // (len(cuts[-1]) + 1))))
    per_pivot = lambda values: F.element_at(F.array(*values), F.col("pivot") + 1)
    bounds = per_pivot([F.array(*map(F.lit, c)).cast("array<double>") for c in cuts])
    sub_count = per_pivot([F.lit(n) for n in subs])
    dealt = placed.withColumn("ring", F.size(F.filter(bounds, lambda c: c < F.col("gap")))).withColumn("sub", F.pmod(F.xxhash64("vec_id", "x"), sub_count).cast("int"))
    shard = ["pivot", "ring", "sub"]
    pages = durable(dealt.select("vec_id", "x", *shard).groupBy(*shard).applyInPandas(pages_of(pivots, top, width, page_rows), "pivot int, ring int, sub int, centre binary, radius double, from_parent double, ids binary, xs binary, gaps binary"))
    found = dealt.groupBy("pivot", "ring").agg(F.min("gap").alias("low"), F.max("gap").alias("high")).collect()
    rings = tuple(np.array([r[c] for r in found], kind) for c, kind in (("pivot", np.int64), ("ring", np.int64), ("low", float), ("high", float)))

    asked = placed.where("asks").dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), "x")
    blocks = max(1, -(-facts["asks"] // query_block))

    def visit(routes: DataFrame, every: bool) -> DataFrame:
        """every: all shards of a route's ring, or one of them."""
        routes = routes.withColumn("sub", F.explode(F.sequence(F.lit(0), sub_count - 1)) if every else F.pmod(F.xxhash64("query_id"), sub_count).cast("int"))
        routes = durable(routes.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")))
        keys = [*shard, "part"]
        wanted = routes.select(*shard, F.col("part").alias("to_part")).distinct()
        copies = pages.join(F.broadcast(wanted) if wanted.limit(MAX_ROUTES + 1).count() <= MAX_ROUTES else wanted.hint("merge"), shard)
        return copies.groupBy(*shard, "to_part").cogroup(routes.groupBy(*keys)).applyInPandas(searched(pivots, top, width, k), "query_id long, vec_id long, score long")

    from pyspark.sql import Window

    route = "query_id long, x binary, pivot int, ring int, bound double"
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    home = asked.mapInPandas(routed(pivots, rings, top, width), route)
    first = visit(home, False).withColumn("rank", F.row_number().over(order)).where(f"rank = {k}").select("query_id", F.col("score").alias("kth"))
    known = asked.hint("merge").join(first.hint("merge"), "query_id", "left")
    rest = visit(known.mapInPandas(routed(pivots, rings, top, width), route), True)
    return rest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.x::DOUBLE[], c.x::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
