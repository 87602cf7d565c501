"""Helpers shared by the operators: table access, lineage cuts, batch arithmetic and connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The white space of every word and line rule here: U+0020 and U+0009 to U+000D.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
WORD_REGEX = "[^\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir or was given; a temporary one only where all runs in one process."""
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="docledger-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
    return given.get()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster names in spark.checkpoint.dir."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def strings(series) -> list:
    """A column's strings as a list, null as None, however pandas stores them."""
    return [x if isinstance(x, str) else None for x in series]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of unsigned 64-bit values, so that their low bits can pick partitions."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def summed_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of the values of each."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(values, starts)


def find(table_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted array, and whether each is there."""
    if not len(table_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table_keys, keys), len(table_keys) - 1)
    return at, table_keys[at] == keys


def runs_of(batches: Iterator, key: str) -> Iterator:
    """Frames of one key each, from batches sorted by that key; a run may cross batches."""
    import pandas as pd

    held = []
    for frame in batches:
        if not len(frame):
            continue
        keys = frame[key].to_numpy()
        cuts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = frame.iloc[a:b]
            if held and held[0][key].iloc[0] != keys[a]:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0 to n-1 and links among them: the smallest node of each node's component."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(root, high[apart], low[apart])
        while (nxt := root[root]).tolist() != root.tolist():
            root = nxt
        left, right = left[apart], right[apart]
    return root


def join_counted(rows: DataFrame, facts: DataFrame, key: str, most: int = 1024) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, which holds each key once, with ``__rows``: how many of the rows have it.

    Keys of more than one in ``most`` of those rows are fewer than ``most``: they are broadcast, so that no task gathers their rows.
    The others are joined by a shuffle. Both inputs are read more than once and should be durable; null keys join nothing.
    """
    total = facts.agg(F.coalesce(F.sum("__rows"), F.lit(0))).first()[0]
    hot = F.col("__rows") * most > total
    few, rest = facts.where(hot).drop("__rows"), facts.where(~hot).drop("__rows")
    if isinstance(rows.schema[key].dataType, StructType):
        others = rows.join(F.broadcast(few.select(key)), key, "left_anti")
    else:
        frequent = [r[0] for r in few.select(key).collect()]
        if not frequent:
            return rows.hint("merge").join(rest.hint("merge"), key)
        others = rows.where(~F.col(key).isin(frequent))
    return rows.join(F.broadcast(few), key).unionByName(others.hint("merge").join(rest.hint("merge"), key))


def within(rows: DataFrame, keys: DataFrame, on: list[str], keep: bool = True, most: int = 1_000_000) -> DataFrame:
    """The rows whose ``on`` is among the distinct ``keys`` (``keep``), or is not; nulls are equal to each other.

    Up to ``most`` keys are broadcast, so that wide rows stay where they are; beyond, both sides are shuffled."""
    held = keys.select(*(F.col(c).alias(f"__k_{i}") for i, c in enumerate(on)))
    same = [rows[c].eqNullSafe(held[f"__k_{i}"]) for i, c in enumerate(on)]
    side = F.broadcast(held) if held.limit(most + 1).count() <= most else held.hint("merge")
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return rows.join(side, condition, "left_semi" if keep else "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b), as rows (node, root): every node that has a link, root the smallest node reachable.

    Nodes are long. Each round every node points to the neighbour (itself included) that is least in a hashed order, and links
    are rewritten between the nodes pointed to; the hashed order makes the graph shrink by a constant factor each round even on
    long chains. No round holds more than (node, node) rows, a node's neighbours meet only in a map-side combined minimum, and
    skewed joins are left to adaptive execution. Nulls, self-links and repeated links are ignored.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    live = durable(edges.where("a is not null and b is not null and a <> b").selectExpr("cast(a as long) a", "cast(b as long) b").distinct())
    steps: list[DataFrame] = []
    while not live.isEmpty():
        both = live.unionByName(live.selectExpr("b as a", "a as b"))
        step = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("v")))["v"].alias("to"))
        step = durable(step)
        steps.append(step)
        one = live.hint("merge").join(step.withColumnRenamed("node", "a"), "a").select(F.col("to").alias("a1"), "b")
        two = one.hint("merge").join(step.selectExpr("node as b", "to as b1"), "b").select(F.col("a1").alias("a"), F.col("b1").alias("b"))
        live = durable(two.where("a <> b").distinct())
    if not steps:
        return live.selectExpr("a as node", "b as root")
    label = steps[0].selectExpr("node", "to as root")
    for step in steps[1:]:
        label = label.hint("merge").join(step.selectExpr("node as root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    label = durable(label)
    least = durable(label.groupBy("root").agg(F.min("node").alias("least"), F.count("*").alias("__rows")))
    return join_counted(label, least, "root").select("node", F.col("least").alias("root"))
