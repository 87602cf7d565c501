"""Token counts by source, language and tokenizer version as rollups that signed deltas maintain.

The state is a folder in shared storage with one folder of Parquet per committed batch, holding additive rows by source, language
and version: documents, tokens and characters, positive or negative. An insert adds a document's counts, a delete takes them off,
a revision takes the old counts off and adds the new. A batch is summed before it is written. Committing writes a batch's own
folder in full and its success mark last, and only marked folders are read: a batch that failed half-way is written anew, one that
is already there is left as it is, so a batch counts once however often it is sent. ``compact`` sums all batches so far into a base
folder that first lists their numbers; totals read the newest base and the batches that it does not list. So batches may come in any
order, before and after a base. One writer at a time is assumed.

Defined results: null text has no tokens; null source or language is a group of its own; groups whose three totals are all zero are
left out; repeated rows of a batch each count, as the signed log says; an empty batch commits and changes nothing; ties do not occur.
Texts of any length are counted whole. Columns other than those named are not read, so they may clash.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, strings, table, word_count
from .tokens import encoder, in_parts

GROUP = ("source", "lang", "version")
TOTALS = ("documents", "tokens", "chars")
SCHEMA = "source string, lang string, version string, documents long, tokens long, chars long"


def counted(docs: DataFrame, path: str, version: str) -> DataFrame:
    """(doc_id, source, lang, version, tokens, chars) of documents by a tokenizers file."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            texts = strings(frame["text"])
            n = np.zeros(len(texts), np.int64)
            for a, b in in_parts(texts):
                n[a:b] = [len(x) // 4 for x in encoder(path).encode(texts[a:b])]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "source": strings(frame["source"]), "lang": strings(frame["lang"]), "version": version, "tokens": n, "chars": [len(t or "") for t in texts]})

    return docs.select("doc_id", "source", "lang", "text").mapInPandas(run, "doc_id long, source string, lang string, version string, tokens long, chars long")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, F.lit(1).cast("long").alias("documents"), "tokens", "chars")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, F.lit(-1).cast("long").alias("documents"), (-F.col("tokens")).alias("tokens"), (-F.col("chars")).alias("chars"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Deltas that put the counts ``new`` in the place of ``old``."""
    return deletes(old).unionByName(inserts(new))


class TokenRollup:
    """Totals kept under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _entries(self, kind: str, mark: str = "_SUCCESS") -> dict[int, str]:
        """Committed folders by number."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return {}
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        marked = [n for n in names if n.startswith(f"{kind}=") and fs.exists(jvm.org.apache.hadoop.fs.Path(root, f"{n}/{mark}"))]
        return {int(n.split("=")[1]): f"{self.path}/{n}" for n in marked}

    def _base(self) -> tuple[int, str | None, set[int]]:
        """Number and folder of the newest base, and the batches that it lists."""
        bases = self._entries("base", "totals/_SUCCESS")
        if not bases:
            return -1, None, set()
        newest = max(bases)
        return newest, bases[newest], {r["batch"] for r in self.spark.read.schema("batch long").parquet(f"{bases[newest]}/batches").collect()}

    def commit(self, batch: int, deltas: DataFrame) -> bool:
        """Write the batch; False if it was committed before."""
        if batch in self._entries("batch") or batch in self._base()[2]:
            return False
        summed = deltas.groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in TOTALS))
        summed.write.mode("overwrite").parquet(f"{self.path}/batch={batch:012d}")
        return True

    def totals(self) -> DataFrame:
        _, base, listed = self._base()
        paths = [f"{base}/totals"] * (base is not None) + [p for b, p in sorted(self._entries("batch").items()) if b not in listed]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*paths)
        live = F.greatest(*(F.abs(c) for c in TOTALS)) > 0
        return rows.groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in TOTALS)).where(live)

    def compact(self) -> set[int]:
        """Sum all batches so far into a new base, unless the newest lists them all. Returns the batches that the base lists."""
        number, _, listed = self._base()
        batches = set(self._entries("batch")) | listed
        if batches != listed:
            target = f"{self.path}/base={number + 1:012d}"
            self.spark.createDataFrame([(b,) for b in sorted(batches)], "batch long").coalesce(1).write.mode("overwrite").parquet(f"{target}/batches")
            self.totals().write.mode("overwrite").parquet(f"{target}/totals")
        return batches


def shared_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints."""
    return f"{checkpoint_dir(spark)}/rollup-{uuid.uuid4().hex}"


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents enter with their numbers of words; the second batch, sent twice, revises every count to the byte-level
    tokenizer's. Totals by source, language and version: the words' groups cancel."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    words = docs.select("doc_id", "source", "lang", F.lit("words/1").alias("version"), word_count(F.col("text")).alias("tokens"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("chars"))
    rollup = TokenRollup(spark, shared_folder(spark))
    rollup.commit(1, inserts(words))
    for _ in range(2):
        rollup.commit(2, revisions(words, counted(docs, public_tokenizers.path("byte_bpe_50k.json"), "byte_bpe_50k/1")))
    rollup.compact()
    return rollup.totals()
