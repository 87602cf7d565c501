"""Training-corpus pipeline: language, repeated lines, near-duplicates, source mix and packing, over the whole documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents, and others that the table has, as they are.

Defined results, stage by stage: null texts and texts without letters go with the rejected languages; rows of null lang teach nothing
and are judged like others. Rows of one doc_id are one document for repeated lines; those of null doc_id neither count nor keep such a
line. Of near-duplicates the smallest doc_id stays, null last, and of equal rows one. Documents without words are taken zero times by
the mix; null source is a source. Every row that is left is packed, whatever its length. An empty table gives no rows at every stage.
Columns whose names begin with two underscores are not allowed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.llm.language_id import drop_rejected, teaches
from docledger.llm.line_dedup import dedup_lines
from docledger.llm.mixing import mix
from docledger.llm.packing import pack
from docledger.llm.simhash_dedup import keep_one


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the character models tell; the rejected ones go."""
    return drop_rejected(docs, teaches())


def keeping(docs: DataFrame, results: tuple[str, ...], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step`` on documents whose own columns named like its results are put aside; the columns of ``docs`` come back."""
    aside = {c: f"__own_{c}" for c in results if c in docs.columns}
    done = step(docs.withColumnsRenamed(aside)).drop(*results)
    return done.withColumnsRenamed({v: k for k, v in aside.items()}).select(*(F.col(f"`{c}`") for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated long lines stay in one document only; n_chars follows the text."""
    return keeping(docs, ("n_lines", "n_dropped"), dedup_lines).withColumn("n_chars", F.char_length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: a similarity of 0.8 or more of the shingles of five words."""
    return keep_one(docs, words=5, similarity=0.8)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, a fraction of a repetition rounded."""
    copies = F.round(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")

    def taken(rows: DataFrame) -> DataFrame:
        repeated = mix(rows).withColumn("__copies", copies).where("__copies > 0")
        return repeated.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__copies", "__copy")

    return keeping(docs, ("size", "source_size", "target", "taken"), taken)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of 1,024 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash_dedup", near_duplicates), ("source_mix", source_mix), ("packing", packing)]

#: Character models, fingerprints and token ids are beyond SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
