"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

A source's target share is its weight's share of all words, clamped at ``epochs`` times its size; what a clamped source can't take is
shared among the others by weight until no target is above its clamp. A source's documents are then taken whole as often as the
target allows, and the rest of it goes to documents in a seeded hash order, the last of which is taken in part.

The level of the water is found from sums per source, one pair of scalars a round. Running sums in hash order are taken in two
steps, over 4,096 hash buckets of a source and inside each bucket, so that a source with a third of all rows is no single task.

Defined results: size is the number of words, 0 for null text; null sources are one source, last in order; documents without words
take nothing; repeated rows are taken each; documents of equal hash go by doc_id, then size; columns named size, source_size, target
and taken are replaced, other columns kept, and names with two leading underscores are not allowed; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table, word_count

WEIGHTS, EPOCHS, SEED = (5, 2, 1), 3, "mix-1"


def targets(sizes: DataFrame, weights: Sequence[int], epochs: int) -> DataFrame:
    """(source, source_size) with target: weights go round the sources in code point order, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row per source
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    ranked = durable(sizes.withColumn("weight", weight).withColumn("clamp", F.col("source_size") * epochs))
    clamped, level = -1, 0.0
    while True:
        over = F.col("weight") * F.lit(level) > F.col("clamp")
        state = ranked.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(over, F.col("clamp"))), F.lit(0)).alias("spent"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("open"), F.count_if(over).alias("clamped"),
        ).first()
        if state["clamped"] == clamped or not state["open"]:
            break
        clamped, level = state["clamped"], float(state["all"] - state["spent"]) / float(state["open"])
    return ranked.withColumn("target", F.least(F.col("clamp").cast("double"), F.col("weight") * F.lit(level)))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED, size: Column | None = None) -> DataFrame:
    """Rows of ``docs`` with size, source_size, target and taken (columns of these names are replaced)."""
    size = word_count(F.col("text")) if size is None else size
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = docs.withColumns({"size": size, "__order": order}).withColumns({"__bucket": F.substring("__order", 1, 3), "__key": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))})
    rows = rows.drop("source_size", "target", "taken")
    buckets = durable(rows.groupBy("__key", "__bucket").agg(F.first("source").alias("source"), F.sum("size").alias("words")))
    aims = targets(buckets.groupBy("__key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size")), weights, epochs)
    aims = aims.withColumn("__aim", F.round("target").cast("long")).withColumn("__whole", F.when(F.col("source_size") > 0, F.floor(F.col("__aim") / F.col("source_size"))).otherwise(F.lit(0)))
    aims = aims.select("__key", "source_size", "target", "__whole", (F.col("__aim") - F.col("__whole") * F.col("source_size")).alias("__rest"))
    before = F.sum("words").over(Window.partitionBy("__key").orderBy("__bucket")) - F.col("words")
    starts = buckets.select("__key", "__bucket", before.alias("__before")).hint("merge").join(aims.hint("merge"), "__key")
    joined = rows.hint("merge").join(starts, ["__key", "__bucket"])
    inside = Window.partitionBy("__key", "__bucket").orderBy("__order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("__rest") - F.col("__before") - (F.sum("size").over(inside) - F.col("size"))
    taken = F.col("__whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return joined.withColumn("taken", taken.cast("long")).drop("__key", "__bucket", "__order", "__before", "__whole", "__rest")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mix_sql(relation: str) -> str:
    """DuckDB SQL: the rows of ``relation`` (doc_id, text, source, ...) with size, source_size, target and taken."""
    return f"""
  SELECT z.*, p.source_size, p.target, CAST(p.whole * z.size + greatest(0, least(z.size, p.rest - (sum(z.size) OVER (
    PARTITION BY z.source ORDER BY z.o, z.doc_id, z.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - z.size))) AS BIGINT) AS taken
  FROM (SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM {relation}) z
  JOIN (
    WITH s AS (
      SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) AS BIGINT) AS source_size FROM {relation} GROUP BY source
    ), w AS (
      SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s
    ), c AS (
      SELECT *, 3 * source_size AS clamp, 3.0::DOUBLE * source_size / weight AS ratio, CAST(sum(source_size) OVER () AS BIGINT) AS n FROM w
    ), l AS (
      SELECT *, CAST(coalesce(sum(clamp) OVER o, 0) AS BIGINT) AS spent, CAST(sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS BIGINT) AS open_weight
      FROM c WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), v AS (
      SELECT min_by(CAST(n - spent AS DOUBLE) / CAST(open_weight AS DOUBLE), ratio) FILTER (CAST(n - spent AS DOUBLE) / open_weight <= ratio) AS level FROM l
    ), t AS (
      SELECT source, source_size, least(CAST(clamp AS DOUBLE), weight * level) AS target FROM l, v
    ), q AS (
      SELECT *, CAST(round(target) AS BIGINT) AS aim, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM t
    )
    SELECT source, source_size, target, whole, aim - whole * source_size AS rest FROM q
  ) p ON z.source IS NOT DISTINCT FROM p.source"""


OP7_SQL = f"SELECT doc_id, size, source_size, target, taken FROM ({mix_sql('documents')})"
