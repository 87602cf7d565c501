"""Best-fit packing of tokenized documents into fixed-length training sequences: vector best-fit.

Every document becomes token ids plus an end id; only those longer than a sequence are cut, into whole sequences after a first
piece that may be shorter. A sequence (bin) has three capacities: tokens, documents and attention cost (the sum of squared piece
lengths). Pieces are placed in decreasing order; of the open bins that have room for a piece under every constraint, the one with
the smallest weighted residual norm, or the largest weighted dot product of piece and residual, takes it; none: a new bin.

Pieces as long as a sequence are one each and go no further. The others, at most one for each document, are counted and dealt by hash
into groups of about ``group_rows``, each of which a task packs on its own, which costs a fraction of a percent in sequences.
Placement depends on the group's rows only, not on their order.

Defined results: null text counts as empty, so every document has at least its end id; repeated rows are packed each; a null doc_id
stays null; of equal bins the first opened takes a piece, and pieces of one length go by checksum, doc_id and piece; columns other
than doc_id and text are not read, so they may clash; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, strings, table
from .tokens import encoder, in_parts


def pieces(docs: DataFrame, path: str, end_id: int, tokens: int, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) for every piece of every document."""

    def run(frames):
        import pandas as pd

        end = np.array([end_id], "<u4").tobytes()
        for frame in frames:
            texts, ids = strings(frame["text"]), frame["doc_id"].astype("Int64")
            for a, b in in_parts(texts):
                rows, columns = [], ("at", "piece", "start", "length", "ids_crc32", "ids")
                for i, blob in enumerate(encoder(path).encode(texts[a:b]), a):
                    blob += end
                    n = len(blob) // 4
                    first = n % tokens or tokens
                    for piece, start in enumerate((0, *range(first, n, tokens))):
                        part = blob[4 * start : 4 * (first if piece == 0 else start + tokens)]
                        rows.append((i, piece, start, len(part) // 4, zlib.crc32(part), part if with_ids else b""))
                out = pd.DataFrame(rows, columns=columns)
                out["doc_id"] = ids.iloc[out.pop("at").to_numpy()].to_numpy()
                yield out if with_ids else out.drop(columns="ids")

    return docs.select("doc_id", "text").mapInPandas(run, "piece int, start long, length long, ids_crc32 long, " + "ids binary, " * with_ids + "doc_id long")


def best_fit(lengths: np.ndarray, tokens: int, documents: int, attention: float, rule: str = "norm", weights=(1.0, 0.1, 0.1)) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, in the given order."""
    capacity = np.array([tokens, documents, attention], float)
    scale = np.sqrt(np.array(weights)) / capacity
    room = np.zeros((3, 64))
    names, used, made = np.zeros(64, np.int64), 0, 0
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        need = (float(length), 1.0, float(length) ** 2)
        left = room[:, :used] - np.array(need)[:, None]
        fits = np.flatnonzero((left >= 0).all(axis=0)) if used else ()
        if len(fits):
            if rule == "norm":
                score = ((left[:, fits] * scale[:, None]) ** 2).sum(axis=0)
            else:
                score = -(room[:, fits] * (np.array(need) * scale**2)[:, None]).sum(axis=0)
            at = fits[int(score.argmin())]
        else:
            if length > tokens or need[2] > attention:
                raise ValueError("a piece does not fit an empty sequence")
            if used == room.shape[1]:
                room, names = np.concatenate([room, np.zeros_like(room)], axis=1), np.concatenate([names, np.zeros_like(names)])
            at, used = used, used + 1
            room[:, at], names[at], made = capacity, made, made + 1
        bins[i], offsets[i] = names[at], int(tokens - room[0, at])
        room[:, at] -= need
        if room[:, at].min() < 1:  # full: the last open bin takes its place
            used -= 1
            room[:, at], names[at] = room[:, used], names[used]
    return bins, offsets


def pack(docs: DataFrame, path: str, end_id: int = 2, tokens: int = 1024, documents: int | None = None, attention: float | None = None, rule: str = "norm", group_rows: int = 16_384, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    documents and attention: a sequence's capacities besides ``tokens``; by default as many as its tokens allow. rule: "norm" or "dot".
    """
    documents, attention = documents or tokens, attention or float(tokens) ** 2
    if float(tokens) ** 2 > attention:
        raise ValueError("a whole sequence costs more attention than a sequence may")
    parts = durable(pieces(docs, path, end_id, tokens, with_ids))
    alone = F.col("length") == tokens
    rest = parts.where(~alone)
    groups = max(1, round(rest.count() / group_rows))

    def run(frame):
        frame = frame.sort_values(["length", "ids_crc32", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = best_fit(frame["length"].to_numpy(), tokens, documents, attention, rule)
        return frame.assign(sequence_id=(frame["part"].to_numpy(dtype=np.int64) << 32) + bins, offset=offsets).drop(columns="part")

    # hashed twice: partitions and groups shall not fall together
    dealt = rest.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema.fields)
    packed = dealt.groupBy("part").applyInPandas(run, schema + ", sequence_id long, offset long")
    whole = parts.where(alone).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})  # of a checkpoint, so numbered alike by every run
    return packed.unionByName(whole)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
