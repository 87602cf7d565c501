"""Periodic runs of words: Baier grouping gives Lyndon arrays under both orders, whose roots LCE extends into runs.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends. Every run has a root of q words that
is a Lyndon word under an order of the words or under the reversed order, and that is the longest Lyndon word at its place. The first
phase of Baier's suffix sorter yields just these: it groups the places by their longest Lyndon word. From the highest group down,
the places of a group are taken off the row of open places; the place left of each then begins a longer Lyndon word, its own one
followed by as many of the group's words as were taken off behind it, and moves to a new group above its old one. Each place moves at
most once for each place taken off, so a phase is linear in the words. It is done for both orders.

Where a place and the place one root later are in one group, the root stands there twice, as it does in every run of three periods.
The longest common extensions to both sides of such a row of roots, each shorter than a root, complete the run. Runs of at least ``least`` words and ``times`` periods are kept.

Before that the document is cut at words that no such run can hold: with w = least - least // times or fewer words, every word of a run
is in a window of w words that the document has twice, one period apart. All windows of a batch are compared by rolling hashes; a chance meeting leaves
more words in, never fewer. What is left is cut into stretches, which are grouped on their own: a run lies in one stretch.

``periodic_runs`` is row-wise: any split of the table gives the same rows. Defined results: null text has no words; words of any
length are compared whole, byte by byte; repeated rows are taken each; a null doc_id stays null; texts of any length are taken whole; an
empty table gives no rows. Ties of exponents: ``best_run`` takes the smaller start, then the smaller period. Only doc_id and text are
read, so other columns may clash.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mixed, table
from .tokens import in_parts

RUNS = "array<struct<start:long,length:long,period:long>>"


def grouped(word: list[int], kinds: int) -> tuple[list[int], list[int]]:
    """Baier's first phase over symbols below ``kinds``: the final group of each place, and the length of its longest Lyndon word."""
    n = len(word)
    members: list[list[int]] = [[] for _ in range(kinds)]
    for i, symbol in enumerate(word):
        members[symbol].append(i)
    size, below, above = [1] * kinds, [*range(-1, kinds - 1)], [*range(1, kinds), -1]
    group, length = list(word), [0] * n
    left, right = [*range(-1, n - 1)], [*range(1, n + 1)]
    at = kinds - 1
    while at >= 0:
        unit = size[at]
        moves: dict[tuple[int, int], list[int]] = {}
        last, count = -1, 0
        for i in members[at]:
            if group[i] != at:
                continue
            length[i] = unit
            before, after = left[i], right[i]
            if after < n:
                left[after] = before
            if before >= 0:
                right[before] = after
            if before == last:
                count += 1
                continue
            if last >= 0:
                moves.setdefault((group[last], count), []).append(last)
            last, count = before, 1
        if last >= 0:
            moves.setdefault((group[last], count), []).append(last)
        base = under = -1
        for old, times in sorted(moves):  # of one old group, more of the unit stand higher
            new = len(members)
            members.append(moves[old, times])
            size.append(size[old] + times * unit)
            if old != base:
                base = under = old
            over = above[under]
            below.append(under)
            above.append(over)
            above[under] = new
            if over >= 0:
                below[over] = new
            under = new
            for i in members[new]:
                group[i] = new
        members[at] = []
        at = below[at]
    return group, length


def extension(word: list[int], a: int, b: int, most: int, step: int) -> int:
    """How many words, at most ``most``, are equal from the places a < b on, forwards (step 1) or backwards (step -1)."""
    n = len(word)
    most = min(most, n - b if step > 0 else a + 1)
    done, width = 0, 1
    while done < most and width:
        w = min(width, most - done)
        x, y = a + step * done, b + step * done
        same = word[x : x + w] == word[y : y + w] if step > 0 else word[x - w + 1 : x + 1] == word[y - w + 1 : y + 1]
        if same:
            done, width = done + w, 2 * w
        else:
            width = w // 2
            most = done + w - 1  # an unlike word is among these w
    return done


def runs_of_word(word: list[int], least: int, times: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of symbols."""
    order = {x: i for i, x in enumerate(sorted(set(word)))}
    ranks, n, found = [order[x] for x in word], len(word), set()
    for symbols in (ranks, [len(order) - 1 - x for x in ranks]):
        group, length = grouped(symbols, len(order))
        for i, p in enumerate(length):
            g, end = group[i], i + p
            if i >= p and group[i - p] == g:
                continue
            while end < n and group[end] == g:
                end += p
            if times > 2 and end == i + p:
                continue
            start = i - extension(word, i - 1, i + p - 1, p - 1, -1)
            end += extension(word, end - p, end, p - 1, 1)
            if end - start >= max(least, times * p):
                found.add((start, end - start, p))
    return found


def repeated_stretches(ids: np.ndarray, starts: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """(from, to) of the stretches of at least ``least`` words that are covered by windows which their document has twice; the windows
    have the largest power of two of words that is allowed. starts: where each document begins, and the end."""
    width = 1
    with np.errstate(over="ignore"):
        base = np.uint64(0x9E3779B97F4A7C15)
        sums, power = mixed(ids.astype(np.uint64) + np.uint64(1)), base
        while 2 * width <= least - least // times:
            sums, power, width = sums[: len(sums) - width] * power + sums[width:], power * power, 2 * width
        owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        inside = owner[: len(sums)] == owner[width - 1 :] if len(sums) > 0 and len(owner) >= width else np.zeros(0, bool)
        at = np.flatnonzero(inside)
        keys = mixed(sums[at] + mixed(owner[at].astype(np.uint64) + np.uint64(1)))
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return []
    place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    change = np.zeros(len(ids) + 1, np.int64)
    hits = at[twice[place] == keys]
    change[hits] += 1
    change[hits + width] -= 1
    covered = np.cumsum(change[:-1]) > 0
    cut = np.flatnonzero(np.r_[True, (covered[1:] != covered[:-1]) | (owner[1:] != owner[:-1]), True])
    return [(a, b) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True) if covered[a] and b - a >= least]


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8: what stands between U+0020 and U+0009 to U+000D."""
    return (text or "").encode().split()


def runs_of_documents(words: list[list[bytes]], least: int = 24, times: int = 3) -> list[list[tuple[int, int, int]]]:
    """The runs of each document, sorted by start and period."""
    ids, starts = array("q"), [0]
    for mine in words:
        number: dict[bytes, int] = {}
        ids.extend([number.setdefault(w, len(number)) for w in mine])
        starts.append(len(ids))
    flat, bounds = np.frombuffer(ids, np.int64) if len(ids) else np.zeros(0, np.int64), np.array(starts)
    found: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for a, b in repeated_stretches(flat, bounds, least, times):
        k = int(np.searchsorted(bounds, a, "right")) - 1
        found[k] += [(a - starts[k] + s, n, p) for s, n, p in runs_of_word(flat[a:b].tolist(), least, times)]
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    kept, at = [], 0
    for a, b in sorted((s + p, s + n) for s, n, p in runs):
        if b > at:
            kept += words[at:a] if a > at else []
            at = b
    return kept + words[at:]


def looped(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The rows that the query plants: in one document of ten, told by the checksum of its number, the words from a place on repeat a
    few of them over and over. A null number plants nothing."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3, plant: bool = False) -> DataFrame:
    """(doc_id, runs, collapsed): a document's runs of at least ``least`` words and ``times`` periods, by start and period, and its words,
    joined by one space, without those that a run holds after its first period. plant: see ``looped``."""

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            texts, numbers = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in in_parts(texts):
                words = [words_of(t) for t in texts[a:b]]
                if plant:
                    words = [looped(w, i) for w, i in zip(words, numbers[a:b], strict=True)]
                runs = runs_of_documents(words, least, times)
                rows = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in x] for x in runs], kind)
                kept = pa.array([b" ".join(collapsed(w, x)) for w, x in zip(words, runs, strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], rows, kept], ["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, runs {RUNS}, collapsed string")


def best_run(runs: Column | str) -> Column:
    """The run of the greatest length / period, compared exactly; null if there is none."""
    runs = F.col(runs) if isinstance(runs, str) else runs  # by start and period, so the first of equals stays
    return F.aggregate(runs, F.get(runs, 0), lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), plant=True).withColumn("best", best_run("runs"))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
