"""Alignment of two tokenizers' ids over the same texts: whitespace-token anchors and memoised windows.

Both tokenizers encode every whole text. Where a token of each side begins with a space at the same byte, the tokens before it end
together: such anchors, checked on the summed byte lengths, split a document into windows of a few token ids of each side. A window's
alignment depends on its ids alone, so it is worked out once and kept by the tuple of both sides' ids: groups that the shared token
ends cut, and the links of every token of one side with every token of the other in a group. That the bytes of both sides are those of
the text is verified window by window.

How many documents hold a pair of ids linked is a count over the corpus. A task sums its documents in blocks of about ``block_chars``
characters: a block lists its distinct pairs once, and its documents hold places in that list. So only distinct pairs of blocks are
shuffled: summed by pair, with the highest count of each id of side A (as many rows as A's vocabulary has ids, which is why it may be
broadcast), then joined back and given to their block. The blocks are written to the shared folder first, so a lost executor's work is
done again from there and blocks keep their numbers.

Defined results: texts that are null or empty, or whose tokens' bytes differ from a space and the text, have no tokens and zeros, and
an empty ``groups``. Each row is a document, so repeated rows count as often; a null doc_id stays null. Of equal counts all are highest.
Texts of any length are aligned whole. Only doc_id and text are read, so other columns may clash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, mixed, table
from .piece_codec import MARK, codec
from .tokens import encoder, in_parts, printable_bytes

#: Bounds of a worker's memory: windows, ids in all of them, words with the ids of both sides, and characters of such a word.
MEMO_ROWS, MEMO_IDS = 400_000, 6_000_000
WORD_ROWS, WORD_CHARS = 300_000, 48
BLOCK = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, held binary, pairs binary, documents binary"


def byte_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizers file."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    byte, out = printable_bytes(), [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(byte[ch] for ch in token) if all(ch in byte for ch in token) else token.encode()
    return out


def piece_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a SentencePiece file: a piece's text, or the byte that it stands for."""
    c = codec(path, library=True)
    return [bytes([c.bytes_of[i]]) if i in c.bytes_of else name.encode() for i, name in enumerate(c.names)]


def spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``many`` of each."""
    return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))


class Windows:
    """A worker's memory of windows, each under a number: its bytes (None where both sides differ), its groups as text and how many they
    are, and its links as pairs (id of A times B's size, plus id of B) with how often each is held."""

    def __init__(self, bytes_a: list[bytes], bytes_b: list[bytes]):
        self.bytes_a, self.bytes_b = bytes_a, bytes_b
        self.size_a, self.size_b = (np.array([len(x) for x in s], np.int64) for s in (bytes_a, bytes_b))
        self.names = [[f"{i}{end}" for i in range(len(s))] for s, ends in ((bytes_a, ",|"), (bytes_b, ",;")) for end in ends]
        self.clear()

    def clear(self) -> None:
        self.number: dict[tuple[bytes, bytes], int] = {}
        self.raw: list[bytes | None] = []
        self.text: list[str] = []
        self.groups, self.links, self.first = array("q"), array("q"), array("q", [0])
        self.pair, self.times = array("q"), array("q")
        self.ids = 0

    def add(self, keys: list[tuple[bytes, bytes]]) -> None:
        """Work out new windows, all at once."""
        base = len(self.raw)
        self.number.update(zip(keys, range(base, base + len(keys)), strict=True))
        a, b = (np.frombuffer(b"".join([k[side] for k in keys]), "<u4").astype(np.int64) for side in (0, 1))
        n_a, n_b = (np.array([len(k[side]) for k in keys], np.int64) // 4 for side in (0, 1))
        self.ids += len(a) + len(b)
        ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
        raw = []
        for ids, n, ends, table, size in ((a, n_a, ends_a, self.bytes_a, self.size_a), (b, n_b, ends_b, self.bytes_b, self.size_b)):
            whole = b"".join(map(table.__getitem__, ids.tolist()))
            cut = np.r_[0, np.cumsum(size[ids])][np.r_[0, ends]].tolist()
            raw.append([whole[x:y] for x, y in zip(cut, cut[1:], strict=False)])
        same = np.array([x == y for x, y in zip(*raw, strict=True)])
        self.raw += [x if ok else None for x, ok in zip(raw[0], same.tolist(), strict=True)]
        # places where tokens of both sides end, over the bytes of all windows that agree
        in_a, in_b = np.repeat(np.arange(len(keys)), n_a), np.repeat(np.arange(len(keys)), n_b)
        a, b, in_a, in_b = a[same[in_a]], b[same[in_b]], in_a[same[in_a]], in_b[same[in_b]]
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        at = np.zeros((2, int(end_a[-1]) + 1 if len(end_a) else 1), bool)
        at[0, end_a], at[1, end_b] = True, True
        shared = at[0] & at[1]
        last_a, last_b = shared[end_a], shared[end_b]
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        many = int(last_a.sum())
        size_a, size_b = np.bincount(group_a, minlength=many), np.bincount(group_b, minlength=many)
        of_group = in_a[last_a]
        # the ids of a group's A, then of its B, each with the sign that follows it
        order = np.argsort(np.r_[2 * group_a, 2 * group_b + 1], kind="stable").tolist()
        names_a, mid, names_b, stop = self.names
        said = [mid[i] if last else names_a[i] for i, last in zip(a.tolist(), last_a.tolist(), strict=True)]
        said += [stop[i] if last else names_b[i] for i, last in zip(b.tolist(), last_b.tolist(), strict=True)]
        said = [said[i] for i in order]
        cut = np.r_[0, np.cumsum(np.where(same, n_a + n_b, 0))].tolist()
        self.text += ["".join(said[x:y])[:-1] for x, y in zip(cut, cut[1:], strict=False)]
        self.groups.frombytes(np.bincount(of_group, minlength=len(keys)).astype(np.int64).tobytes())
        self.links.frombytes(np.bincount(of_group, size_a * size_b, minlength=len(keys)).astype(np.int64).tobytes())
        # every A of a group with every B of it
        width = size_b[group_a]
        other = spread((np.cumsum(size_b) - size_b)[group_a], width)
        held = np.repeat(in_a, width) * (len(self.bytes_a) * len(self.bytes_b)) + np.repeat(a, width) * len(self.bytes_b) + b[other]
        held, times = np.unique(held, return_counts=True)
        owner, pair = np.divmod(held, len(self.bytes_a) * len(self.bytes_b))
        self.first.frombytes((self.first[-1] + np.cumsum(np.bincount(owner, minlength=len(keys)))).astype(np.int64).tobytes())
        self.pair.frombytes(pair.tobytes())
        self.times.frombytes(times.astype(np.int64).tobytes())

    def numbers(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> np.ndarray:
        """The number of each window; cut_a, cut_b: where each begins among the ids, and the end.

        Windows that recur in these texts are told by a hash of their ids, which is verified, so each is looked up once."""
        first, back = alike(((a, cut_a), (b, cut_b)))
        whole_a, whole_b = a.tobytes(), b.tobytes()
        at, to = (4 * cut_a[first]).tolist(), (4 * cut_a[first + 1]).tolist()
        from_b, to_b = (4 * cut_b[first]).tolist(), (4 * cut_b[first + 1]).tolist()
        keys = [(whole_a[i:j], whole_b[k:m]) for i, j, k, m in zip(at, to, from_b, to_b, strict=True)]
        found = list(map(self.number.get, keys))
        if None in found:
            gap = [i for i, x in enumerate(found) if x is None]
            self.add(list(dict.fromkeys([keys[i] for i in gap])))
            for i in gap:
                found[i] = self.number[keys[i]]
        return np.array(found, np.int64)[back]


def alike(sides: tuple[tuple[np.ndarray, np.ndarray], ...]) -> tuple[np.ndarray, np.ndarray]:
    """Of windows over several arrays of ids: one window of each kind, and the kind of each window. Windows are of a kind if their ids are
    equal; those that a 64-bit hash takes for equal and that are not are kinds of their own."""
    n = len(sides[0][1]) - 1
    code = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for ids, cut in sides:
            width = np.diff(cut)
            place = np.arange(len(ids)) - np.repeat(cut[:-1], width)
            salted = mixed(ids.astype(np.uint64) + np.uint64(1) + (place.astype(np.uint64) << np.uint64(32)))
            total = np.r_[np.zeros(1, np.uint64), np.cumsum(salted, dtype=np.uint64)]
            code = mixed(code * np.uint64(0x9E3779B97F4A7C15) + (total[cut[1:]] - total[cut[:-1]]) + width.astype(np.uint64))
    _, first, back = np.unique(code, return_index=True, return_inverse=True)
    wrong = np.zeros(n, bool)
    for ids, cut in sides:
        width, own = np.diff(cut), first[back]
        wrong |= width != width[own]
        same = np.flatnonzero(~wrong)
        unlike = ids[spread(cut[same], width[same])] != ids[spread(cut[own[same]], width[same])]
        wrong[np.repeat(same, width[same])[unlike]] = True
    odd = np.flatnonzero(wrong)
    back[odd] = len(first) + np.arange(len(odd))
    return np.r_[first, odd], back


class Aligner:
    """Aligns texts by two files; see ``documents``."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = encoder(path_a, plain=True), codec(path_b, library=True)
        bytes_a, bytes_b = byte_tokens(path_a), piece_tokens(path_b)
        self.space_a, self.space_b = (np.array([x[:1] == b" " for x in s]) for s in (bytes_a, bytes_b))
        self.windows = Windows(bytes_a, bytes_b)
        self.size_a, self.size_b = self.windows.size_a, self.windows.size_b
        self.words: dict[str, tuple[bytes, bytes]] = {}

    def encoded(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """The ids of a space and each text by both sides. Where neither has more than a word to look at, words are looked up for both."""
        a: list[bytes] = [b""] * len(texts)
        b: list[bytes] = [b""] * len(texts)
        if len(self.words) > WORD_ROWS:
            self.words = {}
        get, held, other, new = self.words.get, [], [], {}
        for i, text in enumerate(texts):
            if text[0] == " " or "  " in text or "<|" in text or MARK in text or not self.b.by_word or self.a.ranks is None:
                other.append(i)
                continue
            words = text.split(" ")
            found = list(map(get, words))
            gap = [(k, words[k]) for k, x in enumerate(found) if x is None] if None in found else []
            new.update((w, None) for _, w in gap)
            held.append((i, found, gap))
        if new:
            fresh = list(new)
            new = dict(zip(fresh, zip(self.a.fresh([" " + w for w in fresh]), self.b.fresh([MARK + w for w in fresh]), strict=True), strict=True))
            self.words.update((w, v) for w, v in new.items() if len(w) <= WORD_CHARS)
        for i, found, gap in held:
            for k, w in gap:
                found[k] = new[w]
            a[i], b[i] = b"".join([x[0] for x in found]), b"".join([x[1] for x in found])
        for i, x, y in zip(other, self.a.encode([" " + texts[i] for i in other]), self.b.encode([texts[i] for i in other]), strict=True):
            a[i], b[i] = x, y
        return a, b

    def documents(self, texts: list[str | None]):
        """Of each text (n_a, n_b, n_groups, n_links, groups), and of all links (text's place, pair, times), by text and pair."""
        rows: list[tuple] = [(0, 0, 0, 0, "")] * len(texts)
        asked = [i for i, t in enumerate(texts) if t]
        a, b = self.encoded([texts[i] for i in asked])
        raw = [(" " + texts[i]).encode() for i in asked]
        size = np.array([len(x) for x in raw], np.int64)
        total = lambda blobs, sizes: np.array([int(sizes[np.frombuffer(x, "<u4")].sum()) for x in blobs], np.int64)
        fit = np.flatnonzero((total(a, self.size_a) == size) & (total(b, self.size_b) == size)).tolist()
        none = (np.zeros(0, np.int64),) * 3
        if not fit:
            return rows, none
        windows = self.windows
        if len(windows.raw) > MEMO_ROWS or windows.ids > MEMO_IDS:
            windows.clear()
        blob_a, blob_b = b"".join([a[i] for i in fit]), b"".join([b[i] for i in fit])
        ids_a, ids_b = np.frombuffer(blob_a, "<u4"), np.frombuffer(blob_b, "<u4")
        start_a, start_b = (np.cumsum(s[x]) - s[x] for s, x in ((self.size_a, ids_a), (self.size_b, ids_b)))
        begins = np.cumsum(size[fit]) - size[fit]
        length = int(size[fit].sum())
        at_a, at_b = np.zeros(length, bool), np.zeros(length, bool)
        at_a[start_a[self.space_a[ids_a]]] = True
        at_b[start_b[self.space_b[ids_b]]] = True
        anchor = at_a & at_b
        anchor[begins] = True
        cut_a, cut_b = (np.r_[np.flatnonzero(anchor[s] & (size_of[x] > 0)), len(x)] for s, size_of, x in ((start_a, self.size_a, ids_a), (start_b, self.size_b, ids_b)))
        of_text = np.searchsorted(np.flatnonzero(anchor), np.r_[begins, length])  # a text's windows
        number = windows.numbers(ids_a, ids_b, cut_a, cut_b)
        numbers = number.tolist()
        known, texts_of, raws = [], windows.text, windows.raw
        parts = [raws[k] for k in numbers]
        all_same = None not in parts and b"".join(parts) == b"".join([raw[i] for i in fit])
        for n, i in enumerate(fit):
            x, y = int(of_text[n]), int(of_text[n + 1])
            mine = numbers[x:y]
            if not all_same and (None in parts[x:y] or b"".join(parts[x:y]) != raw[i]):
                continue
            rows[asked[i]] = (len(a[i]) // 4, len(b[i]) // 4, x, y, ";".join([texts_of[k] for k in mine]))
            known.append((asked[i], x, y))
        if not known:
            return rows, none
        groups, links, first = (np.frombuffer(x, np.int64) for x in (windows.groups, windows.links, windows.first))
        pair, times = np.frombuffer(windows.pair, np.int64), np.frombuffer(windows.times, np.int64)
        whole_groups, whole_links = (np.r_[0, np.cumsum(x[number])] for x in (groups, links))
        owner = np.full(len(number), -1, np.int64)
        for i, x, y in known:
            n_a, n_b, _, _, text = rows[i]
            rows[i] = (n_a, n_b, int(whole_groups[y] - whole_groups[x]), int(whole_links[y] - whole_links[x]), text)
            owner[x:y] = i
        number, owner = number[owner >= 0], owner[owner >= 0]
        many = first[number + 1] - first[number]
        place = spread(first[number], many)
        distinct, inverse = np.unique(pair[place], return_inverse=True)
        both = np.repeat(owner, many) * len(distinct) + inverse
        order = np.argsort(both, kind="stable")
        both, weight = both[order], times[place][order]
        begin = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
        return rows, (both[begin] // len(distinct), distinct[both[begin] % len(distinct)], np.add.reduceat(weight, begin))


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner of these files."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def packed(places: np.ndarray, times: np.ndarray) -> bytes:
    """Rising places and how often each is held, small."""
    return zlib.compress(np.diff(places, prepend=0).astype("<u4").tobytes() + times.astype("<u4").tobytes(), 1)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(blob), "<u4").astype(np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def blocks(docs: DataFrame, path_a: str, path_b: str, block_chars: int, with_groups: bool) -> DataFrame:
    """A row for each document with the places of its pairs in the block's list, and a row for each block with that list."""

    def rows_of(block: int, rows: list[tuple], found: list[tuple]):
        owner, pair, times = (np.concatenate(x) for x in zip(*found, strict=True))
        distinct, place, documents = np.unique(pair, return_inverse=True, return_counts=True)
        cut = np.searchsorted(owner, np.arange(len(rows) + 1))
        for i, (doc_id, n_a, n_b, n_groups, n_links, groups) in enumerate(rows):
            x, y = cut[i], cut[i + 1]
            digest = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
            yield (block, doc_id, n_a, n_b, n_groups, n_links, digest, groups if with_groups else None, packed(place[x:y], times[x:y]), None, None)
        if len(distinct):
            yield (block, None, None, None, None, None, None, None, None, distinct.astype("<i8").tobytes(), documents.astype("<i8").tobytes())

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([(name, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[kind]) for name, kind in (c.split(" ") for c in BLOCK.split(", "))])
        block, rows, found, chars = TaskContext.get().partitionId() << 32, [], [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows_of(block, rows, found), strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            numbers, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for x, y in in_parts(texts):
                mine, (owner, pair, times) = aligner(path_a, path_b).documents(texts[x:y])
                found.append((owner + len(rows), pair, times))
                rows += [(i, *r) for i, r in zip(numbers[x:y], mine, strict=True)]
                chars += sum(len(t or "") for t in texts[x:y])
                if chars >= block_chars:
                    yield out()
                    block, rows, found, chars = block + 1, [], [], 0
        if rows:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCK)


def align(docs: DataFrame, path_a: str, path_b: str, block_chars: int = 1 << 22, with_groups: bool = False) -> DataFrame:
    """Every document's alignment: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is held by as many documents as any of its id of
    side A), count_sum (those numbers over all links), groups_sha256[, groups as ``a1,a2|b1;a3|b2,b3``].

    path_a: a byte-level tokenizers file, which reads a space and the text. path_b: a SentencePiece file, which puts the space itself."""
    made, width = durable(blocks(docs, path_a, path_b, block_chars, with_groups)), len(piece_tokens(path_b))

    def listed(batches):
        import pyarrow as pa

        for batch in batches:
            for block, pairs, documents in zip(*(batch.column(c).to_pylist() for c in ("block", "pairs", "documents")), strict=True):
                pair = np.frombuffer(pairs, "<i8")
                columns = (np.full(len(pair), block), np.arange(len(pair)), *np.divmod(pair, width), np.frombuffer(documents, "<i8"))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "place", "a", "b", "documents"])

    each = made.where("pairs is not null").select("block", "pairs", "documents").mapInArrow(listed, "block long, place long, a long, b long, documents long")
    totals = durable(each.groupBy("a", "b").agg(F.sum("documents").alias("held_by")))
    highest = F.broadcast(totals.groupBy("a").agg(F.max("held_by").alias("highest")))  # a row for each id of the vocabulary at most
    facts = totals.join(highest, "a").select("a", "b", F.col("held_by").alias("n"), (F.col("held_by") == F.col("highest")).alias("best"))
    answers = each.select("block", "place", "a", "b").hint("merge").join(facts.hint("merge"), ["a", "b"]).select("block", "place", "n", "best")
    plain = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if with_groups else [])]

    def answered(rows, known):
        import pandas as pd

        n, best = np.zeros(len(known), np.int64), np.zeros(len(known), bool)
        place = known["place"].to_numpy()
        n[place], best[place] = known["n"].to_numpy(), known["best"].to_numpy()
        sums = np.zeros((len(rows), 2), np.int64)
        for i, blob in enumerate(rows["held"]):
            at, times = unpacked(blob)
            sums[i] = times[best[at]].sum(), (times * n[at]).sum()
        return pd.concat([rows[plain], pd.DataFrame(sums, columns=["n_best", "count_sum"], index=rows.index)], axis=1)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.select(plain).schema.fields)
    texts = made.where("held is not null").select("block", *plain, "held")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(answered, schema + ", n_best long, count_sum long")


def op11_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
