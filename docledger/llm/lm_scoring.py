"""Language-model scoring by context-tree weighting over binary-decomposed bytes, beside an add-one unigram base score.

A text is read as its tokens: the words of its A-Z lower-cased form, joined by one space, then an end byte (a line feed, which no
word holds). Every byte is eight binary decisions; the decision node (the bits of the byte so far) keeps, for the context of the
last 0 to ``depth`` bytes, how often 0 and 1 followed in the training texts. Each context node estimates by Krichevsky-Trofimov;
context-tree weighting mixes the estimates of all depths by the weights P_e / (2 P_w) that the training counts give. A path stops
at the deepest context that training has seen. The code length per byte is the sum of -log2 over the decisions.

Neither counts nor scores pass through the driver or a table that every task holds. Tasks cut the texts into blocks and write, for
each block, its text and its distinct grams (context, byte) and words with their training counts, dealt into parts by a hash of the
three nearest context bytes or of the word; all are sorted and packed, a few bytes a gram, and checkpointed, so later steps read the
same blocks whatever is run again. A part meets the grams of all blocks in one group: it sums their counts, builds the context trees
from three bytes down and answers every block with the scores of its own grams; the block's text then meets its answers. Only the
tree above three context bytes, at most 65,536 contexts of 255 decisions whatever the corpus, and two sums pass through the driver.
A part holds about ``part_bytes`` of text's share of the distinct grams; a frequent context of three bytes is one part's.

Defined results: null text counts as empty (one end token); null training flag counts as not training; repeated rows are scored
each; without training texts every decision has probability 1/2; columns other than doc_id, text and the flag are not read, so
others may clash. An empty table gives no rows. Texts of any length are cut at words into blocks; ties do not occur. Words are told
apart by a 64-bit hash; scores of single grams are kept to 2^-19 of a decimal digit.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, mixed, strings, table

END, CHUNK = 10, 1 << 20
END_HASH, BASE = np.uint64(0x1234567), np.uint64(0x9E3779B97F4A7C15)
GRAMS, WORDS, TEXTS = 0, 1, 2
LOCAL = 3  # context bytes whose trees are built inside a part
STEP = 1 << 18  # a score's unit is 1 / STEP of a decimal digit
MAX_PARTS = 1 << 17
PIECE = "kind int, place long, block long, size long, a binary, b binary, doc_ids array<long>, train array<boolean>"
_powers: dict[str, np.ndarray] = {}
_tables: list[tuple[np.ndarray, np.ndarray]] = []


def normalised(text) -> bytes:
    return b" ".join((text or "").encode("utf-8", "replace").lower().split())


def packed(x: np.ndarray) -> bytes:
    """An array as compressed planes of its bytes: sorted or small values shrink to a few bits."""
    import pyarrow as pa

    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return pa.Codec("zstd", compression_level=6).compress(planes, asbytes=True) if len(x) else b""


def unpacked(blob: bytes, size: int, kind) -> np.ndarray:
    import pyarrow as pa

    width = np.dtype(kind).itemsize
    if not size:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(blob, decompressed_size=size * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, size).T).reshape(-1).view(kind)


def pieces_of(body: bytes, most: int):
    """A text's body in pieces of about ``most`` bytes that end after a space."""
    start = 0
    while start < len(body):
        cut = len(body) if len(body) - start <= most else (body.find(b" ", start + most) + 1 or len(body))
        yield start, cut
        start = cut


def gram_codes(x: np.ndarray, owner: np.ndarray, depth: int):
    """(codes, documents) of the bytes that are not context, a chunk at a time. A code has the nearest byte before on top, then the
    others, then the byte itself."""
    for start in range(depth, len(x), CHUNK):
        stop = min(len(x), start + CHUNK)
        wide = x[start - depth : stop].astype(np.uint64)
        codes = wide[depth:].copy()
        for d in range(1, depth + 1):
            codes |= wide[depth - d : len(wide) - d] << np.uint64(8 * (depth + 1 - d))
        own = owner[start:stop]
        real = own >= 0
        yield codes[real], own[real]


def word_codes(x: np.ndarray, owner: np.ndarray):
    """(hashes, documents) of the tokens, a chunk at a time. A word's hash is that of its bytes; the end has its own."""
    own = np.where(owner >= 0, x, np.uint8(END))  # a piece begins after a space, so no word lies across the context
    gaps = np.flatnonzero((own == 32) | (own == END))
    start = 0
    while start < len(x):
        stop = int(gaps[min(np.searchsorted(gaps, start + CHUNK), len(gaps) - 1)]) + 1
        yield chunk_words(x[start:stop], own[start:stop], owner[start:stop])
        start = stop


def chunk_words(x: np.ndarray, own: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < len(x) + 1:
        n = max(len(x), 2 * CHUNK)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers["up"] = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, BASE)])
            _powers["down"] = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, inverse)])
    gap = np.flatnonzero((own == 32) | (own == END))
    start, stop = np.r_[0, gap[:-1] + 1], gap
    real = stop > start
    start, stop = start[real], stop[real]
    with np.errstate(over="ignore"):
        sums = np.where(own == END, np.uint64(0), own.astype(np.uint64) + np.uint64(1))
        sums *= _powers["up"][: len(x)]
        sums = np.r_[np.uint64(0), np.cumsum(sums, dtype=np.uint64)]
        code = mixed((sums[stop] - sums[start]) * _powers["down"][start] + (stop - start).astype(np.uint64))
    ends = np.flatnonzero((x == END) & (owner >= 0))
    return np.r_[code, np.full(len(ends), END_HASH)], np.r_[owner[start], owner[ends]]


def owners(lengths: np.ndarray, depth: int) -> np.ndarray:
    """The document of each byte of a block, -1 for the ``depth`` bytes of context before each piece."""
    marks = np.stack([np.full(len(lengths), -1, np.int32), np.arange(len(lengths), dtype=np.int32)], axis=1).ravel()
    return np.repeat(marks, np.stack([np.full(len(lengths), depth), lengths], axis=1).ravel())


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sum of the counts of each."""
    key, n = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])
    if len(keys) < 2 or not len(key):
        return key, n
    order = np.argsort(key)
    key, n = key[order], n[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[starts], np.add.reduceat(n, starts)


def training_counts(batches) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes with their number in training; ``batches`` are (codes, whether each is training)."""
    keys, counts = [], []
    for codes, train in batches:
        key, n = np.unique(codes[train], return_counts=True)
        other = np.unique(codes[~train])
        keys += [key, other]
        counts += [n, np.zeros(len(other), np.int64)]
        if sum(map(len, keys[1:])) > max(CHUNK, len(keys[0])):
            key, n = summed(keys, counts)
            keys, counts = [key], [n]
    return summed(keys, counts)


def part_of(kind: int, keys: np.ndarray, parts: int, depth: int) -> np.ndarray:
    near = keys >> np.uint64(8 * (depth + 1 - LOCAL)) if kind == GRAMS else keys
    return (mixed(near) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int32)


def block_pieces(depth: int, parts: dict[int, int], block_bytes: int):
    """Per task: blocks of documents, each as a row of its text and rows of its grams and words by part."""

    def finish(block: int, entries: list[tuple]):
        body, lengths = b"".join(e[0] for e in entries), np.array([len(e[0]) - depth for e in entries], np.int64)
        train = np.array([e[3] for e in entries], bool)
        uids = np.array([e[1] for e in entries], np.int64)
        x, owner = np.frombuffer(body, np.uint8), owners(lengths, depth)
        yield (TEXTS, block, block, len(body), packed(x), np.stack([lengths, uids]).tobytes(), [e[2] for e in entries], train.tolist())
        for kind, batches in ((GRAMS, gram_codes(x, owner, depth)), (WORDS, word_codes(x, owner))):
            keys, n = training_counts((codes, train[own]) for codes, own in batches)
            at = part_of(kind, keys, parts[kind], depth)
            order = np.argsort(at, kind="stable")
            keys, n, at = keys[order], n[order].astype(np.uint32), at[order]
            cuts = np.r_[np.flatnonzero(np.r_[True, at[1:] != at[:-1]]), len(at)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield (kind, int(at[a]), block, int(b - a), packed(keys[a:b]), packed(n[a:b]), None, None)

    def run(frames):
        import pandas as pd
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        block = made = first
        entries, size = [], 0

        def closed():
            return pd.DataFrame(list(finish(block, entries)), columns=["kind", "place", "block", "size", "a", "b", "doc_ids", "train"])

        for frame in frames:
            for text, doc_id, train in zip(strings(frame["text"]), frame["doc_id"].astype("Int64"), frame["train"], strict=True):
                body = normalised(text) + b"\n"
                for start, cut in pieces_of(body, block_bytes):
                    entries.append((body[max(0, start - depth) : start].rjust(depth, b"\n") + body[start:cut], made, None if doc_id is pd.NA else int(doc_id), bool(train)))
                    size += cut - start + depth
                    if size >= block_bytes:
                        yield closed()
                        entries, size, block = [], 0, block + 1
                made += 1
        if entries:
            yield closed()

    return run


def log_gamma(x: np.ndarray) -> np.ndarray:
    z = x + 8.0
    out = (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3)
    for k in range(8):
        out = out - np.log(x + k)
    return out


def kt_log(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    if not _tables:
        n = np.arange(1 << 16, dtype=float)
        _tables.append((log_gamma(n + 0.5), log_gamma(n + 1.0)))
    half, whole = _tables[0]
    few = a + b < len(half)
    if few.all():
        a, b = a.astype(np.int64), b.astype(np.int64)
        return half[a] + half[b] - whole[a + b] - 1.1447298858494002
    out = np.empty(len(a))
    out[few] = kt_log(a[few], b[few])
    a, b = a[~few].astype(float), b[~few].astype(float)
    out[~few] = log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - 1.1447298858494002
    return out


def weighted(estimate: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log P_w of nodes from log P_e and the children's summed log P_w, and the weight of stopping at the node."""
    total = np.logaddexp(estimate, children) - np.log(2)
    return total, np.exp(estimate - np.log(2) - total)


class Trees:
    """The context trees of one part's grams, from LOCAL context bytes down to ``depth``, one decision at a time."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int):
        self.keys, self.n, self.depth = keys, n, depth
        self.byte = (keys & np.uint64(255)).astype(np.int64)
        self.orders: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d in range(LOCAL, depth + 1):  # grams by context of d bytes, then by byte: the decisions below a context are neighbours
            context = keys >> np.uint64(8 * (depth + 1 - d))
            code = (np.cumsum(np.r_[False, context[1:] != context[:-1]]) << 8) | self.byte
            order = np.argsort(code) if d < depth else np.arange(len(keys))
            self.orders[d] = order, code[order]

    def decision(self, k: int):
        """Levels LOCAL to depth of decision k as (node of each gram, zeros, ones, stopping weight); the grams that stand for the
        uppermost level's nodes, and the log P_w of these."""
        levels, below, stand = {}, None, None
        for d in range(self.depth, LOCAL - 1, -1):
            order, code = self.orders[d]
            node = code >> (8 - k)
            new = np.r_[True, node[1:] != node[:-1]]
            starts, n = np.flatnonzero(new), self.n[order]
            ones = np.add.reduceat(n * ((code >> (7 - k)) & 1), starts)
            zeros = np.add.reduceat(n, starts) - ones
            of = np.empty(len(order), np.int64)
            of[order] = np.cumsum(new) - 1
            estimate = kt_log(zeros, ones)
            if below is None:
                below, stop = estimate, np.ones(len(starts))
            else:
                below, stop = weighted(estimate, np.bincount(of[stand], below, len(starts)))
            stand = order[starts]
            levels[d] = of, zeros, ones, stop
        return levels, stand, below

    def above(self) -> np.ndarray:
        """Of each gram, the LOCAL - 1 nearest bytes and the byte itself."""
        return ((self.keys >> np.uint64(8 * (self.depth + 2 - LOCAL))).astype(np.int64) << 8) | self.byte


def node_keys(above: np.ndarray, k: int, d: int) -> np.ndarray:
    """Keys of the nodes of decision k at level d < LOCAL: context and decision node."""
    context = above >> (8 * (LOCAL - d)) if d else np.zeros(len(above), np.int64)
    return (context << 8) | (1 << k) | ((above & 255) >> (8 - k))


def gathered(frame) -> tuple[np.ndarray, np.ndarray]:
    rows = list(zip(frame["a"], frame["b"], frame["size"], strict=True))
    return summed([unpacked(a, s, np.uint64) for a, _, s in rows], [unpacked(b, s, np.uint32).astype(np.int64) for _, b, s in rows])


def upper_sums(depth: int):
    """Of a part of grams: zeros, ones and summed log P_w of the children, for the nodes with LOCAL - 1 context bytes. Of a part of
    words (node -1): how many are in training texts, and how often."""

    def run(frame):
        import pandas as pd

        keys, n = gathered(frame)
        if frame["kind"].iloc[0] == WORDS:
            return pd.DataFrame({"node": [-1], "zeros": [int((n > 0).sum())], "ones": [int(n.sum())], "logs": [0.0]})
        seen = n > 0
        trees, out = Trees(keys[seen], n[seen], depth), []
        above = trees.above()
        for k in range(8 if seen.any() else 0):
            levels, stand, logs = trees.decision(k)
            _, zeros, ones, _ = levels[LOCAL]
            node, at = np.unique(node_keys(above[stand], k, LOCAL - 1), return_inverse=True)
            out.append(pd.DataFrame({"node": node, "zeros": np.bincount(at, zeros).astype(np.int64), "ones": np.bincount(at, ones).astype(np.int64), "logs": np.bincount(at, logs)}))
        return pd.concat(out) if out else pd.DataFrame({"node": np.zeros(0, np.int64), "zeros": np.zeros(0, np.int64), "ones": np.zeros(0, np.int64), "logs": np.zeros(0)})

    return run


def top_levels(rows) -> list[tuple[np.ndarray, ...]]:
    """Levels 0 to LOCAL - 1 as (sorted node keys, zeros, ones, stopping weights)."""
    order = np.argsort(rows["node"].to_numpy())
    node, zeros, ones, logs = (rows[c].to_numpy()[order] for c in ("node", "zeros", "ones", "logs"))
    found = []
    for d in range(LOCAL - 1, -1, -1):
        total, stop = weighted(kt_log(zeros, ones), logs)
        found.append((node, zeros, ones, stop))
        context = (node >> 16) if d > 1 else np.zeros(len(node), np.int64)  # the farthest byte is the lowest of a context
        node, at = np.unique((context << 8) | (node & 255), return_inverse=True)
        zeros, ones, logs = (np.bincount(at, v, len(node)) for v in (zeros, ones, total))
        zeros, ones = zeros.astype(np.int64), ones.astype(np.int64)
    return found[::-1]


class Path:
    """Mixing weights along the contexts of many decisions at once, from the empty context down."""

    def __init__(self, bit: np.ndarray):
        self.bit, self.alive = bit, np.ones(len(bit), bool)
        self.last, self.mass, self.p = np.full(len(bit), 0.5), np.ones(len(bit)), np.zeros(len(bit))

    def at(self, which: np.ndarray) -> Path:
        found = Path.__new__(Path)
        found.bit, found.alive, found.last, found.mass, found.p = (x[which] for x in (self.bit, self.alive, self.last, self.mass, self.p))
        return found

    def down(self, zeros, ones, stop, there=True):
        n = zeros + ones
        self.alive &= there & (n > 0)
        here = (np.where(self.bit, ones, zeros) + 0.5) / (n + 1)
        mass = np.where(self.alive, self.mass, 0.0)
        self.p += mass * stop * here
        self.mass -= mass * stop
        self.last = np.where(self.alive, here, self.last)

    def log10(self) -> np.ndarray:
        return np.log10(self.p + self.mass * self.last)


def gram_scores(keys: np.ndarray, n: np.ndarray, depth: int, top) -> np.ndarray:
    """-log10 of each gram's byte after its context, in units of 1 / STEP."""
    trees, total = Trees(keys, n, depth), np.zeros(len(keys))
    above, which = np.unique(trees.above(), return_inverse=True)
    for k in range(8):
        path = Path(((above >> (7 - k)) & 1).astype(bool))
        for d in range(LOCAL):
            node, zeros, ones, stop = top[d]
            if not len(node):
                break
            want = node_keys(above, k, d)
            place = np.minimum(np.searchsorted(node, want), len(node) - 1)
            path.down(zeros[place], ones[place], stop[place], node[place] == want)
        path = path.at(which)
        levels, _, _ = trees.decision(k)
        for d in range(LOCAL, depth + 1):
            of, zeros, ones, stop = levels[d]
            path.down(zeros[of], ones[of], stop[of])
        total -= path.log10()
    return np.rint(total * STEP).astype(np.uint32)


def answers(depth: int, top):
    """Of a part: for each of its blocks the keys again, with their scores (grams) or counts (words)."""

    def run(frame):
        import pandas as pd

        keys, n = gathered(frame)
        value = gram_scores(keys, n, depth, top.value) if frame["kind"].iloc[0] == GRAMS else n
        made = [packed(value[np.searchsorted(keys, unpacked(a, s, np.uint64))]) for a, s in zip(frame["a"], frame["size"], strict=True)]
        return pd.DataFrame({"kind": frame["kind"], "block": frame["block"], "size": frame["size"], "a": frame["a"], "b": made})

    return run


def looked_up(rows, kind: int, values):
    """A function from codes and what belongs to each to the codes' answers in a block, and the latter in their order."""
    mine = rows[rows["kind"] == kind]
    keys = np.concatenate([np.zeros(0, np.uint64), *(unpacked(a, s, np.uint64) for a, s in zip(mine["a"], mine["size"], strict=True))])
    value = np.concatenate([np.zeros(0, values), *(unpacked(b, s, values) for b, s in zip(mine["b"], mine["size"], strict=True))])
    order = np.argsort(keys)
    keys, value = keys[order], value[order]

    def find(codes, own):
        order = np.argsort(codes)
        return value[np.searchsorted(keys, codes[order])], own[order]

    return find


def document_scores(depth: int, denominator: float):
    """Of a block and its answers: one row for each document, or piece of one."""

    def run(texts, rows):
        import pandas as pd

        if not len(texts):
            return pd.DataFrame({c: [] for c in ("uid", "doc_id", "train", "tokens", "known", "base", "score", "bytes")})
        block = texts.iloc[0]
        lengths, uids = np.frombuffer(block["b"], np.int64).reshape(2, -1)
        x, owner, docs = unpacked(block["a"], block["size"], np.uint8), owners(lengths, depth), len(lengths)
        score, scores, counts = np.zeros(docs), looked_up(rows, GRAMS, np.uint32), looked_up(rows, WORDS, np.int64)
        for codes, own in gram_codes(x, owner, depth):
            value, own = scores(codes, own)
            score -= np.bincount(own, value, docs)
        base, known, tokens = np.zeros(docs), np.zeros(docs), np.zeros(docs, np.int64)
        for words, own in word_codes(x, owner):
            n, own = counts(words, own)
            base += np.bincount(own, np.log10((n + 1) / denominator), docs)
            known += np.bincount(own, n > 0, docs)
            tokens += np.bincount(own, minlength=docs)
        return pd.DataFrame({"uid": uids, "doc_id": pd.array(list(block["doc_ids"]), "Int64"), "train": list(block["train"]), "tokens": tokens, "known": known.astype(np.int64), "base": base, "score": score / STEP, "bytes": lengths})

    return run


def score_documents(docs: DataFrame, train: Column, depth: int = 6, block_bytes: int = 16 << 20, part_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: doc_id, train, n_tokens, n_known, train_tokens, base_score, score (log10), n_bytes, bits_per_byte.

    ``train`` tells the rows to learn from. depth: context bytes, 3 to 7. block_bytes, part_bytes: text of a block, and for each part.
    """
    if not LOCAL <= depth <= 7:
        raise ValueError(f"depth is {LOCAL} to 7")
    texts = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    grams = min(MAX_PARTS, 1 + size // part_bytes)
    parts = {GRAMS: grams, WORDS: 1 + grams // 8}
    made = durable(texts.mapInPandas(block_pieces(depth, parts, block_bytes), PIECE))
    dealt = made.where(F.col("kind") != TEXTS).select("kind", "place", "block", "size", "a", "b").repartition(sum(parts.values()), "kind", "place")
    found = dealt.groupBy("kind", "place").applyInPandas(upper_sums(depth), "node long, zeros long, ones long, logs double")
    sums = found.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "logs"))).toArrow().to_pandas()
    words = sums[sums["node"] == -1]
    distinct, train_tokens = int(words["zeros"].sum()), int(words["ones"].sum())
    top = docs.sparkSession.sparkContext.broadcast(top_levels(sums[sums["node"] >= 0]))
    replies = dealt.groupBy("kind", "place").applyInPandas(answers(depth, top), "kind int, block long, size long, a binary, b binary")

    bodies = made.where(F.col("kind") == TEXTS).select("block", "size", "a", "b", "doc_ids", "train")
    schema = "uid long, doc_id long, train boolean, tokens long, known long, base double, score double, bytes long"
    scored = bodies.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(document_scores(depth, float(train_tokens + distinct + 1)), schema)
    totals = scored.groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"), F.first("train").alias("train"), F.sum("tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        F.sum("base").alias("base_score"), F.sum("score").alias("score"), F.sum("bytes").alias("n_bytes"),
    )
    return totals.withColumn("bits_per_byte", -F.col("score") / F.lit(np.log10(2)) / F.col("n_bytes")).drop("uid")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    out = score_documents(docs, rest != 2)
    return out.select("doc_id", (F.coalesce(rest == 2, F.lit(False))).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
