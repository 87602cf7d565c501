"""SentencePiece encoding and decoding of merge-type models: exact merges found by backtracking.

A merge-type model starts from single characters and joins, again and again, the adjacent pair whose joined string is the piece of the
highest score, the leftmost of equals. A split of a text into pieces is the model's own exactly if every two neighbours are: joined
again from their characters, they must come out as the same two pieces. So no merge queue over the text is needed:

* an Aho-Corasick automaton of the pieces gives the longest piece that starts at each character;
* from the left, the longest piece that is compatible with the piece before it is taken, then its shorter prefixes; where none is,
  the position has failed, the last piece is taken back and a shorter one is tried. The pieces up to a position are unique, so a
  failed position never need be entered again: a bitfield holds them, and the work is linear in the text;
* two pieces are compatible if, re-merging both side by side in order of score, no pair across their border is ever the next to be
  joined. A piece's own merges are worked out once, on loading; pieces that don't merge to themselves are left out.

Characters without a piece are single symbols that become byte pieces at the end. Where no piece has a space mark after another
character, which is checked on loading, merges never cross a space after a non-space, so texts go in such words; a bounded cache of the
worker keeps the ids of short ones.

``encode`` and ``decode`` are row-wise: any split of the table gives the same rows, and a lost executor's rows are simply done again.
Defined results: null text counts as empty and has the begin and end ids alone; null ids decode to null; a null doc_id stays null;
repeated rows are encoded each; texts of any length are encoded whole; U+2581 in a text is read as a space, as the model does;
bytes that are no UTF-8 decode to U+FFFD one by one; an empty table gives no rows. Equal scores are the only ties: the leftmost pair goes
first. Only doc_id and text (or ids) are read, so other columns may clash.
"""

from __future__ import annotations

import re
from array import array

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import in_parts

#: Fixed value: the character that stands for a space in pieces.
MARK = "▁"
CACHE_ROWS, CACHE_PIECE, CACHE_PAIRS = 500_000, 48, 2_000_000
NEVER = float("-inf")
WORDS = re.compile(f"{MARK}({MARK}*[^{MARK}]*)")


def merges(symbols: str, scores: dict[str, float]) -> tuple[list[str], list[tuple[float, str, str]]]:
    """The pieces that plain merging makes of a short string, and of each merge its score and the first and last piece after it."""
    parts, steps = list(symbols), []
    while True:
        best, at = NEVER, -1
        for i in range(len(parts) - 1):
            score = scores.get(parts[i] + parts[i + 1], NEVER)
            if score > best:
                best, at = score, i
        if at < 0:
            return parts, steps
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        steps.append((best, parts[0], parts[-1]))


class PieceCodec:
    """Ids of texts and texts of ids by a SentencePiece file of the merge type with byte pieces. library: words that the cache does not
    hold are encoded by the sentencepiece library, for callers that only want ids."""

    def __init__(self, path: str, library: bool = False):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = " a  Åﬁ　b "
        if model.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("only models that keep texts as they are and put a space before them are supported")
        self.model, size = model if library else None, model.vocab_size()
        names = [model.id_to_piece(i) for i in range(size)]
        odd = [model.is_control(i) or model.is_unknown(i) for i in range(size)]
        self.bytes_of = {i: int(names[i][1:-1], 16) for i in range(size) if model.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.bytes_of.items()}
        if len(self.byte_ids) != 256:
            raise ValueError("only models with byte pieces are supported")
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        self.ids = {names[i]: i for i in range(size) if not odd[i] and i not in self.bytes_of and not model.is_unused(i)}
        self.scores = {p: model.get_score(i) for p, i in self.ids.items()}
        self.names = [" ⁇ " if i == self.unknown else "" if odd[i] else names[i].replace(MARK, " ") for i in range(size)]
        self.controls = {i for i in range(size) if odd[i] and i != self.unknown}
        self.spaced = {i for p, i in self.ids.items() if p[0] == MARK}
        self.first, self.last = {}, {}  # of a piece, its merges in order: (score, first piece so far), (score, last piece so far)
        self.automaton = ahocorasick.Automaton()
        for p in self.ids if self.model is None else ():
            parts, steps = merges(p, self.scores)
            if len(parts) == 1:
                self.first[p], self.last[p] = [(s, a) for s, a, _ in steps], [(s, b) for s, _, b in steps]
                if len(p) > 1:
                    self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.shorter: dict[str, str | None] = {}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.cache: dict[str, bytes] = {}

    def prefix(self, piece: str) -> str | None:
        """The longest shorter piece that the piece begins with; a single character has none."""
        if piece not in self.shorter:
            self.shorter[piece] = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if n == 1 or piece[:n] in self.first), None)
        return self.shorter[piece]

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the characters of both gives the same two pieces: their own merges run side by side, the higher score first,
        the left one of equals, and a pair across the border must never be next."""
        mine, other, scores = self.last.get(a, ()), self.first.get(b, ()), self.scores
        i = j = 0
        x, y = a[-1], b[0]
        while True:
            left = mine[i][0] if i < len(mine) else NEVER
            right = other[j][0] if j < len(other) else NEVER
            across = scores.get(x + y, NEVER)
            if across > left and across >= right and across > NEVER:
                return False
            if left >= right:
                if left == NEVER:
                    return True
                x = mine[i][1]
                i += 1
            else:
                y = other[j][1]
                j += 1

    def split(self, text: str, longest: list[str], start: int, stop: int) -> list[str]:
        """The pieces of text[start:stop]; longest: the longest piece from each character on."""
        out: list[str] = []
        failed, shorter, pairs = None, self.shorter, self.pairs
        at, known, piece = start, None, longest[start] if start < stop else ""
        while at < stop:
            end = at + len(piece)
            fits = failed is None or not failed[(end - start) >> 3] >> ((end - start) & 7) & 1
            if fits and known is not None:
                fits = known.get(piece)
                if fits is None:
                    fits = known[piece] = self.compatible(out[-1], piece)
                    self.n_pairs += 1
            if not fits:
                piece = shorter[piece] if piece in shorter else self.prefix(piece)
                if piece is not None:
                    continue
                failed = failed or bytearray((stop - start) // 8 + 1)
                failed[(at - start) >> 3] |= 1 << ((at - start) & 7)
                piece = out.pop()
                at -= len(piece)
                known = pairs[out[-1]] if out else None
                continue
            out.append(piece)
            at = end
            if at < stop:
                known = pairs.get(piece)
                if known is None:
                    known = pairs[piece] = {}
                piece = longest[at]
        return out

    def fresh(self, words: list[str]) -> list[bytes]:
        """Ids of words, which stand for texts with their marks, as little-endian unsigned 32-bit numbers."""
        if self.model is not None:  # the library puts the mark before a text itself, but for an empty one
            alone = array("I", [self.ids[MARK]]).tobytes()
            return [array("I", x).tobytes() if len(w) > 1 else alone for w, x in zip(words, self.model.encode([w[1:] for w in words], num_threads=1), strict=True)]
        if self.n_pairs > CACHE_PAIRS:
            self.pairs, self.n_pairs = {}, 0
        # a character that no piece has stands between the words, so that no match crosses them
        found = []
        for a, b in in_parts(words, 1 << 18):
            text = "".join([w + "\x00" for w in words[a:b]])
            longest = list(text)
            for end, piece in self.automaton.iter(text):
                longest[end - len(piece) + 1] = piece
            start = 0
            for w in words[a:b]:
                pieces = self.split(text, longest, start, start + len(w))
                try:
                    ids = array("I", [self.ids[piece] for piece in pieces])
                except KeyError:  # characters without a piece
                    ids = array("I", [i for piece in pieces for i in ([self.ids[piece]] if piece in self.ids else [self.byte_ids[x] for x in piece.encode()])])
                found.append(ids.tobytes())
                start += len(w) + 1
        return found

    def encode(self, texts, begin: bool = False, end: bool = False) -> list[bytes]:
        """The ids of each text, null as empty."""
        if len(self.cache) > CACHE_ROWS:
            self.cache = {}
        front = array("I", [self.begin] if begin else []).tobytes()
        back = array("I", [self.end] if end else []).tobytes()
        get, held, gaps, new = self.cache.get, [], [], {}
        for text in texts:
            text = (text or "").replace(" ", MARK)
            if not text:
                words = []
            elif not self.by_word:
                words = [text]
            elif MARK * 2 in text or text[0] == MARK:
                words = WORDS.findall(MARK + text)
            else:
                words = text.split(MARK)
            found = list(map(get, words))
            if None in found:
                gap = [(i, words[i]) for i, x in enumerate(found) if x is None]
                gaps.append((found, gap))
                new.update((w, None) for _, w in gap)
            held.append(found)
        if new:
            fresh = list(new)
            new = dict(zip(fresh, self.fresh([MARK + w for w in fresh]), strict=True))
            self.cache.update((w, v) for w, v in new.items() if len(w) <= CACHE_PIECE)
        for found, gap in gaps:
            for i, w in gap:
                found[i] = new[w]
        return [b"".join([front, *found, back]) for found in held]

    def decode(self, blob: bytes) -> str:
        """The text of ids: begin, end and other control ids vanish, byte pieces join, and the mark that begins the text goes."""
        ids = array("I", blob)
        opens = next((i for i in ids if i not in self.controls), None)
        if self.bytes_of.keys().isdisjoint(ids):
            text = "".join(map(self.names.__getitem__, ids))
        else:
            parts, held = [], bytearray()
            for i in [*ids, self.begin]:
                if i in self.bytes_of:
                    held.append(self.bytes_of[i])
                    continue
                if held:
                    parts.append(characters(bytes(held)))
                    held.clear()
                parts.append(self.names[i])
            text = "".join(parts)
        return text[1:] if opens in self.spaced else text


def characters(held: bytes) -> str:
    """UTF-8 bytes as text, each byte that begins no character as U+FFFD."""
    try:
        return held.decode()
    except UnicodeDecodeError as wrong:
        return held[: wrong.start].decode() + "�" + characters(held[wrong.start + 1 :])


_codecs: dict[tuple[str, bool], PieceCodec] = {}


def codec(path: str, library: bool = False) -> PieceCodec:
    """The worker's codec of this file."""
    if (path, library) not in _codecs:
        _codecs[path, library] = PieceCodec(path, library)
    return _codecs[path, library]


def encode(docs: DataFrame, path: str, begin: bool = True, end: bool = True) -> DataFrame:
    """(doc_id, ids): the ids of every whole text, as little-endian unsigned 32-bit numbers."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in in_parts(texts):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(codec(path).encode(texts[a:b], begin, end), pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): the text of every row's ids."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column("ids").to_pylist()
            for a, b in in_parts(ids, 1 << 22):
                texts = [None if x is None else codec(path).decode(x) for x in ids[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], batch.column("ids")[a:b], pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    done = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
