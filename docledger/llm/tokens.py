"""Token ids of whole texts, with a cache of the pieces between spaces.

Byte-level BPE merges only inside pre-tokens, and a single space before a non-space opens one. So the ids of a text are those of its
pieces, each with its leading space, wherever no two spaces meet; other texts, and those with a marker of a special token, are
encoded whole. Natural text repeats its pieces, so most are found in the worker's cache, which is emptied when it is full.

Where a file's merges stand in the order of their ids and its pre-tokens are the byte-level ones, which is checked on loading, pieces
that the cache does not hold are merged by rank with tiktoken over the file's own vocabulary: the same ids in a third of the time.
"""

from __future__ import annotations

import json
import os
from array import array

CACHE_ROWS, CACHE_PIECE = 200_000, 64
#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranked(path: str):
    """A tiktoken encoding of a tokenizers file, or None where its merges don't follow their ids."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    ids = [vocab.get(a + b, -1) for a, b in merges]
    plain = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    if model.get("type") != "BPE" or not plain or model.get("end_of_word_suffix") or ids != sorted(ids) or min(ids, default=-1) < 0:
        return None
    special = {t["content"] for t in spec.get("added_tokens", [])}
    byte = printable_bytes()
    ranks = {bytes(byte[ch] for ch in token): i for token, i in vocab.items() if token not in special}
    if sorted(ranks.values()) != list(range(len(ranks))):
        return None
    return tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class PieceEncoder:
    """Little-endian unsigned 32-bit ids of texts by a tokenizers file; plain: strings of special tokens are ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        self.path, self.tokenizer, self.plain = path, None, plain
        self.cache: dict[str, bytes] = {}
        self.ranks = ranked(path)

    def fresh(self, pieces: list[str]) -> list[bytes]:
        if self.ranks is None:
            return self.whole(pieces)
        one = self.ranks.encode_ordinary
        return [array("I", one(p)).tobytes() for p in pieces]

    def whole(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        if self.tokenizer is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
            self.tokenizer.encode_special_tokens = self.plain
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts) -> list[bytes]:
        out: list[bytes | None] = []
        split: list[list[str] | None] = []
        new: dict[str, None] = {}
        if len(self.cache) > CACHE_ROWS:
            self.cache = {}
        for text in texts:
            text = text or ""
            if "  " in text or "<|" in text or not text:
                split.append(None)
                out.append(self.whole([text])[0] if text else b"")
                continue
            first, *rest = text.split(" ")
            pieces = [first, *[" " + p for p in rest]] if first else [" " + p for p in rest]
            split.append(pieces)
            out.append(None)
            for p in pieces:
                if p not in self.cache:
                    new[p] = None
        fresh = list(new)
        found = dict(zip(fresh, self.fresh(fresh), strict=True)) if fresh else {}
        self.cache.update((p, v) for p, v in found.items() if len(p) <= CACHE_PIECE)
        get = self.cache.get
        return [o if p is None else b"".join([get(x) or found[x] for x in p]) for o, p in zip(out, split, strict=True)]


_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, plain: bool = False) -> PieceEncoder:
    """The worker's encoder of this file."""
    if (path, plain) not in _encoders:
        _encoders[path, plain] = PieceEncoder(path, plain)
    return _encoders[path, plain]


def in_parts(values: list, weight: int = 1 << 20):
    """Runs of indices whose texts have about ``weight`` characters together."""
    start, size = 0, 0
    for i, v in enumerate(values):
        size += len(v or "")
        if size >= weight:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(values):
        yield start, len(values)
