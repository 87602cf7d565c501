"""Which of very many keys stand in a text: the part that runs on Arrow batches.

Every substring's hash comes from two running sums, whatever its length, so a batch is a few vector operations a byte. A Bloom filter over the
hashes of all keys and of one gram of each tells which substrings may be keys; it lets a few wrong ones through, which the caller's join
by the key itself drops, and never loses a right one. It has at most ``MOST_BITS`` bits, whatever the number of keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
#: Bytes of text that are looked at together.
STEP = 1 << 18
BASE = 0x9E3779B97F4A7C15
MIX, LENGTH, PLACE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers up to n and their inverses modulo 2**64."""
    if not POWERS or len(POWERS[0]) <= n:
        size = max(n + 1, STEP)
        POWERS[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))]) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return POWERS[0], POWERS[1]


def sums(data: np.ndarray) -> np.ndarray:
    """Running sums of which two give the hash of what stands between them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def mixed(x: np.ndarray, n) -> np.ndarray:
    x = x + LENGTH * np.asarray(n, np.uint64).reshape(-1)
    x ^= x >> np.uint64(32)
    x *= MIX
    x ^= x >> np.uint64(29)
    return x


def hashes(run: np.ndarray, start: np.ndarray, n) -> np.ndarray:
    """Of the substrings that begin at ``start`` and have ``n`` bytes."""
    return mixed((run[start + n] - run[start]) * powers(len(run))[1][start], n)


def in_place(h: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A key's hash with its place's number: keys count in their own place only."""
    return mixed(h + PLACE * place.astype(np.uint64), 0)


def bits_of(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings, and where each begins and the last ends."""
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def numbers(column: pa.Array | None, n: int, places: list[str]) -> np.ndarray:
    """The number of each row's place; places that no key has are one further number."""
    if column is None:
        return np.zeros(n, np.int64)
    found = pa.compute.index_in(column, pa.array(places, column.type))
    return found.fill_null(len(places)).to_numpy(zero_copy_only=False).astype(np.int64)


def bloom(index: DataFrame, n_keys: int, place: str | None, places: list[str]) -> tuple[bytes, int]:
    """The filter over the keys (__key) and grams (__gram) of an index, and its number of bits."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (64 * max(1, n_keys) - 1).bit_length()))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = []
            for name in ("__gram", "__key"):
                data, at = strings(batch.column(name))
                begin = at[0] if len(at) else 0
                run = sums(data[begin : at[-1]])
                h = hashes(run, at[:-1] - begin, at[1:] - at[:-1])
                each += bits_of(in_place(h, numbers(batch.column(place) if place else None, len(h), places)) if name == "__key" else h, bits)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(each)).astype(np.int64) + 1)], ["bit"])

    shown = [c for c in ("__key", "__gram", place) if c]
    marked = index.select(*shown).mapInArrow(marks, "bit long")
    held = marked.groupBy(F.bitmap_bucket_number("bit").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in held.toLocalIterator():  # at most 32 MB in all, however many keys there are
        part = np.frombuffer(r["bits"], np.uint8)
        begin = (r["at"] - 1) * len(part)
        out[begin : begin + len(part)] = part[: len(out) - begin]
    return out.tobytes(), bits


def finder(own: list[str], place: str | None, places: list[str], forms: list[tuple[int, int, int]], held, bits: int) -> Callable:
    """Batches with ``own`` and __hay to batches with ``own`` and __found, the substrings of __hay that may be keys. forms: (bytes of the gram,
    its place in the key, bytes of the key); held: the broadcast filter."""
    longest, ahead = max(n for *_, n in forms), max(off for _, off, _ in forms)
    by_gram = {g: [(off, n) for h, off, n in forms if h == g] for g in sorted({g for g, *_ in forms})}

    def found_in(data: np.ndarray, at: np.ndarray, number: np.ndarray, known: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        def maybe(h: np.ndarray) -> np.ndarray:
            a, b = bits_of(h, bits)
            hit = np.flatnonzero((known[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8)) & 1)
            b = b[hit]
            return hit[((known[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]

        for first in range(int(at[0]), int(at[-1]), STEP):
            low, high = max(int(at[0]), first - ahead), min(int(at[-1]), first + STEP + longest)
            run, inverse = sums(data[low:high]), powers(high - low)[1]
            for gram, keys in by_gram.items():
                begin, end = first - low, min(first + STEP, high - gram + 1) - low
                if end <= begin:
                    continue
                pos = maybe(mixed((run[begin + gram : end + gram] - run[begin:end]) * inverse[begin:end], gram)) + begin
                row = np.searchsorted(at, pos + low, "right") - 1
                start, stop = at[row] - low, at[row + 1] - low
                for off, n in keys:
                    inside = np.flatnonzero((pos - off >= start) & (pos - off + n <= stop))
                    mine, where = row[inside], pos[inside] - off
                    h = in_place(hashes(run, where, n), number[mine])
                    hit = maybe(h)
                    if len(hit):
                        yield mine[hit], where[hit] + low, np.full(len(hit), n), h[hit]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            data, at = strings(batch.column("__hay"))
            number = numbers(batch.column(place) if place else None, batch.num_rows, places)
            parts = list(found_in(data, at, number, known)) if batch.num_rows else []
            if not parts:
                continue
            row, start, size, h = (np.concatenate(p) for p in zip(*parts))
            order = np.lexsort((h, row))  # a key that stands in a text several times is told once
            first = np.concatenate([[True], (np.diff(row[order]) != 0) | (h[order][1:] != h[order][:-1])])
            row, start, size = (v[order][first] for v in (row, start, size))
            ends = np.cumsum(size)
            taken = data[np.repeat(start - (ends - size), size) + np.arange(ends[-1])]
            offsets = np.concatenate([[0], ends])
            words = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(taken)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in own), words], [*own, "__found"])

    return find
