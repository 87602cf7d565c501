"""op11 against a plain version: both libraries, every group and every link."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from docledger.llm import token_alignment as A
from docledger.llm.queries import QUERIES

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WHERE = "/root/testdata/sf0.001"
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1]), A.byte_tokens(PATHS[0]), A.piece_tokens(PATHS[1])


def plain_groups(libraries, text):
    """[(ids of A, ids of B)] of a text, empty where bytes differ."""
    one, two, bytes_a, bytes_b = libraries
    if not text:
        return []
    a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
    if not (b"".join(bytes_a[i] for i in a) == b"".join(bytes_b[i] for i in b) == (" " + text).encode()):
        return []
    ends = []
    for ids, table in ((a, bytes_a), (b, bytes_b)):
        at, mine = 0, []
        for i in ids:
            at += len(table[i])
            mine.append(at)
        ends.append(mine)
    shared = sorted(set(ends[0]) & set(ends[1]))
    groups, before = [], 0
    for end in shared:
        groups.append(tuple([i for i, e in zip(ids, mine, strict=True) if before < e <= end] for ids, mine in zip((a, b), ends, strict=True)))
        before = end
    return groups


def plain_rows(libraries, docs):
    every = [(i, plain_groups(libraries, t)) for i, t in docs]
    links = [[(x, y) for a, b in groups for x in a for y in b] for _, groups in every]
    held = collections.Counter(p for mine in links for p in set(mine))
    highest = collections.defaultdict(int)
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    for (i, groups), mine in zip(every, links, strict=True):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        yield (
            i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(mine), sum(held[p] == highest[p[0]] for p in mine), sum(held[p] for p in mine),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        )


def hard_texts():
    rng = random.Random(2)
    parts = ["the", " ", "  ", "\n", "é", "日本", "😀", "▁", "<|endoftext|>", "<s>", "\x00", "naïve", "don't", "12345", "...", "ﷺ", "onthe", "ing"]
    return [None, "", " ", "\n", "▁", "a▁b", "<|endoftext|>", "x" * 5000, " " * 300, "日本語" * 200] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(300)]


@pytest.mark.parametrize("block_chars", [1 << 23, 500])
def test_rows_are_those_of_a_plain_version(spark, libraries, block_chars):
    docs = list(enumerate(hard_texts())) + [(5, "the same row"), (5, "the same row"), (None, "no number"), (None, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], *(r[c] for c in COLUMNS)) for r in A.align(frame, *PATHS, block_chars=block_chars, with_groups=True).collect()]
    assert sorted(got, key=str) == sorted(plain_rows(libraries, docs), key=str)


def test_query_is_the_plain_version(spark, libraries):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{WHERE}/documents.parquet").select("doc_id", "text").collect()]
    got = [(r["doc_id"], *(r[c] for c in COLUMNS)) for r in QUERIES["op11_align_tokens"](spark, WHERE).collect()]
    assert sorted(got, key=str) == sorted(plain_rows(libraries, docs), key=str)


def test_memory_of_windows_may_be_emptied(libraries, monkeypatch):
    texts = [t for t in hard_texts() if t]
    whole = A.Aligner(*PATHS)
    small = A.Aligner(*PATHS)
    monkeypatch.setattr(A, "MEMO_ROWS", 1)
    for t in texts:
        x, y = whole.documents([t]), small.documents([t])
        assert x[0] == y[0] and all((p == q).all() for p, q in zip(x[1], y[1], strict=True))


def test_places_pack():
    import numpy as np

    places, times = np.array([0, 5, 6, 900_000]), np.array([1, 2, 3, 70_000])
    assert [x.tolist() for x in A.unpacked(A.packed(places, times))] == [places.tolist(), times.tolist()]
    assert [x.tolist() for x in A.unpacked(A.packed(places[:0], times[:0]))] == [[], []]


def test_windows_are_told_apart_by_their_ids(monkeypatch):
    import numpy as np

    rng = random.Random(7)
    windows = [tuple(tuple(rng.randrange(3) for _ in range(rng.randint(1, 3))) for _ in "ab") for _ in range(500)]
    sides = [(np.array([x for w in windows for x in w[s]], np.uint32), np.r_[0, np.cumsum([len(w[s]) for w in windows])]) for s in (0, 1)]
    for mix in (A.mixed, lambda x: x & np.uint64(3)):  # the second hashes badly
        monkeypatch.setattr(A, "mixed", mix)
        first, back = A.alike(tuple(sides))
        assert [windows[first[k]] for k in back] == windows
