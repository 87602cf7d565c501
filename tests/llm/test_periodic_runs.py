"""op12 against brute force over every start and period."""

import hashlib
import random
import zlib

import pytest

from docledger.llm import periodic_runs as P
from docledger.llm.queries import QUERIES

WHERE = "/root/testdata/sf0.001"


def plain_runs(words, least=24, times=3):
    """Every maximal stretch of a period whose period is its smallest."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and (i, j + q - i) not in found:
                smaller = next(p for p in range(1, q + 1) if all(words[k] == words[k + p] for k in range(i, j + q - p)))
                if smaller == q:
                    found[i, j + q - i] = q
            i = j
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_lyndon(word):
    """Length of the longest Lyndon word at each place: where the next smaller suffix begins."""
    n = len(word)
    return [next((j for j in range(i + 1, n) if word[j:] < word[i:]), n) - i for i in range(n)]


def some_words(rng):
    """Words with planted repeats of small and large periods, some broken in places."""
    out = []
    for _ in range(rng.randint(1, 6)):
        unit = [rng.choice("abcd") for _ in range(rng.randint(1, 12))]
        out += unit * rng.randint(1, 9) + unit[: rng.randint(0, len(unit))]
        if rng.random() < 0.5:
            out += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 20))]
    return out


def test_grouping_gives_lyndon_arrays():
    rng = random.Random(1)
    for _ in range(400):
        kinds = rng.randint(1, 4)
        word = [rng.randrange(kinds) for _ in range(rng.randint(1, 40))]
        kinds = max(word) + 1
        group, length = P.grouped(word, kinds)
        assert length == plain_lyndon(word)
        roots = [tuple(word[i : i + p]) for i, p in enumerate(length)]
        assert all((group[i] == group[j]) == (roots[i] == roots[j]) for i in range(len(word)) for j in range(len(word)))


@pytest.mark.parametrize(("least", "times"), [(24, 3), (2, 2), (5, 2), (9, 4)])
def test_runs_are_those_of_brute_force(least, times):
    rng = random.Random(least)
    docs = [some_words(rng) for _ in range(300)] + [[], ["a"], ["a"] * 23, ["a"] * 24, ["a"] * 200, ["a", "b"] * 12, ["a", "b", "c"] * 8]
    coded = [[w.encode() for w in d] for d in docs]
    assert P.runs_of_documents(coded, least, times) == [plain_runs(d, least, times) for d in docs]


def test_equal_windows_elsewhere_add_no_runs():
    words = [str(i) for i in range(40)]
    assert P.runs_of_documents([[w.encode() for w in words + ["x"] + words + ["y"] + words]]) == [[]]


def test_long_loops_are_linear():
    words = [b"%d" % (i % 7) for i in range(300_000)]
    assert P.runs_of_documents([words, words[:100]]) == [[(0, 300_000, 7)], [(0, 100, 7)]]


def plain_row(doc_id, text, plant=True):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    h = zlib.crc32(str(doc_id).encode())
    if plant and h % 10 == 0 and words:
        g = h // 10
        a, n = g % len(words), len(words)
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(kept))]
    return (len(runs), *best, best[1] and 1000 * best[1] // best[2], *digests)


def test_query_is_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{WHERE}/documents.parquet").select("doc_id", "text").collect()]
    rows = [r for r in rows if len((r[1] or "").split()) < 400] + [(10_000 + i, " ".join(some_words(rng))) for i in range(60)]
    rows += [(20_000, None), (20_001, ""), (20_002, " \n"), (20_003, "a\x1cb c " * 30), (20_004, "one  \ttwo\r\n" * 13), (20_004, "one  \ttwo\r\n" * 13)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()
    columns = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    mine = sorted(((r["doc_id"], *(r[c] for c in columns)) for r in got), key=str)
    assert mine == sorted(((i, *plain_row(i, t)) for i, t in rows), key=str)
    assert sum(r["n_runs"] > 0 for r in got) > 30


def test_null_ids_plant_nothing(spark):
    docs = spark.createDataFrame([(None, "a " * 30), (None, None)], "doc_id long, text string")
    rows = P.periodic_runs(docs, plant=True).collect()
    assert sorted((len(r["runs"]), r["collapsed"]) for r in rows) == [(0, ""), (1, "a")]
