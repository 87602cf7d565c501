"""The pipeline's stages on a small corpus with planted cases."""

import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(5)
    words = {"en": ["the", "of", "and", "house", "with", "they", "when"], "de": ["der", "und", "nicht", "haus", "mit", "sie", "wenn"]}
    line = "A passage that many of the documents share with each other, word for word."
    rows = [(i, " ".join(rng.choice(words[k], 60)) + f" {i}\n{line}" * (i % 4 == 0), k, f"s{i % 3}", 0) for i, k in enumerate(["en", "de"] * 30)]
    rows += [(100, rows[1][1], "de", "s0", 0), (101, None, "en", "s1", 0), (102, "12 34", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names, ids = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == names or k == 4, name
        ids.append({r["doc_id"] for r in docs.collect()})
        if k == 1:
            assert docs.where(docs.text.contains(line)).count() == 1
    assert {101, 102}.isdisjoint(ids[0]) and set(range(60)) <= ids[0]
    assert 100 not in ids[2] and set(range(60)) - ids[2] == set()
    packed = docs.groupBy("sequence_id").sum("length").collect()
    assert max(r["sum(length)"] for r in packed) <= 1024


def plain_lines(docs, least_chars=40, least_docs=5):
    holders = collections.defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").lower()
    for i, text, _ in docs:
        for line in text.split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(i)
    lost = {k: max(v) for k, v in holders.items() if len(v) >= least_docs}
    return [(i, "\n".join(x for x in text.split("\n") if lost.get(key(x), i) == i), source) for i, text, source in docs]


def plain_near(docs, words=5, similarity=0.8):
    def shingles(text):
        w = text.lower().split()
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets, root = [shingles(t) for _, t, _ in docs], list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    keep = {r: min(docs[i][0] for i in range(len(docs)) if root[i] == r) for r in set(root)}
    return [d for i, d in enumerate(docs) if keep[root[i]] == d[0]]


def plain_mix(docs, weights=(5, 2, 1), epochs=3):
    sizes = collections.Counter()
    for _, text, source in docs:
        sizes[source] += len(text.split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = set()
    while True:
        level = (sum(sizes.values()) - sum(epochs * sizes[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if weight[s] * level > epochs * sizes[s]} | capped
        if over == capped:
            break
        capped = over
    out = []
    for s in names:
        aim = round(min(epochs * sizes[s], weight[s] * level))
        whole, rest = divmod(aim, sizes[s])
        for i, text, source in sorted((d for d in docs if d[2] == s), key=lambda d: hashlib.md5(f"mix-1:{d[0]}".encode()).hexdigest()):
            n = len(text.split())
            taken, rest = whole * n + max(0, min(n, rest)), rest - n
            out += [(i, text, source)] * int(np.floor(taken / max(n, 1) + 0.5))
    return out


def test_run_against_a_plain_version(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(12)
    words = {"en": ["the", "of", "and", "house", "with", "they", "when", "there"], "de": ["der", "und", "nicht", "haus", "mit", "sie", "wenn", "dort"]}
    line = "A passage that many of the documents share with each other, word for word."
    rows = [(i, " ".join(rng.choice(words[k], 80)) + f" {i} {i * 7}\n{line}" * (i % 3 == 0) + " end" * (i % 5), k, [None, "a", "b", "c"][i % 4], 0) for i, k in enumerate(["en", "de"] * 20)]
    rows += [(100 + i, rows[i][1].replace(" house ", " home ", 1), rows[i][2], "a", 0) for i in range(6)] + [(200, rows[1][1], "de", "b", 0), (201, None, "en", "a", 0), (202, "12 34", "de", "a", 0), (203, " ".join(rng.choice(words["en"], 3000)), "en", "c", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs = [(r[0], r[1], r[3]) for r in rows if r[0] not in (201, 202)]
    left = plain_mix(plain_near(plain_lines(docs)))
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for i, text, _ in left:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        for piece, (a, b) in enumerate(zip([0, *range(first, len(ids), 1024)], [*range(first, len(ids), 1024), len(ids)], strict=True)):
            want.append((i, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    places = collections.defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for mine in places.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(mine), [*sorted(mine)[1:], (sum(n for _, n in mine), 0)], strict=True)) and sum(n for _, n in mine) <= 1024
    assert len(places) <= -(-sum(r["length"] for r in got) // 1024) + 1


def test_stages_on_hard_rows_and_empty_tables(spark, tmp_path):
    rows = [(1, "one text of some words here and there", None, None, None, "x"), (1, "one text of some words here and there", "en", None, 3, "x"), (None, "another text with no id at all in it", "en", "a", 0, "y"), (None, "a third text of quite other words, so it stays", "en", "a", 0, None), (2, "", "en", "a", 0, "z")]
    rows += [(10 + i, f"the house of the {i} and the garden " * 9, "en", "a", 0, "q") for i in range(12)]
    docs = spark.createDataFrame([(*r, r[5]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, taken string, n_lines string")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), "").count() == 0
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == names and {(r["taken"], r["n_lines"]) for r in docs.collect()} <= {(r[5], r[5]) for r in rows}
        if k == 2:
            assert sum(r["doc_id"] == 1 for r in docs.collect()) == 1 and sum(r["doc_id"] is None for r in docs.collect()) == 2
    assert docs.count() > 0
