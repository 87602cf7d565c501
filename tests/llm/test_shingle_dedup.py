"""The pipeline's near-duplicate stage against all pairs of texts."""

import numpy as np

import corpus_pipeline


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_kept(texts, similarity=0.8):
    sets, kept, seen = [shingles(t) for t in texts], set(), set()
    alike = lambda a, b: a == b or len(a & b) >= similarity * len(a | b)
    for i in range(len(texts)):
        if i in seen:
            continue
        kept.add(i)
        todo = [i]
        seen.add(i)
        while todo:
            a = todo.pop()
            new = {j for j in range(len(texts)) if j not in seen and alike(sets[a], sets[j])}
            seen |= new
            todo += new
    return kept


def test_near_copies_from_080_up(spark):
    rng = np.random.default_rng(11)
    texts, planted = [None, "", "one two", "ONE  two", "one three"], {}
    for n in (100, 400, 2000):
        for share in (0.80, 0.85, 0.9, 0.95, 0.7, 0.5):
            words = [f"w{x}" for x in rng.integers(0, 10**6, n)]
            # r changed words at the end of a text of n words: similarity (n - 4 - r) / (n - 4 + r)
            r = int((n - 4) * (1 - share) / (1 + share))
            texts += [" ".join(words), " ".join(words[: n - r] + [f"x{x}" for x in rng.integers(0, 10**6, r)])]
            planted[len(texts) - 1] = share
    base = [f"b{x}" for x in rng.integers(0, 10**6, 200)]
    texts += [" ".join(base[:k] + ["new"] + base[k + 1 :]) for k in range(0, 200, 2)]
    texts += [" ".join(base[30 * k : 200] + [f"c{k}{j}" for j in range(30 * k)]) for k in range(5)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert {i for i in planted if i not in got} == {i for i, share in planted.items() if share >= 0.8}
    assert got == plain_kept(texts)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_rows_without_or_with_the_same_id(spark):
    rows = [(None, "a b c d e f g"), (None, "q r s t u v w x"), (7, "one text of some words here"), (7, "and another that is unlike it"), (3, "one text of some words here")]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r["doc_id"]), r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == sorted((str(i), t) for i, t in rows if (i, t) != rows[2])
