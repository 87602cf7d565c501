"""The registered queries against their SQL, or a plain version, on the smallest tables and on small ones with the hard cases."""

import collections
import hashlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from docledger.llm import language_id, packing
from docledger.llm.queries import ORACLE_SQL, QUERIES

WHERE = "/root/testdata/sf0.001"
LINE = "A line that is long enough to be looked at by the deduplication, word for word."


def written(path, frames):
    for name, frame in frames.items():
        duckdb.sql("SELECT * FROM frame").write_parquet(f"{path}/{name}.parquet")
    return str(path)


def hard_documents():
    """Repeated rows, null ids, empty and very long texts, shared lines, a clashing column."""
    texts = [None, "", " \n", LINE, f"x\n{LINE}", f" {LINE.upper()}\ny", f"{LINE}\n{LINE}", f"z\n{LINE}\nz", "the cat sat on the mat " * 40_000, "the cat sat on the mat " * 40_000, "short"]
    rows = [(i, t, "en", [None, "b", "a"][i % 3], 0) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[4], (None, f"{LINE}\nnull id", None, None, 0), (None, f"{LINE}\nnull id", None, None, 0), (4, f"another text\n{LINE}", "en", "a", 1)]
    # a line in three rows of one document and in two others: three documents, so it stays
    few = LINE.replace("A line", "Another")
    rows += [(50, few, "en", "a", 0)] * 3 + [(51, few, "en", "a", 0), (52, few, "en", "a", 0)]
    return pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_lines"]).astype({"doc_id": "Int64"})


def hard_vectors():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 16))
    x = np.concatenate([x, x[:10] + 0.05 * rng.normal(size=(10, 16)), x[:3]]).astype(np.float32)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    rows += [(100, None, 1), (150, [0.0] * 16, 1), (102, [float("nan")] * 16, 1), (200, [None] * 16, 1), (104, x[0].tolist(), None), (None, x[0].tolist(), 0)]
    return pd.DataFrame(rows, columns=["vec_id", "embedding", "label"]).astype({"vec_id": "Int64", "label": "Int64"})


def plain(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("null" if v is None or v is pd.NA or v != v else str(round(float(v), 6)) if isinstance(v, float | int | np.number) and not isinstance(v, bool | np.bool_) else str(v) for v in row) for row in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def hard(tmp_path_factory):
    return written(tmp_path_factory.mktemp("hard"), {"documents": hard_documents(), "embeddings": hard_vectors()})


@pytest.fixture(scope="module")
def empty(tmp_path_factory, spark):
    path = tmp_path_factory.mktemp("empty")
    for name in ("documents", "embeddings", "pages"):
        spark.read.parquet(f"{WHERE}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("where", ["given", "hard"])
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_sql(spark, hard, name, where):
    folder = WHERE if where == "given" else hard
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    assert plain(QUERIES[name](spark, folder).toPandas()) == plain(con.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op4_html_extraction"}))
def test_query_runs_on_hard_rows(spark, hard, name):
    rows = QUERIES[name](spark, hard).collect()
    of = {"op1_embedding_dedup": len(hard_vectors()), "op2_mtree_topk": 15, "op10_token_counts": None, "op5_best_fit_packing": None}.get(name, len(hard_documents()))
    assert of is None or len(rows) == of


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_on_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_copies_of_rows_are_alike(spark, hard):
    by = collections.defaultdict(set)
    for r in QUERIES["op3_simhash"](spark, hard).collect():
        by[r["fingerprint"]].add(r["component_id"])
    assert all(len(v) == 1 for v in by.values())
    lines = [(r["doc_id"], r["kept_sha256"]) for r in QUERIES["op6_line_dedup"](spark, hard).collect() if r["doc_id"] == 50]
    assert lines == [(50, hashlib.sha256(LINE.replace("A line", "Another").encode()).hexdigest())] * 3


# --- op1: recall at the threshold ---------------------------------------------------------------------------------------
@pytest.mark.parametrize(("width", "least"), [(64, 0.999), (256, 0.995), (768, 0.99)])
def test_op1_buckets_meet_at_the_threshold(width, least):
    from docledger.llm.embedding_dedup import polytope_codes

    rng = np.random.default_rng(width)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    a, b = unit(rng.normal(size=(1000, width))), rng.normal(size=(1000, width))
    b = unit(b - (a * b).sum(1)[:, None] * a)
    c = 0.93 * a + np.sqrt(1 - 0.93**2) * b
    x, y = polytope_codes(a, 5, 4), polytope_codes(c, 5, 4)
    met = (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3))
    assert met.mean() >= least


# --- op5: plain best fit and the number of sequences ----------------------------------------------------------------------
def plain_best_fit(lengths, tokens):
    """Best fit by residual tokens, the first opened of equal bins."""
    bins, rooms = [], []
    for n in lengths:
        fits = [(room - n, i) for i, room in enumerate(rooms) if room >= n]
        at = min(fits)[1] if fits else len(rooms)
        if not fits:
            rooms.append(tokens)
        rooms[at] -= n
        bins.append(at)
    return bins, len(rooms)


def test_op5_packs_as_plain_best_fit():
    lengths = np.sort(np.random.default_rng(4).integers(1, 1024, 600))[::-1]
    bins, offsets = packing.best_fit(lengths, 1024, 1024, 1024.0**2, weights=(1.0, 0.0, 0.0))
    want, count = plain_best_fit(lengths.tolist(), 1024)
    assert len(set(bins.tolist())) == count
    assert collections.Counter(np.bincount(bins, lengths).tolist()) == collections.Counter(np.bincount(want, lengths).tolist())
    weighted, _ = packing.best_fit(lengths, 1024, 1024, 1024.0**2)
    assert len(set(weighted.tolist())) <= 1.01 * count


def test_op5_query_needs_few_sequences(spark):
    rows = QUERIES["op5_best_fit_packing"](spark, WHERE).collect()
    total, used = sum(r["length"] for r in rows), {r["sequence_id"] for r in rows}
    assert len(used) <= 1.02 * -(-total // 1024) + 1
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for mine in places.values():
        ends = 0
        for offset, length in sorted(mine):
            assert offset == ends
            ends += length
        assert ends <= 1024


# --- op9: plain interpolated Kneser-Ney -----------------------------------------------------------------------------------
def plain_kneser_ney(counts, alphabet):
    """Probability of the last character after the others, by counts of 4-character windows of one language."""
    tables = {4: collections.Counter(counts)}
    for k in (3, 2, 1):
        tables[k] = collections.Counter(g[1:] for g in tables[k + 1])
    discount = {}
    for k, table in tables.items():
        ones, twos = sum(v == 1 for v in table.values()), sum(v == 2 for v in table.values())
        discount[k] = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.9)

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / (alphabet + 1)
        same = {g: n for g, n in tables[k].items() if g[:-1] == gram[:-1]}
        if not same:
            return p(gram[1:])
        total = sum(same.values())
        return max(same.get(gram, 0) - discount[k], 0) / total + discount[k] * len(same) / total * p(gram[1:])

    return p


def test_op9_model_is_plain_kneser_ney():
    rng = np.random.default_rng(6)
    texts = {0: "".join(rng.choice(list("abcd "), 400)), 1: "".join(rng.choice(list("bcde "), 300))}
    counts = {k: collections.Counter(tuple(map(ord, t[i : i + 4])) for i in range(len(t) - 3)) for k, t in texts.items()}
    grams = np.array([g for c in counts.values() for g in c], np.uint32)
    model = language_id.fit(grams, np.repeat([0, 1], [len(counts[0]), len(counts[1])]), np.array([n for c in counts.values() for n in c.values()]), 2)
    asked = np.array([[ord(x) for x in "".join(rng.choice(list("abcdef "), 4))] for _ in range(200)], np.uint32)
    got = np.exp(language_id.log_probabilities(model, asked))
    for k in (0, 1):
        p = plain_kneser_ney(counts[k], len(set(grams.ravel().tolist())))
        assert got[:, k] == pytest.approx([p(tuple(g)) for g in asked.tolist()], rel=1e-4)


def test_op9_ties_go_to_the_first_language():
    grams = np.array([[97, 98, 99, 100], [98, 99, 100, 101]], np.uint32)
    model = language_id.fit(np.concatenate([grams, grams]), np.array([0, 0, 1, 1]), np.array([2, 1, 2, 1]), 2)
    entropy, _, _ = language_id.entropies(model, ["abcd", "bcde", "zz"])
    assert (entropy[:, 0] == entropy[:, 1]).all() and entropy.argmin(axis=1).tolist() == [0, 0, 0]
