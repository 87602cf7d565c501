"""The ten operators on small cases, against plain versions."""

import collections
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from docledger.llm import embedding_dedup, html_extraction, language_id, line_dedup, lm_scoring, metric_search, mixing, packing, simhash_dedup, token_counts, tokens
from docledger.llm.common import components

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "This line is long enough to be looked at by the deduplication."
TEXTS = [None, "", " \n", "one", f"{LINE}\nother words here", f"x\n {LINE.upper()} \ny", f"{LINE}\nz", f"{LINE}", f"q\n{LINE}", "the cat sat on the mat " * 30, "the cat sat on the mat " * 30, "le chat est sur la table " * 30, "word  two  spaces <|endoftext|>", "ünïcode — ดี 日本", "a" * 5000]


def docs_of(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "fr" if t and "chat" in t else "en", f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)], DOCS)


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 90), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 90: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op1_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    base = unit(rng.normal(size=(30, 64)))
    x = np.concatenate([base, unit(base[:10] + 0.03 * rng.normal(size=(10, 64))), base[:3], base[:3]]).astype(np.float32)
    rows = [(i, v.tolist(), i % 2 if i < 40 else (i - 40) % 3 % 2) for i, v in enumerate(x)]
    rows += [(100, None, 1), (101, [0.0] * 64, 1), (102, [float("nan")] * 64, 1), (103, [None] * 64, 1), (104, x[0].tolist(), None), (None, x[0].tolist(), 0), (105, [1.0, 2.0], 0), (106, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, block=8).collect()}
    assert len(got) == len(rows)
    s = unit(x.astype(float)) @ unit(x.astype(float)).T
    label = np.array([r[2] for r in rows[: len(x)]])
    link = (s >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    for i in range(len(x)):
        assert got[i]["n_links"] == link[i].sum()
        seen, todo = {i}, [i]
        while todo:
            new = set(np.flatnonzero(link[todo.pop()]).tolist()) - seen
            seen |= new
            todo += new
        assert got[i]["component_id"] == min(seen)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in (100, 101, 102, 103, 104, 105, 106))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("shard_rows", [4096, 20, 3])
def test_op2_against_all_products(spark, shard_rows):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(150, 16)) * rng.uniform(0.1, 2, size=(150, 1))).astype(np.float32)
    x[7] = x[8]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (250, [float("inf")] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in metric_search.top_products(df, F.col("vec_id") % 50 == 0, shard_rows=shard_rows, page_rows=8, query_block=2).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    v = np.floor(256 * x.astype(float)).astype(np.int64)
    want = {q: [(i, int(v[q] @ v[i])) for i in sorted((i for i in range(150) if i != q), key=lambda i: (-int(v[q] @ v[i]), i))[:5]] for q in (0, 50, 100)}
    assert dict(got) == want
    assert metric_search.top_products(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_op3_against_all_pairs(spark):
    texts = [*TEXTS, "the cat sat on the mat " * 29 + "the cat sat on the rug", *[" ".join(f"w{j * (i // 6 + 1)}" for j in range(400)) + " x" * (i % 6) for i in range(24)]]
    got = {r["doc_id"]: r for r in simhash_dedup.near_duplicates(docs_of(spark, texts)).collect()}
    prints = [plain_print(t) for t in texts]
    assert [got[i]["fp"] % (1 << 64) for i in range(len(texts))] == prints
    for i in range(len(texts)):
        seen, todo = {i}, [i]
        while todo:
            a = prints[todo.pop()]
            new = {j for j, b in enumerate(prints) if (a ^ b).bit_count() <= 3} - seen
            seen |= new
            todo += new
        assert got[i]["component_id"] == min(seen)
    assert simhash_dedup.near_duplicates(docs_of(spark).limit(0)).count() == 0


def test_op3_links_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    prints = list(base)
    for x in base:
        for _ in range(12):
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                x = x ^ (np.uint64(1) << np.uint64(b))
            prints.append(x)
    prints = np.unique(np.array(prints, np.uint64).view(np.int64))
    got = {(r["a"], r["b"]) for r in simhash_dedup.linked(spark.createDataFrame([(int(p),) for p in prints], "fp long")).collect()}
    # few other pairs meet: keys are the fingerprints' own
    assert simhash_dedup.keys_of(spark.createDataFrame([(int(p),) for p in prints], "fp long")).groupBy("key").count().where("count > 20").count() == 0
    far = np.bitwise_count((prints[:, None] ^ prints[None, :]).view(np.uint64))
    assert got == {(int(prints[i]), int(prints[j])) for i, j in zip(*np.nonzero(far <= 3), strict=True) if i < j} and len(got) > 500


PAGE = '<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>menu</a></nav><div class="ad">buy, now, please</div><article><h1>A &amp; B</h1><p>First, with   <b>bold</b> text<br>here.<p>Second &eacute; &lt;tag&gt; &am<script>var x="</p>"</script></article><div class="comments"><p>nice, very, nice</p></div><aside>side</aside><footer>&copy; f</footer>'


def test_op4_pages(spark):
    want = "A & B\n\nFirst, with bold text here.\n\nSecond é <tag> &am"
    rows = [(i, f"http://h{i % 2}.example/a", PAGE) for i in range(4)] + [(4, None, PAGE), (5, "http://h0.example/x", None), (6, "nonsense", ""), (7, "http://h9.example", "plain  text"), (8, "http://h0.example/y", "<div><p>alone here</p></div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in html_extraction.extract(df).collect()}
    assert all(got[i]["text"] == want for i in range(5)) and got[5]["text"] == got[6]["text"] == ""
    assert got[7]["text"] == "plain text" and got[8]["text"] == "alone here" and got[0]["n_chars"] == len(want)
    assert html_extraction.extract(df.limit(0)).count() == 0


def test_op5_round_trip(spark):
    from tokenizers import Tokenizer

    docs = docs_of(spark, [*TEXTS, "lorem ipsum dolor " * 1500])
    got = packing.pack(docs, BPE, with_ids=True, group_rows=8).collect()
    whole, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        whole[r["doc_id"]].append((r["start"], bytes(r["ids"])))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and r["length"] == len(r["ids"]) // 4
    t = Tokenizer.from_file(BPE)
    for i, text in enumerate([*TEXTS, "lorem ipsum dolor " * 1500]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert np.frombuffer(b"".join(b for _, b in sorted(whole[i])), "<u4").tolist() == ids
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_best_fit_keeps_every_constraint():
    lengths = np.sort(np.random.default_rng(2).integers(1, 100, 400))[::-1]
    for rule in ("norm", "dot"):
        bins, _ = packing.best_fit(lengths, 100, 3, 12000.0, rule)
        for b in set(bins.tolist()):
            mine = lengths[bins == b]
            assert mine.sum() <= 100 and len(mine) <= 3 and (mine**2).sum() <= 12000


def test_op6_lines(spark):
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs_of(spark).withColumn("n_lines", F.lit("clash"))).collect()}
    holders = [i for i, t in enumerate(TEXTS) if t and LINE.lower() in t.lower()]
    assert len(holders) == 5 and len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (x.strip(" ").lower() == LINE.lower() and i != max(holders))]
        assert (got[i]["text"], got[i]["n_lines"], got[i]["n_dropped"]) == ("\n".join(kept), len(lines), len(lines) - len(kept))
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]
    assert line_dedup.dedup_lines(docs_of(spark).limit(0)).count() == 0


def test_op7_targets(spark):
    texts = ["w " * n for n in (100, 7, 3, 50, 9, 1, 400, 20, 2, 30)] + [None, ""]
    got = mixing.mix(docs_of(spark, texts)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert r["size"] == len((r["text"] or "").split()) and r["taken"] <= 3 * r["size"]
    assert sum(v[0]["target"] for v in by.values()) == pytest.approx(sum(r["size"] for r in got))
    for rows in by.values():
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 1 and rows[0]["target"] <= 3 * rows[0]["source_size"] + 1e-9
    again = mixing.mix(docs_of(spark, texts).repartition(3)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)
    assert mixing.mix(docs_of(spark).limit(0)).count() == 0


def plain_ctw(train, text, depth):
    """Bits of a text by recursive context-tree weighting over counts of the training texts."""
    counts = collections.defaultdict(lambda: [0, 0])
    norm = lambda t: lm_scoring.normalised(t) + b"\n"
    for t in train:
        x = b"\n" * depth + norm(t)
        for i in range(depth, len(x)):
            for k in range(8):
                for d in range(depth + 1):
                    counts[x[i - d : i], (1 << k) | (x[i] >> (8 - k))][x[i] >> (7 - k) & 1] += 1
    children = collections.defaultdict(set)
    for c, j in list(counts):
        if c:
            children[c[1:], j].add(c)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    memo = {}

    def weighted(c, j):
        if (c, j) not in memo:
            e = kt(*counts[c, j])
            memo[c, j] = (e, 1.0) if len(c) == depth else (lambda t: (t, math.exp(e - math.log(2) - t)))(np.logaddexp(e, sum(weighted(k, j)[0] for k in children[c, j])) - math.log(2))
        return memo[c, j]

    total, x = 0.0, b"\n" * depth + norm(text)
    for i in range(depth, len(x)):
        for k in range(8):
            j, bit, mass, p, last = (1 << k) | (x[i] >> (8 - k)), x[i] >> (7 - k) & 1, 1.0, 0.0, 0.5
            for d in range(depth + 1):
                c = x[i - d : i]
                if (c, j) not in counts:
                    break
                a = counts[c, j]
                last, stop = (a[bit] + 0.5) / (sum(a) + 1), weighted(c, j)[1]
                p, mass = p + mass * stop * last, mass * (1 - stop)
            total += math.log10(p + mass * last)
    return total


@pytest.mark.parametrize(("depth", "block_bytes", "part_bytes"), [(3, 16 << 20, 8 << 20), (3, 20, 10), (7, 16 << 20, 8 << 20), (5, 7, 30)])
def test_op8_against_plain_weighting(spark, depth, block_bytes, part_bytes):
    texts = ["the cat", "The dog sat", None, "a cat sat on the dog", "zebra ☃", "the the the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_scoring.score_documents(docs, F.col("doc_id") < 4, depth=depth, block_bytes=block_bytes, part_bytes=part_bytes).collect()}
    train = collections.Counter(w for t in texts[:4] for w in [*(t or "").lower().split(), "\n"])
    n, v = sum(train.values()), len(train)
    for i, t in enumerate(texts):
        words = [*(t or "").lower().split(), "\n"]
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words))
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(words), sum(train[w] > 0 for w in words), n)
        assert got[i]["score"] == pytest.approx(plain_ctw(texts[:4], t, depth), rel=1e-4)
    assert lm_scoring.score_documents(docs.limit(0), F.lit(True)).count() == 0
    assert lm_scoring.score_documents(docs.limit(1), F.lit(False)).first()["score"] == pytest.approx(8 * 8 * math.log10(0.5))


def test_op9_probabilities_and_cases(spark):
    rng = np.random.default_rng(3)
    words = {"en": ["the", "of", "and", "house", "with", "they"], "de": ["der", "und", "nicht", "haus", "mit", "sie"]}
    rows = [(i, " ".join(rng.choice(words[k], 40)), k) for i, k in enumerate(["en", "de"] * 40)]
    rows += [(200, None, "en"), (201, "123 !!", "de"), (202, "der und nicht", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(docs, F.col("doc_id") % 3 != 1).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows[:80]) and got[202]["lang_pred"] == "de"
    assert got[200]["lang_pred"] == got[201]["lang_pred"] == "und" and got[200]["score"] == 0.0
    assert language_id.drop_rejected(docs, F.col("doc_id") % 3 != 1).where("doc_id < 80").count() == 80
    assert language_id.identify(docs, F.lit(False)).select("lang_pred").distinct().collect()[0][0] == "und"
    grams = np.array([[97, 98, 99, 100], [97, 98, 99, 101], [98, 98, 99, 100]], np.uint32)
    model = language_id.fit(grams, np.zeros(3, int), np.array([3, 1, 2]), 1)
    every = np.array([[97, 98, 99, c] for c in (97, 98, 99, 100, 101)], np.uint32)
    rest = np.exp(language_id.log_probabilities(model, np.array([[97, 98, 99, 5]], np.uint32)))[0, 0]
    assert np.exp(language_id.log_probabilities(model, every)).sum() + rest == pytest.approx(1.0)


def test_op10_batches(spark, tmp_path):
    docs = docs_of(spark)
    counts = token_counts.counted(docs, BPE, "v1")
    roll = token_counts.TokenRollup(spark, str(tmp_path / "roll"))
    assert roll.totals().count() == 0
    assert roll.commit(1, token_counts.inserts(counts)) and not roll.commit(1, token_counts.inserts(counts))
    roll.commit(2, token_counts.deletes(counts.where("doc_id = 9")))
    roll.commit(3, token_counts.revisions(counts.where("doc_id = 10"), counts.where("doc_id = 10").withColumns({"tokens": F.lit(5).cast("long"), "version": F.lit("v2")})))
    enc = tokens.PieceEncoder(BPE)
    n = [len(x) // 4 for x in enc.whole([t or "" for t in TEXTS])]

    def check():
        got = roll.totals().collect()
        assert sum(r["documents"] for r in got) == len(TEXTS) - 1
        assert sum(r["tokens"] for r in got if r["version"] == "v1") == sum(n) - n[9] - n[10] and [r["tokens"] for r in got if r["version"] == "v2"] == [5]

    check()
    assert roll.compact() == {1, 2, 3}
    check()
    assert not roll.commit(2, token_counts.inserts(counts))
    roll.commit(4, token_counts.inserts(counts.limit(0)))
    check()


def test_op10_batches_in_any_order(spark, tmp_path):
    counts = token_counts.counted(docs_of(spark), BPE, "v1")
    roll = token_counts.TokenRollup(spark, str(tmp_path / "roll"))
    documents = lambda: sum(r["documents"] for r in roll.totals().collect())
    assert roll.commit(1, token_counts.inserts(counts)) and roll.commit(3, token_counts.inserts(counts)) and roll.compact() == {1, 3}
    assert roll.commit(2, token_counts.inserts(counts)) and documents() == 3 * len(TEXTS)
    assert not roll.commit(2, token_counts.inserts(counts)) and not roll.commit(3, token_counts.inserts(counts))
    assert roll.compact() == {1, 2, 3} == roll.compact() and documents() == 3 * len(TEXTS)
    assert roll.commit(0, token_counts.deletes(counts)) and documents() == 2 * len(TEXTS)


def test_pieces_give_the_tokenizer_s_ids():
    enc = tokens.PieceEncoder(BPE)
    texts = ["", "a  b", " x", " \nfoo", "x\n\n y", "don't  go", "it's a b", "a <|endoftext|> b", "é 日本\t z ", "\n", "tab\t x", *[t for t in TEXTS if t]]
    assert enc.encode(texts) == enc.whole(texts)


def test_op1_vec_ids_with_several_vectors(spark):
    from docledger.llm.embedding_dedup import near_duplicates

    a, b = [1.0] + [0.0] * 15, [0.0, 1.0] + [0.0] * 14
    near = lambda v: [x + 0.01 for x in v]
    rows = [(1, a), (1, b), (2, a), (5, b), (3, near(a)), (4, near(b)), (4, near(b)), (9, [0.0] * 15 + [1.0])]
    frame = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in near_duplicates(frame).collect()]
    assert sorted(got) == sorted([(1, 2, 1), (2, 2, 1), (3, 2, 1), (1, 3, 1), (5, 3, 1), (4, 3, 1), (4, 3, 1), (9, 0, 9)])
