"""Language identification by interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

A text is lower-cased, every run of other characters than letters becomes one space, and each character is predicted from the three
before it. The models are fitted on whole labelled documents, drawn by a hash of doc_id so that each language gives about
``sample_chars`` characters (all, if it has fewer); four in five of the drawn documents are counted, the fifth calibrates. The
orders' tables hold, under the sorted 64-bit hashes of the grams that any language knows, the log-probability in every language;
a gram that none knows backs off by its contexts' weights. The language of the least cross-entropy per character is chosen. A text
is rejected if its cross-entropy lies more than ``spread`` calibrated deviations (one part per document, one that shrinks with the
text's length) above what the calibration documents of that language have.

Defined results: null text and text without letters give ``und``, score 0, rejected; without any labelled document all are ``und``;
rows with null lang or text teach nothing; repeated rows are predicted each; of equal entropies the first language by name wins;
score is the chosen language's share, 0 to 1. Columns named lang_pred, score, rejected and entropy are replaced by ``identify``, other
columns kept. Texts of any length are read whole. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, find, mixed, strings, table
from .tokens import in_parts

ORDER, BASE = 4, np.uint64(0x9E3779B97F4A7C15)
PART_CHARS = 1 << 18  # characters in work at once
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def symbols(texts) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each after ORDER - 1 spaces, and the text of each (-1 for those leading spaces)."""
    parts, owner = [], []
    for i, text in enumerate(texts):
        x = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        x = np.where(letter_table()[x], x, np.uint32(32))
        x = x[(x != 32) | np.r_[False, x[:-1] != 32]] if len(x) else x
        parts += [np.full(ORDER - 1, 32, np.uint32), x]
        owner += [np.full(ORDER - 1, -1), np.full(len(x), i)]
    if not parts:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(owner)


def windows(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ORDER code points that end at each place."""
    return np.stack([x[at - k] for k in range(ORDER - 1, -1, -1)], axis=1)


def gram_hash(grams: np.ndarray) -> np.ndarray:
    """Hash of each row of code points; rows of other lengths hash apart."""
    h = np.full(len(grams), np.uint64(grams.shape[1]))
    with np.errstate(over="ignore"):
        for k in range(grams.shape[1]):
            h = h * BASE + grams[:, k].astype(np.uint64) + np.uint64(1)
    return mixed(h)


def distinct_grams(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the gram that ends at each place, and where each distinct gram is first."""
    import pandas as pd

    code = np.zeros(len(x), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ORDER):
            code[ORDER - 1 :] = code[ORDER - 1 :] * BASE + x[k : len(x) - ORDER + 1 + k].astype(np.uint64) + np.uint64(1)
    places, distinct = pd.factorize(code[at])
    first = np.zeros(len(distinct), np.int64)
    first[places[::-1]] = at[::-1]
    return places, first


def gram_counts(frames):
    """Per task: (lang, gram, n)."""
    import pandas as pd

    for frame in frames:
        for lang, part in frame.groupby("lang"):
            texts = strings(part["text"])
            for a, b in in_parts(texts, PART_CHARS):
                x, owner = symbols(texts[a:b])
                at = np.flatnonzero(owner >= 0)
                if len(at):
                    places, first = distinct_grams(x, at)
                    yield pd.DataFrame({"lang": lang, "gram": [g.tobytes() for g in windows(x, first)], "n": np.bincount(places)})


def columns_of(counts, at: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams, numbers of the languages and counts of an Arrow table, without an object for each row."""
    gram, lang = counts["gram"].combine_chunks(), counts["lang"].combine_chunks().dictionary_encode()
    grams = np.frombuffer(gram.buffers()[2] or b"", np.uint32, ORDER * len(gram), 4 * ORDER * gram.offset).reshape(-1, ORDER)
    known = np.array([at[k] for k in lang.dictionary.to_pylist()], np.int64)
    return grams, known[lang.indices.to_numpy()] if len(gram) else np.zeros(0, np.int64), counts["n"].to_numpy()


def fit(grams: np.ndarray, lang: np.ndarray, n: np.ndarray, languages: int) -> dict:
    """Tables of every order: sorted gram hashes with log-probabilities, and sorted context hashes with log backoff weights."""
    alphabet = max(1, len(np.unique(grams)))
    floor = np.log(1.0 / (alphabet + 1))
    model, below = {"floor": np.full(languages, floor)}, None
    rows, who, count = {ORDER: grams}, {ORDER: lang}, {ORDER: n.astype(float)}
    for k in range(ORDER - 1, 0, -1):  # distinct left neighbours in place of counts
        packed = np.c_[who[k + 1].astype(np.uint32), rows[k + 1][:, 1:]]
        distinct, number = np.unique(packed, axis=0, return_counts=True)
        rows[k], who[k], count[k] = distinct[:, 1:], distinct[:, 0].astype(np.int64), number.astype(float)
    for k in range(1, ORDER + 1):
        keys = gram_hash(rows[k])
        union = np.unique(keys)
        context = gram_hash(rows[k][:, :-1]) if k > 1 else np.zeros(len(keys), np.uint64)
        contexts = np.unique(context)
        place = np.searchsorted(contexts, context)
        total, kinds = np.zeros((len(contexts), languages)), np.zeros((len(contexts), languages))
        np.add.at(total, (place, who[k]), count[k])
        np.add.at(kinds, (place, who[k]), 1)
        ones, twos = (np.bincount(who[k], count[k] == v, languages) for v in (1, 2))
        discount = np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.1, 0.9)
        backoff = np.where(total > 0, np.log(np.maximum(discount * kinds, 1e-300) / np.maximum(total, 1)), 0.0)
        first = np.zeros(len(union), np.int64)
        first[np.searchsorted(union, keys)] = np.arange(len(keys))
        whole = rows[k][first]
        lower = np.tile(model["floor"], (len(union), 1)) if below is None else below[1][np.searchsorted(below[0], gram_hash(whole[:, 1:]))]
        own_context = np.searchsorted(contexts, gram_hash(whole[:, :-1]) if k > 1 else np.zeros(len(union), np.uint64))
        direct = np.zeros((len(union), languages))
        np.add.at(direct, (np.searchsorted(union, keys), who[k]), np.maximum(count[k] - discount[who[k]], 0) / np.maximum(total[place, who[k]], 1))
        value = np.log(np.exp(backoff[own_context] + lower) + direct)
        below = (union, value)
        model[k] = (union, value.astype(np.float32), contexts, backoff.astype(np.float32))
    return model


def log_probabilities(model: dict, grams: np.ndarray) -> np.ndarray:
    """(rows, languages) for rows of ORDER code points."""
    languages = len(model["floor"])
    out, weight = np.zeros((len(grams), languages)), np.zeros((len(grams), languages))
    todo = np.arange(len(grams))
    for k in range(ORDER, 0, -1):
        keys, value, contexts, backoff = model[k]
        part = grams[todo, ORDER - k :]
        at, there = find(keys, gram_hash(part))
        out[todo[there]] = weight[todo[there]] + value[at[there]]
        todo, part = todo[~there], part[~there]
        if not len(todo):
            return out
        at, known = find(contexts, gram_hash(part[:, :-1]) if k > 1 else np.zeros(len(todo), np.uint64))
        weight[todo[known]] += backoff[at[known]]
    out[todo] = weight[todo] + model["floor"]
    return out


def entropies(model: dict, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cross-entropy per character of each text in each language, its number of characters, and whether it has a letter."""
    x, owner = symbols(texts)
    at = np.flatnonzero(owner >= 0)
    n = np.bincount(owner[at], minlength=len(texts))
    letters = np.bincount(owner[at], x[at] != 32, len(texts)) > 0
    total = np.zeros((len(texts), len(model["floor"])))
    if len(at):
        places, first = distinct_grams(x, at)
        value = log_probabilities(model, windows(x, first))
        for j in range(value.shape[1]):
            total[:, j] = np.bincount(owner[at], value[places, j], len(texts))
    return -total / np.maximum(n, 1)[:, None], n, letters


def predictor(model, names: list[str], limits, spread: float):
    """Vectorised: a text's (lang_pred, score, rejected, entropy). Only texts reach Python, a bounded part of a batch at a time."""
    import pandas as pd

    bounds = np.array([limits.get(i, (np.inf, 0, 0)) for i in range(len(names))])

    @F.pandas_udf("lang_pred string, score double, rejected boolean, entropy double")
    def predict(column):
        texts, out = strings(column), []
        for a, b in in_parts(texts, PART_CHARS):
            h, n, letters = entropies(model.value, texts[a:b])
            best = h.argmin(axis=1)
            low = h[np.arange(b - a), best]
            share = 1 / np.exp(-np.minimum(n, 100)[:, None] * (h - low[:, None])).sum(axis=1)
            mean, document, character = bounds[best].T
            over = low > mean + spread * (document + character / np.sqrt(np.maximum(n, 1)))
            out.append(pd.DataFrame({"lang_pred": np.where(letters, np.array(names, object)[best], "und"), "score": np.where(letters, share, 0.0), "rejected": over | ~letters, "entropy": low}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"lang_pred": np.array([], object), "score": np.zeros(0), "rejected": np.zeros(0, bool), "entropy": np.zeros(0)})

    return predict


def fit_models(docs: DataFrame, learn: Column, sample_chars: int, spread: float):
    """Broadcast model, language names and calibrated limits; None without labelled documents."""
    sc = docs.sparkSession.sparkContext
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.sum(F.char_length("text")).alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return None
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, sample_chars / max(1, sizes[k])))) for k in names))
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20))
    drawn = durable(labelled.where(place < share * (1 << 20)).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(5))))
    held = [r["lang"] for r in drawn.where("fold > 0").select("lang").distinct().collect()]
    counted = drawn.where(F.col("fold") > 0) if len(held) == len(names) else drawn
    counts = counted.select("lang", "text").mapInPandas(gram_counts, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    at = {k: i for i, k in enumerate(names)}
    model = sc.broadcast(fit(*columns_of(counts, at), len(names)))
    del counts

    def own(frames):
        import pandas as pd

        for frame in frames:
            texts = strings(frame["text"])
            for a, b in in_parts(texts, PART_CHARS):
                h, n, letters = entropies(model.value, texts[a:b])
                lang = frame["lang"].iloc[a:b].map(at).to_numpy()
                yield pd.DataFrame({"lang": lang[letters], "h": h[np.arange(b - a), lang][letters], "n": n[letters]})

    tests = drawn.where(F.col("fold") == 0) if len(held) == len(names) else drawn
    scores = tests.select("lang", "text").mapInPandas(own, "lang int, h double, n long")
    facts = scores.groupBy("lang").agg(F.sum(F.col("h") * F.col("n")).alias("hn"), F.sum("n").alias("n"), F.coalesce(F.stddev("h"), F.lit(0.0)).alias("sd")).collect()
    # a character's cross-entropy deviates by about its mean, so a text's by that over the root of its length
    limits = {r["lang"]: (r["hn"] / r["n"], max(r["sd"], 0.02 * r["hn"] / r["n"]), r["hn"] / r["n"]) for r in facts}
    return model, names, limits


def identify(docs: DataFrame, learn: Column, sample_chars: int = 4_000_000, spread: float = 6.0) -> DataFrame:
    """Rows of ``docs`` with lang_pred, score, rejected and entropy (columns of these names are replaced).

    ``learn`` tells the rows that may teach; docs has doc_id, lang and text.
    """
    results = ("lang_pred", "score", "rejected", "entropy")
    fitted = fit_models(docs, F.coalesce(learn, F.lit(False)), sample_chars, spread)
    kept = docs.drop(*results)
    if fitted is None:
        return kept.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "rejected": F.lit(True), "entropy": F.lit(0.0)})
    predict = predictor(*fitted, spread)
    return kept.withColumn("__found", predict("text")).select(*(F.col(f"`{c}`") for c in kept.columns), *(F.col(f"__found.{c}") for c in results))


def drop_rejected(docs: DataFrame, learn: Column, sample_chars: int = 4_000_000, spread: float = 6.0) -> DataFrame:
    """The rows of ``docs`` whose language is told, unchanged."""
    fitted = fit_models(docs, F.coalesce(learn, F.lit(False)), sample_chars, spread)
    return docs.where(F.lit(False)) if fitted is None else docs.where(~predictor(*fitted, spread)(F.col("text"))["rejected"])


def teaches() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return identify(docs, teaches()).select("doc_id", F.coalesce(~teaches(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected", "entropy")
