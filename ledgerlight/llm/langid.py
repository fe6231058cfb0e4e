"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, everything else is one space; n-grams of one to three characters are hashed to DIMS features.
Document frequencies are counted over all training rows; the weights are fitted by follow-the-regularised-leader with L1 and
L2 penalties on a bounded sample of training rows for each language (``sample_per_language``, chosen by hash), whose last
fifth sets the temperature of the probabilities. The fitted model (DIMS rows, mostly zero, one column for each language) is
broadcast; its size depends on the languages alone. Prediction reads whole texts and shuffles nothing.

Null texts and texts without a letter are ``und`` with score 0, and so is everything if there is no training row. Rows keep
null ids; repeated rows are predicted alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import map_texts, small_batches, text_runs

DIMS = 1 << 16
UNKNOWN = "und"
#: Training rows of a language that weights are fitted on.
SAMPLE_PER_LANGUAGE = 600
MAX_LANGUAGES = 1_000


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def features(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[bool]]:
    """Hashed n-grams and their counts for each text, and whether it has a letter."""
    letters, out, has = _letters(), [], []
    for text in texts:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters[codes]
        has.append(bool(is_letter.any()))
        if not has[-1]:
            out.append((np.zeros(0, np.int64), np.zeros(0)))
            continue
        codes = np.where(is_letter, codes, np.uint32(32))
        keep = np.ones(len(codes), bool)
        keep[1:] = is_letter[1:] | is_letter[:-1]
        c = np.concatenate([[np.uint32(32)], codes[keep], [np.uint32(32)]]) * np.uint32(2654435761)
        two = (c[:-1] ^ (c[1:] >> np.uint32(7))) * np.uint32(2246822519)
        three = (two[:-1] ^ (c[2:] >> np.uint32(11))) * np.uint32(3266489917)
        grams = np.concatenate([c, two + np.uint32(97), three + np.uint32(193)])
        grams ^= grams >> np.uint32(15)
        counts = np.bincount(((grams * np.uint32(668265263)) >> np.uint32(16)).astype(np.int64), minlength=DIMS)
        index = np.flatnonzero(counts)
        out.append((index, counts[index].astype(float)))
    return out, has


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def vector(self, index: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[index]
        return x / max(1e-12, float(np.sqrt(x @ x)))

    def probabilities(self, index: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = self.vector(index, counts) @ self.weights[index] / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many rows each feature occurs, counted in every task and summed; at most DIMS sums reach the driver."""

    small_batches(rows.sparkSession)

    def count(batches):
        total, n = np.zeros(DIMS + 1, np.int64), 0
        for batch in batches:
            for _, texts in text_runs(batch):
                for index, _ in features(texts)[0]:
                    total[index] += 1
                    n += 1
        total[DIMS] = n
        index = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(total[index])], names=["feature", "n"])

    sums = rows.select("text").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMS + 1, np.int64)
    for r in sums:
        out[r.feature] = r.n
    return out[:DIMS], int(out[DIMS])


def fit_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, passes: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> np.ndarray:
    """Follow-the-regularised-leader with elastic net; ``rows`` are (class, feature indices, values)."""
    z, n = np.zeros((DIMS, classes)), np.zeros((DIMS, classes))
    rng = np.random.default_rng(11)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - l1, 0)
        return -shrunk / ((beta + np.sqrt(ni)) / alpha + l2)

    for _ in range(passes):
        for k in rng.permutation(len(rows)).tolist():
            y, index, x = rows[k]
            zi, ni = z[index], n[index]
            w = weights(zi, ni)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            g2 = ni + g * g
            z[index] = zi + g - (np.sqrt(g2) - np.sqrt(ni)) / alpha * w
            n[index] = g2
    return weights(z, n)


def fit_temperature(scores: np.ndarray, classes: np.ndarray) -> float:
    """The temperature of the softmax under which the given classes are likeliest.

    One class in n + 2 counts as wrong, so that n classes that are all right do not ask for certainty.
    """
    if not len(scores):
        return 1.0
    wrong = 1.0 / (len(scores) + 2)

    def loss(t: float) -> float:
        s = scores / t
        top = s.max(1, keepdims=True)
        log_p = s - top - np.log(np.exp(s - top).sum(1, keepdims=True))
        right = log_p[np.arange(len(s)), classes]
        others = (log_p.sum(1) - right) / max(1, scores.shape[1] - 1)
        return -float(((1 - wrong) * right + wrong * others).mean())

    return float(min(np.exp(np.linspace(np.log(0.01), np.log(20), 300)), key=loss))


def train(rows: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """A model of ``rows`` (doc_id, text, lang); null languages and texts do not count."""
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return None
    languages = sorted(sizes)
    frequency, total = document_frequencies(rows)
    idf = np.log((1 + total) / (1 + frequency)) + 1
    # a share of each language by hash, at most about the bound; the limit holds it where hashes are uneven
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, int(1e6 * min(1.0, sample_per_language / sizes[lang])))])
    sample = rows.where(place < share[F.col("lang")]).select("doc_id", "lang", "text")

    def vectors(part, texts):
        found, _ = features(texts)
        return [part.column("doc_id"), part.column("lang"), [i.astype(np.int32) for i, _ in found], [c.astype(np.float32) for _, c in found]]

    taken = map_texts(sample, vectors, "doc_id long, lang string, index array<int>, counts array<float>")
    kept = taken.limit(2 * sample_per_language * len(languages)).toPandas().sort_values(["doc_id", "lang"], na_position="first")
    model = Model(languages, idf, np.zeros((DIMS, len(languages))), 1.0)
    data = [(languages.index(lang), i := np.asarray(index, np.int32), model.vector(i, np.asarray(c, float)).astype(np.float32)) for lang, index, c in zip(kept["lang"], kept["index"], kept["counts"]) if len(index)]
    order = np.random.default_rng(5).permutation(len(data))
    fifth = len(data) // 5
    held, used = [data[k] for k in order[:fifth]], [data[k] for k in order[fifth:]]
    model.weights = fit_ftrl(used, len(languages))
    if held:
        model.temperature = fit_temperature(np.array([x @ model.weights[i] for _, i, x in held]), np.array([y for y, _, _ in held]))
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` (all columns but ``text``) with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    rows = docs.select(*rest, "text")

    def work(part, texts):
        model, langs, scores = shared.value, [], []
        found, has = features(texts)
        for (index, counts), any_letter in zip(found, has):
            if model is None or not any_letter:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            p = model.probabilities(index, counts)
            best = int(p.argmax())
            langs.append(model.languages[best])
            scores.append(float(p[best]))
        return [*[part.column(i) for i in range(len(rest))], langs, scores]

    schema = "".join(f"`{c}` {t}, " for c, t in rows.select(*rest).dtypes)
    return map_texts(rows, work, schema + "lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """Rows that training must not see: the CRC-32 of the id as text is divisible by five; rows without an id are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """(doc_id, text_key, held_out, lang_pred, score) of every row, by a model trained on the rows that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", held_out().alias("held_out"))
    model = train(rows.where("NOT held_out"), sample_per_language)
    keyed = rows.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "held_out", "text")
    return predict(keyed, model)


#: Documents whose best language is less likely than this are rejected by ``known_language``.
LEAST_SCORE = 0.3


def known_language(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without those that have no letters or no likely language; columns stay as they are.

    Where there is nothing to learn from (no row with a language), every text with a letter stays. The text is read once more by the model inside the same task, so nothing is joined or shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", held_out().alias("held_out"))
    model = train(rows.where("NOT held_out"))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    names = docs.columns
    kept = predict(docs.withColumns({f"_{i}": F.col(c) for i, c in enumerate(names)}).select(*[f"_{i}" for i in range(len(names))], "text"), model)
    kept = kept.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score))
    return kept.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)])
