"""Toxicity scores through noisy-channel deobfuscation.

Writers hide words: digits and signs for letters, separators between letters, repeated letters. Every token that is not
plain letters spans a lattice: each sign may stand for one of a few letters, for nothing, or for itself, each repeated
letter may be dropped; tokens over LONGEST characters are searched in overlapping windows. A Viterbi search finds the path that a character trigram language model (counted over the whole
corpus) and the channel's costs make likeliest; runs of single letters are joined and go the same way. The restored words
are scored: whole words and word beginnings that mark toxic training rows carry weights (log ratios of document
frequencies), and a logistic model of a document's strongest weight, their number and their share gives the score.

Labels are used of training rows only, in two halves (by hash) of a bounded sample (``sample_rows``): the logistic model is
fitted on one half with weights from the other, then all rows give the weights. Features of toxic rows are counted first,
so that the other rows count only what can matter. The language model has ALPHABET^3 counts at most, the features are limited
by the share of toxic rows that must hold one; both are broadcast. Texts are never shuffled.

Null texts count as empty and score like a text without any marked word; rows with a null id are not held out; repeated
rows score alike; without any labelled row every score is 0. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import map_texts, small_batches, text_runs
from ledgerlight.session import materialise

ALPHABET = 64
#: Letters that a sign is used for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "*": "aeiou"}
#: Costs of the channel, in natural logarithms.
COST_SIGN, COST_DROP_SIGN, COST_DROP_REPEAT, COST_KEEP_REPEAT = 1.0, 2.0, 0.3, 0.5
SEPARATORS = set(".-_ ~,'`·*")
LONGEST = 40
#: Labelled rows that the model is fitted on; word features need this many and this share of the toxic ones.
SAMPLE_ROWS = 40_000
LEAST_DOCS, LEAST_SHARE = 3, 0.002
MAX_FEATURES = 400_000
THRESHOLD = 0.3
MEMORY = 800_000
SINGLE_RUN = re.compile(b"[\x01\x02]{4,}")


def letter(c: str) -> int:
    """Class of a character for the language model: 0 for the edge, 1-26 for a-z, others share the rest."""
    k = ord(c) - 96
    return k if 1 <= k <= 26 else 27 + ord(c) % (ALPHABET - 27)


def trigram_counts(texts: list[str]) -> np.ndarray:
    """How often each letter class follows two others; a word is a stretch of letters, its edges count as class 0."""
    codes = np.frombuffer(" ".join(texts).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    k = np.concatenate([[0], _classes()[codes], [0]])
    before = np.where(k[:-1] == 0, 0, np.concatenate([[0], k[:-2]]))
    return np.bincount(((before * ALPHABET + k[:-1]) * ALPHABET + k[1:])[(k[:-1] > 0) | (k[1:] > 0)], minlength=ALPHABET**3)


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point, 0 for all that are no letters."""
    return np.fromiter((letter(c) if (c := chr(i)).isalpha() else 0 for i in range(0x110000)), np.int64, 0x110000)


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities of a character after two others, from all plain words of all texts.

    Counted in every task and summed by Spark; at most ALPHABET^3 sums reach the driver.
    """

    small_batches(docs.sparkSession)

    def count(batches):
        total = np.zeros(ALPHABET**3, np.int64)
        for batch in batches:
            for _, texts in text_runs(batch):
                total += trigram_counts(texts)
        index = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(total[index])], names=["gram", "n"])

    sums = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full(ALPHABET**3, 0.05)
    counts[sums["gram"].to_numpy(np.int64)] += sums["n"].to_numpy(float)
    table = counts.reshape(ALPHABET**2, ALPHABET)
    return np.log(table / table.sum(1, keepdims=True)).ravel()


def restored(token: str, model: list[float]) -> str:
    """The likeliest plain word behind a token: Viterbi search over (last two characters, place) of its lattice."""
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    before = ""
    for c in token:
        options: list[tuple[float, str]] = []
        if c.isalpha():
            options = [(COST_DROP_REPEAT, ""), (COST_KEEP_REPEAT, c)] if c == before else [(0.0, c)]
        else:
            options = [(COST_SIGN, x) for x in SIGNS.get(c, "")]
            options.append((0.1 if c in SEPARATORS else COST_DROP_SIGN, ""))
        before = c
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, text) in states.items():
            for extra, x in options:
                if x:
                    k = letter(x)
                    to, total = (b, k), cost + extra - model[(a * ALPHABET + b) * ALPHABET + k]
                else:
                    to, total = (a, b), cost + extra
                if to not in after or total < after[to][0]:
                    after[to] = (total, text + x)
        states = after
    return min((cost - model[(a * ALPHABET + b) * ALPHABET], text) for (a, b), (cost, text) in states.items())[1]


EDGES = ".,;:!?\"'()[]{}<>*#%&$|~`«»¡¿…-_/\\=+"
REPEATED = re.compile(r"(.)\1")
#: Longer repetitions are cut to three before the search, which can still keep two of them.
MANY = re.compile(r"(.)\1{3,}")
#: A sign that is part of the word although it stands at its edge.
_SIGN = "[" + re.escape("".join(SIGNS)) + "]"
EDGE_SIGN = re.compile(rf"{_SIGN}(?=[^\W\d_])|(?<=[^\W\d_]){_SIGN}")


def forms(token: str, model: list[float]) -> tuple[str, ...]:
    """The plain words that a lower-case token may stand for; most are their own only form."""
    core = token.strip(EDGES)
    plain = core.isalpha()
    if plain and not REPEATED.search(core) and not EDGE_SIGN.search(token):
        return (core,) if plain and len(core) > 1 else ()
    if not any(map(str.isalpha, token)):
        return ()
    found = [core] if plain else []
    for t in dict.fromkeys(MANY.sub(r"\1\1\1", t) for t in (core, token)):
        # long tokens in windows that overlap by half
        found += [restored(t[k : k + LONGEST], model) for k in range(0, max(1, len(t) - LONGEST // 2), LONGEST // 2)]
    return tuple(dict.fromkeys(x for x in found if len(x) > 1))


class Reader(dict):
    """What each token is worth: ``make`` of its forms, worked out once and remembered."""

    def __init__(self, model: np.ndarray, make):
        self.model, self.make = model.tolist(), make

    def __missing__(self, token: str):
        found = self[token] = self.make(forms(token, self.model))
        return found

    def read(self, text: str) -> list:
        """The worth of every token, and of runs of single letters joined to one token."""
        tokens = text.lower().split()
        if len(self) > MEMORY:
            self.clear()
        out = list(map(self.__getitem__, tokens))
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)).clip(0, 3).astype(np.uint8).tobytes()
        for m in SINGLE_RUN.finditer(sizes):
            run = ""
            for t in [*tokens[m.start() : m.end()], "  "]:
                one = t.strip(EDGES) or t
                if len(one) == 1:
                    run += one
                    continue
                if len(run) > 3:
                    out += [self[run[k : k + LONGEST]] for k in range(0, len(run), LONGEST // 2)]
                run = ""
        return out


def keys(words: tuple[str, ...]) -> tuple[int, ...]:
    """Hashes of words and of their beginnings of three to six letters."""
    of = xxhash.xxh3_64_intdigest
    return tuple({k for w in words for k in (of("=" + w) >> 1, *[of(w[:n]) >> 1 for n in range(3, min(6, len(w)) + 1)])})


@dataclass
class Model:
    grams: np.ndarray
    weights: dict[int, float] = field(default_factory=dict)
    logistic: np.ndarray | None = None
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None


def weigher(weights: dict[int, float]):
    """The largest weight among the keys of a token's forms."""
    return lambda words: max((weights.get(k, 0.0) for k in keys(words)), default=0.0)


def evidence(reader: Reader, text: str) -> list[float]:
    """A document's strongest weight, sum of its three strongest, number and share of marked tokens."""
    found = reader.read(text)
    marks = sorted(filter(None, found), reverse=True)
    return [marks[0] if marks else 0.0, sum(marks[:3]), float(np.log1p(len(marks))), len(marks) / max(1, len(found))]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """``docs`` (doc_id, text) are all rows; ``labels`` (doc_id, toxic) only those that may be learnt from."""
    context = docs.sparkSession.sparkContext
    model = Model(language_model(docs))
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = labels.count()
    if not rows:
        return model
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000))
    sample = materialise(labels.where(place < int(1e6 * min(1.0, sample_rows / rows))).limit(2 * sample_rows))
    if not 0 < sample.where("toxic = 1").count() < sample.count():
        return model
    # 2 * sample_rows rows at most
    known = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))).alias("half"), "text")
    grams = context.broadcast(model.grams)

    def counted(wanted):
        def count(batches):
            only = wanted.value if wanted else None
            reader = Reader(grams.value, keys if only is None else lambda words: tuple(k for k in keys(words) if k in only))
            found, n = (Counter(), Counter()), [0, 0]
            for batch in batches:
                for part, texts in text_runs(batch):
                    for t, half in zip(texts, part.column("half").to_pylist()):
                        found[half].update({k for own in set(reader.read(t)) for k in own})
                        n[half] += 1
                    if len(found[0]) + len(found[1]) > 500_000:
                        yield from map(_counts, (0, 1), found)
                        found = (Counter(), Counter())
            for half in (0, 1):
                found[half][-1] = n[half]
            yield from map(_counts, (0, 1), found)

        return count

    def totals(df: DataFrame, wanted=None) -> DataFrame:
        """(key, first, n): rows with a feature, in the first half and in all; key -1 counts the rows."""
        sums = df.select("half", "text").mapInArrow(counted(wanted), "half int, key long, n long")
        return sums.groupBy("key").agg(F.sum(F.when(F.col("half") == 0, F.col("n")).otherwise(0)).alias("first"), F.sum("n").alias("n"))

    toxic = materialise(totals(known.where("toxic = 1")))
    n_toxic = toxic.where("key = -1").first()
    if n_toxic is None:
        return model
    often = toxic.where((F.col("key") >= 0) & (F.col("n") >= max(LEAST_DOCS, LEAST_SHARE * n_toxic["n"])))
    often = {r["key"]: r for r in often.orderBy(F.desc("n"), "key").limit(MAX_FEATURES).collect()}
    clean = {r["key"]: r for r in totals(known.where("toxic = 0"), context.broadcast(set(often))).collect()}
    if -1 not in clean:
        return model
    n_clean = clean.pop(-1)

    def weights(part: str) -> dict[int, float]:
        """Log ratios of document frequencies, where they are far beyond what chance gives among so many features."""
        out = {}
        for key, r in often.items():
            rate = r[part] / max(1, n_toxic[part])
            base = ((clean[key][part] if key in clean else 0) + 0.5) / (n_clean[part] + 1)
            if r[part] >= LEAST_DOCS and rate > 5 * base and r[part] * np.log(rate / base) > 12:
                out[int(key)] = float(np.log(rate / base))
        return out

    model.weights = weights("first")
    shared = context.broadcast(model)

    def vectors(part, texts, state):
        return [part.column("doc_id"), part.column("toxic").cast(pa.int64()), [evidence(state, t) for t in texts]]

    def setup():
        return Reader(shared.value.grams, weigher(shared.value.weights))

    second = known.where("half = 1").select("doc_id", "toxic", "text")
    data = map_texts(second, vectors, "doc_id long, toxic long, x array<double>", setup).toPandas().sort_values(["doc_id", "toxic"])
    if len(data) and 0 < (data["toxic"] == 1).sum() < len(data):
        x, y = np.array(data["x"].tolist()), (data["toxic"] == 1).to_numpy(float)
    else:
        return model
    model.centre, model.scale = x.mean(0), x.std(0) + 1e-9
    model.logistic = _fit_logistic((x - model.centre) / model.scale, y)
    model.weights = weights("n")  # the logistic model is fitted on rows that its weights had not seen; now they see all
    return model


def _counts(half: int, found: Counter) -> pa.RecordBatch:
    arrays = [pa.array([half] * len(found), pa.int32()), pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["half", "key", "n"])


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps for a ridge logistic regression; the last weight is the constant."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (all columns but ``text``) with ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in ("text", "score")]
    rows = docs.select(*rest, "text")

    def setup():
        m = shared.value
        return m, Reader(m.grams, weigher(m.weights))

    def work(part, texts, state):
        m, reader = state
        if m.logistic is None:
            out = [0.0] * len(texts)
        else:
            x = np.array([evidence(reader, t) for t in texts]).reshape(-1, 4)
            out = 1 / (1 + np.exp(-np.clip(np.c_[(x - m.centre) / m.scale, np.ones(len(x))] @ m.logistic, -30, 30)))
        return [*[part.column(i) for i in range(len(rest))], out]

    schema = "".join(f"`{c}` {t}, " for c, t in rows.select(*rest).dtypes)
    return map_texts(rows, work, schema + "score double", setup)


def held_out():
    """Rows whose labels must not be learnt: the CRC-32 of the id as text leaves 2 when divided by four."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(rows, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(~held_out()), sample_rows)
    found = score(rows.select("doc_id", held_out().alias("held_out"), "text"), model)
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
